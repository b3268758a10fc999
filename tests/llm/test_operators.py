"""Corpus operators against brute force, round trips and held-out accuracy, and on odd rows."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomgraph.llm import audio, chat, common, forest, katz, linededup, mixing, neardup, packing, quality, registry, tokencount
from tests.oracle import assert_same

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASHES = (
    "n long, rank int, size long, cid long, label string, key long, u double, block int, start long, digest string, of long, quality int, "
    "target double, whole long, part double, rest string, source_no int, s_no int, of_source string, number long, first long, c_length int, "
    "n_lines long, n_dropped long, quality_score double, t long, id long, row string, chance double, extra string, class int, weight int, _hit boolean"
)
ODD = [(1, None), (2, ""), (3, " \t\n "), (4, "a b c"), (4, "a b c"), (None, "no id here at all today"), (5, "long " * 60000 + "end"), (6, "Ünïcödé 日本語 é \U0001f600 x"), (7, "One two three four five six seven"), (8, "one TWO three four five six seven"), (9, "line one of this text\nline one of this text\n\nx")]


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None if i == 1 else "en", None if i in (1, 4) else "s", len(t or "")) for i, t in ODD]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for column in CLASHES.split(", "):
        name, kind = column.split(" ")
        docs = docs.withColumn(name, F.lit(1).cast(kind))
    return docs


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    assert_same(spark, registry.queries()[name], registry.oracle_sql()[name], SF)


@pytest.mark.parametrize("rows", ["odd", "empty"])
def test_odd_rows(spark, odd, rows):
    table = odd if rows == "odd" else odd.where("false")
    n = len(ODD) if rows == "odd" else 0
    near = neardup.near_duplicates(table, 85).collect()
    assert len(near) == n
    lines = linededup.dedup_lines(table).collect()
    assert len(lines) == n
    mixed = mixing.mix(table).collect()
    assert len(mixed) == n and all(0 <= r.taken <= 2 * r.size for r in mixed)
    pieces = packing.pack(common.settled(packing.pieces(table))).collect()
    assert len({r.doc_id for r in pieces}) == len({r.doc_id for r in mixed}) or not n
    scores = katz.score(table, F.lit(True)).collect()
    assert len(scores) == n and all(math.isfinite(r.score) for r in scores)
    tokens = tokencount.documents(common.settled(tokencount.scan(tokencount.flat_blocks(table)))).collect()
    assert len(tokens) == n
    model = quality.Model(np.zeros((0, 1)), np.zeros(0))
    assert quality.scored(table, model).count() == n
    assert quality.fit(table, table.select("doc_id", "quality")).weights is None
    members, pairs = audio.matches(common.settled(audio.fingerprints(table.withColumn("pcm", F.encode("text", "UTF-8")))), F.lit(True))
    assert members.count() == n and pairs.count() >= 0
    if n:
        by = defaultdict(list)
        for r in near:
            by[r.doc_id].append(r)
        assert by[1][0].n_shingles == by[2][0].n_shingles == by[3][0].n_shingles == 0 and by[1][0].kept
        assert by[8][0].component_id == 7 and not by[8][0].kept and by[7][0].kept
        assert {r.n_shingles for r in by[4]} == {1}
        text = {r.doc_id: r.text for r in lines}
        assert text[1] is None and text[2] == "" and text[9] == "line one of this text\n\nx"
        assert sorted(odd.columns) == sorted(lines[0].asDict())
        long = [r for r in pieces if r.doc_id == 5]
        assert sum(r.length for r in long) > 60000 and [r.length for r in sorted(long, key=lambda r: r.piece)][1:] == [2048] * (len(long) - 1)
        assert [r.length for r in pieces if r.doc_id == 1] == [1]
        assert {r.n_tokens for r in scores if r.doc_id in (1, 2, 3)} == {1}
        assert {r.n_tokens for r in tokens if r.doc_id in (1, 2)} == {0}


def brute_components(rows, percent):
    sets = {}
    for i, t in rows:
        w = WORD.findall(lower(t))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))) if w else frozenset()
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def variants(seed, n, sizes):
    """Families of texts that differ by few words: some links short of the threshold, some just over it."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    rows = []
    while len(rows) < n:
        base = [word() for _ in range(rng.choice(sizes))]
        for _ in range(rng.choice([1, 2, 30])):
            copy = base[:]
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = word()
            rows.append((len(rows), " ".join(copy)))
    return rows


@pytest.mark.parametrize(("percent", "sizes", "block"), [(85, (3, 6, 30, 60, 200), 2000), (80, (40, 300, 700), 8)])
def test_near_duplicates(spark, percent, sizes, block):
    rows = variants(percent, 350, sizes)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent, block=block).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, percent)


def test_jaccard_estimate():
    rng = np.random.default_rng(0)
    for n, kind in ((200, 0), (3000, 1)):
        both = rng.integers(0, 2**64, n, dtype=np.uint64)
        a, b = (np.sort(np.r_[both, rng.integers(0, 2**64, n // 4, dtype=np.uint64)]) for _ in range(2))
        make = (lambda h: neardup.by_functions(h, np.array([0]))) if kind == 0 else (lambda h: neardup.by_buckets(h, np.zeros(len(h), np.int64), np.array([0])))
        got = neardup.estimate(make(a), make(b), np.array([len(a)]), np.array([len(b)]), kind)[0]
        assert abs(got - n / (n * 1.5)) < 0.2


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a == b or (a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :])


def test_line_dedup(spark):
    rng = random.Random(1)
    base = ["".join(rng.choice("abcé dXY\t") for _ in range(rng.randint(10, 40))) for _ in range(60)]

    def edit(s):
        p, k, c = rng.randrange(len(s)), rng.random(), rng.choice("abcéz")
        return s[:p] + s[p + 1 :] if k < 0.3 else s[:p] + c + s[p + (k < 0.6) :]

    rows = []
    for d in range(150):
        lines = []
        for _ in range(rng.randint(0, 8)):
            line = rng.choice(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                line = edit(line)
            lines.append(line)
        rows.append((d, "\n".join(lines)))
    want, seen = {}, []
    for d, t in rows:
        kept = []
        for line in t.split("\n"):
            x = re.sub(r"[ \t]+", " ", lower(line)).strip(" ")
            if len(x) < 16 or not any(within_one(x, y) for y in seen):
                kept.append(line)
            if len(x) >= 16:
                seen.append(x)
        want[d] = "\n".join(kept)
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), exact_chars=16).collect()
    assert {r.doc_id: r.text for r in got} == want


def test_line_dedup_drops_short_repeats(spark):
    """The registered query and the pipeline's stage: exact repeats go however short; one edit counts from 16 characters."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want, seen, short = {}, set(), 0
    for r in docs.select("doc_id", "text").orderBy("doc_id").collect():
        drops = 0
        for line in (r.text or "").split("\n"):
            x = re.sub(r"[\t-\r ]+", " ", lower(line)).strip(" ")
            drops += x in seen
            short += x in seen and len(x) < 16
            seen |= {x} - {""}
        want[r.doc_id] = drops
    assert short > 300
    got = {r.doc_id: r for r in linededup.op5_lines(spark, sf).collect()}
    assert got.keys() == want.keys() and all(got[i].n_dropped >= n for i, n in want.items())
    texts = {r.doc_id: r.text for r in corpus_pipeline.drop_lines(spark, docs, sf).collect()}
    short = Counter(x for t in texts.values() for line in (t or "").split("\n") if 0 < len(x := re.sub(r"[\t-\r ]+", " ", lower(line)).strip(" ")) < 16)
    assert set(short.values()) == {1}
    few = spark.createDataFrame([(1, "Ab\nabc\n\nab "), (2, "\nabd\nABC\n ")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in linededup.dedup_lines(few).collect()} == {1: "Ab\nabc\n", 2: "\nabd\n "}


@pytest.mark.parametrize("exact", [1, 16])
def test_line_dedup_by_brute_force_with_both_floors(spark, exact):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcé dXY") for _ in range(rng.choice([1, 2, 5, 14, 15, 16, 17, 30]))) for _ in range(50)]
    edit = lambda s: s[: (p := rng.randrange(len(s)))] + rng.choice(["", "b", "éz"]) + s[p + 1 :]
    rows = [(d, "\n".join(edit(x) if rng.random() < 0.4 else x for x in rng.choices(base, k=rng.randint(0, 8)))) for d in range(100)]
    want, seen = {}, []
    for d, t in rows:
        kept = []
        for line in t.split("\n"):
            x = re.sub(r" +", " ", lower(line)).strip(" ")
            again = len(x) >= exact and bool(x) and x in seen or len(x) >= 16 and any(len(y) >= 16 and within_one(x, y) for y in seen)
            kept += [] if again else [line]
            seen.append(x)
        want[d] = "\n".join(kept)
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), exact_chars=exact).collect()
    assert {r.doc_id: r.text for r in got} == want


def test_mixing_reaches_targets(spark, docs):
    rows = mixing.mix(docs).toPandas()
    again = mixing.mix(docs.repartition(5)).toPandas()
    assert rows.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()
    sizes = docs.select("doc_id", "source").toPandas().merge(rows, on="doc_id")
    for _, g in sizes.groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= g["size"].max()
    per = sizes.groupby("source").first()
    assert per.target.sum() == pytest.approx(1.5 * rows["size"].sum())


def test_packing(spark, docs):
    rows = packing.op9_packing(spark, SF).toPandas().sort_values(["sequence_id", "offset"])
    end = rows.offset + rows.length
    assert end.max() <= 2048 and (rows.groupby("sequence_id").offset.min() == 0).all()
    following = rows.groupby("sequence_id").offset.shift(-1)
    assert ((following == end) | following.isna()).all()
    assert rows.sequence_id.nunique() <= math.ceil(rows.length.sum() / 2048) + 1
    from tokenizers import Tokenizer
    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    for r in docs.select("doc_id", "text").collect():
        ids = np.array([*t.encode(r.text, add_special_tokens=False).ids, 0], "<u4")
        own = rows[rows.doc_id == r.doc_id].sort_values("piece")
        assert own.length.sum() == len(ids)
        assert all(zlib.crc32(ids[p.start : p.start + p.length]) == p.ids_crc32 for p in own.itertuples())


def test_encoder_on_special_strings():
    from tokenizers import Tokenizer
    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    for text in ("<|endoftext|> x", "a  b \r\n\t c", "日本語😀é", "it's we'll 12 3,4", "x" * 500, " \n \n"):
        assert packing.encoder().encode_ordinary(text) == t.encode(text, add_special_tokens=False).ids


def test_bin_slack_is_exact():
    rng = random.Random(3)
    for _ in range(20):
        counts = Counter(rng.randint(1, 40) for _ in range(60))
        plan = packing.plan(dict(counts), 50)
        used = Counter()
        for times, taken in plan:
            assert sum(n * k for n, k in taken.items()) <= 50
            for n, k in taken.items():
                used[n] += times * k
        assert used == counts
    best = packing.fullest(Counter({30: 1, 11: 1, 9: 2, 5: 1}), [30, 11, 9, 5], 30, 50)
    assert sum(n * k for n, k in best.items()) == 50


def test_katz_normalises_and_matches_brute_force(spark, docs, monkeypatch):
    monkeypatch.setattr(katz, "BLOCK_TOKENS", 5000)  # many blocks
    rows = {r.doc_id: r.text for r in docs.collect()}
    texts = {i: WORD.findall(lower(t)) + [None] for i, t in rows.items()}
    trains = {i for i in rows if zlib.crc32(str(i).encode()) % 10 != 0}
    c = Counter(w for i in trains for w in texts[i])
    b = Counter(p for i in trains for p in zip([None, *texts[i][:-1]], texts[i]))
    total = sum(c.values())
    counts = lambda x: np.array([0] + [sum(v == r for v in x.values()) for r in range(1, 7)], float)
    d1, d2 = katz.Discounts.fitted(counts(c)).by_count, katz.Discounts.fitted(counts(b)).by_count
    disc = lambda d, n: d[n] if n <= 5 else 1.0
    p = {w: disc(d1, n) * n / total for w, n in c.items()}
    unknown = 1 - sum(p.values())
    after = defaultdict(dict)
    for (h, w), n in b.items():
        after[h][w] = n
    size, alpha = {}, {}
    for h, ws in after.items():
        kept = sum(disc(d2, n) * n for n in ws.values())
        size[h] = c[h] + (c[h] - kept <= 1e-9 * c[h])
        alpha[h] = (1 - kept / size[h]) / (1 - sum(p[w] for w in ws))
    chance = lambda w, h: disc(d2, b[h, w]) * b[h, w] / size[h] if b[h, w] else alpha.get(h, 1) * p.get(w, unknown)
    for h in list(after)[:3]:
        assert sum(chance(w, h) for w in c) + alpha[h] * unknown == pytest.approx(1)
    got = {r.doc_id: r for r in katz.op6_katz(spark, SF).collect()}
    for i, t in texts.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i not in trains, len(t), sum(w in c for w in t), total)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (total + 0.1 * (len(c) + 1))) for w in t))
        assert r.score == pytest.approx(sum(math.log10(chance(w, h)) for h, w in zip([None, *t[:-1]], t)))
    held = [got[i] for i in rows if i not in trains]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def brute_katz(trained, order):
    """(P of a word after a history, log10 probability of a text, words): plain dictionaries; texts are words, then None."""
    disc = lambda d, n: d[n] if n <= 5 else 1.0
    histories = lambda t, k: (tuple(([None] * k + t)[i : i + k]) for i in range(len(t)))
    after = [defaultdict(Counter) for _ in range(order)]
    for t in trained:
        for k in range(order):
            for h, w in zip(histories(t, k), t):
                after[k][h][w] += 1
    fitted = []
    for k in range(order):
        n = Counter(c for ws in after[k].values() for c in ws.values())
        fitted.append(katz.Discounts.fitted(np.array([0] + [n[r] for r in range(1, 7)], float)).by_count)
    total = sum(after[0][()].values())
    left = 1 - sum(disc(fitted[0], n) * n for n in after[0][()].values()) / total
    memo = {}

    def chance(w, h):
        if not h:
            n = after[0][()][w]
            return disc(fitted[0], n) * n / total if n else left
        ws, d = after[len(h)].get(h), fitted[len(h)]
        if not ws:
            return chance(w, h[1:])
        if h not in memo:
            size, kept = sum(ws.values()), sum(disc(d, n) * n for n in ws.values())
            size += size - kept <= 1e-9 * size
            memo[h] = size, (1 - kept / size) / (1 - sum(chance(x, h[1:]) for x in ws))
        size, alpha = memo[h]
        return disc(d, ws[w]) * ws[w] / size if w in ws else alpha * chance(w, h[1:])

    return chance, lambda t: sum(math.log10(chance(w, h)) for h, w in zip(histories(t, order - 1), t)), list(after[0][()])


@pytest.mark.parametrize("order", [1, 3, 4])
def test_katz_of_any_order_matches_brute_force(spark, docs, monkeypatch, order):
    """Blocks that share histories, histories of one block, of held-out texts alone, and very frequent ones."""
    monkeypatch.setattr(katz, "BLOCK_TOKENS", 5000)
    rng = np.random.default_rng(order)
    rows = [(r.doc_id, r.text) for r in docs.limit(150).collect()]
    rows += [(10**6 + i, "so it is " + " ".join(f"w{x}" for x in rng.zipf(1.6, 1 + i % 6) % 40)) for i in range(2500)]
    rows += [(2 * 10**6 + i, t) for i, t in enumerate([None, "", "  ", "so it", "it is so it is", "never seen these words", "so it is never seen"])]
    texts = {i: WORD.findall(lower(t)) + [None] for i, t in rows}
    trains = {i for i in texts if zlib.crc32(str(i).encode()) % 10 != 0}
    chance, brute, words = brute_katz([texts[i] for i in sorted(trains)], order)
    for h in [(None, None, None), ("so", "it", "is"), ("x", "so", "it")]:
        assert sum(chance(w, h[4 - order :]) for w in [*words, "not trained"]) == pytest.approx(1)
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "doc_id")
    got = katz.score(table, F.crc32(F.col("doc_id").cast("string")) % 10 != 0, order=order).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.score == pytest.approx(brute(texts[r.doc_id]), rel=1e-9), r.doc_id


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    rows = quality.op8_quality(spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    held = rows[rows.held_out]
    assert (held.predicted == held.quality).mean() > 0.95 and rows.score.between(0, 1).all()


def test_quality_threshold_with_a_cap_below_the_good_labels(spark):
    """The threshold rejects the share of bad labels of all, also where the fit reads a part of the good ones."""
    rng = np.random.default_rng(3)
    y = (rng.random(20000) > 0.15).astype(int)
    x = rng.normal(0, 1, (20000, 3)) + y[:, None]
    some = np.concatenate([np.flatnonzero(y == v)[:2000] for v in (0, 1)])
    model = quality.Model(x[some], y[some], totals=((y == 0).sum(), (y == 1).sum()))
    assert abs((model.score(x) < quality.THRESHOLD).mean() - (y == 0).mean()) < 0.02
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(30)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 5)) for i in range(40)], "doc_id long, quality int")
    _, got, totals = quality.labelled(docs, labels, 12)
    assert sorted(got) == [0] * 5 + [1] * 6 and totals == (5, 25)


def test_forest_recall(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas().sort_values("vec_id")
    v, ids = np.stack(rows.embedding).astype(float), rows.vec_id.to_numpy()
    hits = total = 0
    for q, g in forest.op1_forest(spark, sf).toPandas().groupby("query_id"):
        s = v @ v[ids == q][0]
        s[ids == q] = -9
        g = g.sort_values("rank")
        assert np.allclose(g.score, s[np.searchsorted(ids, g.vec_id)], atol=1e-12) and g["rank"].tolist() == list(range(1, 21))
        hits += len(set(ids[np.lexsort((ids, -s))[:20]]) & set(g.vec_id))
        total += 20
    assert hits / total >= 0.9


@pytest.mark.parametrize("near", [5, 15, 18, 30])
def test_forest_near_copies(spark, near):
    """A query among near copies gets k rows and finds those beyond its copies too."""
    rng = np.random.default_rng(near)
    v = rng.normal(0, 1, (2000, 64))
    v[:near] = v[0] / np.linalg.norm(v[0]) + rng.normal(0, 0.001, (near, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = [r.vec_id for r in forest.nearest(rows, F.col("vec_id") == 0).collect()]
    want = np.argsort(-(v[1:] @ v[0]))[:20] + 1
    assert len(got) == 20 and len(set(got) & set(want.tolist())) >= 18


def test_forest_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0, None]), (9, [3.0, 4.0]), (10, [1.0, 2.0, 3.0]), (20, [-1.0, 0.5]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1))
    got = [tuple(r) for r in forest.nearest(df, F.col("vec_id") % 10 == 0, k=2).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 9, 3.0), (0, 2, 1, 1.0), (20, 1, 0, -1.0), (20, 2, 1, -1.0)]
    assert forest.nearest(df.where("false"), F.lit(True)).count() == 0


def forest_figures(v, blocks, queries=100, k=20):
    """(recall, share of the rows scored, depths the queries ended at) of forests of blocks of v."""
    rng = np.random.default_rng(1)
    asked, dealt = rng.choice(len(v), queries, replace=False), rng.permutation(len(v))
    longest, found, depths, scored = np.linalg.norm(v, axis=1).max(), [set() for _ in asked], [], 0
    for b in range(blocks):
        rows = dealt[b::blocks]
        own = {r: j for j, r in enumerate(rows)}
        f = forest.Forest(v[rows], np.ones(len(rows), np.int64), 128, 7, longest)
        for i, at, scores, depth in f.search(v[asked], np.array([own.get(q, -1) for q in asked]), k, 0.9):
            assert len(set(at.tolist())) == len(at) and np.allclose(scores, v[rows[at]] @ v[asked[i]])
            found[i] |= set(rows[at].tolist())
            depths.append(depth)
        scored += f.scored.sum()
    scores = v[asked] @ v.T
    scores[np.arange(queries), asked] = -np.inf
    hits = sum(len(found[i] & set(np.argsort(-s)[:k].tolist())) for i, s in enumerate(scores))
    return hits / (queries * k), scored / (queries * len(v)), depths


def test_forest_descends_and_ascends():
    """Random directions and clusters, in one block and in several: recall holds, depths vary with what is near."""
    rng = np.random.default_rng(0)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    spread = unit(rng.normal(0, 1, (6000, 64)))
    centres = rng.normal(0, 1, (150, 64))
    noise = rng.choice([0.02, 0.1, 0.3], 150)  # clusters of three widths
    of = rng.integers(0, 150, 12000)
    clustered = unit(centres[of] + rng.normal(0, 1, (12000, 64)) * noise[of][:, None])
    shares = {}
    for name, v, blocks in (("spread", spread, 1), ("spread", spread, 3), ("clustered", clustered, 1), ("clustered", clustered, 2)):
        recall, share, depths = forest_figures(v, blocks)
        assert recall >= 0.9
        shares[name] = share
        if name == "spread":
            assert set(depths) <= set(range(5, 12)) and len(set(depths)) > 1 or blocks > 1
        else:
            assert len(set(depths)) >= 5 and max(depths) > 15
    assert shares["clustered"] < shares["spread"] / 4


def test_chat_trees_and_round_trip(spark):
    tricky = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>", "a\\e<|x|>\\", "", None, "<<SYS>> [\\INST]", "<|im_end|", "日本\n"]
    rows = [("t", "r", None, 0.0, "user", "root")] + [("t", f"a{i}", "r", float(i), "assi\nst<|im_end|>", t) for i, t in enumerate(tricky)]
    rows += [("t", "b", "a3", 9.0, "user", "deep"), ("t", "b", "a3", 9.0, "user", "deep"), ("o", "x", "gone", 1.0, None, "orphan"), ("c", "c1", "c2", 1.0, "u", "."), ("c", "c2", "c1", 1.0, "u", "."), ("c", "c3", "c1", 1.0, "u", ".")]
    df = spark.createDataFrame(rows, "tree string, node string, parent string, score double, role string, text string")
    made = chat.conversations(df, paths_per_tree=3)
    got = made.withColumn("back", chat.read_back(F.col("formatted"))).orderBy("tree", "rank").collect()
    assert [(r.tree, r.leaf, r["rank"]) for r in got] == [("o", "x", 1), ("t", "b", 1), ("t", "a7", 2), ("t", "a6", 3)]
    every = chat.conversations(df, learn=("user",)).withColumn("back", chat.read_back(F.col("formatted"))).withColumn("m", chat.masked(F.col("formatted"), F.col("loss"))).collect()
    by = {r.leaf: r for r in every}
    for i, t in enumerate(tricky):
        if i != 3:
            assert [(x.role, x.text) for x in by[f"a{i}"].back] == [("user", "root"), ("assi\nst<|im_end|>", t or "")]
            assert by[f"a{i}"].m == "root"
    assert by["b"].m == "rootdeep" and "c3" not in by
    assert chat.conversations(df.where("false")).count() == 0


def test_ranked_paths_match_brute_force(spark):
    """Trees of every depth, with long trunks that many leaves share, and ties."""
    rng = np.random.default_rng(12)
    up, score = {}, {}
    for t in range(20):
        for i in range(60):
            trunk = i < 20 and t % 2
            up[t, i] = None if i == 0 else (t, i - 1 if trunk else int(rng.integers(0, i)))
            score[t, i] = float(rng.integers(0, 3)) / 2
    name = lambda x: None if x is None else f"{x[0]}-{x[1]:02d}"
    rows = [(x[0], name(x), name(up[x]), None if score[x] == 0 else score[x], "user", name(x)) for x in up]

    def path(x):
        return [] if x is None else [*path(up[x]), x]

    want = {}
    for t in range(20):
        leaves = [x for x in up if x[0] == t and x not in set(up.values())]
        best = sorted(leaves, key=lambda x: (-sum(score[y] for y in path(x)), name(x)))[:4]
        want |= {(t, i): [name(y) for y in path(x)] for i, x in enumerate(best, 1)}
    df = spark.createDataFrame(rows, "tree long, node string, parent string, score double, role string, text string")
    got = chat.conversations(df, paths_per_tree=4).withColumn("back", chat.read_back(F.col("formatted"))).collect()
    assert {(r.tree, r["rank"]): [x.text for x in r.back] for r in got} == want
    assert {r.leaf for r in chat.conversations(df).collect()} == {name(x) for x in up if x not in set(up.values())}


def test_separator_scan(spark, docs, tmp_path):
    encode = packing.encoder().encode_ordinary
    want = {r.doc_id: len(encode(r.text)) for r in docs.collect()}
    for size in (64, 1000):
        scanned = common.settled(tokencount.scan(tokencount.flat_blocks(docs.repartition(3), block_tokens=size)))
        for run in (1, 7, 1024):
            got = tokencount.documents(scanned, run).collect()
            assert {r.doc_id: r.n_tokens for r in got} == want and len(got) == len(want)
    flat = np.array([9, 1, 2, 9, 9, 3, 3, 3, 3, 3], "<u2")
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.bin").write_bytes(flat.tobytes() + b"\x01")
    (tmp_path / "f" / "b.bin").write_bytes(b"")
    blocks = tokencount.read_files(spark, str(tmp_path / "f"), block_tokens=2)
    got = tokencount.documents(common.settled(tokencount.scan(blocks, end_id=9)), 2).orderBy("number").collect()
    assert [(r.start, r.n_tokens, r.closed) for r in got] == [(0, 0, True), (1, 2, True), (4, 0, True), (5, 5, False)]


def tune(rng, notes=20, long=600):
    return np.concatenate([np.sin(2 * np.pi * f * np.arange(long) / audio.RATE) for f in rng.choice([55, 82, 110, 131, 165, 220, 247], notes)])


def plain_prints(pcm):
    """The prints with every area summed directly."""
    c = audio.chroma(pcm)
    out = []
    for t in range(len(c) - audio.WIDTH + 1):
        value = 0
        for kind, y, h, w in audio.FILTERS:
            area = lambda t0, n, y0, m: sum(c[t + t0 + i, y0 + j] for i in range(n) for j in range(m))  # noqa: B023, E731
            if kind == 0:
                a, b = area(0, w // 2, y, h), area(w // 2, w - w // 2, y, h)
            elif kind == 1:
                a, b = area(0, w, y, h // 2), area(0, w, y + h // 2, h - h // 2)
            elif kind == 2:
                a = area(0, w // 2, y, h // 2) + area(w // 2, w - w // 2, y + h // 2, h - h // 2)
                b = area(w // 2, w - w // 2, y, h // 2) + area(0, w // 2, y + h // 2, h - h // 2)
            else:
                a, b = area(w // 4, w // 2, y, h), area(0, w // 4, y, h) + area(w // 4 + w // 2, w - w // 4 - w // 2, y, h)
            step = sum(math.log1p(max(a, 0)) - math.log1p(max(b, 0)) >= x for x in audio.THRESHOLDS)
            value = value << 2 | (0, 1, 3, 2)[step]
        out.append(value)
    return out


def plain_match(a, b, most_error=0.15, least_overlap=32):
    """(offset, votes, overlap, bit error) or None, by counting at every offset and trying every stretch."""
    found = []
    for offset in range(1 - len(a), len(b)):
        both = [(a[i], b[i + offset]) for i in range(len(a)) if 0 <= i + offset < len(b)]
        wrong = [bin(x ^ y).count("1") for x, y in both]
        found.append((-wrong.count(0), sum(wrong) / len(wrong), offset, wrong))
    votes, _, offset, wrong = min(found, key=lambda x: x[:3])
    if not votes:
        return None
    fits = [(i, j) for i in range(len(wrong)) for j in range(i + 1, len(wrong) + 1) if sum(wrong[i:j]) <= most_error * 32 * (j - i) + 1e-6]
    i, j = max(fits, key=lambda x: (x[1] - x[0], -x[0]))
    return (offset, -votes, j - i, round(sum(wrong[i:j]) / 32 / (j - i), 6)) if j - i >= min(least_overlap, len(a), len(b)) else None


def test_audio_by_brute_force(spark):
    rng = np.random.default_rng(2)
    pcm = lambda x: (128 + 50 * np.clip(x, -2, 2)).astype(np.uint8)
    song, other = tune(rng), tune(rng, 12)
    sounds = {
        0: song, 1: song, 2: np.r_[np.sin(np.arange(1280) * 1.1), song], 3: rng.normal(0, 1, 9000), 4: song + rng.normal(0, 0.1, len(song)),
        5: song + rng.normal(0, 0.2, len(song)), 6: song[16:], 7: song[32:], 8: song[4000:8000], 9: np.r_[other, song[3000:9000], tune(rng, 5)],
        10: np.zeros(5000), 11: np.zeros(9000), 12: other, 13: np.zeros(300), 14: np.zeros(200), 16: tune(rng, 30),
    }
    rows = [(i, bytearray(pcm(x).tobytes())) for i, x in sounds.items()] + [(15, None), (None, bytearray(pcm(song).tobytes()))]
    df = spark.createDataFrame(rows, "doc_id long, pcm binary")
    members, pairs = audio.matches(common.settled(audio.fingerprints(df)), F.col("id").isin(1, 10, 12))
    prints = {i: audio.prints(np.frombuffer(bytes(p or b""), np.uint8)).tolist() for i, p in rows}
    for i in (4, 8, 13):
        assert prints[i] == plain_prints(np.frombuffer(bytes(dict(rows)[i]), np.uint8))
    least = {}
    for i, p in sorted((i, tuple(p)) for i, p in prints.items() if i is not None):
        least.setdefault(p, i)
    assert least[tuple(prints[13])] == least[tuple(prints[14])] == 13  # other bytes, the same prints
    want = {}
    for q in {least[tuple(prints[i])] for i in (1, 10, 12)}:
        for m in set(least.values()) - {q}:
            if (fit := plain_match(prints[q], prints[m])) is not None:
                want[q, m] = fit
    assert {(r.query_id, r.match_id): (r.offset, r.votes, r.overlap, round(r.bit_error, 6)) for r in pairs.collect()} == want
    assert {(0, i) for i in (2, 4, 5, 6, 7, 8, 9)} <= set(want) and (0, 3) not in want and (0, 16) not in want
    links = Counter(q for q, _ in want)
    got = {(r.id, r.class_id, r.links) for r in members.collect()}
    asks = {least[tuple(prints[i])] for i in (1, 10, 12)}
    assert got == {(i, c := least[tuple(p)], links[c] if c in asks else None) for i, p in prints.items()}


def test_audio_of_much_silence():
    """Prints that repeat are counted by correlation: the same votes, and not the square of their number in steps."""
    rng = np.random.default_rng(5)
    for n, m in ((50, 70), (400, 300)):
        a, b = (np.where(rng.random(k) < 0.9, 7, rng.integers(0, 50, k)).astype(np.uint32) for k in (n, m))
        want = [sum(int(a[i] == b[i + o]) for i in range(n) if 0 <= i + o < m) for o in range(-n, m)]
        assert audio.counted_votes(a, b).tolist() == want
    long = np.full(200_000, 7, np.uint32)
    assert audio.align(long, long)[:3] == (0, 200_000, 200_000)
    assert audio.longest_stretch(np.array([1.0, 0, 0, 1, 0, 0, 0, 1]), 0.2) == (1, 6)


def test_audio_with_a_print_in_all_recordings(spark):
    """400 short recordings of different bytes but one and the same print are one class, without pairs."""
    df = spark.createDataFrame([(i, bytearray([128] * (i + 1))) for i in range(400)], "doc_id long, pcm binary")
    members, pairs = audio.matches(common.settled(audio.fingerprints(df)), F.col("id") % 100 == 0)
    assert {(r.class_id, r.links) for r in members.collect()} == {(0, 0)} and pairs.count() == 0
