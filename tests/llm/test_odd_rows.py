"""Rows that are legal but rare: repeated and missing ids, very long blanks, names that clash, large groups without links."""

import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomgraph.llm import common, linededup, mixing, neardup, packing, quality, tokencount
from tests.llm.test_operators import CLASHES, WORD, lower, within_one

SCHEMA = "doc_id long, text string"


def identified_rows(spark, rows):
    """rows with the hash that orders rows of one doc_id."""
    df = spark.createDataFrame(rows, SCHEMA)
    return df, {r.text: r.t for r in df.select("text", F.xxhash64("text").alias("t")).collect()}


def test_line_dedup_with_repeated_and_missing_ids(spark):
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdef ") for _ in range(rng.randint(12, 30))).strip() for _ in range(25)]
    rows = []
    for _ in range(60):
        lines = [x if rng.random() < 0.6 else x[:9] + rng.choice("xyz") + x[10:] for x in rng.choices(base, k=rng.randint(1, 6))]
        rows.append((rng.choice([None, None, *range(12)]), "\n".join(lines)))
    rows += [(3, None), (None, None), (3, ""), rows[5], rows[5]]
    df, t = identified_rows(spark, rows)
    place = lambda r: (-(2**63) if r[0] is None else r[0], t[r[1]])
    want, seen = {}, []
    for row in sorted({r for r in rows if r[1] is not None}, key=place):
        kept = []
        for line in row[1].split("\n"):
            x = re.sub(r" +", " ", lower(line)).strip(" ")
            again = bool(x) and (x in seen or len(x) >= 16 and any(len(y) >= 16 and within_one(x, y) for y in seen))
            kept += [] if again else [line]
            seen.append(x)
        want[row] = "\n".join(kept)
    got = Counter((r.doc_id, r.text) for r in linededup.dedup_lines(df).collect())
    assert got == Counter((r[0], want.get(r)) for r in rows)


@pytest.mark.parametrize("blank", [" ", "\t", "\n", "\r\n", "\u3000 "])
def test_very_long_blanks(spark, blank):
    from tokenizers import Tokenizer
    import public_tokenizers

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    run = blank * 2_000_000
    for text in (f"{run}b", blank * 60_000, f"a{blank * 60_000}", f"one {blank * 60_000}two  three{blank * 60_000} <|endoftext|>x"):
        want = library.encode(text, add_special_tokens=False).ids
        assert packing.encoder().encode(text) == want
    docs = spark.createDataFrame([(1, f"x{run}y"), (2, "z")], SCHEMA)
    n = len(library.encode(f"x{run}y", add_special_tokens=False).ids)
    pieces = packing.pieces(docs).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in pieces} == {1: n + 1, 2: 2}
    found = tokencount.documents(common.settled(tokencount.scan(tokencount.flat_blocks(docs)))).collect()
    assert {r.doc_id: r.n_tokens for r in found} == {1: n, 2: 1}


def test_special_strings(spark):
    """Packing takes the library's default, which makes them tokens; in flat files they are text, not separators."""
    from tokenizers import Tokenizer
    import public_tokenizers

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    text = "a <|endoftext|> b<|endoftext|>"
    assert packing.encoder().encode(text) == library.encode(text, add_special_tokens=False).ids and 50256 in packing.encoder().encode(text)
    docs = spark.createDataFrame([(1, text), (2, None), (None, "")], SCHEMA)
    found = tokencount.documents(common.settled(tokencount.scan(tokencount.flat_blocks(docs)))).collect()
    library.encode_special_tokens = True
    assert {r.doc_id: r.n_tokens for r in found} == {1: len(library.encode(text, add_special_tokens=False).ids), 2: 0, None: 0}


def sets_of(rows):
    out = {}
    for r in set(rows):
        w = WORD.findall(lower(r[1]))
        out[r] = frozenset(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))) if w else frozenset()
    return out


def brute_force(rows, percent):
    """{row: (set size, least doc_id of its component or None)}; a row is one document, whatever its id."""
    sets = sets_of(rows)
    up = {r: r for r in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
            up[find(a)] = find(b)
    least = defaultdict(list)
    for r in sets:
        least[find(r)] += [] if r[0] is None else [r[0]]
    return {r: (len(s), min(least[find(r)], default=None)) for r, s in sets.items()}


def repeated_ids(seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    rows = [(1, None), (None, None), (2, ""), (None, "")]
    for _ in range(40):
        base = [word() for _ in range(rng.choice([4, 40, 300]))]
        for _ in range(rng.choice([1, 2, 6])):
            copy = base[:]
            for _ in range(rng.choice([0, 1, 1])):
                copy[rng.randrange(len(copy))] = word()
            rows.append((rng.choice([None, *range(20, 40)]), " ".join(copy)))
    return rows + rows[7:10]


def test_near_duplicates_with_repeated_and_missing_ids(spark):
    rows = repeated_ids()
    want = brute_force(rows, 85)
    got = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA), 85).collect()
    flat = lambda x: sorted(x, key=repr)
    assert flat((r.doc_id, r.n_shingles, r.component_id) for r in got) == flat((r[0], *((want[r][0], want[r][1]) if want[r][0] else (0, r[0]))) for r in rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_the_pipeline_drops_what_is_not_kept(spark):
    rows = repeated_ids(6)
    want = brute_force(rows, 80)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA + ", lang string, source string, n_chars long")
    stays = [r for r in rows if not want[r][0] or r[0] == want[r][1]]
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(stays) and len(stays) < len(rows)


def test_a_large_group_without_links(spark):
    """One passage makes up half of 400 texts: they share bands by the dozen, but few are linked."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage = [word() for _ in range(180)]
    rows = [(i, " ".join(passage + [word() for _ in range(100)])) for i in range(400)]
    rows += [(400 + i, rows[i][1] + " more") for i in range(0, 30)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA), 85, block=8, block_bytes=600_000).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i if i < 400 else i - 400 for i, _ in rows}


def test_blocks_and_batches_are_bounded(spark):
    members = spark.range(100).select(F.lit(7).cast("long").alias("key"), F.col("id").alias("cid"), F.lit(1).alias("weight"))
    open_ = neardup.split_members(members, members.where("false").select(F.col("cid").alias("node"), F.col("cid").alias("label")), "key")
    rows = neardup.dealt(open_, 10).collect()
    sizes = Counter((r.block, r.batch) for r in rows)
    assert len(sizes) == 100 and max(sizes.values()) < 50
    met = {(h.cid, a.cid) for h in rows for a in rows if a.asks and not h.asks and (h.block, h.batch) == (a.block, a.batch)}
    assert len(met) == 100 * 99


def test_sampling_is_by_unequal_chances(spark):
    """200 sources of the same sizes: shares taken are near the chances, which differ, and no order of u alone gives them."""
    rng = random.Random(2)
    sizes = [rng.choice([3, 10, 40, 150, 600]) for _ in range(60)]
    rows = [(s * 100 + i, f"s{s:03d}", n) for s in range(200) for i, n in enumerate(sizes)]
    out = mixing.allot(spark.createDataFrame(rows, "doc_id long, source string, size long")).toPandas()
    out["extra"] = out.copies - np.floor(out.target / out.source_size)
    drawn = out[(out.chance > 0) & (out.chance < 1)]
    for (_, chance), g in drawn.groupby(["size", "chance"]):
        if len(g) > 200:
            assert abs(g.extra.mean() - chance) < 0.08
    assert drawn.groupby("target").chance.nunique().max() >= 3
    u = out.doc_id.map({r.doc_id: r.u for r in spark.createDataFrame(rows, "doc_id long, s string, n long").select("doc_id", mixing.uniform(F.col("doc_id"), "mix").alias("u")).collect()})
    out["source_no"], out["u"] = out.doc_id // 100, u
    passed_over = [g[g.extra == 1].u.max() > g[g.extra == 0].u.min() for _, g in out[(out.chance > 0) & (out.chance < 1)].groupby("source_no")]
    assert np.mean(passed_over) > 0.9
    for _, g in out.groupby("source_no"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= max(sizes) / 2 + 1 and (g.taken <= 2 * g["size"]).all()


def test_pareto_ranks_by_plain_python(spark):
    """The sample of one source against ranks written out in Python."""
    import hashlib

    rng = random.Random(4)
    rows = [(i, "a", rng.randint(0, 500)) for i in range(300)] + [(1000 + i, "b", rng.randint(0, 50)) for i in range(100)]
    out = mixing.allot(spark.createDataFrame(rows, "doc_id long, source string, size long"), bucket_rows=7).toPandas().set_index("doc_id")
    for source in "ab":
        own = [(i, n) for i, s, n in rows if s == source]
        target, total = out.target[own[0][0]], sum(n for _, n in own)
        rest = target - target // total * total
        level = next((x for x in np.linspace(0, 1, 200_001) if sum(min(1, x * len(f"{n:b}")) * n for _, n in own) >= rest), 1)
        chance = {i: min(1, level * len(f"{n:b}")) for i, n in own}
        assert all(abs(out.chance[i] - c) < 1e-4 for i, c in chance.items())
        draw = lambda i: (int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        odds = lambda p: p / (1 - p)
        left = rest - sum(n for i, n in own if out.chance[i] == 1)
        want, upto = {i for i, _ in own if out.chance[i] == 1}, 0
        for _, i, n in sorted((odds(draw(i)) / odds(out.chance[i]), i, n) for i, n in own if 0 < out.chance[i] < 1):
            upto += n
            if 2 * upto - n <= 2 * left:
                want.add(i)
        assert {i for i, _ in own if out.copies[i] > target // total} == want


def test_names_that_clash(spark):
    rows = spark.createDataFrame([(1, "a b c", "s"), (2, "a b d e f", "s"), (3, None, None)], "doc_id long, text string, source string")
    for column in CLASHES.split(", "):
        name, kind = column.split(" ")
        rows = rows.withColumn(name, F.lit(1).cast(kind))
    sized = rows.withColumn("size", mixing.word_count(F.col("text")))
    assert mixing.allot(sized).count() == 3
    pieces = common.settled(packing.pieces(rows).withColumns({c: F.lit(1) for c in ("number", "first", "c_length", "salt", "n", "sequence_id", "offset", "_row")}))
    packed = packing.pack(pieces)
    assert sorted(packed.columns) == sorted(pieces.columns) and packed.select("sequence_id").distinct().count() == 1
    labels = spark.createDataFrame([(1, 1, 9), (1, 0, 9), (2, 1, 9), (2, 1, 8), (3, 0, 9)], "doc_id long, quality int, id int")
    x, y, totals = quality.labelled(rows, labels, 100)
    assert y.tolist() == [1, 0] and totals == (1, 1) and len(x) == 2


def test_labels_of_repeated_ids(spark):
    """One row a label however many rows share the id; the bound holds; reruns agree."""
    docs = spark.createDataFrame([(i % 10, f"text {'a ' * i}") for i in range(200)], SCHEMA)
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)] * 3, "doc_id long, quality int")
    x, y, totals = quality.labelled(docs, labels, 6)
    again, *_ = quality.labelled(docs.repartition(7), labels, 6)
    assert len(x) == 6 and sorted(y) == [0, 0, 0, 1, 1, 1] and totals == (5, 5) and (x == again).all()


def test_bradley_terry_against_plain_gradient_steps():
    """Scores order documents as do weights found by gradient ascent on all pairs of a good and a bad one."""
    rng = np.random.default_rng(12)
    y = (rng.random(150) < 0.7).astype(int)
    x = rng.normal(0, 1, (150, 3)) + y[:, None] * np.array([1.0, -0.7, 0.0])
    model = quality.Model(x, y)
    z = model.design(x)
    d = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, z.shape[1])
    pairs = min(quality.MOST_PAIRS, len(d))
    w = np.zeros(z.shape[1])
    for _ in range(20000):
        w += 1.0 * ((d * (1 / (1 + np.exp(d @ w)))[:, None]).mean(0) - w / pairs)
    assert np.allclose(w, model.weights, atol=0.02)
    rank = lambda s: np.argsort(np.argsort(s))
    assert np.corrcoef(rank(z @ w), rank(model.score(x)))[0, 1] > 0.999
    assert abs((model.score(x) < quality.THRESHOLD).mean() - (y == 0).mean()) < 0.02


def test_fullest_by_enumeration():
    rng = random.Random(6)
    for _ in range(200):
        counts = Counter(rng.randint(1, 30) for _ in range(rng.randint(1, 9)))
        lengths = sorted(counts, reverse=True)
        taken = packing.fullest(counts, lengths, lengths[0], 40)
        others = list((counts - Counter([lengths[0]])).elements())
        best = max(lengths[0] + sum(c) for k in range(len(others) + 1) for c in itertools.combinations(others, k) if lengths[0] + sum(c) <= 40)
        assert sum(n * k for n, k in taken.items()) == best and not taken - counts
