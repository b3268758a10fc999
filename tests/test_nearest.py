"""Similar strings by blocks against comparisons of all pairs."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest

from loomgraph.operators import complete as C
from loomgraph.operators import nearest as N


def _column(spark, name, rows):
    return spark.createDataFrame([(x,) for x in rows], f"{name} string")


def _ratio(a, b):
    return SequenceMatcher(None, a, b).ratio()


def _common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


@pytest.mark.parametrize("longest", [9, 32, 64, 90])
def test_bounds(longest):
    rng = random.Random(longest)
    words = ["", "x" * longest, *("".join(rng.choice("ab\0é😀") for _ in range(rng.randint(0, longest))) for _ in range(60))]
    bound, held = N.bounds(words), N.holders(words)
    for text in words[:12]:
        both = [len(text) + len(w) for w in words]
        assert np.allclose(bound(text), [2 * _common(text, w) / n if n else 1.0 for w, n in zip(words, both)])
        assert all(b >= _ratio(text, w) - 1e-12 for b, w in zip(bound(text), words))
        for part in (text, text[1:3], ""):
            assert held(part).tolist() == [part in w for w in words]


def test_nearest_paths_in_many_blocks(spark, monkeypatch):
    """Known paths that repeat give one row for each asked one, and the closest is that of a comparison of all."""
    monkeypatch.setattr(N, "CHARS", 300)
    rng = random.Random(5)
    known = sorted({"lib/" + "".join(rng.choice("abcdef") for _ in range(rng.randint(3, 40))) for _ in range(120)})
    asked = [*known[:5], "./" + known[0], "", "lib/zz", *(p[:6] + "z" + p[7:] for p in known[::3]), *("".join(rng.choice("abcdefz/") for _ in range(20)) for _ in range(30))]
    got = C.nearest_paths(_column(spark, "path", asked), _column(spark, "path", [*known, *known])).collect()
    want = []
    for path in asked:
        found = next((k for k in known if k in (path, path.removeprefix("./"))), None)
        best = min(((-_ratio(path, k), k) for k in known if _ratio(path, k) >= 0.6), default=(0, None))[1]
        want.append((path, found, None if found or not path else best))
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))


def test_many_identifiers_asked(spark, monkeypatch):
    """More identifiers than may be broadcast, also ones that are only contained, against a comparison of all."""
    from loomgraph.operators import search as S

    monkeypatch.setattr(S, "MOST_ASKED", 5)
    monkeypatch.setattr(N, "CHARS", 300)
    rng = random.Random(7)
    words = sorted({"".join(rng.choice("abAB_") for _ in range(rng.randint(1, 30))) for _ in range(80)})
    asked = [*words[:3], "", "zz", "AB", "b_a", *sorted({"".join(rng.choice("abAB_z") for _ in range(rng.randint(1, 30))) for _ in range(40)})]
    rows = C.validated(_column(spark, "code_identifier", asked), _column(spark, "word", [*words, *words]), k=3).collect()
    assert len(rows) == len(set(asked))
    for r in rows:
        a = r.code_identifier
        near = sorted((-_ratio(a, w), w) for w in words if _ratio(a, w) >= 0.3 or a.lower() in w.lower())[:3]
        assert r.is_valid == (a in words) and r.matching_identifiers == ([a] if a in words else [w for _, w in near])


def test_rows_of_suppliers_that_share_a_name(spark, tmp_path):
    """One row for each identifier asked for, as the SQL's, also where names repeat."""
    import __spark_entry__
    from tests.oracle import assert_same

    rows = [(i, f"Supplier#{i % 7}") for i in range(20)]
    spark.createDataFrame(rows, "s_suppkey long, s_name string").coalesce(1).write.parquet(str(tmp_path / "out"))
    next((tmp_path / "out").glob("part-*")).rename(tmp_path / "supplier.parquet")
    for p in sorted((tmp_path / "out").iterdir()):
        p.unlink()
    (tmp_path / "out").rmdir()
    for name in ("nearest_identifier", "closest_paths", "extract_kinds"):
        assert_same(spark, __spark_entry__.queries()[name], __spark_entry__.oracle_sql()[name], str(tmp_path))


def test_few_pairs_are_left_of_unlike_words(spark):
    """Of words that share letters but no order, hardly a pair beyond the like ones is left to be judged."""
    from hashlib import md5

    words = ["w" + md5(str(i).encode()).hexdigest() for i in range(300)]
    changed = [w[:10] + "zz" + w[12:] for w in words]
    got = {(r.t, r.w) for r in C.similar(_column(spark, "t", changed), _column(spark, "w", words), 0.6).collect()}
    assert set(zip(changed, words)) <= got and len(got) < 600


def test_extraction_takes_the_best_pairs_first(spark):
    """As a choice made one pair after another, over kinds first and then ratios."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(3, 16)))
    words = sorted({word() for _ in range(60)})
    texts = {i: " ".join([word() for _ in range(12)] + [w[:-1] for w in rng.sample(words, 3)] + rng.sample(words, 2)) for i in range(25)}
    frame = spark.createDataFrame(list(texts.items()), "text_id long, text string")
    got = {tuple(r)[:4] for r in C.extracted(frame, spark.createDataFrame(list(enumerate(words)), "pos int, word string")).collect()}
    want = set()
    for i, text in texts.items():
        tokens = list(dict.fromkeys(text.split()))
        exact = [t for t in tokens if t in words]
        want |= {(i, t, t, "exact") for t in exact}
        pairs = []
        for t in tokens:
            for w in words:
                if t in exact or w in exact:
                    continue
                short, long = sorted((t, w), key=len)
                if t != w and short in long and len(short) >= 4 and len(short) / len(long) >= 0.3:
                    pairs.append((0, -len(short) / len(long), words.index(w), text.split().index(t), w, t, "substring" if short == t else "reverse_substring"))
                elif _ratio(w, t) >= 0.6:
                    pairs.append((1, -_ratio(w, t), words.index(w), text.split().index(t), w, t, "fuzzy"))
        used = set()
        for *_, w, t, kind in sorted(pairs):
            if ("w", w) not in used and ("t", t) not in used:
                used |= {("w", w), ("t", t)}
                want.add((i, w, t, kind))
    assert got == want
