"""Search on a corpus of four documents, with scores by hand."""

import math

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import search as S

CORPUS = [(1, "apple banana apple"), (2, "banana cherry"), (3, "banana date egg fig"), (4, "banana")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(CORPUS, "doc_id long, text string")


def asked(spark, *queries):
    return spark.createDataFrame(list(enumerate(queries)), "qid long, query string")


def by_hand(tf, dl, df, times, n=4, avgdl=2.5):
    idf = math.log(n / df)
    return 0.7 * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) + 0.3 * tf / dl * idf * times


def hits(index, spark, *queries, k=10):
    return [(r.qid, r["rank"], r.doc_key, r.score) for r in index.search(asked(spark, *queries), k).orderBy("qid", "rank").collect()]


def test_scores(spark, docs):
    index = S.Index.build(docs)
    assert hits(index, spark, "Apple") == [(0, 1, 1, round(by_hand(2, 3, 1, 1), 6))]
    assert hits(index, spark, "date date") == [(0, 1, 3, round(by_hand(1, 4, 1, 2), 6))]


def test_term_of_all_documents_scores_zero_and_ties_go_by_key(spark, docs):
    assert hits(S.Index.build(docs), spark, "banana", k=3) == [(0, i, i, 0.0) for i in (1, 2, 3)]


def test_no_candidates(spark, docs):
    assert hits(S.Index.build(docs), spark, "", "zebra", "!?") == []


def test_update_and_delete(spark, docs):
    index = S.Index.build(docs)
    fresh = spark.createDataFrame([(2, "apple"), (9, "apple pie")], "doc_id long, text string")
    changed = index.updated(fresh)
    whole = S.Index.build(spark.createDataFrame([r for r in CORPUS if r[0] != 2] + [(2, "apple"), (9, "apple pie")], "doc_id long, text string"))
    assert hits(changed, spark, "apple banana") == hits(whole, spark, "apple banana")
    gone = changed.without(spark.createDataFrame([(9,), (2,)], "doc_key long"))
    assert hits(gone, spark, "apple") == hits(S.Index.build(docs.where("doc_id <> 2")), spark, "apple")


def test_save_and_load(spark, docs, tmp_path):
    index = S.Index.build(docs)
    index.save(str(tmp_path / "index"), 2)
    assert hits(S.Index.load(spark, str(tmp_path / "index")), spark, "apple banana cherry") == hits(index, spark, "apple banana cherry")


def test_fusion(spark, docs):
    forms = F.array(F.lit("apple"), F.lit("cherry"))
    got = {r.doc_key: r.score for r in S.smart_search(docs, asked(spark, "Banana cherry"), variations=forms).collect()}
    first, second = round(by_hand(2, 3, 1, 1), 6), round(by_hand(1, 2, 1, 1), 6)
    assert got == {1: first, 2: round((second / 2 + 0.3 * round(1 / 14, 9)) / 2, 6)}


def test_exact(spark, docs):
    got = {r.doc_key: r.score for r in S.exact_scores(docs, asked(spark, "APPLE", "")).collect()}
    assert got == {1: 2 / 19}


def words(spark, query, **options):
    return spark.range(1).select(T.preprocess(F.lit(query), **options)).first()[0]


@pytest.mark.parametrize(("query", "options", "want"), [
    ("getUserName", {"stemming": False}, "getusername"),
    ("getUserName", {"stemming": False, "lowercase_first": False}, "get user name getusername"),
    ("get_user-cfg x 42", {"stemming": False}, "get user get_user config configuration cfg 42"),
    ("utilities applied processing", {}, "utility apply process"),
    ("élan", {"normalise": True, "stemming": False}, "lan"),
    ("the db", {"stop_words": True, "stemming": False}, "database db"),
    ("", {}, ""),
])
def test_preprocess(spark, query, options, want):
    if query == "get_user-cfg x 42":
        want = "get user get_user config configuration cfg 42"
    assert words(spark, query, **options) == want


@pytest.mark.parametrize(("text", "name", "n"), [("foo foo_bar foo", "foo", 2), ("foo.foo(foo)", "foo", 3), ("food", "foo", 0), ("a+b a+b", "a+b", 2), ("x", "", 0), (r"\E \E", r"\E", 2), ("éfoo", "foo", 1)])
def test_occurrences(spark, text, name, n):
    assert spark.createDataFrame([(text, name)], "t string, n string").select(T.occurrences(F.col("t"), F.col("n"))).first()[0] == n


def test_text_helpers(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert value(T.newlines(F.lit("a\r\nb\rc\n"))) == "a\nb\nc"
    assert value(T.trimmed(F.lit("a\n  b\nc"), 2)) == "a\n  b\n  ..." and value(T.trimmed(F.lit("a\nb"), 2)) == "a\nb"
    assert value(T.is_docstring(F.lit('"""x\ny"""'))) and not value(T.is_docstring(F.lit('"x"')))
    assert value(T.upto_docstring(F.lit('def f():\n  """d"""\n  x'), F.lit('"""d"""'))) == 'def f():\n  """d"""'
    assert value(T.is_git_url(F.lit("https://example.com/a/b.git"))) and not value(T.is_git_url(F.lit("not a url")))
    assert value(T.without_prompts(F.lit("a /run b"), ["/run "])) == "a b"


def test_candidates_by_keys(spark):
    """The joins on characters lose no pair that a comparison of all would find."""
    import random
    from difflib import SequenceMatcher

    from loomgraph.operators import complete as C

    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abcde_") for _ in range(rng.randint(1, 9))) for _ in range(150)})
    left = spark.createDataFrame([(w,) for w in words[::2]], "t string")
    right = spark.createDataFrame([(w,) for w in words], "w string")
    for least in (0.3, 0.6, 0.9):
        got = {(r.t, r.w) for r in C.similar(left, right, least).collect()}
        assert len(got) < len(words) ** 2 / 2
        assert {(a, b) for a in words[::2] for b in words if SequenceMatcher(None, a, b).ratio() >= least} <= got
    with pytest.raises(ValueError):
        C.similar(left, right, 0)
    longer, shorter = right.withColumnRenamed("w", "longer"), left.withColumnRenamed("t", "shorter")
    got = {(r.longer, r.shorter) for r in C.containing(longer, shorter).collect()}
    assert got == {(a, b) for a in words for b in words[::2] if len(b) > 2 and b in a}


def test_stated_sets_are_bounded(spark, monkeypatch):
    from loomgraph.operators import search as S

    monkeypatch.setattr(S, "MOST_ASKED", 5)
    assert S.stated(spark.range(5)).count() == 5
    with pytest.raises(ValueError, match="more than 5"):
        S.stated(spark.range(6))


def test_output_order_and_nearest_paths(spark):
    from loomgraph.operators import complete as C

    rows = [(1, "b", "b", "exact", 1.0), (1, "z", "zz", "substring", 0.5), (1, "a", "a", "exact", 1.0), (1, "y", "yx", "fuzzy", 0.7), (1, "x", "xx", "fuzzy", 0.9), (1, "c", "cc", "reverse_subpath", 0.4)]
    found = spark.createDataFrame(rows, "text_id long, word string, token string, match_type string, score double")
    assert [r.word for r in C.in_order(found).orderBy("place").collect()] == ["a", "b", "c", "z", "x", "y"]
    known = spark.createDataFrame([("src/app.py",), ("src/lib.py",), ("docs/readme.md",)], "path string")
    asked = spark.createDataFrame([("src/app.py",), ("src/ap.py",), ("zzzz",)], "path string")
    got = {r.path: (r.found, r.closest) for r in C.nearest_paths(asked, known).collect()}
    assert got == {"src/app.py": ("src/app.py", None), "src/ap.py": (None, "src/app.py"), "zzzz": (None, None)}
