from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from lodestem.operators import dense
from lodestem.sources.staging import staged

SCHEMA = "term string, doc_id long, tf int, key_id string, n_rows string"


def totals(spark, rows):
    df = spark.createDataFrame([(t, d, f, "x", "y") for t, d, f in rows], SCHEMA)
    return {r["term"]: (r["n_rows"], r["tf"]) for r in dense.key_totals(df, "term", ["tf"]).collect()}


def test_nulls_blanks_and_spelling(spark):
    rows = [("A", 1, 2), (" a\t", 1, 3), (" a", None, None), (None, 1, 9), (" ", 1, 9), ("", 2, 1), ("b", 2, 1)]
    assert totals(spark, rows) == {"a": (3, 5), "b": (1, 1)}
    df = spark.createDataFrame([(t, d, f, "x", "y") for t, d, f in rows], SCHEMA)
    assert {r["term"]: r["n_members"] for r in dense.key_members(df, "term", "doc_id").collect()} == {"a": 1, "b": 1}


def test_empty(spark):
    df = staged(dense.key_totals(spark.createDataFrame([], SCHEMA), "term", ["tf"]))
    assert df.count() == 0 and dense.heavy_keys(df, "term", 0.1).count() == 0


def test_ids_are_unique_and_repeatable(spark):
    df = spark.range(5000).selectExpr("concat('k', id % 700) AS term")
    first, again = (sorted(map(tuple, dense.key_totals(df, "term").collect())) for _ in range(2))
    assert first == again and len({r[1] for r in first}) == 700


def test_hot_key_and_flushes(spark, monkeypatch):
    rows = [("hot" if i % 3 else f"k{i}", i, 1) for i in range(3000)]
    want = {k: (n, n) for k, n in Counter(t for t, _, _ in rows).items()}
    assert totals(spark, rows) == want
    totals_ = staged(dense.key_totals(spark.createDataFrame([(t, d, f, "", "") for t, d, f in rows], SCHEMA), "term"))
    assert [r[0] for r in dense.heavy_keys(totals_, "term", 0.5).collect()] == ["hot"]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.sampled_from(["a", "A ", "b", "", "é"])), st.integers(0, 3), st.one_of(st.none(), st.integers(0, 9))), max_size=30))
def test_against_brute_force(spark, rows):
    want: dict = {}
    for t, _, f in rows:
        k = (t or "").strip().lower()
        if k:
            n, s = want.get(k, (0, 0))
            want[k] = (n + 1, s + (f or 0))
    assert totals(spark, rows) == want


def test_dictionary_encoding_and_id_totals(spark, monkeypatch):
    rows = [("A", 1, 2), (" a", 1, 3), ("b", 2, 1), (None, 1, 9), (" ", 1, 9), *[("hot", i, 1) for i in range(200)]]
    df = spark.createDataFrame([(t, d, f, "x", "y") for t, d, f in rows], SCHEMA)
    words = dense.dictionary(df, "term")
    spellings = {r["raw"]: (r["term"], r["key_id"], r["n_rows"]) for r in words.collect()}
    assert {k: (t, n) for k, (t, _, n) in spellings.items()} == {"A": ("a", 1), " a": ("a", 1), "b": ("b", 1), "hot": ("hot", 200)} and spellings["A"][1] == spellings[" a"][1]
    name = {i: t for t, i, _ in spellings.values()}
    for few in (100, 0):
        coded = dense.encoded(df.select("term", "tf"), "term", words, few)
        got = {name[r["key_id"]]: (r["n_rows"], r["tf"]) for r in dense.id_totals(coded, ["tf"]).collect()}
        assert got == {"a": (2, 5), "b": (1, 1), "hot": (200, 200)}
    assert dense.id_totals(coded.where("false"), ["tf"]).count() == 0 == dense.dictionary(df.where("false"), "term").count()


def test_id_totals_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(dense, "FLUSH_KEYS", 3)
    df = spark.range(2000).selectExpr("id % 7 * 70000 + id % 3 AS key_id", "1L AS tf").repartition(5)
    got = {r["key_id"]: (r["n_rows"], r["tf"]) for r in dense.id_totals(df, ["tf"]).collect()}
    want = Counter(i % 7 * 70000 + i % 3 for i in range(2000))
    assert got == {k: (n, n) for k, n in want.items()}


def test_without_repeats(spark):
    df = spark.range(9000).selectExpr("id % 3 AS a", "cast(id % 2 AS int) AS b").coalesce(2)
    got = dense.without_repeats(df).collect()
    assert len(got) <= 12 and {tuple(r) for r in got} == {(a, b) for a in range(3) for b in range(2)}
    assert dense.without_repeats(df.where("false")).count() == 0


def test_staging_needs_a_shared_folder_on_a_cluster(spark, tmp_path):
    import os
    from types import SimpleNamespace

    import pytest

    from lodestem.sources import staging

    none = SimpleNamespace(get=lambda *_: None)
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            staging.shared_dir(SimpleNamespace(sparkContext=SimpleNamespace(master=master, getConf=lambda: none), conf=none))
    with staging.staging_area():
        df = staging.staged(spark.range(3))
        path = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
        assert os.path.isdir(path) and df.count() == 3
    assert not os.path.exists(path)
