import pytest
from pyspark.sql import functions as F

from lodestem.operators import index as ix
from lodestem.operators import retrieval as rt

CORPUS = {1: "red fox red owl", 2: "fox owl", 3: "red red red red log log log log", 4: "log"}


def build(spark, docs, stemmed=False):
    rows = [(i, f"u{i}", f"t{i}", t) for i, t in docs.items()]
    return ix.build(spark.createDataFrame(rows, "doc_id long, url string, title string, text string"), stemmed)


@pytest.fixture(scope="module")
def small(spark):
    return build(spark, CORPUS)


def scores_of(df):
    return {r["doc_id"]: round(r["score"], 6) for r in df.collect()}


def test_bm25(small):
    assert scores_of(rt.ranked(small, ["red", "owl"])) == {1: 1.666723, 2: 0.756711, 3: 1.153323}
    assert scores_of(rt.ranked(small, ["red", "red", "owl"])) == {1: 1.666723, 2: 0.756711, 3: 1.153323}
    assert scores_of(rt.ranked(small, ["red", "owl"], k1=1.2, b=0.75)) == {1: 1.610281, 2: 0.856699, 3: 0.980658}
    assert scores_of(rt.ranked(small, ["fox"])) == {1: 0.684928, 2: 0.756711}
    assert scores_of(rt.ranked(small, ["zzz"])) == {} == scores_of(rt.ranked(small, []))


def test_tfidf_ties_go_by_id(small):
    assert scores_of(rt.ranked(small, ["red", "owl"], method="tfidf")) == {1: 0.774770, 2: 0.287682, 3: 0.686494}
    assert [r["doc_id"] for r in rt.ranked(small, ["fox"], method="tfidf").collect()] == [1, 2]


def test_length_favours_short_more_with_b(small):
    short, long = (scores_of(rt.ranked(small, ["log"], b=b)) for b in (0.9, 0.0))
    assert short[4] / short[3] > long[4] / long[3]


def test_boolean(small):
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())
    assert ids(rt.boolean_and(small, ["red", "owl"])) == [1] and ids(rt.boolean_or(small, ["red", "owl"])) == [1, 2, 3]
    assert ids(rt.boolean_and(small, ["red", "zzz"])) == [] == ids(rt.boolean_and(small, []))


@pytest.mark.parametrize(("phrase", "want"), [(["red", "fox", "red"], [1]), (["fox", "red", "owl"], [1]), (["owl", "fox"], []), (["red", "red"], [3]), (["log"], [3, 4]), ([], [1, 2, 3, 4])])
def test_phrases(small, phrase, want):
    assert sorted(r["doc_id"] for r in rt.phrase_documents(small, phrase).collect()) == want


def test_search(small):
    assert rt.search(small, '"owl fox"').phrase_fallback and not rt.search(small, '"fox red owl"').phrase_fallback
    nothing = rt.search(small, '"to be" or not')
    assert (nothing.results.count(), nothing.corrections, nothing.phrase_fallback) == (0, {}, False)
    assert [r["doc_id"] for r in rt.search(small, '"fox red"', phrase_scope="corpus").results.collect()] == [1]
    assert rt.compare(small, ["red", "owl"]).count() == 3


@pytest.mark.parametrize(("word", "fix"), [("crawlr", "crawl"), ("xrawl", "brawl"), ("tfidf", None), ("ab", None), ("crawl", None)])
def test_repairs(spark, word, fix):
    index = build(spark, {1: "crawl crown idf brawl crawls"})
    assert rt.corrections(index, [word]) == ({word: fix} if fix else {})


def test_repairs_against_brute_force(spark):
    import random

    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    vocab = sorted({word(rng.randrange(2, 9)) for _ in range(150)})
    index = build(spark, {1: " ".join(vocab)})
    vocab = [t for t in vocab if t in {r["term"] for r in index.vocab.collect()}]
    asked = sorted({word(rng.randrange(2, 10)) for _ in range(60)} | {"", "ab"})

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    for limit in (None, 0, 1, 3):
        want = {}
        for w in asked:
            cap = limit if limit is not None else 0 if len(w) <= 3 else 1 if len(w) <= 5 else 2
            near = sorted((d, len(t), t) for t in vocab if (d := distance(w, t)) <= cap)
            if w not in vocab and cap > 0 and near:
                want[w] = near[0][2]
        df = spark.createDataFrame([(w,) for w in asked], "word string")
        assert {r["word"]: r["fix"] for r in rt.repairs(index, df, limit).collect()} == want


def test_batch(small, spark):
    rows = [(1, "Red OWL, the red owl"), (2, "redd"), (3, "zzz"), (4, None), (5, ""), (6, "fox"), (6, "fox"), (None, "fox"), (7, "ttred logg")]
    got = rt.search_batch(small, spark.createDataFrame([(*r, "x") for r in rows], "query_id int, raw string, doc_id string"), k=2).collect()
    assert {(r["query_id"], r["rank"]): (r["doc_id"], round(r["score"], 6)) for r in got} == {
        (1, 1): (1, 1.666723), (1, 2): (3, 1.153323), (6, 1): (2, 0.756711), (6, 2): (1, 0.684928),
        (2, 1): (3, 1.153323), (2, 2): (1, 0.981795), (7, 1): (3, 1.153323), (7, 2): (4, 0.798557),  # redd, logg repaired
    }
    assert rt.search_batch(small, spark.createDataFrame([], "query_id int, raw string")).count() == 0


def test_pages_are_indexed_under_their_stored_title(spark):
    rows = [(1, "u1", "Stored", "<title>own</title>fox", 1), (2, "u2", None, "<title>own</title>owl", 1), (3, "u3", None, "<title></title>red", 1), (4, "u4", None, None, 1), (2, "u2", None, "<title>own</title>owl", 2)]
    pages = spark.createDataFrame(rows, "id long, url string, title string, html string, crawled_at int")
    assert {r["doc_id"]: (r["title"], r["text"]) for r in ix.from_pages(pages).collect()} == {1: ("Stored", "own fox"), 2: ("own", "own owl"), 3: ("u3", "red"), 4: ("u4", "")}
    assert ix.from_pages(pages.drop("title")).where("doc_id = 1").first()["title"] == "own"


def test_a_frequent_term_is_cut(spark):
    index = build(spark, {i: f"hot word{i}" for i in range(4000)})
    from pyspark.sql.functions import spark_partition_id

    parts = index.postings.where("term = 'hot'").select(spark_partition_id().alias("p")).distinct().count()
    assert parts > 1 and index.postings.where("term = 'hot'").count() == 4000


def test_parse(small):
    q = rt.parse('say "fox owl" "red log" now "open', small, repair=False)
    assert q.phrases == [["fox", "owl"], ["red", "log"]] and q.free == ["say", "now", "open"]
    assert rt.parse('""', small, repair=False).phrases == []


SNIPPETS = [
    ("the red fox", 11, False, False), ("a" * 200, 201, False, True), ("a" * 400, 321, False, True), ("x" * 79 + " fox end", 87, False, False), ("x" * 80 + " fox end", 88, True, False),
    ("fox " + "y" * 300, 161, False, True), ("", 0, False, False), (None, 0, False, False),
]


def test_snippets(spark):
    df = spark.createDataFrame([(t,) for t, *_ in SNIPPETS], "t string")
    for r, (_, n, lead, trail) in zip(df.select(rt.snippet(F.col("t"), ["fox"])).collect(), SNIPPETS):
        assert (len(r[0]), r[0].startswith("…"), r[0].endswith("…")) == (n, lead, trail)
    assert spark.createDataFrame([("springer book",)], "t string").select(rt.snippet(F.col("t"), ["spring"])).first()[0] == "springer book"


def test_first_copies(spark):
    index = build(spark, {1: "a  b", 2: "a b", 3: "a b c", 7: " \t", 5: " "})
    assert sorted(r["doc_id"] for r in index.doc_meta.collect()) == [1, 3, 5] and index.n_docs == 3 and index.skipped == 2
    assert {r["doc_id"]: r["length"] for r in index.doc_meta.collect()}[5] == 0


def test_empty_index(spark, tmp_path):
    index = build(spark, {1: "x"})
    none = ix.clear(index)
    assert rt.ranked(none, ["x"]).count() == 0 and rt.corrections(none, ["crawlr"]) == {}
    empty = ix.build(spark.createDataFrame([], "doc_id long, url string, title string, text string"), False)
    assert (empty.n_docs, empty.average_length, ix.describe(empty).count()) == (0, 0.0, 1)
    ix.write(index, str(tmp_path / "i"))
    assert ix.read(spark, str(tmp_path / "i")).n_docs == 1


def test_stemmed_search(spark):
    index = build(spark, {1: "The crawlers were crawling", 2: "a browser"}, stemmed=True)
    assert [r["doc_id"] for r in rt.search(index, "crawler").results.collect()] == [1]


def test_invariants(spark):
    from tests.conftest import DATA

    index = ix.cached(spark, f"{DATA}/sf0.001")
    assert index.postings.agg(F.sum("tf")).first()[0] == index.doc_meta.agg(F.sum("length")).first()[0]
    assert index.vocab.where(F.col("df") > index.n_docs).count() == 0
    assert index.postings.where(F.size("positions") != F.col("tf")).count() == 0


def test_command_line(spark, tmp_path, capsys):
    from lodestem.__main__ import main
    from tests.conftest import DATA

    where = str(tmp_path / "index")
    main(["build", "--documents", f"{DATA}/sf0.001/documents.parquet", "--index", where], spark)
    assert "documents indexed" in capsys.readouterr().out
    for args in (["stats"], ["lookup", "reader"], ["search", "--b", "0.5", "redaers"]):
        main([args[0], "--index", where, *args[1:]], spark)
    out = capsys.readouterr().out
    assert "--- tfidf, " in out and ", repaired" in out and "--- bm25" in out
