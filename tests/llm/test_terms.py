import math

import pytest

from lodestem.llm import oracle, queries, terms
from lodestem.llm.terms import characteristic_terms, term_frequencies
from tests.conftest import DATA, same_rows

POSTINGS = "term string, doc_id long, tf int, positions array<int>, f string, n_docs string, part string, length string"
META = "doc_id long, length int, term string, f string"
ROWS = [
    ("A", 1, 2, [1, 2]), (" a ", 1, 2, [1, 2]), ("a", 1, 1, [9]), ("b", 1, 1, [3]), ("a", 2, 1, [1]), ("c", 2, 1, None), ("c", 2, 1, None), ("d", 3, None, [4]),
    (None, 1, 1, [5]), (" ", 1, 1, [6]), ("z", None, 1, [7]), ("é", 3, 1, []), ("é", 4, 1, [1]), ("é", 5, 1, [1]),
]


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], POSTINGS)


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_same_as_sql(spark, duck, name):
    assert same_rows(queries.QUERIES[name](spark, f"{DATA}/sf0.001"), duck.execute(oracle.SQL[name]))


def test_frequencies(spark):
    got = {r["term"]: (r["n_occurrences"], r["n_docs"], r["mark"]) for r in term_frequencies(table(spark, ROWS)).collect()}
    assert got == {"a": (4, 2, "rare"), "b": (1, 1, "rare"), "c": (1, 1, "rare"), "d": (0, 1, "rare"), "é": (3, 3, "common")}


def test_empty(spark):
    assert term_frequencies(table(spark, [])).count() == 0
    assert characteristic_terms(table(spark, []), spark.createDataFrame([], META)).count() == 0


def test_repeated_runs_give_the_same_ids(spark):
    one, two = (sorted((r["term"], r["term_id"]) for r in term_frequencies(table(spark, ROWS)).collect()) for _ in range(2))
    assert one == two and len({i for _, i in one}) == 5


@pytest.mark.parametrize("limit", [terms.BROADCAST_TERMS, 0])
def test_scores(spark, monkeypatch, limit):
    monkeypatch.setattr(terms, "BROADCAST_TERMS", limit)
    meta = spark.createDataFrame([(1, 4, "x", "x"), (1, 4, "x", "x"), (2, 0, "x", "x"), (3, None, "x", "x"), (None, 3, "x", "x"), (5, 2, "x", "x")], META)
    got = {(r["doc_id"], r["term"]): r for r in characteristic_terms(table(spark, ROWS), meta).collect()}
    assert got[1, "a"]["f"] == 3 and got[1, "a"]["score"] == pytest.approx(3 / 4 * math.log(5 / 2))
    assert got[2, "a"]["score"] is None and got[3, "d"]["score"] is None and got[4, "é"]["score"] is None
    # 2x2 table of "a" in document 1: 3 of 4 there, 1 of 5 in the rest
    cells = ((3, 1), (1, 4))
    g = 2 * sum(o * math.log(o * 9 / (sum(row) * sum(r[j] for r in cells))) for row in cells for j, o in enumerate(row) if o)
    assert got[1, "a"]["llr"] == pytest.approx(g)
    assert len(got) == 8 and got[5, "é"]["llr"] > 0
