"""Every core query with SQL against DuckDB, on the smallest data."""

import pytest

from lodestem.plans import oracle, queries
from tests.conftest import DATA, same_rows


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_same_as_sql(spark, duck, name):
    assert same_rows(queries.QUERIES[name](spark, f"{DATA}/sf0.001"), duck.execute(oracle.SQL[name]))


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(oracle.SQL)))
def test_runs(spark, name):
    df = queries.QUERIES[name](spark, f"{DATA}/sf0.001")
    assert len(df.collect()) == 0 if name == "search_nothing" else len(df.collect()) > 0


def test_core_does_not_import_llm():
    import os
    import re

    import lodestem

    root = os.path.dirname(lodestem.__file__)
    for folder, _, files in os.walk(root):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    assert not re.search(r"lodestem\.llm|from \.+llm", open(os.path.join(folder, f)).read()), f
