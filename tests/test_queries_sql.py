"""Every core query that has SQL gives the rows of its SQL; the others run."""

import pytest

from docweave.plans import core_queries, document_queries, search_queries

MODULES = (core_queries, search_queries, document_queries)
WITH_SQL = [(m, n) for m in MODULES for n in m.SQL]
WITHOUT = [(m, n) for m in MODULES for n in m.QUERIES if n not in m.SQL]


@pytest.mark.parametrize(("module", "name"), WITH_SQL, ids=[n for _, n in WITH_SQL])
def test_same_rows_as_sql(same_as_sql, module, name):
    same_as_sql(module.QUERIES[name], module.SQL[name])


@pytest.mark.parametrize(("module", "name"), WITHOUT, ids=[n for _, n in WITHOUT])
def test_runs(spark, module, name):
    from tests.conftest import ROOT

    assert module.QUERIES[name](spark, ROOT).limit(5).count() > 0


def test_every_sql_has_its_query():
    for m in MODULES:
        assert set(m.SQL) <= set(m.QUERIES)
