"""Every registered query against DuckDB over the same Parquet files."""

import duckdb
import pytest

import __spark_entry__ as wired
from tests.conftest import TESTDATA

TABLES = [
    "region nation customer supplier part orders lineitem events",
    "documents embeddings pages benchmark labels conversations",
]


@pytest.fixture(scope="module", params=["sf0.01"])
def scale(request):
    folder = TESTDATA / request.param
    con = duckdb.connect()
    for name in " ".join(TABLES).split():
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return str(folder), con


def as_text(rows):
    return sorted(map(repr, rows))


def test_every_query_has_sql():
    assert wired.library_queries().keys() <= wired.oracle_sql().keys()


@pytest.mark.parametrize("name", list(wired.library_queries()))
def test_matches_duckdb(spark, scale, name):
    folder, con = scale
    got = wired.queries()[name](spark, folder)
    want = con.execute(wired.oracle_sql()[name])
    want_names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(want_names)
    order = sorted(want_names)
    want_rows = [tuple(r[want_names.index(c)] for c in order) for r in want.fetchall()]
    got_rows = [tuple(r[c] for c in order) for r in got.collect()]
    assert got_rows, "the query gave no row"
    assert as_text(got_rows) == as_text(want_rows)


def test_entry_gives_every_document(spark):
    assert wired.entry(spark).count() == 200


@pytest.mark.parametrize(
    ("name", "broken"),
    [
        ("verification_status", ("'rejected'", "'refused'")),
        ("reconcile_values", ("* 100 as bigint) as cents from orders", "* 10 as bigint) as cents from orders")),
        ("extract_values", ("[?&][a-z_]+=", "[?][a-z]+=")),
        ("completeness_by_round", ("'short'", "'over'")),
    ],
)
def test_a_changed_expectation_is_noticed(spark, scale, name, broken):
    folder, con = scale
    sql = wired.oracle_sql()[name]
    assert broken[0] in sql
    want = con.execute(sql.replace(*broken))
    order = [d[0] for d in want.description]
    got_rows = [tuple(r[c] for c in order) for r in wired.queries()[name](spark, folder).collect()]
    assert as_text(got_rows) != as_text(want.fetchall())
