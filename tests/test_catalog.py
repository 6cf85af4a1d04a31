"""Every query beside its SQL, over whole tables of the smallest size."""

from pathlib import Path

import pytest

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables here")

from strandline.plans import queries as core  # noqa: E402

ALL = core.queries()
SQL = core.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for file in DATA.glob("*.parquet"):
        con.execute(f"create view {file.stem} as select * from '{file}'")
    return con


def keyed(rows, names):
    order = sorted(names)
    plain = lambda v: float(v) if hasattr(v, "as_tuple") else v
    return sorted(tuple(repr(plain(r[names.index(n)])) for n in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ALL))
def test_query(spark, duck, name):
    df = ALL[name](spark, str(DATA))
    rows = [list(r) for r in df.collect()]
    if name in SQL:
        found = duck.execute(SQL[name])
        names = [x[0] for x in found.description]
        assert sorted(names) == sorted(df.columns)
        assert keyed(rows, df.columns) == keyed([list(r) for r in found.fetchall()], names)


def test_entry_has_all_names():
    import __spark_entry__ as entry

    assert set(ALL) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
