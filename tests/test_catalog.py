import duckdb
import pytest

from markloom.plans import catalog

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def duck():
    import pathlib

    con = duckdb.connect()
    for p in pathlib.Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def canon(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in rows], key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = canon([tuple(r) for r in df.collect()], df.columns)
    out = duck.execute(catalog.ORACLE_SQL[name])
    assert got == canon(out.fetchall(), [c[0] for c in out.description])
    assert got
