from pathlib import Path

import duckdb
import pytest

from markloom.llm import queries

from .fixtures import frame, hostile

SMALL = "/root/testdata/sf0.001"


def tables(spark, tmp_path):
    """Hostile documents, items that quote them, and pages that repeat."""
    texts = ["Spelling spelling spellings", "spelling spellings Spelinge spelinge", *hostile(n=40)]
    frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    items = [None, "", "w1 w2", "É", " ".join((texts[-1] or "").split()[100:130])]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    html = [None, "", "é" * 600, "é" * 600, "é" * 600, "a" * 999, "a" * 999, "a" * 1000]
    spark.createDataFrame([(i, "u", h) for i, h in enumerate(html)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
@pytest.mark.parametrize("small", [False, True])
def test_query_matches_sql(spark, tmp_path, name, small):
    sf = SMALL if small else tables(spark, tmp_path / "t")
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    out = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in out.description]
    want = sorted(out.fetchall(), key=repr)
    got = sorted((tuple(r) for r in queries.QUERIES[name](spark, sf).select(*names).collect()), key=repr)
    assert got == want and got
