"""Every registered page query against its SQL on the smallest tables."""

import decimal
import os

import duckdb
import pytest

from leafgrid.plans import queries as page_queries
from leafgrid.plans import part_queries, pixel_queries, text_queries  # noqa: F401

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    return con


def rows(table):
    """Rows in one order; whole numbers are whole numbers whatever their type, other numbers are rounded."""
    names = sorted(table.column_names)

    def plain(v):
        if isinstance(v, (float, decimal.Decimal)) and v == v:
            return int(v) if v == int(v) else round(float(v), 6)
        return v

    return sorted(repr(tuple(plain(r[c]) for c in names)) for r in table.to_pylist())


@pytest.mark.parametrize("name", sorted(page_queries.SQL))
def test_query_equals_sql(spark, duck, name):
    mine = page_queries.QUERIES[name](spark, DIR).toArrow()
    want = duck.sql(page_queries.SQL[name]).to_arrow_table()
    assert sorted(mine.column_names) == sorted(want.column_names)
    assert mine.num_rows and rows(mine) == rows(want)


def test_entry_imports_and_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_assembly_covers_the_kept_words(spark):
    blocks = page_queries.QUERIES["page_assembly"](spark, DIR).toPandas()
    assert len(blocks) and not blocks.duplicated(["doc_id", "block"]).any() and not blocks.duplicated(["doc_id", "place"]).any()
    assert set(blocks["align"]) <= {"left", "right", "center", "justify"} and blocks["size"].gt(0).all()
    docs = {r["doc_id"]: set(r["text"].split()) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    assert all(set(t.split()) <= docs[d] for d, t in zip(blocks["doc_id"], blocks["text"], strict=True))
