"""Every query with SQL against DuckDB on the small tables; the others run and have rows."""

from __future__ import annotations

import glob
import math
import os

import pytest

from tessera.plans import more, queries, stored  # noqa: F401


@pytest.fixture(scope="module")
def duck(data):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    return str(x) if isinstance(x, list) else x


def rows(table):
    names = sorted(table.column_names)
    return names, sorted((tuple(plain(v) for v in r) for r in zip(*(table[c].to_pylist() for c in names), strict=True)), key=repr)


#: Queries without SQL that find nothing in the small tables, by their question.
EMPTY = {"keyword_stemmed"}


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, data, duck, name):
    found = queries.QUERIES[name](spark, data).toArrow()
    if name in queries.ORACLE:
        assert rows(found) == rows(duck.sql(queries.ORACLE[name]).to_arrow_table())
    else:
        assert found.num_rows > 0 or name in EMPTY


#: Texts whose lines are odd: none, empty ones at either end, other ends of lines than a line feed.
LINES = [None, "", "a", "a\n", "a\n\n", "a\nb", "a\nb\n", "a\nb\nc\nd", "a\n\n\nb", "\n", "\n\n", "\nx", "\na\na", "a\r\nb\r\nc\r\n", "a\rb\rc", "x\n\r\n", "\r\n\r\n", "a\nb\x0bc\u2028d\x85e\nf", "a\x00\nb", "é\n\ud55c\n", " \n \n "]


@pytest.mark.parametrize("name", ["line_ranges", "document_slice"])
def test_odd_lines(spark, tmp_path, name):
    import duckdb

    spark.createDataFrame(list(enumerate(LINES)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert rows(queries.QUERIES[name](spark, str(tmp_path)).toArrow()) == rows(con.sql(queries.ORACLE[name]).to_arrow_table())


def test_entry_works_without_the_training_data_operators(spark):
    import __spark_entry__

    first = __spark_entry__.entry(spark).collect()
    assert [(r.doc_id, r.file, r.score) for r in first] == [(0, "docs/src0/0.md", 0.775), (12, "apps/web/src12/12.ts", 0.217719)]
    assert set(queries.QUERIES) <= set(__spark_entry__.queries())
