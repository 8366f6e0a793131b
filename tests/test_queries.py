"""Every registered core query against its oracle on the smallest tables; the core stands without the text subpackage."""

import glob
import os
import subprocess
import sys

import duckdb
import pytest

from mentionloom.plans import core_queries

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def tables(small):
    con = duckdb.connect()
    for p in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(core_queries.SQL))
def test_against_sql(spark, tables, small, name):
    df = core_queries.QUERIES[name](spark, small)
    got = sorted(tuple(str(r[c]) for c in sorted(df.columns)) for r in df.collect())
    r = tables.execute(core_queries.SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in sorted(names)]
    assert got == sorted(tuple(str(x[i]) for i in at) for x in r.fetchall())


@pytest.mark.parametrize("name", sorted(set(core_queries.QUERIES) - set(core_queries.SQL)))
def test_without_sql(spark, small, name):
    assert core_queries.QUERIES[name](spark, small).count() >= 0


def test_core_does_not_need_the_text_subpackage():
    code = "import sys; sys.modules['mentionloom.llm'] = None; import __spark_entry__ as e; assert 'p6_found' in e.queries() and 'p1_found' not in e.queries(); import mentionloom.plans.core_queries"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
    for p in glob.glob(f"{ROOT}/mentionloom/**/*.py", recursive=True):
        if "/llm/" not in p:
            assert "mentionloom.llm" not in open(p, encoding="utf8").read()


def test_streaming(spark, small, tmp_path):
    from mentionloom.streaming import ingest

    batch = spark.read.parquet(f"{small}/events.parquet")
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = ingest.event_windows(ingest.table_stream(spark, str(tmp_path / "in"), batch.schema))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("by_hour").start()
    q.processAllAvailable()
    q.stop()
    want = {tuple(map(str, r)) for r in ingest.event_windows(batch).collect()}
    assert {tuple(map(str, r)) for r in spark.sql("SELECT * FROM by_hour").collect()} == want
