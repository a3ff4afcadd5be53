import os

import duckdb
import pytest

import __spark_entry__ as entry
from leakwright.plans import catalog
from leakwright.streaming import incremental

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{D}/{t}.parquet')")
    return c


def plain(rows, columns):
    return sorted(repr([float(r[c]) if isinstance(r[c], (int, float)) and not isinstance(r[c], bool) else r[c] for c in columns]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = catalog.queries()[name](spark, D)
    cur = duck.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    want = [dict(zip(columns, r)) for r in cur.fetchall()]
    assert sorted(columns) == sorted(got.columns)
    assert plain([r.asDict() for r in got.collect()], sorted(columns)) == plain(want, sorted(columns))


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_stream_equals_batch(spark, tmp_path):
    rows = catalog.predictions(spark, D).select("y_true", "y_pred")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = incremental.confusion_stream(stream).writeStream.outputMode("complete").format("memory").queryName("cells").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("cells").selectExpr("sum(n)").first()[0] == rows.count()
    q = incremental.append_log(stream, str(tmp_path / "log"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "log")).count() == rows.count()
