"""Incremental forms: findings merged, and metrics kept up, as batches arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leakwright.sources.shared_tables import stash


def confusion_stream(preds: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Running confusion counts of a stream of predictions; state is a row for each pair of classes."""
    return preds.groupBy(F.col(y_true).alias("y_true"), F.col(y_pred).alias("y_pred")).agg(F.count("*").alias("n"))


def windowed_accuracy(preds: DataFrame, ts: str, late: str = "10 minutes", width: str = "5 minutes", y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Accuracy in windows of event time; rows later than the watermark are left out, and state with them."""
    hit = (F.col(y_true) == F.col(y_pred)).cast("double")
    return preds.withWatermark(ts, late).groupBy(F.window(ts, width)).agg(F.count("*").alias("n"), F.avg(hit).alias("accuracy"))


def append_log(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream to a Parquet log, each batch once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


#: Where a table notes the batches that it holds; Spark's readers pass over names with an underscore.
COMMITS = "_commits"


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def refresh_batch(batch: DataFrame, batch_id: int, path: str, key: str = "id_a") -> bool:
    """Replace the findings of every method in ``batch`` in the table at ``path``, whose partitions are methods.

    A row with null in ``key`` only says that its method ran: a method with no other row found
    nothing, and its partition goes.  A batch whose number is noted already is a replay
    and changes nothing; false is returned.  The number is noted last, so a batch that
    broke off is done again, with the same result.
    """
    spark = batch.sparkSession
    note, fs = _fs(spark, f"{path}/{COMMITS}/{batch_id}")
    if fs.exists(note):
        return False
    rows = stash(batch, "batch")
    ran = {r["method"]: r["found"] for r in rows.groupBy("method").agg(F.count(key).alias("found")).collect()}  # a row a method
    found = rows.where(F.col(key).isNotNull()).dropDuplicates()
    found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("method").parquet(path)
    for method in (m for m, n in ran.items() if n == 0):
        for status in fs.globStatus(_fs(spark, f"{path}/method=*")[0]) or []:
            folder = status.getPath()
            if spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(folder.getName().split("=", 1)[1]) == str(method):
                fs.delete(folder, True)
    fs.create(note, True).close()
    return True


def refresh_findings(stream: DataFrame, path: str, checkpoint: str, key: str = "id_a") -> StreamingQuery:
    """Keeps a table of findings up to date from a stream of ``(method, ...)``, each batch once."""
    return stream.writeStream.foreachBatch(lambda batch, n: refresh_batch(batch, n, path, key) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
