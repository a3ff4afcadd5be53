"""Files: delimited tables of unknown delimiter, image indexes, caches, logs and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakwright.sources.shared_tables import stash

#: Delimiters tried, names of a metadata file, its columns, and folders of images.
DELIMITERS = (",", "\t", ";", "|")
METADATA_NAMES = ("HAM10000_metadata", "HAM10000_metadata.csv", "HAM10000_metadata.tab", "HAM10000_metadata.txt")
REQUIRED = ("lesion_id", "image_id", "dx", "dx_type", "age", "sex", "localization")
IMAGE_FOLDERS = ("images", "HAM10000_images_part_1", "HAM10000_images_part_2", "ham10000_images_part_1", "ham10000_images_part_2")


def _ls(spark: SparkSession, folder: str, pattern: str = "*") -> list[str]:
    """Names in a folder of any file system that Spark reads, sorted."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(f.getPath().getName() for f in found or [])


def find_metadata(spark: SparkSession, folder: str, names: tuple[str, ...] = METADATA_NAMES) -> str | None:
    """The first of the known names that exists, else the first file whose name begins like them."""
    there = _ls(spark, folder)
    found = [n for n in names if n in there] or [n for n in there if n.startswith(names[0])]
    return f"{folder}/{found[0]}" if found else None


#: Bytes that are looked at to find a delimiter.
HEAD_BYTES = 8192


def head_of(spark: SparkSession, path: str, size: int = HEAD_BYTES) -> str:
    """The first bytes of a file, or of the first file with rows in a folder, as text."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(fs_path):
        raise FileNotFoundError(path)
    files = [fs_path]
    if fs.getFileStatus(fs_path).isDirectory():
        found = sorted((f for f in fs.listStatus(fs_path) if f.getLen() and not f.getPath().getName().startswith(("_", "."))), key=lambda f: f.getPath().getName())
        files = [f.getPath() for f in found[:1]]
    for file in files:
        stream = fs.open(file)
        try:
            return bytes(stream.readNBytes(size)).decode("utf-8", "replace")
        finally:
            stream.close()
    return ""


def records(head: str, delimiter: str) -> tuple[list[int], bool]:
    """Columns of each record of a text, and whether a record goes over a line end; delimiters and line ends inside double quotes are text."""
    counts, columns, quoted, fresh, last, over = [], 1, False, True, "", False
    for c in head:
        if quoted:
            quoted = c != '"'
            over |= c == "\n"
        elif c == '"' and (fresh or last == '"'):  # opens a field, or was doubled inside one
            quoted = True
        elif c == delimiter:
            columns += 1
        elif c == "\n":
            if columns > 1 or not fresh or last not in ("", "\n", "\r"):
                counts.append(columns)
            columns = 1
        fresh = not quoted and c in (delimiter, "\n")
        last = c
    if columns > 1 or last not in ("", "\n"):
        counts.append(columns)
    return counts, over


def column_counts(head: str, delimiter: str) -> list[int]:
    return records(head, delimiter)[0]


def sniff_delimiter(head: str) -> str:
    """The delimiter whose records have most consistently one number of columns, more than one.

    Of the records, the last of which may be cut off, the share with the commonest number
    decides, then that number, then the order of ``DELIMITERS``.  If no delimiter parts the
    records, it is the one that the header has most of outside quotes.
    """
    best, score = None, (0.0, 1)
    for delimiter in DELIMITERS:
        counts = column_counts(head, delimiter)
        counts = counts[:-1] if len(counts) > 1 and len(head.encode()) >= HEAD_BYTES else counts
        if not counts:
            continue
        usual = max(set(counts), key=lambda n: (counts.count(n), n))
        now = (counts.count(usual) / len(counts), usual)
        if usual > 1 and now > score:
            best, score = delimiter, now
    header = head.split("\n", 1)[0]
    return best or max(DELIMITERS, key=lambda d: (column_counts(header, d) or [1])[0])


def has_quoted_breaks(head: str) -> bool:
    """Whether a field in quotes holds a line end: then records are not lines."""
    return records(head, sniff_delimiter(head))[1]


def read_delimited(spark: SparkSession, path: str, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """A delimited table with a header; other delimiters are tried until the required columns are there.

    The delimiter is sniffed from the first bytes.  Files with line ends inside quotes
    there are read as whole records, which Spark does not split.  A missing file is a
    FileNotFoundError, missing columns are a ValueError that lists them.
    """
    head = head_of(spark, path)
    if not head.strip():
        raise ValueError(f"{path} is empty")
    guess = sniff_delimiter(head)
    for delimiter in (guess, *(d for d in DELIMITERS if d != guess)):
        rows = spark.read.csv(path, header=True, sep=delimiter, inferSchema=True, multiLine=has_quoted_breaks(head), escape='"')
        if set(required) <= set(rows.columns):
            return rows
    there = spark.read.csv(path, header=True, sep=guess).columns
    raise ValueError(f"{path} lacks columns {sorted(set(required) - set(there))}; it has {there}")


def image_folders(spark: SparkSession, folder: str, known: tuple[str, ...] = IMAGE_FOLDERS, suffix: str = ".jpg") -> list[str]:
    """Known folders that exist, or else every folder below that has an image."""
    there = [n for n in known if n in set(_ls(spark, folder))]
    return [f"{folder}/{n}" for n in there or [n for n in _ls(spark, folder) if _ls(spark, f"{folder}/{n}", f"*{suffix}")]]


def index_files(spark: SparkSession, folders: list[str], suffix: str = ".jpg") -> DataFrame:
    """``(image_id, path)`` by file stem; of one stem in several folders the last folder wins.  No file is opened."""
    found = spark.createDataFrame([], "image_id string, path string, rank int")
    for rank, folder in enumerate(folders):
        files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder)
        rows = files.select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("image_id"), "path", F.lit(rank).alias("rank"))
        found = found.unionByName(rows)
    return found.groupBy("image_id").agg(F.max_by("path", F.struct("rank", "path")).alias("path"))


def same_ids(one: DataFrame, two: DataFrame, id_col: str) -> bool:
    """Whether two tables hold the same set of ids: a cache of the one serves the other."""
    a, b = one.select(id_col).distinct(), two.select(id_col).distinct()
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def cached(rows: DataFrame, path: str, id_col: str, compute) -> DataFrame:
    """The table at ``path`` if it holds just the ids of ``rows``; else ``compute(rows)``, written there."""
    spark = rows.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at) and same_ids(spark.read.parquet(path), rows, id_col):
        return spark.read.parquet(path)
    compute(rows).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that ``write_json`` wrote, or anyone; a missing file is an AnalysisException, columns that it lacks are null."""
    return spark.read.schema(schema).json(path)


def read_clusters(spark: SparkSession, path: str) -> DataFrame | None:
    """``(node, component)`` of a CSV table of clusters; none where there is no such table."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.csv(path, header=True, inferSchema=True).select("node", "component")


def append_runs(runs: DataFrame, path: str, commit: str | None = None) -> None:
    """Adds rows to a run log; a retried job adds whole files only.

    With ``commit``, the name of the job, its rows are a partition of their own that a
    repeated job replaces: however often it runs, the log has its rows once.
    """
    if commit is None:
        runs.write.mode("append").parquet(path)
    else:
        runs.withColumn("commit", F.lit(commit)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("commit").parquet(path)


def append_new_runs(runs: DataFrame, path: str, keys: list[str], commit: str) -> None:
    """Adds the runs whose keys no other job has logged yet; of repeated keys one."""
    spark = runs.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    new = runs.dropDuplicates(keys)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        logged = spark.read.parquet(path).where(F.col("commit") != commit)
        new = new.join(logged.select(*keys).distinct(), keys, "left_anti")
    append_runs(stash(new, "new-runs"), path, commit)
