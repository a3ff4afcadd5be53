"""Delimiters, logs, clusters and streams."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from leakwright.sources import files
from leakwright.streaming import incremental

NAMES = ("id", "note", "dx")


@pytest.mark.parametrize("delimiter", files.DELIMITERS)
def test_sniffs_a_delimiter_beside_others_in_quotes(spark, tmp_path, delimiter):
    others = [d for d in files.DELIMITERS if d != delimiter]
    lines = [delimiter.join(NAMES)]
    for i in range(40):
        noise = "".join(others) * (i % 7)
        lines.append(delimiter.join([str(i), f'"a{noise}b, said ""no"" {delimiter} x"', "nv"]))
    path = tmp_path / "table"
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    head = files.head_of(spark, str(path))
    assert files.sniff_delimiter(head) == delimiter and not files.has_quoted_breaks(head)
    rows = files.read_delimited(spark, str(path), NAMES)
    assert rows.count() == 40 and rows.where("id = 3").first()["note"] == f'a{"".join(others) * 3}b, said "no" {delimiter} x'


def test_line_ends_in_quotes_make_one_record(spark, tmp_path):
    path = tmp_path / "table"
    path.write_text('id;note;dx\n1;"two\nlines; and\n\nmore";nv\n2;plain;mel\n', encoding="utf-8")
    assert files.has_quoted_breaks(files.head_of(spark, str(path)))
    rows = {r["id"]: r["note"] for r in files.read_delimited(spark, str(path), NAMES).collect()}
    assert rows == {1: "two\nlines; and\n\nmore", 2: "plain"}


def test_counts_of_columns():
    assert files.column_counts('a,b\n1,"x,y\n,z"\n"q""r,",2\n\nlast', ",") == [2, 2, 2, 1]
    assert files.column_counts("", ",") == [] and files.column_counts("a b", ",") == [1]
    assert files.sniff_delimiter("a|b|c") == "|" and files.sniff_delimiter("plain") == ","
    # The header alone would say comma.
    assert files.sniff_delimiter("id;note, with, commas, inside;dx\n1;x;y\n2;z;w\n") == ";"
    # A last record that the head cuts off does not count.
    assert files.sniff_delimiter("a\tb\n" + "1\t2\n" * 2500 + "3") == "\t"


def test_missing_files_and_columns_are_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.read_delimited(spark, str(tmp_path / "none"))
    (tmp_path / "empty").write_text(" \n")
    with pytest.raises(ValueError, match="is empty"):
        files.read_delimited(spark, str(tmp_path / "empty"))
    (tmp_path / "few").write_text("id,note\n1,x\n")
    with pytest.raises(ValueError, match="dx"):
        files.read_delimited(spark, str(tmp_path / "few"), NAMES)


def test_a_repeated_job_is_logged_once(spark, tmp_path):
    path = str(tmp_path / "log")
    one = spark.createDataFrame([(1, "a"), (2, "b")], "seed int, arm string")
    for _ in range(2):
        files.append_runs(one, path, "job-1")
    files.append_runs(one.limit(1), path, "job-2")
    assert spark.read.parquet(path).groupBy("commit").count().orderBy("commit").collect() == [("job-1", 2), ("job-2", 1)]
    more = spark.createDataFrame([(2, "b"), (3, "c"), (3, "c")], "seed int, arm string")
    for _ in range(2):
        files.append_new_runs(more, path, ["seed", "arm"], "job-3")
    assert [r["seed"] for r in spark.read.parquet(path).where("commit = 'job-3'").collect()] == [3]
    files.append_new_runs(more, str(tmp_path / "other"), ["seed", "arm"], "job-1")
    assert spark.read.parquet(str(tmp_path / "other")).count() == 2


def findings(spark, path):
    return sorted(tuple(r) for r in spark.read.schema("id_a long, id_b long, method string").parquet(path).collect())


def test_refresh_by_method_drops_replays_and_clears_what_finds_nothing(spark, tmp_path):
    path = str(tmp_path / "findings")
    batch = lambda *rows: spark.createDataFrame(list(rows), "id_a long, id_b long, method string")
    first = batch((1, 2, "exact"), (1, 2, "exact"), (3, 4, "odd name/é"), (None, None, "exact"))
    assert incremental.refresh_batch(first, 0, path)
    assert findings(spark, path) == [(1, 2, "exact"), (3, 4, "odd name/é")]
    assert not incremental.refresh_batch(batch((9, 9, "exact")), 0, path)  # a replay
    assert findings(spark, path) == [(1, 2, "exact"), (3, 4, "odd name/é")]
    assert incremental.refresh_batch(batch((5, 6, "cosine"), (None, None, "odd name/é")), 1, path)
    assert findings(spark, path) == [(1, 2, "exact"), (5, 6, "cosine")]
    assert incremental.refresh_batch(batch(), 2, path)
    assert findings(spark, path) == [(1, 2, "exact"), (5, 6, "cosine")]


def test_refresh_stream_and_its_repeat(spark, tmp_path):
    source, path = tmp_path / "in", str(tmp_path / "findings")
    rows = spark.createDataFrame([(1, 2, "exact"), (3, 4, "cosine")], "id_a long, id_b long, method string")
    rows.write.parquet(str(source))
    for n in range(2):
        stream = spark.readStream.schema(rows.schema).parquet(str(source))
        incremental.refresh_findings(stream, path, str(tmp_path / f"checkpoint-{n}")).awaitTermination(60)
        assert findings(spark, path) == [(1, 2, "exact"), (3, 4, "cosine")]


def test_windowed_accuracy_leaves_late_rows_out(spark, tmp_path):
    at = lambda minute: dt.datetime(2024, 1, 1, 0, minute)
    schema = "ts timestamp, y_true string, y_pred string"
    # Rows beyond the watermark of an earlier file come last; each file is a run of its own.
    for k, rows in enumerate([[(at(1), "a", "a"), (at(2), "a", "b"), (at(7), "b", "b")], [(at(40), "a", "a")], [(at(3), "a", "a"), (at(41), "b", "a")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        out = incremental.windowed_accuracy(stream, "ts").select(F.col("window.start").alias("start"), "n", "accuracy")
        writer = out.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint"))
        writer.trigger(availableNow=True).start().awaitTermination(120)
    got = {r["start"].minute: (r["n"], r["accuracy"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {0: (2, 0.5), 5: (1, 1.0)}


def test_clusters_are_read_or_none(spark, tmp_path):
    assert files.read_clusters(spark, str(tmp_path / "none.csv")) is None
    files.write_csv(spark.createDataFrame([("a", "a"), ("b", "a")], "node string, component string"), str(tmp_path / "clusters"))
    assert sorted(map(tuple, files.read_clusters(spark, str(tmp_path / "clusters")).collect())) == [("a", "a"), ("b", "a")]


def test_configuration_of_roles(spark, tmp_path):
    from leakwright.session import read_roles

    (tmp_path / "c.yaml").write_text("seed: 7\ndataset:\n  id: item\n  classes: [a, b]\naudit:\n  phash: {max_hamming: 12}\npaths:\n  raw: data/raw\n  out: /out\n")
    (tmp_path / "c.json").write_text('{"dataset": {"group": "g", "label": "y"}}')
    (tmp_path / "empty.yaml").write_text("")
    roles = read_roles(spark, str(tmp_path / "c.yaml"))
    assert (roles.id, roles.group, roles.classes, roles.seed) == ("item", "lesion_id", ("a", "b"), 7)
    assert roles.get("audit.phash.max_hamming") == 12 and roles.get("audit.none", 3) == 3
    assert roles.path("paths.raw", "/root/") == "/root/data/raw" and roles.path("paths.out", "/root") == "/out"
    with pytest.raises(KeyError):
        roles.path("paths.none", "/")
    other = read_roles(spark, str(tmp_path / "c.json"))
    assert (other.group, other.label, other.seed) == ("g", "y", 42)
    assert read_roles(spark, str(tmp_path / "empty.yaml")).id == "image_id"
    with pytest.raises(FileNotFoundError):
        read_roles(spark, str(tmp_path / "none.yaml"))
