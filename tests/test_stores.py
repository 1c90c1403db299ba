import datetime
import json
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from logweave.operators import search, serve, storage

SCHEMA = "log_type string, event_date date, timestamp string, message string, file_path string, line_no bigint"
DAY = datetime.date(2024, 1, 1)


def frame(spark, *rows):
    return spark.createDataFrame([("t", d, s, m, f, n) for d, s, m, f, n in rows], SCHEMA)


def test_daily_merge_keeps_stored_rows(spark, tmp_path):
    path = str(tmp_path / "store")
    other = datetime.date(2024, 1, 2)
    storage.write_daily(frame(spark, (DAY, "x", "m", "old", 1), (None, None, "m", "old", 2), (other, "y", "m", "old", 3)), path)
    storage.write_daily(frame(spark, (DAY, "x", "m", "new", 1), (None, None, "m", "new", 2), (DAY, "z", "m", "new", 5), (DAY, "z", "m", "new", 4)), path)
    rows = spark.read.schema(SCHEMA).parquet(path).orderBy("line_no").collect()
    assert [(r["file_path"], r["line_no"]) for r in rows] == [("old", 1), ("old", 2), ("old", 3), ("new", 4)]


def test_stored_columns_survive_a_narrower_write(spark, tmp_path):
    path = str(tmp_path / "store")
    storage.write_daily(frame(spark, (DAY, "x", "m", "old", 1)).withColumn("event_type", F.lit("e")), path)
    storage.write_daily(frame(spark, (DAY, "x", "m", "new", 1), (DAY, "y", "m", "new", 2)), path)
    rows = spark.read.parquet(path).orderBy("line_no").collect()
    assert [(r["file_path"], r["event_type"]) for r in rows] == [("old", "e"), ("new", None)]


def test_envelope_is_one_document_per_day(spark, tmp_path):
    path = tmp_path / "json"
    rows = frame(spark, *[(DAY, str(i), f"m{i}", "f", i) for i in range(50)], (None, None, "u", "f", 1))
    storage.write_daily_json(rows, str(path))
    folder = path / "log_type=t" / f"event_date={DAY}"
    document = json.loads("".join(p.read_text() for p in sorted(folder.glob("part-*"))))
    assert document["log_type"] == "t" and document["date"] == str(DAY)
    assert [r["line_no"] for r in document["records"]] == list(range(50))
    undated = path / "log_type=t" / "event_date=__HIVE_DEFAULT_PARTITION__"
    assert json.loads("".join(p.read_text() for p in sorted(undated.glob("part-*"))))["date"] == "sin_fecha"


def test_files_to_process(spark):
    registry = spark.createDataFrame([("same", 1, False), ("grown", 1, False), ("flagged", 1, True)], "rel_path string, size_bytes bigint, needs_reprocessing boolean")
    files = spark.createDataFrame([("same", 1, False), ("grown", 2, False), ("flagged", 1, False), ("new", 1, False), ("tail", 1, True)], "rel_path string, size_bytes bigint, incremental boolean")
    found = {r["rel_path"]: r["reason"] for r in storage.files_to_process(files, registry).collect()}
    assert found == {"same": "unchanged", "grown": "size_changed", "flagged": "needs_reprocessing", "new": "new", "tail": "incremental"}
    assert storage.files_to_process(files, registry, force=True).filter("process").count() == 5


def test_documents(spark):
    rows = spark.createDataFrame([("s", "14/02/20 20:14:34.807", "a", "t"), ("s", None, "b", "t")], "source_file string, timestamp string, message string, log_type string")
    documents = search.prepare_documents(rows, F.lit("2030-01-01T00:00:00"))
    assert [r["@timestamp"] for r in documents.orderBy("message").collect()] == ["2020-02-14T20:14:34.807000", "2030-01-01T00:00:00"]
    assert documents.select("_id").distinct().count() == 2
    assert "raw_line" not in json.loads(search.document_json(documents).first()["body"])
    kept = search.delete_documents(documents, search.where_date_range("2020-02-14", "2020-02-14"))
    assert [r["message"] for r in kept.collect()] == ["b"]
    assert tuple(search.deletion_counts(documents, search.where_source_file("s")).first()) == (2, 0)
    assert search.delete_documents(documents).count() == 0
    numbered = documents.withColumn("seq", F.lit(1))
    changed = numbered.withColumn("level", F.lit("WARN"))
    assert {r["level"] for r in search.upsert_documents(changed, numbered).collect()} == {"WARN"}
    assert search.upsert_documents(changed.filter("message = 'a'"), numbered, mode="rebuild").count() == 1


def test_pages(spark):
    rows = spark.range(120).select(F.col("id").alias("line_no"), F.lit("f").alias("file"), F.timestamp_seconds(F.col("id") % 7).cast("timestamp_ntz").alias("event_ts"))
    seen = [r["line_no"] for n in (1, 2, 3) for r in serve.page(rows, n).collect()]
    assert len(seen) == len(set(seen)) == 120
    assert tuple(serve.page_totals(rows).first()) == (120, 3)
    assert tuple(serve.page_totals(rows.limit(0)).first()) == (0, 1)


def test_keep_first_with_a_hot_key(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 50).alias("k"), (20_000 - F.col("id")).alias("o"))
    found = {r["k"]: r["o"] for r in storage.keep_first(rows, ["k"], ["o"]).collect()}
    expected = duckdb.sql("select k, min(o) from (select case when id % 3 = 0 then null else id % 50 end as k, 20000 - id as o from range(20000) t(id)) group by k").fetchall()
    assert found == dict(expected)


def test_lineage_accumulates(spark):
    schema = "log_type string, event_date date, source_file string, line_no bigint"
    first = storage.source_lineage(spark.createDataFrame([("t", DAY, "a", 4), ("t", DAY, "a", 2)], schema))
    both = storage.source_lineage(spark.createDataFrame([("t", DAY, "b", 1), ("t", DAY, "a", 9)], schema), first)
    assert sorted((r["source_file"], r["first_seen"], r["records"]) for r in both.collect()) == [("a", 2, 3), ("b", 1, 1)]


def test_registry_round_trip(spark):
    old = spark.createDataFrame([("a", 1, 5, 0, False), ("b", 2, 6, 0, False)], "rel_path string, size_bytes bigint, records_count bigint, unmatched_lines bigint, needs_reprocessing boolean")
    runs = spark.createDataFrame([("b", 3, 7, 2), ("c", 4, 8, 0)], "rel_path string, size_bytes bigint, records_count bigint, unmatched_lines bigint")
    found = {r["rel_path"]: (r["size_bytes"], r["needs_reprocessing"]) for r in storage.update_registry(old, runs).collect()}
    assert found == {"a": (1, False), "b": (3, True), "c": (4, False)}


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_formats(spark, tmp_path, fmt):
    from logweave.sources.tables import read_parsed

    storage.write_daily(frame(spark, (DAY, "x", "m", "f", 1), (DAY, "y", "  ", "f", 2)), str(tmp_path / fmt), fmt)
    assert read_parsed(spark, str(tmp_path / fmt), "t", fmt).count() == 1


def test_store_reads_only_affected_partitions(spark, tmp_path):
    """Day bounds and origins reach the scan as partition filters; undated and unnamed records have their branches."""
    schema = "log_type string, event_date date, timestamp string, message string, file_path string, line_no bigint"
    day = lambda d: datetime.date(2024, 1, d)
    rows = [("a", day(d), f"t{d}", "m", "f", d) for d in range(1, 10)] + [("b", day(3), "t", "m", "f", 1), ("a", None, "t", "m", "f", 2)]
    spark.createDataFrame(rows, schema).write.partitionBy("log_type", "event_date").parquet(f"{tmp_path}/store")
    stored = spark.read.parquet(f"{tmp_path}/store")
    found = lambda new: {
        (r.log_type, r.event_date) for r in storage.affected(stored, spark.createDataFrame(new, schema)).collect()
    }
    new = [("a", day(3), "x", "y", "f", 1), ("a", day(5), "x", "y", "f", 1)]
    assert found(new) == {("a", day(3)), ("a", day(5))}
    assert found([("a", None, "x", "y", "f", 1)]) == {("a", None)}
    assert found([(None, day(3), "x", "y", "f", 1), ("c", day(3), "x", "y", "f", 1)]) == set()
    assert found([]) == set()
    plan = storage.affected(stored, spark.createDataFrame(new, schema))._jdf.queryExecution().toString()
    filters = re.findall(r"PartitionFilters: \[([^\]]*)\]", plan)
    assert any("event_date" in f and "log_type" in f for f in filters)


def test_json_documents_are_merged_by_day(spark, tmp_path):
    from logweave.sources.tables import read_parsed

    path, other = str(tmp_path / "json"), datetime.date(2024, 1, 2)
    storage.write_daily_json(frame(spark, (DAY, "x", "m", "old", 1), (None, None, "u", "old", 2)), path)
    storage.write_daily_json(frame(spark, (other, "y", 'say "hi", {[', "new", 3)), path)
    storage.write_daily_json(frame(spark, (DAY, "x", "m", "new", 1), (DAY, "z", "]}", "new", 4)), path)
    rows = read_parsed(spark, path, "t", "json").orderBy("line_no").collect()
    assert [(r["event_date"], r["file_path"], r["message"]) for r in rows] == [
        (DAY, "old", "m"), (None, "old", "u"), (other, "new", 'say "hi", {['), (DAY, "new", "]}"),
    ]
    folder = tmp_path / "json" / "log_type=t" / f"event_date={DAY}"
    document = json.loads("".join(p.read_text() for p in sorted(folder.glob("part-*"))))
    assert [r["message"] for r in document["records"]] == ["]}", "m"]


def test_lineage_of_the_same_run_twice(spark):
    schema = "log_type string, event_date date, source_file string, line_no bigint"
    run = spark.createDataFrame([("t", DAY, "a", 4), ("t", DAY, "a", 2), (None, None, "a", 1)], schema)
    later = spark.createDataFrame([("t", DAY, "a", 9)], schema)
    first = storage.source_lineage(run)
    twice = storage.source_lineage(later, storage.source_lineage(run, first))
    again = storage.source_lineage(later, twice)
    expected = {("t", 2, 9, 3), (None, 1, 1, 1)}
    for found in (twice, again):
        assert {(r["log_type"], r["first_seen"], r["last_seen"], r["records"]) for r in found.collect()} == expected


def test_a_version_stays_until_the_next_is_complete(spark, tmp_path):
    path = str(tmp_path / "table")
    assert storage.read_version(spark, path) is None
    for n in range(3):
        storage.write_version(spark.createDataFrame([(n,)], "n int"), path)
    (tmp_path / "table" / "version-00000009").mkdir()  # a write that failed
    assert storage.read_version(spark, path).first()["n"] == 2
    storage.write_version(storage.read_version(spark, path).withColumn("n", F.col("n") + 5), path)
    assert storage.read_version(spark, path).first()["n"] == 7


def test_templates_in_three_layouts(spark, tmp_path):
    from logweave.sources.tables import read_templates

    clusters = [{"cluster_id": "1", "template": "a <*>", "size": 2}, {"cluster_id": "2", "template": "b", "size": 1}]
    (tmp_path / "list.json").write_text(json.dumps({"clusters": clusters}, indent=1))
    (tmp_path / "map.json").write_text(json.dumps({"clusters": {c["cluster_id"]: c for c in clusters}}))
    storage.write_clusters(spark.createDataFrame([(1, 2, 66.7, "a <*>"), (2, 1, 33.3, "b")], "cluster_id int, size int, percentage double, template string"), str(tmp_path / "w"))
    for name in ("list.json", "map.json", "w/full", "w/clusters"):
        rows = read_templates(spark, f"{tmp_path}/{name}").collect()
        assert {(r["cluster_id"], r["template"], r["size"]) for r in rows} == {("1", "a <*>", 2), ("2", "b", 1)}
