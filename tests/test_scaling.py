"""What runs once, in how many tasks, and in what splits."""

import io
import tarfile

import pytest
from pyspark.sql import functions as F

from checks import inputs, templates
from logweave.operators import mining, storage
from logweave.session import small_splits, spread
from logweave.sources import archives


def counted_records(spark, n=60):
    """Records whose messages count how often they are made."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def message(i):
        made.add(1)
        return [f"ORA-{i:05} request failed for user {i}", f"START block {i % 5}", f"User: U{i} from 10.0.0.{i}"][i % 3]

    rows = spark.range(0, n, 1, 2).withColumn("message", message.asNondeterministic()(F.col("id").cast("int")))
    return rows.select(F.lit("app_0.log").alias("file"), F.col("id").alias("line_no"), "message"), made


@pytest.mark.parametrize(
    "name, times",
    [
        ("snk_9_write_clusters", 1),
        ("tpl_8_patterns_match_members", 1),
        ("joi_5_classify_by_cluster_regex", 2),
        ("joi_2_mined_rules_classify_own_input", 1),
    ],
)
def test_records_are_not_made_again_for_every_use(spark, monkeypatch, name, times):
    records, made = counted_records(spark)
    monkeypatch.setattr(inputs, "records", lambda *_: records)
    assert templates.QUERIES[name](spark, "").collect()
    assert made.value <= times * 60


@pytest.mark.parametrize("mine", [mining.mine_templates_first_match, mining.mine_templates_best_match])
def test_messages_are_checked_and_mined_from_one_copy(spark, mine):
    records, made = counted_records(spark)
    mined = mine(records.select(F.lit("a").alias("origin"), F.col("line_no").alias("seq"), "message"))
    assert mined.clusters.agg(F.sum("size")).first()[0] == 60
    assert made.value == 60


def test_archives_are_unpacked_by_many_tasks_and_no_line_shuffles(spark, tmp_path, monkeypatch):
    for i in range(12):
        data = f"first {i}\nsecond\n".encode()
        with tarfile.open(tmp_path / f"{i}.tar.gz", "w:gz") as tar:
            entry = tarfile.TarInfo(f"{i}.log")
            entry.size = len(data)
            tar.addfile(entry, io.BytesIO(data))
    tasks = {}

    def stored(df, label):
        tasks[label] = df.select(F.spark_partition_id()).distinct().count()
        return storage.materialize(df, label)

    monkeypatch.setattr(archives, "materialize", stored)
    lines = archives.read_archived_logs(spark, str(tmp_path))
    assert lines.count() == 24
    assert tasks["archive-lines"] > 1
    assert "BroadcastHashJoin" in lines._jdf.queryExecution().executedPlan().toString()


def test_rows_are_spread_by_their_number(spark):
    df = spark.range(0, 1000, 1, 1)
    assert spread(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert spread(df, 10).rdd.getNumPartitions() == 100
    assert sorted(r.id for r in spread(df, 10).collect()) == list(range(1000))


def test_day_store_reads_small_splits(spark, tmp_path, monkeypatch):
    key, seen = "spark.sql.files.maxPartitionBytes", []
    before = spark.conf.get(key)

    def watched(session, *size):
        seen.append(session)
        return small_splits(session, *size)

    monkeypatch.setattr(storage, "small_splits", watched)
    row = "select 'a' as log_type, date'2024-01-01' as event_date, 't' as timestamp, 'm' as message, 'f' as file_path, 1L as line_no"
    storage.write_daily(storage.materialize(spark.sql(row), "day"), str(tmp_path / "store"))
    assert seen and spark.conf.get(key) == before
    assert spark.read.parquet(str(tmp_path / "store")).count() == 1
    with small_splits(spark, 1 << 20):
        assert spark.conf.get(key) == str(1 << 20)
