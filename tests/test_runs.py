import tarfile

import pytest
from pyspark.sql import functions as F

from logweave.plans.parsing_run import follow_growing, parse_folder, read_lineage, read_registry, store_run
from logweave.operators.storage import update_registry
from logweave.rules.origins import BY_NAME, ORIGINS
from logweave.schema import REGISTRY
from logweave.streaming.incremental import flush_open, start_incremental
from logweave.streaming.tail import stream_log_tail

ALERT = "2024-02-1{d}T20:14:34.80710{d}+01:00\nErrors in file /x/y{d}.trc:\nORA-0060{d}: internal\n"


@pytest.fixture
def folder(tmp_path):
    logs = tmp_path / "logs"
    (logs / "d").mkdir(parents=True)
    (logs / "jas_1.log").write_text("03 Aug 2026 10:16:39,059 [WARN  ] - [42][RUNTIME] text failed\nno header\n")
    (logs / "d" / "alert_jde_1.log").write_text(ALERT.format(d=1) + ALERT.format(d=2))
    (logs / "strange.log").write_text("23-DEC-2024 11:44:26 * (CONNECT_DATA=(SERVICE_NAME=s1)) * 12514\n")
    return logs


def test_parse_folder(spark, folder, tmp_path):
    run = parse_folder(spark, str(folder), year=2026)
    rows = {(r["log_type"], r["timestamp"]): r for r in run.records.collect()}
    assert len(rows) == 4
    alert = rows["alert_jde", "11/02/24 20:14:34.807"]
    assert alert["extracted"] == {"ora_error_code": ["ORA-00601"], "trace_file": ["/x/y1.trc"]}
    assert alert["source_file"] == "d/alert_jde_1.log" and alert["file"] == "alert_jde_1.log"
    assert rows["jas", "03/08/26 10:16:39.059"]["level"] == "WARN"
    assert [r["raw_line"] for r in run.unmatched.collect()] == ["no header"]
    assert run.summary.first()["total_files"] == 3
    registry = update_registry(spark.createDataFrame([], REGISTRY), run.file_counts)
    again = parse_folder(spark, str(folder), registry, year=2026)
    assert {r["reason"] for r in again.files.collect()} == {"needs_reprocessing", "incremental"}
    store_run(run, str(tmp_path / "store"), str(tmp_path / "queue"))
    store_run(again, str(tmp_path / "store"), str(tmp_path / "queue"))
    assert spark.read.parquet(str(tmp_path / "store")).count() == 4


def test_packed_logs_and_the_end_of_a_run(spark, tmp_path):
    """Archive members are parsed like files; registry, lineage and history follow; growing files go to the stream."""
    logs = tmp_path / "logs"
    logs.mkdir()
    inside = logs / "alert_jde_9.log"
    inside.write_text(ALERT.format(d=3))
    strange = logs / "odd.log"
    strange.write_text("23-DEC-2024 11:44:26 * (CONNECT_DATA=(SERVICE_NAME=s1)) * 12514\n")
    with tarfile.open(logs / "old.tar.gz", "w:gz") as tar:
        tar.add(inside, "deep/alert_jde_9.log")
        tar.add(strange, "odd.log")
    inside.unlink()
    strange.unlink()
    (logs / "jas_1.log").write_text("03 Aug 2026 10:16:39,059 [WARN  ] - [42][RUNTIME] text\n")
    run = parse_folder(spark, str(logs), year=2026)
    assert {(r["log_type"], r["source_file"]) for r in run.records.collect()} >= {("alert_jde", "alert_jde_9.log"), ("listener", "odd.log")}
    paths = {n: str(tmp_path / n) for n in ("queue", "registry", "lineage", "history")}
    for _ in range(2):
        store_run(run, str(tmp_path / "store"), **paths)
    assert read_registry(spark, paths["registry"]).count() == 3
    assert spark.read.parquet(paths["history"]).count() == 2
    assert read_lineage(spark, paths["lineage"]).filter("source_file = 'odd.log'").first()["records"] == 1
    again = parse_folder(spark, str(logs), read_registry(spark, paths["registry"]), year=2026, force=True, growing=False)
    assert not again.files.filter("incremental and not packed").count()
    growing = [o for o in ORIGINS if o.incremental]
    assert growing
    kept = str(tmp_path / "followed")
    for text in ("first", "second"):
        with open(logs / "alert_jde_2.log", "a") as handle:
            handle.write(ALERT.format(d=5 if text == "first" else 6))
        follow_growing(spark, str(logs), kept, str(tmp_path / "state"), 2026)
    followed = {r["file_path"].rsplit("/", 1)[-1] for r in spark.read.parquet(kept).collect()}
    assert followed <= {"alert_jde_2.log", "jas_1.log"} and followed


def drain_stream(spark, logs, target, range_bytes=1 << 20):
    query = (
        stream_log_tail(spark, str(logs), range_bytes=range_bytes)
        .writeStream.format("parquet")
        .option("path", f"{target}/out")
        .option("checkpointLocation", f"{target}/cp")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(120)
    assert query.exception() is None
    return spark.read.parquet(f"{target}/out")


@pytest.mark.parametrize("range_bytes", [1 << 20, 13])
def test_tail_reads_each_line_once(spark, tmp_path, range_bytes):
    logs = tmp_path / "logs"
    logs.mkdir()
    target = tmp_path / "t"
    (logs / "a.log").write_bytes(b"one\ntwo\nthr")
    (logs / "b.log").write_bytes(b"\n")
    first = drain_stream(spark, logs, target, range_bytes)
    assert sorted(r["value"] for r in first.collect()) == ["", "one", "two"]
    with open(logs / "a.log", "ab") as handle:
        handle.write(b"ee\n" + b"x" * 40 + b"\nlast")
    second = drain_stream(spark, logs, target, range_bytes)
    mine = second.filter(F.col("file_path").endswith("a.log")).orderBy("line_no").collect()
    assert [r["value"] for r in mine] == ["one", "two", "three", "x" * 40]
    assert [r["line_no"] for r in mine] == [0, 4, 8, 14]
    # A shorter file takes its place.
    (logs / "a.log").write_bytes(b"new\n")
    third = drain_stream(spark, logs, target, range_bytes)
    assert third.filter("value = 'new'").count() == 1 and third.count() == 6


def test_growing_file_in_pieces(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    whole = "".join(ALERT.format(d=d) for d in range(4)).encode()
    cuts = [0, 50, 95, 200, len(whole)]
    store, state, checkpoint = (str(tmp_path / n) for n in ("store", "state", "cp"))
    batches = []
    for start, end in zip(cuts, cuts[1:]):
        with open(logs / "alert_jde.log", "ab") as handle:
            handle.write(whole[start:end])
        query = start_incremental(stream_log_tail(spark, str(logs)), BY_NAME["alert_jde"], store, state, checkpoint)
        query.awaitTermination(120)
        assert query.exception() is None
        batches += [p["batchId"] for p in query.recentProgress]
    held = spark.read.parquet(store)
    assert held.count() == 3  # the last event may still grow
    flush_open(spark, BY_NAME["alert_jde"], store, state, max(batches))
    rows = spark.read.parquet(store).orderBy("timestamp").collect()
    assert [r["message"] for r in rows] == [f"Errors in file /x/y{d}.trc:\nORA-0060{d}: internal" for d in range(4)]


def test_new_lines_of_a_batch_are_stored_once(spark, tmp_path, monkeypatch):
    """What an event held open from the batch before adds is stored beside the new lines, which are not written again."""
    from logweave.streaming import incremental

    written, store_rows = [], incremental.materialize

    def noted(df, label):
        made = store_rows(df, label)
        written.append((label, made.count()))
        return made

    monkeypatch.setattr(incremental, "materialize", noted)
    write = incremental.batch_writer(BY_NAME["alert_jde"], str(tmp_path / "store"), str(tmp_path / "state"))
    lines = "".join(ALERT.format(d=d) for d in range(4)).splitlines()
    half = len(lines) // 2
    for number, (low, high) in enumerate([(0, half), (half, len(lines))]):
        rows = [("alert_jde.log", at, lines[at]) for at in range(low, high)]
        write(spark.createDataFrame(rows, "file_path string, line_no bigint, value string"), number)
    assert [n for label, n in written if label == "stream-lines"] == [half, len(lines) - half]
    assert [0 < n < half for label, n in written if label == "stream-held"] == [True]
    assert spark.read.parquet(str(tmp_path / "store")).count() == 3


def test_no_file_is_in_neither_way(spark, tmp_path):
    """A growing format known by content only, and one packed: the batch and the stream account for both."""
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "db_notes.log").write_text(ALERT.format(d=1) + ALERT.format(d=2))
    (logs / "jas_1.log").write_text("03 Aug 2026 10:16:39,059 [WARN  ] - [42][RUNTIME] text\n")
    packed = tmp_path / "alert_jde_7.log"
    packed.write_text(ALERT.format(d=7))
    with tarfile.open(logs / "old.tar.gz", "w:gz") as tar:
        tar.add(packed, "alert_jde_7.log")
    run = parse_folder(spark, str(logs), year=2026, growing=False)
    assert {r["source_file"] for r in run.records.collect()} == {"jas_1.log", "alert_jde_7.log"}
    store, state = str(tmp_path / "store"), str(tmp_path / "state")
    for d in (3, 4, 5):
        follow_growing(spark, str(logs), store, state, 2026, max_bytes=70)
        with open(logs / "db_notes.log", "a") as handle:
            handle.write(ALERT.format(d=d))
    follow_growing(spark, str(logs), store, state, 2026)
    messages = [r["message"] for r in spark.read.parquet(store).orderBy("timestamp").collect()]
    assert messages == [f"Errors in file /x/y{d}.trc:\nORA-0060{d}: internal" for d in (1, 2, 3, 4)]
    # What batches have held does not pile up.
    assert len([p for p in (tmp_path / "state" / "alert_jde" / "held" / "open").iterdir() if p.is_dir()]) <= 2


def test_idle_events_are_flushed(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    store, state = str(tmp_path / "store"), str(tmp_path / "state")
    (logs / "alert_jde_1.log").write_text(ALERT.format(d=1))
    follow_growing(spark, str(logs), store, state, 2026, flush_after=0)
    (logs / "alert_jde_2.log").write_text(ALERT.format(d=2))
    follow_growing(spark, str(logs), store, state, 2026, flush_after=0)
    assert [r["message"] for r in spark.read.parquet(store).collect()] == ["Errors in file /x/y1.trc:\nORA-00601: internal"]


def test_a_backlog_is_read_in_several_batches(spark, tmp_path):
    from logweave.streaming.incremental import follow_tail

    logs = tmp_path / "logs"
    logs.mkdir()
    lines = [f"0{d} Aug 2026 10:16:39,059 [WARN  ] - [42][RUNTIME] text {d}" for d in range(1, 10)]
    (logs / "jas_1.log").write_text("\n".join(lines) + "\n")
    (logs / "other.log").write_text("x\n")
    path = str(logs / "jas_1.log")
    for _ in range(2):
        ran = follow_tail(spark, str(logs), BY_NAME["jas"], str(tmp_path / "s"), str(tmp_path / "st"), only=[path], max_bytes=150)
    assert ran == 0
    assert spark.read.parquet(str(tmp_path / "s")).count() == 9
    offsets = [p for p in (tmp_path / "st" / "checkpoint" / "offsets").iterdir() if p.name.isdigit()]
    assert len(offsets) >= 4
