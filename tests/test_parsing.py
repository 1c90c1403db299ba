import tarfile

import pytest
from pyspark.sql import functions as F

from logweave.functions import text
from logweave.functions.entities import extract_entities
from logweave.functions.levels import implicit_level, map_level
from logweave.functions.timestamps import event_date, generic_timestamp, iso_timestamp, normalize_timestamp
from logweave.operators import detect, events
from logweave.operators.enrich import enrich_records
from logweave.rules.origins import BY_NAME, ORIGINS, Extractor
from logweave.sources.archives import read_archived_logs
from logweave.sources.files import read_log_lines, sample_lines, scan_log_files

STAMPS = [
    ("23-DEC-2024 11:44:26", "23/12/24 11:44:26.000"),
    ("Sun Aug  9 02:00:07.608092", "09/08/26 02:00:07.608"),
    ("Aug 20 19:14:03.206883", "20/08/26 19:14:03.206"),
    ("31 jul 2026 23:34:03,027", "31/07/26 23:34:03.027"),
    ("07 ago 2026 01:51:46.148", "07/08/26 01:51:46.148"),
    ("2020-02-14T20:14:34.807103+01:00", "14/02/20 20:14:34.807"),
    ("13/02/2024 10:00:00", "13/02/24 10:00:00.000"),
    ("02/13/2024 10:00:00.5", "13/02/24 10:00:00.500"),
    ("03/04/2024 10:00:00", "03/04/24 10:00:00.000"),
    ("3-4-24 10:00:00", "03/04/24 10:00:00.000"),
    ("13/13/2024 10:00:00", None),
    ("00/04/2024 10:00:00", None),
    ("Jun 14 15:16:01", "14/06/26 15:16:01.000"),
    ("2023-10-11 12:34:56", None),
    ("  Jun 14 15:16:01 ", "14/06/26 15:16:01.000"),
    ("", None),
    (None, None),
]


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    return [r[0] for r in df.withColumn("y", expression(F.col("x"))).orderBy("i").select("y").collect()]


def test_normalize_timestamp(spark):
    assert column(spark, [s for s, _ in STAMPS], lambda c: normalize_timestamp(c, 2026)) == [e for _, e in STAMPS]


def test_generic_timestamp(spark):
    raw = ["2023-10-11 12:34:56", "Time 06-JUL-2026 21 12 31", "11 abr 2026 02:04:07,195", "Jun 4 15:16:01", "Wed Jun 24 16:26:13 CEST 2025", "x"]
    expected = [
        "11/10/23 12:34:56.000", "06/07/26 21:12:31.000", "11/01/26 02:04:07.195", "04/06/26 15:16:01.000",
        "24/06/25 16:26:13.000", None,
    ]
    assert column(spark, raw, generic_timestamp) == expected


def test_dates_and_iso(spark):
    values = ["14/02/20 20:14:34.807", "31/02/20 00:00:00.000", "garbage", "2024-01-01 00:00:00", "14/02/20 20:14:34.000", None]
    assert [str(d) for d in column(spark, values, event_date)] == ["2020-02-14", "None", "None", "None", "2020-02-14", "None"]
    assert column(spark, values, lambda c: iso_timestamp(c, F.lit("run"))) == [
        "2020-02-14T20:14:34.807000", "run", "run", "run", "2020-02-14T20:14:34", "run",
    ]


def test_levels(spark):
    assert column(spark, ["SEVERE", " warn ", "odd", None], map_level) == ["ERROR", "WARN", "odd", None]
    messages = ["it failed", "will retry", "can't open", "fine", None]
    assert column(spark, messages, lambda c: implicit_level(F.lit(None).cast("string"), c)) == ["ERROR", "WARN", "ERROR", "INFO", "INFO"]


def test_separators_and_ignored_lines(spark):
    assert column(spark, ["=====\n-----  \ntext\n=====", "a\n", None], text.strip_leading_separators) == ["text\n=====", "a", None]
    rules = ("drop me",)
    values = ["a\nx drop me\nb", "drop me\ndrop me", "a\nORCHESTRATION TRACING: [1]"]
    assert column(spark, values, lambda c: text.filter_message_lines(c, rules)) == ["a\nb", None, "a"]


def test_many_leading_separators(spark):
    long = "=====\n" * 50_000 + "end"
    assert column(spark, [long], text.strip_leading_separators) == ["end"]


def test_condense_trace(spark):
    whole = 'ORCHESTRATION TRACING: [{"type":"t","name":"n","output":"o","input":"x"}, {"type":"u"}]'
    cut = 'pre ORCHESTRATION TRACING: [{"type":"t","name":"n","output":"o","input":[1]'
    assert column(spark, [whole, cut, "other"], text.condense_trace_json) == [
        'ORCHESTRATION TRACING: [{"type":"t","name":"n","output":"o"},{"type":"u","name":"","output":""}]',
        'pre ORCHESTRATION TRACING: [{"type":"t","name":"n","output":"o"}]',
        "other",
    ]


def test_result_names(spark):
    names = ["a/2024_01_02_e1_root.parquet", "sin_fecha_x_y.json", "odd.parquet", "2024_1_x_y.json"]
    df = spark.createDataFrame([(n,) for n in names], "p string")
    date, log_type = text.parse_result_name(F.col("p"))
    assert [tuple(r) for r in df.select(date, log_type).collect()] == [
        ("2024-01-02", "e1_root"), ("sin_fecha", "x_y"), (None, None), (None, None),
    ]


def test_entities(spark):
    rules = (
        Extractor("code", "ORA-", (r"(?P<c>ORA-\d+)",)),
        Extractor("port", "PORT", (r"PORT=(?P<port>\d+)",)),
        Extractor("module", "Mod", (r"\[(?P<m>A|B)\]", r"other:\s*(?P<m>\w+)")),
        Extractor("pair", ".c", (r"(?P<f>\w+\.c) Line (?P<l>\d+)",)),
        Extractor("far", "near", (r"near.*(?P<x>Z\d)",)),
        Extractor("anywhere", None, (r"id (?P<i>\d+)",)),
    )
    message = (
        "ORA-1 ora-2 ORA-1 PORT=70000 PORT=80 other: q Mod x [B] src.c Line 7 id 5 " + "." * 30 + " near " + "y" * 500 + "Z1"
    )
    df = spark.createDataFrame([(message,), (None,)], "message string")
    found = [r["extracted"] for r in extract_entities(df, rules).collect()]
    assert found[0] == {
        "code": ["ORA-1", "ora-2"],
        "port": ["80"],
        "module": ["B"],
        # The anchor's window starts at the anchor, so the name before it is found by the search of the whole text.
        "pair": ["src.c", "7"],
        # Nothing within 400 characters of the anchor, so the whole text is searched.
        "far": ["Z1"],
        "anywhere": ["5"],
    }
    assert found[1] == {}


HEADERS = {
    "ais": ("07 ago 2026 01:51:46,148 [WARN  ] USER1 - [CUSTOM] hello\nmore", "ais_event", "hello\nmore"),
    "alert_jde": ("2020-02-14T20:14:34.807103+01:00\nErrors in file /x/y.trc:\nORA-00600: internal", "alert_jde_event",
                  "Errors in file /x/y.trc:\nORA-00600: internal"),
    "bssv": ("31 jul 2026 23:34:03,027 [INFO  ] - [BSSVFRAMEWORK] [Context ID: 1.2:3] [CLIENT1][P1] text\ntail", "bssv", "text"),
    "e1root": ("03 Aug 2026 10:16:39,059 [APP] - [12345][JAS] text", "e1root_with_pid", "text"),
    "jas": ("03 Aug 2026 10:16:39,059 [WARN  ] - [42][RUNTIME] text", "jas", "text"),
    "jde": ("4242/99 WRK:x\tSun Aug  9 02:00:07.608092\tfile.c12\n\ttext", "jde", "text"),
    "jdedebug": ("Aug 20 19:14:03.206883 - 42/7 COMP text", "jdedebug_pid_tid", "text"),
    "listener": ("23-DEC-2024 11:44:26 * (CONNECT_DATA=(SERVICE_NAME=s1)) * 12514", "db_listener_connection",
                 "* (CONNECT_DATA=(SERVICE_NAME=s1)) * 12514"),
    "weblogic": ("29 Jun 2026 02:04:07,195 [WARN] USER1 - [APP1][COMP] text\nmore\n29 Jun 2026 not a header\nlost", "weblogic", "text\nmore"),
}


@pytest.mark.parametrize("name", sorted(HEADERS))
def test_each_format(spark, lines, name):
    body, pattern, message = HEADERS[name]
    parsed = events.parse_lines(lines("noise\n" + body), BY_NAME[name])
    row = enrich_records(parsed.records, BY_NAME[name], 2026).orderBy("line_no").collect()[-1]
    assert (row["pattern"], row["message"]) == (pattern, message)
    assert row["timestamp"] is not None and row["event_date"] is not None and row["level"]


def test_lines_of_no_event_are_kept(lines):
    parsed = events.parse_lines(lines("early\n" + HEADERS["weblogic"][0]), BY_NAME["weblogic"])
    assert sorted(r["raw_line"] for r in parsed.unmatched.collect()) == ["29 Jun 2026 not a header", "early", "lost"]


def test_header_inside_a_line(lines):
    one = "07 Aug 2026 01:51:46,148 [WARN] U1 - [AIS] first 08 Aug 2026 01:51:46,148 [INFO] U2 - [AIS] second"
    rows = events.parse_lines(lines(one), BY_NAME["ais"]).records.orderBy("timestamp").collect()
    assert [(r["user"], r["message"]) for r in rows] == [("U1", "first"), ("U2", "second")]


def test_other_groups_go_to_fields(lines):
    debug = "Level Program Library Module Statement Procedure\n3 prog lib mod 12 proc name"
    rows = events.parse_lines(lines(debug), BY_NAME["jdedebug"]).records.orderBy("line_no").collect()
    # Both carry no message, and this format has ignore rules, so nothing of them is stored.
    assert rows == []
    bssv = events.parse_lines(lines(HEADERS["bssv"][0]), BY_NAME["bssv"]).records.first()
    assert bssv["fields"] == {"context_id": "1.2:3", "client": "CLIENT1"} and bssv["pid"] == "P1"


def test_numbering_does_not_depend_on_blocks(spark, lines):
    body = "\n".join("S" if i % 7 == 3 else "T" if i % 11 == 0 else "-" for i in range(200))
    df = lines(body)
    start = F.col("value").isin("S", "T")

    def run(block):
        numbered = events.number_events(df, start, opens=F.col("value") == "S", block_rows=block)
        return [tuple(r) for r in numbered.orderBy("line_no").select("line_no", "event_no", "in_event").collect()]

    whole = run(10_000)
    assert run(3) == whole and run(16) == whole
    n, inside = 0, False
    for i, value in enumerate(body.split("\n")):
        if value in "ST":
            n, inside = n + 1, value == "S"
        assert whole[i] == (i + 1, n, inside)


def test_timestamp_grouping_without_rules(lines):
    found = events.split_events_by_timestamp(lines("a\n b\nc\n.d\n|e"), ()).orderBy("event_no").collect()
    assert [r["text"] for r in found] == ["a\n b", "c\n.d\n|e"]


def test_detection(spark, lines):
    names = ["alert_jde_2026.log", "ged_jde_74715", "AIS-server.log", "COV_HTML_LOG.log", "x.log"]
    assert column(spark, names, detect.type_by_name) == ["alert_jde", "jde", "ais", "e1root", "unknown"]
    for origin in ("jas", "listener", "weblogic"):
        body = "junk-free\n" if origin == "none" else ""
        found = detect.detect_by_content(lines(body + HEADERS[origin][0])).first()
        assert found["log_type"] in (origin, "e1root", "ais") or origin == found["log_type"]
    late = "\n".join([""] * 100 + [HEADERS["listener"][0]])
    assert detect.detect_by_content(lines(late)).first()["log_type"] == "listener"
    assert detect.detect_by_content(lines(late), max_lines=100).first()["log_type"] == "unknown"
    assert detect.detect_by_content(lines(late), max_bytes=50).first()["log_type"] == "unknown"


def test_every_rule_compiles_in_both_dialects(spark):
    import re

    from logweave.functions.regex import java_regex
    from logweave.rules.masks import CUSTOM_MASKS, DOMAIN_MASKS, PLACEHOLDER_PATTERNS

    rules = [p for o in ORIGINS for p in (*o.filenames, *o.ignore, *o.timestamps, *[h for _, h in o.headers])]
    rules += [p for o in ORIGINS for e in o.extractors for p in e.patterns]
    rules += [p for p, _ in CUSTOM_MASKS] + [p for p, _ in DOMAIN_MASKS] + list(PLACEHOLDER_PATTERNS.values())
    for rule in rules:
        re.compile(rule)
    df = spark.range(1).select([F.lit("x").rlike(java_regex(p)).alias(f"c{i}") for i, p in enumerate(rules)])
    assert len(df.first()) == len(rules)


def test_read_lines_over_many_splits(spark, tmp_path):
    rows = [f"line {i} " + "x" * (i % 50) + ("\r" if i % 9 == 0 else "") for i in range(5000)]
    (tmp_path / "a.log").write_bytes(("\n".join(rows) + "\n").encode())
    (tmp_path / "b.log").write_bytes(b"one\n\xff two")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        read = read_log_lines(spark, str(tmp_path)).orderBy("file_path", "line_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    mine = [r for r in read if r["file_path"].endswith("a.log")]
    assert [r["line_no"] for r in mine] == list(range(1, 5001))
    assert [r["value"] for r in mine] == rows
    assert len(read) == 5002


def test_scan_and_sample(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.log").write_text("x\n\ny\n")
    (tmp_path / "b.txt").write_text("x")
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "c.log").write_text("x")
    found = scan_log_files(spark, str(tmp_path), exclude_prefix="out").collect()
    assert [(r["rel_path"], r["size_bytes"]) for r in found] == [("d/a.log", 5)]
    lines = read_log_lines(spark, str(tmp_path / "d"))
    assert sorted(r["value"] for r in sample_lines(lines, 10).collect()) == ["x", "y"]
    assert sample_lines(lines, 1, seed=3).collect() == sample_lines(lines, 1, seed=3).collect()


def test_archives(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, content in (("a.log", "1\n2\n"), ("b.log", "3\n"), ("c.log", "4\n")):
        (tmp_path / name).write_text(content)
    with tarfile.open(tmp_path / "in" / "x.tar.gz", "w:gz") as tar:
        tar.add(tmp_path / "a.log", "deep/a.log")
        tar.add(tmp_path / "b.log", "b.log")
    with tarfile.open(tmp_path / "in" / "y.tbz2", "w:bz2") as tar:
        tar.add(tmp_path / "c.log", "c.log")
        tar.add(tmp_path / "a.log", "other/a.log")
    existing = spark.createDataFrame([("b.log",)], "rel_path string")
    rows = read_archived_logs(spark, str(tmp_path / "in"), existing).orderBy("rel_path", "line_no").collect()
    assert [(r["rel_path"], r["line_no"], r["value"]) for r in rows] == [("a.log", 1, "1"), ("a.log", 2, "2"), ("c.log", 1, "4")]
