"""Masks are only tried on texts that hold what their matches need, with the same rows."""

from pyspark.sql import functions as F

from logweave.functions.masking import apply_masks, custom_masks, domain_masks
from logweave.functions.regex import java_regex
from logweave.rules.masks import CUSTOM_MASKS, DOMAIN_MASKS, MASK_NEEDS

MATCHING = [
    'x ORCHESTRATION TRACING: [{"a": 1}] y', "SELECT a\nfrom b; INSERT  INTO t; UPDATE t; DELETE FROM t", "select 1; insert into t; update t; delete from t",
    "Select 1; Insert into t; Update t; Delete from t", "see LIB1234567", "A123456 B12", "Context ID: 12.5:7", "at Time: 06-JUL-2026 21:12:31 end",
    "<s:Envelope a='1'>\n<b/></s:Envelope>", "------=_Part_1_2.3 abc\n------=_Part_4_5.6 rest", "A" * 45 + "==", '{ "key" : 1 } ', "<a b='c'>\nd</a>",
    "-----BEGIN RSA KEY-----\nabc\n-----END RSA KEY-----", "eyJab.cd-e.f_g", "  at a.b.C(D.java:1)\n\tat e.F(G.java:2)\n", '  File "a.py", line 1, in f\n  File "b.py", line 2\n',
    "(1, 2, 3, 4, 5, 6, 7)", "https://h/p?q=1 http://h/p", "123e4567-e89b-12d3-a456-426614174000", "10.0.0.1", "0xFF", "/u01/app/x_123.trc /a/b/12", "value7 12 1. ",
    "2023-10-11 12:34:56 späť ٣٤ SELECT", "217668\tThu Jun 25 18:00:02.591327 x", "", None, "no literal", "Time SELEC </ { ( . - / at File",
]


def _plain(text, masks):
    for pattern, replacement in masks:
        text = F.regexp_replace(text, java_regex(pattern), replacement)
    return text


def test_guarded_masks_replace_what_plain_ones_replace(spark):
    rows = [(i, t) for i, t in enumerate(MATCHING + [f"{a} {b}" for a in MATCHING[:-4] for b in MATCHING[:-4]])]
    texts = spark.createDataFrame(rows, "id int, message string")
    for masks in (custom_masks(), domain_masks(False), domain_masks(True)):
        made = texts.select("message", apply_masks(F.col("message"), masks).alias("got"), _plain(F.col("message"), masks).alias("plain"))
        assert made.where(~F.col("got").eqNullSafe(F.col("plain"))).collect() == []


def test_every_guarded_mask_is_tried_by_a_sample_and_no_other_mask_is_named(spark):
    known = {p for p, _ in CUSTOM_MASKS + DOMAIN_MASKS}
    assert set(MASK_NEEDS) <= known and len(MASK_NEEDS) > 20
    texts = spark.createDataFrame([(t,) for t in MATCHING], "message string")
    patterns = list(MASK_NEEDS)
    met = texts.agg(*[F.max(F.col("message").rlike(java_regex(p))).alias(str(k)) for k, p in enumerate(patterns)]).first()
    # A stack trace's lines begin with ``^``, which stands at the begin of a text only: two in a row match nowhere.
    assert [p for k, p in enumerate(patterns) if not met[k] and not p.startswith("(?:^")] == []


def test_texts_without_the_literal_are_not_searched(spark):
    plan = spark.range(1).select(apply_masks(F.col("id").cast("string"), DOMAIN_MASKS))._jdf.queryExecution().analyzed().toString()
    assert "Contains" in plan or "contains(" in plan
