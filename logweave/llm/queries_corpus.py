"""Queries that hold documents against other text."""

from __future__ import annotations

from pyspark.sql import functions as F

from logweave.llm import decontaminate
from logweave.llm.registry import query, table

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query(
    "op9_decontaminate",
    f"""
    with d as (select doc_id, {_WORDS} as w from documents),
    b as (select item_id, {_WORDS} as w from benchmark),
    bw as (select item_id, least(10, len(w)) as n, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) as s
           from b where len(w) > 0),
    windows as (select distinct item_id, n, array_to_string(w[s:s + n - 1], ' ') as phrase from bw),
    sizes as (select distinct n from windows),
    dw as (select doc_id, n, w, unnest(range(1, len(w) - n + 2)) as s from d, sizes where len(w) >= n),
    dp as (select doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') as phrase from dw),
    hits as (select doc_id, s, n, item_id from dp join windows using (n, phrase)),
    words as (select doc_id, count(distinct p) as n_hit
              from (select doc_id, unnest(range(s, s + n)) as p from hits) group by doc_id),
    found as (select doc_id, count(*) as n_items, string_agg(i, ',' order by i) as list
              from (select distinct doc_id, cast(item_id as varchar) as i from hits) group by doc_id)
    select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
           sha256(coalesce(list, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
    from d left join words using (doc_id) left join found using (doc_id)
    """,
)
def _op9(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = decontaminate.find_passages(docs, table(spark, sf, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
