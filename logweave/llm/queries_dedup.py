"""Queries of the deduplicating operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from logweave.llm import exact_dedup, line_dedup, simhash, suffix_dedup
from logweave.llm.registry import query, table


@query(
    "op3_line_dedup",
    r"""
    with lines as (
        select doc_id, unnest(string_split(text, chr(10))) as line,
               unnest(range(len(string_split(text, chr(10))))) as n
        from documents where length(text) > 0),
    runs as (select *, lead(line) over (partition by doc_id order by n) as following from lines),
    later as (
        select doc_id, n from (
            select *, row_number() over (partition by line, following order by doc_id, n) as copy
            from runs where following is not null)
        where copy > 1),
    long_later as (
        select doc_id, n from (select *, row_number() over (partition by line order by doc_id, n) as copy from lines)
        where copy > 1 and len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda w: w <> '')) >= 10),
    gone as (
        select distinct doc_id, n
        from (select * from later union all select doc_id, n + 1 from later union all select * from long_later)),
    marked as (
        select l.doc_id, l.n, line, g.n is not null as out,
               coalesce(lag(g.n is not null) over (partition by l.doc_id order by l.n), false) as out_before
        from lines l left join gone g on l.doc_id = g.doc_id and l.n = g.n),
    per_doc as (
        select doc_id, count(*) as n_lines, count(*) filter (out) as n_removed,
               count(*) filter (out and not out_before) as n_runs,
               string_agg(line, chr(10) order by n) filter (not out) as kept
        from marked group by doc_id)
    select doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed, coalesce(n_runs, 0) as n_runs,
           sha256(coalesce(kept, '')) as kept_sha256
    from documents left join per_doc using (doc_id)
    """,
)
def _op3(spark, sf):
    found = line_dedup.remove_repeated_lines(table(spark, sf, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    )


@query(
    "op5_exact_dedup",
    r"""
    with hashed as (
        select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256
        from documents)
    select doc_id, min(doc_id) over g as keep_id, count(*) over g as group_size,
           doc_id = min(doc_id) over g as kept, text_sha256
    from hashed window g as (partition by text_sha256)
    """,
)
def _op5(spark, sf):
    return exact_dedup.exact_copies(table(spark, sf, "documents").select("doc_id", "text"))


@query("op4_simhash")
def _op4(spark, sf):
    found = simhash.near_duplicates(table(spark, sf, "documents").select("doc_id", "text"))
    return found.select("doc_id", "fingerprint", "component_id")


@query("op7_suffix_dedup")
def _op7(spark, sf):
    found = suffix_dedup.remove_repeats(table(spark, sf, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
