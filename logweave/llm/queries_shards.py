"""Query of the sharding operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from logweave.llm import ring_shards
from logweave.llm.registry import query, table
from logweave.llm.sql import crc32


def _position(text: str) -> str:
    return f"cast('0x' || substr(md5({text}), 1, 15) as bigint)"


@query(
    "op13_ring_shards",
    f"""
    with recursive table_of as ({crc32.table}),
    d as (select doc_id, coalesce(text, '') as t from documents),
    keyed as (select doc_id, octet_length(encode(t)) + 1 as size, {crc32("t")} as crc,
                     {_position("coalesce(cast(doc_id as varchar), 'null')")} as pos
              from d, table_of),
    places as (select {_position("'shard ' || s || ' place ' || v")} as pos, s, s * 128 + v as id
               from range(8) a(s), range(128) b(v)),
    ring as (select list(s order by pos, id) as owners, list(pos order by pos, id) as spots from places),
    docs as (select *, row_number() over (order by pos, doc_id nulls first, size, crc) as k,
                    len(list_filter(spots, lambda p: p < pos)) as skipped
             from keyed, ring),
    total as (select count(*) as n from keyed),
    step as (
        select 0::bigint as k, -1::bigint as shard, -1::bigint as slot,
               list_transform(range(8), lambda s: n // 8 + (case when s < n % 8 then 1 else 0 end)) as room,
               list_transform(range(8), lambda s: 0::bigint) as taken
        from total
        union all
        select d.k, c.shard, taken[c.shard + 1],
               list_transform(range(8), lambda s: room[s + 1] - (case when s = c.shard then 1 else 0 end)),
               list_transform(range(8), lambda s: taken[s + 1] + (case when s = c.shard then 1 else 0 end))
        from step join docs d on d.k = step.k + 1,
             lateral (select list_filter(d.owners[d.skipped + 1:] || d.owners[:d.skipped], lambda s: room[s + 1] > 0)[1] as shard) c)
    select doc_id, size, crc as text_crc32, 'rows' as law, step.shard, step.slot, cast(null as integer) as grown_shard
    from step join docs using (k)
    """,
)
def _op13(spark, sf):
    found = ring_shards.assign(table(spark, sf, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
