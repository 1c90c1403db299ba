"""Ring sharding against documents taken one by one."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest

from logweave.llm import ring_shards


def spot(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def plain(rows, shards, nodes, slack=0.0):
    """Rows ``(id, text)`` to ``(id, size, crc, shard, slot)``: each goes clockwise to the first shard with room."""
    ring = sorted((spot(f"shard {s} place {v}"), s * nodes + v, s) for s in range(shards) for v in range(nodes))
    room, taken, found = ring_shards.rooms(len(rows), shards, slack), [0] * shards, []
    keyed = []
    for i, t in rows:
        raw = (t or "").encode()
        keyed.append((spot("null" if i is None else str(i)), i is not None, i or 0, len(raw) + 1, zlib.crc32(raw), i))
    for position, _, _, size, crc, i in sorted(keyed, key=lambda k: k[:5]):
        start = next((k for k, place in enumerate(ring) if place[0] >= position), 0)
        shard = next(s for *_, s in ring[start:] + ring[:start] if taken[s] < room[s])
        found.append((i, size, crc, shard, taken[shard]))
        taken[shard] += 1
    return Counter(found)


@pytest.mark.parametrize("shards,nodes,slack", [(8, 128, 0.0), (3, 1, 0.0), (5, 4, 0.25), (1, 2, 0.0)])
def test_documents_taken_one_by_one(spark, docs, rows, shards, nodes, slack):
    found = ring_shards.assign(docs, shards, nodes=nodes, slack=slack)
    assert Counter(map(tuple, found.collect())) == plain(rows, shards, nodes, slack)


def test_shards_are_full_and_slots_have_no_gaps(spark, docs):
    found = ring_shards.assign(docs).collect()
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert ring_shards.assign(docs.where("false")).count() == 0


def test_hot_key_and_written_rows(spark, tmp_path):
    rows = [(i if i % 3 else None, f"text {i % 40}", "x", 0) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, position string, number int")
    expected = plain([r[:2] for r in rows], 8, 128)
    assert Counter(map(tuple, ring_shards.assign(docs).collect())) == expected
    ring_shards.write_shards(docs, f"{tmp_path}/shards")
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert Counter((r.doc_id, r.text, r.position, r.number) for r in back.collect()) == Counter(rows)
    assert Counter((r.doc_id, r.shard, r.slot) for r in back.collect()) == Counter((e[0], e[3], e[4]) for e in expected.elements())
    with pytest.raises(ValueError):
        ring_shards.assign(docs.withColumn("slot", docs.number), keep=["slot"])


def test_few_documents_move_when_a_shard_comes(spark):
    docs = spark.range(20_000).selectExpr("id as doc_id", "cast(id as string) as text")
    of = [{r.doc_id: r.shard for r in ring_shards.assign(docs, n).collect()} for n in (8, 9)]
    moved = sum(of[0][i] != of[1][i] for i in of[0]) / len(of[0])
    assert 1 / 9 <= moved < 0.16
