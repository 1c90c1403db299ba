"""Conversations brought to the form ``(system? (user assistant)+)?`` by the cheapest edits, Hirschberg's way.

Keeping a row costs nothing, giving it the role user or assistant 3, deleting it 4, inserting an empty turn 3; a truncated
row that stays costs 3 more; blank and duplicate rows must be deleted. Of the cheapest edits those with the least audit
count, the letters K, R, D and I in the order of the rows, compared as ASCII.

Rows are numbered in one range shuffle of narrow columns (no texts) and cut into blocks of BLOCK rows whatever the
conversations are, so a conversation that holds a third of all rows is many blocks. A conversation inside a block is
solved there. The pieces of one that crosses blocks become 4 x 4 tables of costs (``crossings``); a driver-free tree over
those finds the states at the borders of the pieces, FAN pieces to a task, and then each piece is solved between its
states. Texts shuffle once, to meet the edits in order.

The digest of a repaired conversation is one SHA-256 over all its text, which can only be taken in order: one task reads
a conversation for it, a batch at a time. ``repaired_rows`` has no such limit: it is dealt by ranges of rows.

Defined cases: nulls in role and text are one space; a conversation without an id is one conversation; rows come by turn
(nulls first), then by role, text (16 characters each) and digest; equal rows are copies of the first; conversations
without rows have zeros, an empty audit and an empty text; an empty table gives an empty result; other columns do not
matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from logweave.llm import crossings as X
from logweave.llm.ordering import number_rows
from logweave.llm.text import small_batches
from logweave.session import materialize, sized_broadcast

BLOCK = 8192
# Pieces of a conversation whose borders one task finds.
FAN = 4096
_ORDER = ["conv", "turn", "role16", "text16", "digest"]
_ROLES = {"u": "user", "a": "assistant"}


def damage(conversations: DataFrame) -> DataFrame:
    """Rows of ``conv_id, turn, role, text`` with planted faults, by the checksum of ``conv_id:turn``.

    0 drops a row, 1 empties its text, 2 takes the ends of its sentences, 3 repeats it, 4 makes it a user's.
    """
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    fault = F.crc32(F.concat(text["conv_id"], F.lit(":"), text["turn"]).cast("binary")) % 20
    return (
        conversations.select(
            "conv_id",
            "turn",
            F.when(fault == 4, "user").otherwise(text["role"]).alias("role"),
            F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text["text"], "[.!?]", "")).otherwise(text["text"]).alias("text"),
            F.when(fault == 3, 2).otherwise(1).alias("times"),
            fault.alias("fault"),
        )
        .where("fault <> 0")
        .drop("fault")
    )


def _keyed(rows: DataFrame) -> DataFrame:
    """``conv, turn, role16, text16, digest`` and ``role, text, times`` of rows without nulls in role and text."""
    times = F.col("times") if "times" in rows.columns else F.lit(1)
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    rows = rows.select(F.col("conv_id").alias("conv"), "turn", role.alias("role"), text.alias("text"), times.alias("times"))
    of = F.concat(F.col("conv").isNull().cast("string"), F.coalesce(F.col("conv").cast("string"), F.lit("")))
    whole = F.concat(of, F.lit(":"), F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    return rows.withColumns(
        {
            "role16": F.substring("role", 1, 16),
            "text16": F.substring("text", 1, 16),
            "digest": F.unhex(F.sha2(whole.cast("binary"), 256)),
        }
    )


def _faults(text: Column) -> Column:
    """1 blank, 3 truncated, else 0."""
    blank = ~text.rlike(r"[^\x20\x09-\x0D]")
    return F.when(blank, 1).when(~text.rlike(r"[.!?][\x20\x09-\x0D]*\z"), 3).otherwise(0)


def _ordered(rows: DataFrame) -> DataFrame:
    """Narrow rows in order: the keys, ``g`` (their number), ``initial`` (0 s, 1 u, 2 a, 3 other) and ``fault``."""
    first = F.substring("role", 1, 1)
    narrow = _keyed(rows).select(
        *_ORDER,
        F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3).alias("initial"),
        _faults(F.col("text")).alias("fault"),
        F.explode(F.sequence(F.lit(1), "times")).alias("copy"),
        F.monotonically_increasing_id().alias("row"),
    )
    ordered = number_rows(materialize(narrow, "turns"), [*_ORDER, "row", "copy"], "g", "ordered-turns").drop("row", "copy")
    firsts = ordered.groupBy("digest").agg(F.min("g").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    marked = ordered.join(sized_broadcast(firsts.drop("n"), "first-turns"), "digest", "left")
    fault = F.when((F.col("fault") != 1) & (F.col("g") > F.col("first")), 2).otherwise(F.col("fault"))
    return marked.withColumn("fault", fault).drop("first")


def _blocks(ordered: DataFrame) -> DataFrame:
    """Rows with their ``block``; the rows beside a block stand in it too, with ``beside`` -1 before it and 1 behind."""
    at, block = F.col("g") % BLOCK, F.expr(f"g div {BLOCK}")
    there = F.array(
        F.struct(block.alias("block"), F.lit(0).alias("beside")),
        F.when(at == BLOCK - 1, F.struct((block + 1).alias("block"), F.lit(-1).alias("beside"))),
        F.when((at == 0) & (F.col("g") > 0), F.struct((block - 1).alias("block"), F.lit(1).alias("beside"))),
    )
    return ordered.withColumn("there", F.explode(F.filter(there, lambda t: t.isNotNull()))).select("there.*", *ordered.columns)


class _Block:
    """The rows of a block in order and the conversations in it."""

    def __init__(self, table: pa.Table):
        table = table.take(pa.array(np.argsort(table["g"].to_numpy(), kind="stable"))).combine_chunks()
        beside = table["beside"].to_numpy()
        # A last block may be only the neighbour of another.
        self.n = int((beside == 0).sum())
        low, high = int((beside == -1).sum()), int((beside == -1).sum()) + self.n
        conv = pc.dictionary_encode(table["conv"].combine_chunks(), null_encoding="encode").indices.to_numpy()
        self.rows = table.slice(low, self.n)
        self.conv = conv[low:high]
        change = np.flatnonzero(np.diff(self.conv)) + 1
        self.starts = np.concatenate([[0], change]).astype(np.int64) if self.n else np.zeros(0, np.int64)
        self.ends = np.append(self.starts[1:], self.n) if self.n else self.starts
        self.goes_on_from = bool(low and self.n and conv[0] == self.conv[0])
        self.goes_on_to = bool(high < len(conv) and self.n and conv[high] == self.conv[-1])
        self.before = table.slice(0, low) if self.goes_on_from else None
        fault, initial = self.rows["fault"].to_numpy(), self.rows["initial"].to_numpy()
        sort = np.where(fault == 3, 1, np.where(fault == 0, 0, 2))
        # Steps: the rows and, behind the last row of a conversation, its end.
        closed = np.ones(len(self.starts), bool)
        if self.goes_on_to:
            closed[-1] = False
        self.low = self.starts + np.concatenate([[0], np.cumsum(closed)[:-1]]) if self.n else self.starts
        self.high = self.low + (self.ends - self.starts) + closed
        self.kinds = np.full(self.n + int(closed.sum()), X.END, np.int64)
        self.step = np.arange(self.n) + np.repeat(self.low - self.starts, self.ends - self.starts)
        self.kinds[self.step] = 3 * initial + sort
        self.closed = closed

    def edges(self) -> list[tuple[int, int]]:
        """``(edge, conversation)``: 0 for one that goes on from the block before, 1 for another that goes on behind."""
        last = len(self.starts) - 1
        found = [(0, 0)] if self.goes_on_from else []
        return found + ([(1, last)] if self.goes_on_to and not (self.goes_on_from and last == 0) else [])


def _edge_pieces(table: pa.Table) -> pa.Table:
    block, found = _Block(table), []
    for edge, c in block.edges():
        cost, code = X.transfer(X.COST, X.CODE, block.kinds, int(block.low[c]), int(block.high[c]))
        found.append((edge, block.starts[c], cost.ravel(), code.ravel()))
    rows = block.rows.take(pa.array([int(f[1]) for f in found], pa.int64()))
    return pa.table(
        {
            "conv": rows["conv"],
            "idx": rows["block"],
            "edge": pa.array([f[0] for f in found], pa.int32()),
            "cost": pa.array([f[2] for f in found], pa.list_(pa.int64())),
            "code": pa.array([f[3] for f in found], pa.list_(pa.int64())),
        }
    )


def _tables(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    table = table.take(pa.array(np.argsort(table["idx"].to_numpy(), kind="stable"))).combine_chunks()
    shape = (table.num_rows, 4, 4)
    return table, *(pc.list_flatten(table[c]).to_numpy().reshape(shape) for c in ("cost", "code"))


def _join_pieces(table: pa.Table) -> pa.Table:
    table, cost, code = _tables(table)
    total, order = X.transfer(cost, code, np.arange(len(cost)), 0, len(cost))
    first = table.slice(0, 1)
    lists = {"cost": pa.array([total.ravel()], pa.list_(pa.int64())), "code": pa.array([order.ravel()], pa.list_(pa.int64()))}
    return pa.table({"conv": first["conv"], "idx": first["parent"], "edge": pa.array([0], pa.int32()), **lists})


def _solve_pieces(table: pa.Table) -> pa.Table:
    table, cost, code = _tables(table)
    n = len(cost)
    start, end = table["start"][0].as_py(), table["end"][0].as_py()
    after = X.solve(cost, code, np.arange(n), [0], [n], [start], [end])
    made = {"start": pa.array(np.append(start, after[:-1]), pa.int32()), "end": pa.array(after, pa.int32())}
    return pa.table({"conv": table["conv"], "idx": table["idx"], "edge": table["edge"], **made})


def _borders(pieces: DataFrame) -> DataFrame:
    """``conv, idx, edge, start, end``: states around each piece on the path of its conversation; a tree of FAN pieces."""
    kind = dict(pieces.dtypes)["conv"]
    wide = f"conv {kind}, idx bigint, edge int, cost array<bigint>, code array<bigint>"
    narrow = f"conv {kind}, idx bigint, edge int, start int, end int"
    limits = pieces.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if limits <= FAN:
        whole = pieces.withColumns({"start": F.lit(X.NOTHING), "end": F.lit(X.ASSISTANT)})
        return materialize(whole.groupBy("conv").applyInArrow(_solve_pieces, narrow), "borders")
    numbered = pieces.withColumn("parent", F.expr(f"idx div {FAN}"))
    parents = materialize(numbered.groupBy("conv", "parent").applyInArrow(_join_pieces, wide), "piece-tree")
    around = _borders(parents).select(F.col("conv").alias("c"), F.col("idx").alias("p"), "start", "end")
    met = numbered.join(around, (F.col("conv").eqNullSafe(F.col("c"))) & (F.col("parent") == F.col("p")))
    return materialize(met.drop("c", "p").groupBy("conv", "parent").applyInArrow(_solve_pieces, narrow), "borders")


def _edit(table: pa.Table, borders: pa.Table) -> pa.Table:
    """Edits of the rows of a block and sums per conversation in it."""
    block = _Block(table)
    m = len(block.starts)
    if not m:
        return _edit_rows(block.rows, [], [], [], [])
    start, end = np.zeros(m, np.int64), np.full(m, X.ASSISTANT)
    known = {r["edge"]: r for r in borders.to_pylist()}
    for edge, c in block.edges():
        start[c], end[c] = known[edge]["start"], known[edge]["end"]
    after = X.solve(X.COST, X.CODE, block.kinds, block.low, block.high, start, end)
    before = np.append(0, after[:-1])
    before[block.low] = start
    costs, codes = X.COST[block.kinds, before, after], X.CODE[block.kinds, before, after]
    edits = [X.EDITS[c] for c in codes]
    said, state_of = [], {}
    for s in range(4):
        for k in range(3):
            at, roles = s, ""
            for _ in range(k):
                roles += X.spoken(at)
                at = X.USER if X.spoken(at) == "u" else X.ASSISTANT
            state_of[s, k] = roles, at
    acts = []
    for step in block.step:
        name = edits[step]
        roles, at = state_of[int(before[step]), len(name) - 1]
        said.append(roles)
        act = name[-1]
        acts.append(X.spoken(at) if act == "R" else act)
    last = np.full(block.n, "", object)
    for c in np.flatnonzero(block.closed):
        step = block.high[c] - 1
        last[block.ends[c] - 1] = state_of[int(before[step]), len(edits[step])][0]
    sums = _sums(block, costs, edits)
    return _edit_rows(block.rows, said, acts, list(last), sums)


def _sums(block: _Block, costs: np.ndarray, edits: list[str]) -> list[dict]:
    fault, initial = block.rows["fault"].to_numpy(), block.rows["initial"].to_numpy()
    turn = block.rows["turn"].to_pylist()
    earlier = block.before.to_pylist()[-1] if block.before is not None else None
    found = []
    for c, (a, b) in enumerate(zip(block.starts, block.ends)):
        going_on = earlier if c == 0 else None
        pairs = list(initial[a:b]) if going_on is None else [going_on["initial"], *initial[a:b]]
        turns = [None if going_on is None else going_on["turn"], *turn[a:b]]
        named = [t for t in turn[a:b] if t is not None]
        low, high = block.low[c], block.high[c]
        found.append(
            {
                "at": int(a),
                "blank": int((fault[a:b] == 1).sum()),
                "duplicate": int((fault[a:b] == 2).sum()),
                "truncated": int((fault[a:b] == 3).sum()),
                "illegal": sum((x, y) not in ((0, 1), (1, 2), (2, 1)) for x, y in zip(pairs, pairs[1:])),
                "turns": sum(t is not None and t != last for last, t in zip(turns, turns[1:])),
                "first_turn": min(named, default=None),
                "last_turn": max(named, default=None),
                "cost": int(costs[low:high].sum()),
                "audit": "".join(edits[low:high]),
            }
        )
    return found


_SUMS = "blank bigint, duplicate bigint, truncated bigint, illegal bigint, turns bigint, first_turn bigint, last_turn bigint, cost bigint, audit string"
_EDITS = "g bigint, said string, act string, last string"


def _edit_rows(rows: pa.Table, said: list, acts: list, last: list, sums: list[dict]) -> pa.Table:
    """One table of both: edits have an ``act``, sums have an ``audit``. Rows that only go are not told."""
    tell = np.array([not (a == "D" and not s and not t) for a, s, t in zip(acts, said, last)], bool)
    keep = np.flatnonzero(tell) if len(tell) else np.zeros(0, np.int64)
    firsts = np.array([s["at"] for s in sums], np.int64)
    taken = rows.select([*_ORDER, "g"]).take(pa.array(np.concatenate([keep, firsts]).astype(np.int64)))
    n, k = len(sums), len(keep)
    columns = {c: taken[c] for c in (*_ORDER, "g")}
    for name, values in (("said", said), ("act", acts), ("last", last)):
        columns[name] = pa.array([values[i] for i in keep] + [None] * n, pa.string())
    for field in _SUMS.split(", "):
        name, kind = field.split()
        columns[name] = pa.array([None] * k + [s[name] for s in sums], pa.string() if kind == "string" else pa.int64())
    return pa.table(columns)


def edits(rows: DataFrame) -> DataFrame:
    """The edits of all rows and the sums per conversation and block, written; see ``_edit_rows``."""
    ordered = _ordered(rows)
    kinds = dict(ordered.dtypes)
    blocks = materialize(_blocks(ordered), "turn-blocks")
    keys = ", ".join(f"{c} {kinds[c]}" for c in _ORDER)
    wide = f"conv {kinds['conv']}, idx bigint, edge int, cost array<bigint>, code array<bigint>"
    narrow = blocks.select("block", "beside", "g", "conv", "initial", "fault")
    pieces = materialize(narrow.groupBy("block").applyInArrow(_edge_pieces, wide), "edge-pieces")
    borders = _borders(pieces).withColumnRenamed("idx", "block")
    made = blocks.groupBy("block").cogroup(borders.groupBy("block")).applyInArrow(_edit, f"{keys}, {_EDITS}, {_SUMS}")
    return materialize(made, "edits")


def _said(rows: DataFrame, made: DataFrame) -> DataFrame:
    """Texts and, behind each, its edits; ``g`` is null for texts."""
    texts = _keyed(rows).select(*_ORDER, F.lit(None).cast("bigint").alias("g"), "role", "text")
    told = made.where("act is not null").select(*_ORDER, "g", "said", "act", "last")
    return texts.unionByName(told, allowMissingColumns=True)


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """``(conv, g, role, text)`` of the repaired turns, in order; texts and edits come sorted."""
    role = text = None
    for batch in batches:
        for row in batch.to_pylist():
            if row["g"] is None:
                role, text = row["role"], row["text"]
                continue
            for letter in row["said"]:
                yield row["conv"], row["g"], _ROLES[letter], ""
            if row["act"] != "D":
                yield row["conv"], row["g"], role if row["act"] == "K" else _ROLES[row["act"]], text
            for letter in row["last"]:
                yield row["conv"], row["g"], _ROLES[letter], ""


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema, made, now, digest = None, [], None, None

    def watched():
        nonlocal schema
        for batch in batches:
            schema = schema or pa.schema([("conv", batch.schema.field("conv").type), ("sha256", pa.string())])
            yield batch

    for conv, _, role, text in _replay(watched()):
        if digest is None or conv != now:
            if digest is not None:
                made.append({"conv": now, "sha256": digest.hexdigest()})
            now, digest = conv, hashlib.sha256(f"{role}:{text}".encode())
        else:
            digest.update(f"\n{role}:{text}".encode())
        if len(made) >= 1000:
            yield pa.RecordBatch.from_pylist(made, schema)
            made = []
    if digest is not None:
        made.append({"conv": now, "sha256": digest.hexdigest()})
        yield pa.RecordBatch.from_pylist(made, schema)


def repaired_rows(rows: DataFrame, made: DataFrame | None = None) -> DataFrame:
    """``conv_id, place, step, role, text`` of the repaired conversations, ordered by place and step; ``made`` are ``edits``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, place, step = [], None, 0
        for conv, g, role, text in _replay(batches):
            place, step = g, step + 1 if g == place else 0
            found.append({"conv_id": conv, "place": g, "step": step, "role": role, "text": text})
            if len(found) >= 100:
                yield pa.RecordBatch.from_pylist(found, schema)
                found = []
        if found:
            yield pa.RecordBatch.from_pylist(found, schema)

    said = _said(rows, edits(rows) if made is None else made)
    spark, kind = rows.sparkSession, dict(said.dtypes)["conv"]
    small_batches(spark)
    made_of = StructType.fromDDL(f"conv_id {kind}, place bigint, step int, role string, text string")
    schema = to_arrow_schema(made_of)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = said.repartitionByRange(partitions, *_ORDER).sortWithinPartitions(*_ORDER, "g")
    return ranged.mapInArrow(run, made_of)


def repair(rows: DataFrame) -> DataFrame:
    """One row per ``conv_id`` of ``rows``: ``gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``."""
    small_batches(rows.sparkSession)
    made = edits(rows)
    kind = dict(made.dtypes)["conv"]
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    said = _said(rows, made).repartition(partitions, "conv").sortWithinPartitions(*_ORDER, "g")
    digests = said.mapInArrow(_digests, f"conv {kind}, sha256 string")
    sums = made.where("audit is not null").select("conv", "g", *[f.split()[0] for f in _SUMS.split(", ")])
    every = sums.unionByName(digests, allowMissingColumns=True)

    def total(name: str) -> Column:
        return F.coalesce(F.sum(name), F.lit(0)).cast("bigint").alias(name)

    span = F.max("last_turn") - F.min("first_turn") + 1 - F.sum("turns")
    parts = F.array_sort(F.collect_list(F.when(F.col("audit").isNotNull(), F.struct("g", "audit"))))
    return every.groupBy(F.col("conv").alias("conv_id")).agg(
        F.coalesce(span, F.lit(0)).cast("bigint").alias("gaps"),
        *[total(name) for name in ("blank", "duplicate", "truncated", "illegal", "cost")],
        F.array_join(F.transform(parts, lambda p: p["audit"]), "").alias("audit"),
        F.coalesce(F.max("sha256"), F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """``repair`` of the damaged conversations; those without a row left have zeros and empty texts."""
    conversations = conversations.select("conv_id", "turn", "role", "text")
    found = repair(damage(conversations)).withColumnRenamed("conv_id", "c")
    ids = conversations.select("conv_id").distinct()
    joined = ids.join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    zeros = {n: F.coalesce(n, F.lit(0).cast("bigint")) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    texts = {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256))}
    return joined.withColumns(zeros | texts).drop("c")
