"""Conversation repair against a plain search over edits, and its SQL on odd rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from logweave.llm import conversation_repair
from logweave.llm.registry import ORACLE
from logweave.llm.queries_conversations import _op11

SCHEMA = "conv_id bigint, turn bigint, role string, text string, block string, g bigint, audit string"


def odd_rows():
    rnd, rows = random.Random(5), []
    texts = ["Yes.", "No", "", " ", "\n\t", "What?", "Well!  ", None, "a. b", "日本。", "x" * 3000 + "."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "User"]
    for conv in range(60):
        for turn in range(rnd.randint(1, 14)):
            rows.append((conv, rnd.choice([turn, turn, turn, 3, None]), rnd.choice(roles), rnd.choice(texts)))
    rows += [(None, t, "user" if t % 2 else "assistant", f"t{t}.") for t in range(9)]
    # Copies of one row, and a conversation much longer than a block.
    rows += [(70, 1, "user", "same.")] * 12
    rows += [(71, t, rnd.choice(roles[:5]), rnd.choice(texts[:7]) or f"text {t}.") for t in range(400)]
    return [(*r, "x", 1, "y") for r in rows]


def plain_damage(rows):
    found = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(key.encode()) % 20
        if fault == 0:
            continue
        if fault == 1:
            text = ""
        if fault == 2:
            text = text.translate({ord(c): None for c in ".!?"})
        found += [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return found


def plain_repair(rows):
    """``rows`` of one conversation; a search that keeps the least (cost, audit) per state after each row."""
    space = " \t\n\x0b\x0c\r"
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    best, seen, counts = {"": (0, "", [])}, set(), defaultdict(int)

    def says(state, letter):
        if letter == "s":
            return "s" if state == "" else None
        if letter == "u":
            return "u" if state in ("", "s", "a") else None
        return "a" if letter == "a" and state == "u" else None

    def with_inserts(states):
        found = {s: [way] for s, way in states.items()}
        last = found
        for _ in range(2):
            following = defaultdict(list)
            for state, ways in last.items():
                for cost, audit, said in ways:
                    for letter, role in (("u", "user"), ("a", "assistant")):
                        if says(state, letter):
                            following[letter].append((cost + 3, audit + "I", [*said, f"{role}:"]))
            found = {s: found.get(s, []) + following.get(s, []) for s in {*found, *following}}
            last = following
        return found

    for _, _, role, text in rows:
        if not text.strip(space):
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        else:
            fault = "" if text.strip(space)[-1] in ".!?" else "truncated"
        seen.add((role, text))
        counts[fault] += 1
        cut, options = 3 if fault == "truncated" else 0, defaultdict(list)
        for state, ways in with_inserts(best).items():
            for cost, audit, said in ways:
                options[state].append((cost + 4, audit + "D", said))
                if fault not in ("blank", "duplicate"):
                    if role[:1] and says(state, role[:1]):
                        options[says(state, role[:1])].append((cost + cut, audit + "K", [*said, f"{role}:{text}"]))
                    for letter, title in (("u", "user"), ("a", "assistant")):
                        if says(state, letter):
                            options[letter].append((cost + 3 + cut, audit + "R", [*said, f"{title}:{text}"]))
        best = {s: min(o) for s, o in options.items()}
    ends = [w for s, ways in with_inserts(best).items() if s in ("", "a") for w in ways]
    cost, audit, said = min(ends)
    initials = [r[2][:1] for r in rows]
    turns = [r[1] for r in rows if r[1] is not None]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        counts["blank"], counts["duplicate"], counts["truncated"],
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        cost, audit, "\n".join(said),
    )


@pytest.mark.parametrize("block,fan", [(8192, 4096), (7, 3), (1, 2)])
def test_repair_is_the_plain_search(spark, monkeypatch, block, fan):
    monkeypatch.setattr(conversation_repair, "BLOCK", block)
    monkeypatch.setattr(conversation_repair, "FAN", fan)
    rows = odd_rows()
    convs = defaultdict(list)
    for row in plain_damage([r[:4] for r in rows]):
        convs[row[0]].append(row)
    expected = {}
    for conv in {r[0] for r in rows}:
        *numbers, audit, said = plain_repair(convs[conv]) if convs[conv] else (0, 0, 0, 0, 0, 0, "", "")
        expected[conv] = (*numbers, audit, hashlib.sha256(said.encode()).hexdigest())
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    found = {r.conv_id: tuple(r[n] for n in names) for r in conversation_repair.repair_damaged(frame).collect()}
    assert found == expected


def test_repaired_rows_are_the_repaired_text(spark):
    frame = spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)
    damaged = conversation_repair.damage(frame)
    texts = defaultdict(list)
    for r in sorted(conversation_repair.repaired_rows(damaged).collect(), key=lambda r: (r.place, r.step)):
        texts[r.conv_id].append(f"{r.role}:{r.text}")
    digests = {r.conv_id: r.repaired_sha256 for r in conversation_repair.repair(damaged).collect()}
    assert {c: hashlib.sha256("\n".join(texts[c]).encode()).hexdigest() for c in digests} == digests


def test_rows_sql_and_empty_tables(spark, tmp_path):
    frame = spark.createDataFrame(odd_rows(), SCHEMA)
    frame.write.parquet(f"{tmp_path}/conversations.parquet")
    connection = duckdb.connect()
    connection.execute(f"create view conversations as select * from read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    result = connection.execute(ORACLE["op11_conversation_repair"])
    names = [c[0] for c in result.description]
    found = _op11(spark, str(tmp_path))
    assert set(map(tuple, found.select(*names).collect())) == set(result.fetchall())
    assert conversation_repair.repair_damaged(frame.where("false")).count() == 0
    dropped = spark.createDataFrame([(c, 0, "user", "Hm.") for c in range(60) if zlib.crc32(f"{c}:0".encode()) % 20 == 0], "conv_id bigint, turn bigint, role string, text string")
    rows = conversation_repair.repair_damaged(dropped).collect()
    assert len(rows) == dropped.count() > 0
    assert {(r.cost, r.audit, r.repaired_sha256) for r in rows} == {(0, "", hashlib.sha256(b"").hexdigest())}
