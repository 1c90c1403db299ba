"""Deduplication against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from logweave.llm import components, exact_dedup, line_dedup, simhash, suffix_array, suffix_dedup

SHA = lambda b: hashlib.sha256(b).hexdigest()


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def order(i):
    return (i is None, i if i is not None else 0)


@pytest.mark.parametrize("bits", [exact_dedup.MAX_BITS, exact_dedup.SEGMENT_BITS])
def test_exact_copies(docs, rows, bits):
    groups = defaultdict(list)
    for i, t in rows:
        groups[normal(t)].append(i)
    expected = Counter()
    for i, t in rows:
        mine = groups[normal(t)]
        expected[(i, min(mine, key=order), len(mine), SHA(normal(t).encode()))] += 1
    found = exact_dedup.exact_copies(docs, max_bits=bits).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == expected
    kept = Counter(r.text_sha256 for r in found if r.kept)
    assert kept == Counter({SHA(t.encode()): 1 for t in groups})
    assert all(r.doc_id == r.keep_id for r in found if r.kept)


def test_drop_copies_keeps_whole_rows(docs, rows):
    kept = exact_dedup.drop_copies(docs)
    assert kept.dtypes == docs.dtypes
    groups = defaultdict(list)
    for i, t in rows:
        groups[normal(t)].append(i)
    expected = Counter((t, min(ids, key=order)) for t, ids in groups.items())
    assert Counter((normal(r.text), r.doc_id) for r in kept.collect()) == expected


def test_exact_empty(nothing):
    assert exact_dedup.exact_copies(nothing).count() == 0
    assert exact_dedup.drop_copies(nothing).count() == 0


def test_filter_lets_all_copies_through(spark):
    """A filter far too small only lets more rows shuffle."""
    docs = spark.range(3000).selectExpr("id as doc_id", "cast(id % 2900 as string) as text")
    found = exact_dedup.exact_copies(docs, max_bits=exact_dedup.SEGMENT_BITS)
    assert found.where("kept").count() == 2900
    assert found.where("group_size = 2").count() == 200


# --- SimHash ---------------------------------------------------------------------------------------------------------


def plain_fingerprint(text, size=3):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    parts = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_same_hash_as_spark(spark):
    made = spark.sql("select xxhash64('a b c') as h").first().h & (1 << 64) - 1
    assert made == xxhash.xxh64_intdigest(b"a b c", 42)


def plain_components(prints):
    parent = list(range(len(prints)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= simhash.MAX_BITS:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def test_near_duplicates(docs, rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    roots = plain_components(prints)
    least = {}
    for (i, _), root in zip(rows, roots):
        if i is not None:
            least[root] = min(i, least.get(root, i))
    expected = Counter((i, f"{p:016x}", least.get(r)) for (i, _), p, r in zip(rows, prints, roots))
    found = simhash.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in found) == expected


def test_links_lose_none(spark):
    """Chains find every pair within two bits, wherever the bits are."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 25, dtype=np.uint64)
    made = set(base.tolist())
    for value in base.tolist():
        for _ in range(12):
            a, b = rng.integers(0, 64, 2).tolist()
            made |= {value ^ 1 << a, value ^ 1 << a ^ 1 << b}
    prints = [int(np.uint64(v).view(np.int64)) for v in made]
    found = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp bigint")).collect()
    mask = (1 << 64) - 1
    expected = {
        (max(a, b), min(a, b))
        for k, a in enumerate(prints)
        for b in prints[:k]
        if bin((a ^ b) & mask).count("1") <= 2
    }
    assert {(r.a, r.b) for r in found} == expected and len(found) == len(expected)


def test_drop_near_duplicates(docs, rows):
    kept = simhash.drop_near_duplicates(docs)
    assert kept.dtypes == docs.dtypes
    roots = plain_components([plain_fingerprint(t) for _, t in rows])
    least = {}
    for (i, _), root in zip(rows, roots):
        least[root] = min(order(i), least.get(root, order(i)))
    assert Counter(order(r.doc_id) for r in kept.collect()) == Counter(least.values())


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(100, 100), (101, 100)]
    found = components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r.node: r.component for r in found} == {
        **{i: 0 for i in range(41)},
        **{100 + i: 100 for i in range(30)},
    }
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# --- lines -----------------------------------------------------------------------------------------------------------


def plain_lines(rows, size, words):
    """Rows in reading order are not known here, so ids must be unique."""
    seen, long_seen, gone = set(), set(), defaultdict(set)
    split = {i: (t or "").split("\n") if t else [] for i, t in rows}
    for i in sorted(split):
        lines = split[i]
        for n in range(len(lines) - size + 1):
            run = tuple(lines[n : n + size])
            if run in seen:
                gone[i].update(range(n, n + size))
            seen.add(run)
        for n, line in enumerate(lines):
            if len([w for w in re.split(r"[\x20\x09-\x0D]+", line) if w]) >= words:
                if line in long_seen:
                    gone[i].add(n)
                long_seen.add(line)
    return {
        i: (
            "\n".join(line for n, line in enumerate(lines) if n not in gone[i]),
            len(lines),
            len(gone[i]),
            sum(n - 1 not in gone[i] for n in gone[i]),
        )
        for i, lines in split.items()
    }


def line_rows(rows):
    unique = {i: t for i, t in rows if i is not None}
    more = ["a\nb\nc\nd", "x\nb\nc\nd\ny", "a\na\na\na", "\n\n\n", "b\nc", "a\nb\nc\nd\n", "q\n" + "w " * 12 + "\nr", "s\n" + "w " * 12 + "\nt"]
    more += ["\n".join(f"l{k % 7}" for k in range(40)), "\n".join(f"l{k % 7}" for k in range(3, 30))]
    return unique | {1000 + k: t for k, t in enumerate(more)}


@pytest.mark.parametrize("size,words", [(1, 1), (2, 10), (3, 1000), (5, 10), (7, 3)])
def test_repeated_lines(spark, rows, size, words):
    unique = line_rows(rows)
    docs = spark.createDataFrame(list(unique.items()), "doc_id bigint, text string")
    found = line_dedup.remove_repeated_lines(docs, min_lines=size, min_words=words).collect()
    assert {r.doc_id: (r.kept, r.n_lines, r.n_removed, r.n_runs) for r in found} == plain_lines(unique.items(), size, words)


def test_copied_runs_are_copies_and_cannot_go_on(spark, rows):
    unique = line_rows(rows)
    ids = sorted(unique)
    docs = spark.createDataFrame(list(unique.items()), "doc_id bigint, text string").repartition(3)
    lines = line_dedup.materialize(line_dedup._places(line_dedup.numbered_documents(docs, "text", "doc_id")), "lines")
    levels = line_dedup.repeated_prefixes(lines.select("place", "id"))
    sources = {r.place: (r.lines, r.source) for r in line_dedup.deepest_sources(levels).collect()}
    text = [(unique[i] or "").split("\n") if unique[i] else [] for i in ids]
    at = lambda p: (p >> 24, p & (1 << 24) - 1)
    places = [(d, n) for d, split in enumerate(text) for n in range(len(split))]
    for d, n in places:
        # The greatest power of two that the next lines share with an earlier place, and the first such place.
        best = None
        k = 1
        while n + k <= len(text[d]):
            run = text[d][n : n + k]
            earlier = next(((e, m) for e, m in places if (e, m) < (d, n) and text[e][m : m + k] == run and m + k <= len(text[e])), None)
            if earlier is None:
                break
            best, k = (k, (earlier[0] << 24) + earlier[1]), 2 * k
        assert sources.get((d << 24) + n) == best
    runs = line_dedup.copied_runs(line_dedup.deepest_sources(levels)).collect()
    assert runs and max(r.lines for r in runs) >= 30
    covered = set()
    for r in runs:
        (d, n), (e, m) = at(r.place), at(r.source)
        assert text[d][n : n + r.lines] == text[e][m : m + r.lines] and n + r.lines <= len(text[d])
        covered |= {(d, k) for k in range(n, n + r.lines)}
    assert covered >= {at(p) for p in sources}


def test_lines_of_repeated_and_null_ids(docs, rows, nothing):
    assert line_dedup.remove_repeated_lines(docs).count() == len(rows)
    assert line_dedup.remove_repeated_lines(nothing).count() == 0


def test_lines_use_no_python(docs):
    plan = line_dedup.remove_repeated_lines(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- byte strings ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(30))
def test_suffix_array_and_prefixes(seed):
    rng = np.random.default_rng(seed)
    data = rng.integers(0, rng.integers(1, 5) + 1, rng.integers(0, 300)).astype(np.uint8)
    if seed % 3 == 0 and len(data):
        data = np.tile(data[: max(1, len(data) // 7)], 8)
    raw = data.tobytes()
    expected = sorted(range(len(raw)), key=lambda i: raw[i:])
    found = suffix_array.suffix_array(data)
    assert found.tolist() == expected

    def common(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    prefixes = [0] * bool(expected) + [common(raw[a:], raw[b:]) for a, b in zip(expected, expected[1:])]
    assert suffix_array.common_prefixes(data, found).tolist() == prefixes


def plain_repeats(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    times = Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    found = Counter()
    for (i, _), text in zip(rows, texts):
        cover = np.zeros(len(text) + 1, bool)
        for k in range(len(text) - length + 1):
            if times[text[k : k + length]] > 1:
                cover[k : k + length] = True
        cover = cover[: len(text)]
        kept = bytes(np.frombuffer(text, np.uint8)[~cover])
        runs = int((np.diff(np.append(0, cover.astype(int))) == 1).sum())
        found[(i, kept, len(text), int(cover.sum()), runs)] += 1
    return found


@pytest.mark.parametrize("length,hot", [(200, 1500), (40, 1500), (40, 2)])
def test_repeated_bytes(docs, rows, length, hot, monkeypatch):
    """With ``hot`` 2 every anchor of more than two segments is split over shards and merged."""
    monkeypatch.setattr(suffix_dedup, "HOT_SEGMENTS", hot)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 3000)
    found = suffix_dedup.remove_repeats(docs, length=length).collect()
    made = Counter((r.doc_id, bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans) for r in found)
    assert made == plain_repeats(rows, length)


def test_repeated_bytes_in_long_text(monkeypatch):
    """Anchors of a text that is longer than a chunk are those of the same strings elsewhere."""
    monkeypatch.setattr(suffix_dedup, "_CHUNK", 1000)
    rng = np.random.default_rng(2)
    data = rng.integers(0, 4, 5000).astype(np.uint8)
    start, count, anchor = suffix_dedup.anchors(data, np.array([0, 5000]), 200)
    assert count.sum() == 5000 - 200 + 1
    alone = suffix_dedup.anchors(data[900:1300], np.array([0, 400]), 200)
    assert set(alone[2].tolist()) <= set(anchor.tolist())
    covered = np.concatenate([np.arange(s, s + c) for s, c in zip(start, count)])
    assert np.array_equal(np.sort(covered), np.arange(4801))


def test_repeated_bytes_empty(nothing):
    assert suffix_dedup.remove_repeats(nothing).count() == 0
