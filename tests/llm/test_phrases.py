"""Phrase mining against plain counting, and its trie with bounds so small that everything leaves often."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from logweave.llm import collocations, hat_trie
from logweave.llm.queries_phrases import _op12
from logweave.llm.registry import ORACLE


def plain_counts(rows, longest=4):
    found = Counter()
    for lang, text in rows:
        lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            for n in range(1, longest + 1):
                for k in range(len(words) - n + 1):
                    found[lang or "und", tuple(words[k : k + n])] += 1
    return found


def plain(rows, min_count, cover, top):
    f = plain_counts(rows)
    totals = Counter()
    for (lang, words), n in f.items():
        totals[lang] += n * (len(words) == 1)
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= min_count}
    longer = defaultdict(int)
    for (lang, words), a in candidates.items():
        for n in range(2, len(words)):
            for k in range(len(words) - n + 1):
                longer[lang, words[k : k + n]] = max(longer[lang, words[k : k + n]], a)
    ranked = defaultdict(list)
    for (lang, words), a in candidates.items():
        if 100 * longer[lang, words] >= cover * a:
            continue
        cuts = [(2000000 * a // (f[lang, words[:k]] + f[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        ranked[lang].append((-score, -a, " ".join(words).encode(), a, f[lang, words[:k]], f[lang, words[k:]]))
    return Counter(
        (lang, rank, phrase.decode(), a, l, r, totals[lang], -score)
        for lang, found in ranked.items()
        for rank, (score, _, phrase, a, l, r) in enumerate(sorted(found)[:top], 1)
    )


def odd_rows():
    rnd = random.Random(2)
    words = ["New", "york", "city", "hall", "of", "the", "É", "ß", "日本", "a" * 400, "a" * 399 + "b", "x\x0bz", "\x00", "in"]
    texts = ["".join(w + rnd.choice([" ", "  ", "\t", ". ", ",", "\n"]) for w in rnd.choices(words, k=rnd.randint(0, 60))) for _ in range(150)]
    rows = [(rnd.choice(["en", "de", None, "und"]), t) for t in texts]
    return rows + [("en", None), (None, ""), ("de", " \t")] + [("en", "one hot line of text here")] * 200


def test_phrases_are_the_plain_ones(spark):
    rows = odd_rows()
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "lang string, text string, phrase string, n int, hash string").repartition(4)
    names = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    for min_count, cover, top in ((3, 80, 2000), (5, 50, 7)):
        found = collocations.collocations(docs, min_count=min_count, cover=cover, top=top).select(*names).collect()
        expected = plain(rows, min_count, cover, top)
        assert Counter(map(tuple, found)) == expected and len(expected) > 10
    assert collocations.collocations(docs.where("false")).count() == 0


def test_sql_gives_the_same_rows(spark, tmp_path):
    rows = odd_rows() * 5
    spark.createDataFrame(rows, "lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    connection = duckdb.connect()
    connection.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    result = connection.execute(ORACLE["op12_collocations"])
    names = [c[0] for c in result.description]
    assert Counter(map(tuple, _op12(spark, str(tmp_path)).select(*names).collect())) == Counter(result.fetchall())


@pytest.mark.parametrize("entries,words,piece", [(40, 6, 50), (10_000, 1000, 64), (300, 9, 1 << 19)])
def test_counts_survive_spills_bursts_and_windows(monkeypatch, entries, words, piece):
    monkeypatch.setattr(collocations, "ENTRIES", entries)
    monkeypatch.setattr(collocations, "WORDS", words)
    monkeypatch.setattr(hat_trie, "BURST", 3)
    rows = [(lang or "und", text or "") for lang, text in odd_rows()]
    found = Counter()
    for low, high in ((1, 1), (2, 4)):
        counter = collocations._Counter(low, high, None, None, 3)
        batches = []
        for lang, text in rows:
            codes, data = counter.langs(pa.array([lang])), np.frombuffer(text.encode(), np.uint8)
            if not len(data):
                continue
            for begin, end, own in collocations.windows(data, piece):
                batches += counter.add(data[begin:end], np.array([0, end - begin]), codes, own - begin)
        batches += counter.leave()
        whole = collocations.merge_runs(pa.Table.from_batches(batches), 1)
        totals = Counter()
        for row in whole.to_pylist():
            if row["phrase"] is None:
                totals[row["lang"]] += row["times"]
            else:
                assert row["n"] == len(row["phrase"].split(" "))
                found[row["lang"], tuple(row["phrase"].split(" "))] += row["times"]
        assert sum(totals.values()) == sum(n for (_, w), n in found.items() if low <= len(w) <= high)
    assert found == plain_counts(rows)


def test_a_full_bitmap_only_counts_more(spark, monkeypatch):
    monkeypatch.setattr(collocations, "_bits", lambda frequent: collocations.Bits(np.full(8, 255, np.uint8), 63))
    rows = odd_rows()
    docs = spark.createDataFrame(rows, "lang string, text string")
    found, _ = collocations.phrase_counts(docs, min_count=4)
    expected = {k: n for k, n in plain_counts(rows).items() if n >= 4}
    assert {(r.lang, tuple(r.phrase.split(" "))): r.times for r in found.collect()} == expected


@pytest.mark.parametrize("bits", [1, 19])
def test_words_of_equal_hash_stay_apart(monkeypatch, bits):
    """Numbers stand for bytes: all words of one hash, and few slots."""
    monkeypatch.setattr(collocations, "SLOT_BITS", bits)
    rows = [(lang or "und", text or "") for lang, text in odd_rows()]
    for same in (True, False):
        if same:
            monkeypatch.setattr(collocations, "safe_hashes", lambda low, total, down, starts, ends: np.full(len(starts), 7, np.uint64))
        counter = collocations._Counter(1, 1, None, None, 3)
        codes, (data, offsets) = counter.langs(pa.array([r[0] for r in rows])), collocations.flat(pa.array([r[1] for r in rows]))
        batches = [*counter.add(data, offsets, codes, len(data)), *counter.add(data, offsets, codes, len(data)), *counter.leave()]
        whole = collocations.merge_runs(pa.Table.from_batches(batches), 1).to_pylist()
        found = Counter({(r["lang"], (r["phrase"],)): r["times"] for r in whole if r["phrase"] is not None})
        assert found == Counter({k: 2 * n for k, n in plain_counts(rows, 1).items()})
        monkeypatch.undo()
        monkeypatch.setattr(collocations, "SLOT_BITS", bits)


def test_known_words_are_not_looked_up_one_by_one(monkeypatch):
    words = [f"w{k}" for k in range(1000)]
    data, offsets = collocations.flat(pa.array([" ".join(words * 3)]))
    counter, asked = collocations._Counter(1, 1, None, None, 3), []
    by_bytes = collocations.Words._by_bytes
    monkeypatch.setattr(collocations.Words, "_by_bytes", lambda self, low, starts, *a: asked.append(len(starts)) or by_bytes(self, low, starts, *a))
    for _ in range(5):
        list(counter.add(data, offsets, counter.langs(pa.array(["en"])), len(data)))
    assert sum(asked[:2]) == 1000 and sum(asked[2:]) < 40
