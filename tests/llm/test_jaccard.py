"""Near copies of the pipeline against brute force over whole shingle sets."""

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from logweave.llm import jaccard
from tests.llm.test_dedup import order


def plain_shingles(text, size=5):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))}


def plain_kept(rows):
    sets, parent = [plain_shingles(t) for _, t in rows], list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        groups[find(k)].append(order(i))
    return Counter(min(g) for g in groups.values())


def edited_rows():
    """Texts of 20 to 300 words with copies in which some words differ, and chains of copies of copies."""
    rnd = random.Random(11)
    vocabulary = [f"w{k}" for k in range(4000)]
    texts = []
    for _ in range(25):
        words = rnd.choices(vocabulary, k=rnd.randint(20, 300))
        for _ in range(rnd.randint(2, 8)):
            texts.append(" ".join(words))
            start = words if rnd.random() < 0.5 else list(words)
            for at in rnd.sample(range(len(start)), rnd.randint(1, max(1, len(start) // 45))):
                start[at] = rnd.choice(vocabulary)
            words = start
            texts.append(" ".join(words) + rnd.choice(["", " end", " a new end of it"]))
    return list(enumerate(texts))


def test_edited_copies_go(spark):
    rows = edited_rows()
    expected = plain_kept(rows)
    assert len(expected) < len(rows) - 50
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert Counter(order(r.doc_id) for r in kept.collect()) == expected


def test_nulls_short_and_equal_rows(spark, docs, rows, nothing):
    kept = jaccard.drop_near_copies(docs)
    assert kept.dtypes == docs.dtypes
    assert Counter(order(r.doc_id) for r in kept.collect()) == plain_kept(rows)
    assert jaccard.drop_near_copies(nothing).count() == 0


def test_all_of_a_shared_band_meet(spark, monkeypatch):
    """With every text in the same bands, what the ends of a band do not link meets in pairs."""
    monkeypatch.setattr(jaccard, "_simhash_pairs", lambda distinct: distinct.select(F.col("node").alias("a"), F.col("node").alias("b")))
    rows = edited_rows()[:60]
    made = [(i, sorted(plain_shingles(t)), t) for i, t in rows]
    hashes, starts = jaccard.shingle_hashes(pa.array([t for _, _, t in made]))
    short = jaccard.sketches(jaccard.minima(hashes, starts)).tolist()
    distinct = spark.createDataFrame(
        [(i, len(s), list(range(jaccard.BANDS)), k, 0, i) for (i, s, _), k in zip(made, short)],
        "node bigint, size bigint, bands array<bigint>, sketch array<bigint>, fp bigint, least bigint",
    )
    texts = spark.createDataFrame([(i, t) for i, _, t in made], "least bigint, text string")
    found = jaccard.components(jaccard.links(distinct, texts, 5, Fraction("0.8"))).collect()
    linked = {r.node for r in found} - {r.component for r in found}
    unique = {frozenset(plain_shingles(t)) for _, t in rows}
    assert len(rows) - len(linked) == sum(plain_kept(rows).values()) <= len(unique)


def test_pairs_below_the_similarity_become_no_rows(spark):
    """Texts of one family that all differ too much: before, the sketch let most of their pairs be rows."""
    rnd = random.Random(5)
    vocabulary = [f"w{k}" for k in range(4000)]
    base, rows = rnd.choices(vocabulary, k=150), []
    for i in range(40):
        words = list(base)
        for at in rnd.sample(range(150), 3 if i % 8 else 1):
            words[at] = rnd.choice(vocabulary)
        rows.append((i, " ".join(words)))
    sets = [plain_shingles(t) for _, t in rows]
    similar = {(i, j) for j in range(40) for i in range(j) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    x = jaccard.with_bands(docs).select(F.struct("doc_id", "size", "sketch").alias("x"))
    pairs = x.join(x.withColumnRenamed("x", "y"), F.expr("x.doc_id < y.doc_id")).where(jaccard._may_reach("x", "y", Fraction("0.8")))
    met = {(r.a, r.b) for r in pairs.select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).collect()}
    assert similar <= met
    assert len(met) <= len(similar) + 100


def test_parities_differ_in_no_more_places_than_sets():
    rng = np.random.default_rng(9)
    for size, changed in [(1, 1), (3, 0), (150, 20), (2000, 150), (5000, 5000)]:
        pool = rng.integers(0, 1 << 63, size + changed, dtype=np.uint64)
        both = np.concatenate([pool[:size], pool[changed:]])
        made = jaccard.parities(both, np.array([0, size, 2 * size])).view(np.uint64)
        assert np.bitwise_count(made[0] ^ made[1]).sum() <= 2 * min(changed, size)


def test_all_near_fingerprints_meet(spark):
    """Each pair of fingerprints within two bits is a pair of nodes, not only the least and greatest neighbours."""
    prints = {10: 0, 11: 1, 12: 2, 13: 3, 14: 1 << 40 | 3, 15: 0xFF << 20}
    distinct = spark.createDataFrame(list(prints.items()), "node bigint, fp bigint")
    found = {frozenset((r.a, r.b)) for r in jaccard._simhash_pairs(distinct).collect()}
    assert found == {frozenset((x, y)) for x in prints for y in prints if x < y and (prints[x] ^ prints[y]).bit_count() <= 2}


@pytest.mark.parametrize("similarity", [0.8, 0.85, 0.9])
def test_bands_bring_similar_texts_together(similarity):
    rng = np.random.default_rng(4)
    met, tried, size = 0, 400, 300
    for _ in range(tried):
        same = round(2 * size * similarity / (1 + similarity))
        pool = rng.integers(0, 1 << 63, 2 * size - same, dtype=np.uint64)
        both = np.concatenate([pool[:size], pool[size - same :]])
        least = jaccard.minima(both, np.array([0, size, 2 * size]))
        keys, short = jaccard.band_keys(least), jaccard.sketches(least).view(np.uint64)
        near = np.bitwise_count(short[0] ^ short[1]).sum() <= jaccard.SKETCH_BITS
        met += bool((keys[0] == keys[1]).any() and near)
    assert met == tried
