"""Benchmark passages against brute force, and the pipeline against a plain version of its stages."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from logweave.llm import decontaminate, toxicity
from logweave.llm.text import fold
from tests.llm.test_dedup import normal, order
from tests.llm.test_jaccard import plain_kept
from tests.llm.test_tokens import BPE

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


@pytest.fixture(scope="module")
def items(rows):
    def part(i, low, high):
        return " ".join(words(rows[i][1])[low:high])

    return [
        (1, part(0, 0, 25)), (2, part(4, 2, 14).upper()), (2, part(4, 2, 14)), (30, "two words"), (31, "word"), (4, None),
        (5, ""), (6, "?! ."), (None, part(8, 0, 12)), (7, "an item that no document has anywhere at all in it"), (8, part(0, 3, 20)),
    ]


def plain_hits(text, items, window=10):
    mine, hit, found = words(text), set(), set()
    for item, passage in items:
        theirs = words(passage)
        size = min(window, len(theirs))
        wanted = {tuple(theirs[k : k + size]) for k in range(len(theirs) - size + 1)} if size else set()
        for k in range(len(mine) - size + 1) if size else ():
            if tuple(mine[k : k + size]) in wanted:
                hit.update(range(k, k + size))
                found.add(item)
    return len(mine), len(hit), tuple(sorted(str(i) for i in found if i is not None))


@pytest.mark.parametrize("block", [decontaminate.BLOCK, 9])
def test_passages(spark, docs, rows, items, block):
    """All windows at once, and in many blocks."""
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontaminate.find_passages(docs, benchmark, block_rows=block).collect()
    expected = Counter((i, *plain_hits(t, items)) for i, t in rows)
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in found) == expected
    assert sum(e[2] > 0 for e in expected) > 5
    assert all(sum(s.high - s.low for s in r.spans) == r.n_hit for r in found)


def test_nothing_to_find_and_nothing_to_search(spark, docs, nothing, items):
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    assert decontaminate.find_passages(nothing, benchmark).count() == 0
    found = decontaminate.find_passages(docs, benchmark.where("false"))
    assert found.where("n_hit = 0").count() == docs.count()


def test_proximity(spark):
    docs = spark.createDataFrame(
        [(1, "red big blue green"), (2, "red blue green"), (3, "red big old blue green"), (4, "red blue"), (5, "green")], "doc_id int, text string"
    )
    items = spark.createDataFrame([(1, "red blue green")], "item_id int, text string")
    near = lambda slop: {
        r.doc_id for r in decontaminate.find_passages(docs, items, slop=slop).where("n_hit > 0").collect()
    }
    assert near(0) == {2} and near(1) == {1, 2} and near(2) == {1, 2, 3}


def test_drop_contaminated(spark, docs, rows, items):
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    kept = decontaminate.drop_contaminated(docs, benchmark)
    assert kept.dtypes == docs.dtypes
    expected = Counter((i, t) for i, t in rows if not plain_hits(t, items)[1])
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == expected


def test_pipeline_stages(spark, docs, rows, items, tmp_path):
    """Every stage against a plain version on what the stage before it kept."""
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    labels = [(i, 1, int(i % 5 == 0)) for i, _ in rows if i is not None]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    sf, current = str(tmp_path), spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact_dedup", "simhash_near_dedup", "decontamination", "bpe_round_trip"]

    def run(name):
        made = stages[name](spark, current, sf)
        made.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    def pairs(frame):
        return Counter((r.doc_id, r.text) for r in frame.select("doc_id", "text").collect())

    model = toxicity.train(current, spark.read.parquet(f"{tmp_path}/labels.parquet"), "toxic", fold("doc_id", 3, 1))
    scores = toxicity.score(current.select("doc_id", "text"), model).where("score < 0.7").select("doc_id")
    after = run("toxicity")
    assert after.columns == docs.columns
    assert Counter(r.doc_id for r in after.select("doc_id").collect()) == Counter(r.doc_id for r in scores.collect())

    current, left = after, pairs(after)
    after = run("exact_dedup")
    first = {}
    for i, t in left:
        first[normal(t)] = min(i, first.get(normal(t), i), key=order)
    assert Counter((normal(t), i) for i, t in pairs(after)) == Counter(first.items())

    current, left = after, list(pairs(after))
    after = run("simhash_near_dedup")
    assert Counter(order(i) for i, _ in pairs(after)) == plain_kept(left)

    current, left = after, list(pairs(after))
    after = run("decontamination")
    assert pairs(after) == Counter((i, t) for i, t in left if not plain_hits(t, items)[1])

    current, left = after, list(pairs(after))
    library = Tokenizer.from_file(BPE)
    expected = Counter()
    for i, t in left:
        ids = library.encode(t or "", add_special_tokens=False).ids
        expected[(i, hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), tuple(ids))] += 1
    assert Counter((r.doc_id, r.ids_sha256, tuple(r.ids)) for r in run("bpe_round_trip").collect()) == expected
    assert corpus_pipeline.run(spark, sf).count() == len(left)
