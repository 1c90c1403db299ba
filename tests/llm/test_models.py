"""Trained models: accuracy on held-out rows, defined cases, and the methods against plain versions."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logweave.llm import language, quality, toxicity
from logweave.llm.text import fold

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def labelled(spark):
    """Two kinds of text: label 1 has an insult beside a group, label 0 has one of both or none."""
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(1200):
        words = [f"w{rng.integers(0, 60)}" for _ in range(rng.integers(5, 40))]
        kind = i % 4
        words += {0: [], 1: ["vile"], 2: ["folks"], 3: ["vile", "folks"]}[kind]
        rng.shuffle(words)
        shout = i % 5 == 0
        text = " ".join(words)
        rows.append((i, text.upper() + "!!" if shout else text + "."))
        labels.append((i, int(kind == 3), int(not shout)))
    rows += [(None, None), (None, ""), (3, "again"), (9000, None), (9001, "")]
    labels += [(None, 1, 1), (5, None, None), (7, 1, 0), (9000, 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    return docs, spark.createDataFrame(labels, "doc_id bigint, toxic int, quality int"), rows


def accuracy(scored, labels, label, held_out):
    joined = scored.where(held_out).join(labels, "doc_id").where(F.col(label).isNotNull() & (F.col("doc_id") > 100))
    right = (F.col("score") >= 0.5).cast("int") == F.col(label)
    return joined.agg(F.avg(right.cast("double"))).first()[0]


@pytest.mark.parametrize("module,label", [(toxicity, "toxic"), (quality, "quality")])
def test_learns_and_scores_every_row(labelled, module, label):
    docs, labels, rows = labelled
    held_out = fold("doc_id", 3, 1)
    model = module.train(docs, labels, label, held_out)
    scored = module.score(docs, model)
    found = scored.collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    assert len({r.score for r in found if r.doc_id in (9000, 9001)}) == 1
    assert accuracy(scored, labels, label, held_out) > 0.95


@pytest.mark.parametrize("module", [toxicity, quality])
def test_without_labels_or_rows(labelled, module):
    docs, labels, rows = labelled
    model = module.train(docs, labels.where("false"), "toxic", F.lit(False))
    assert {r.score for r in module.score(docs, model).collect()} == {0.5}
    assert module.score(docs.where("false"), model).count() == 0


def test_sample_is_bounded(labelled):
    docs, labels, _ = labelled
    found = toxicity.labelled_sample(
        docs, labels, "toxic", F.lit(False), 100,
        lambda b: toxicity.record(key=b.column(0), stats=pa.array([[1.0]] * b.num_rows)), "key bigint, stats array<double>", "stats",
    )
    assert 50 < found.count() < 170


def test_drop_toxic_keeps_columns(labelled):
    docs, labels, rows = labelled
    wide = docs.withColumn("key", F.lit("x")).withColumn("score", F.lit(1))
    model = toxicity.train(docs, labels, "toxic", F.lit(False))
    kept = toxicity.drop_toxic(wide, model)
    assert kept.columns == wide.columns
    share = kept.where("text like '%vile%' and text like '%folks%'").count()
    assert share < 30 and kept.count() > 850


def test_machine_is_the_sum_over_pairs():
    rng = np.random.default_rng(3)
    machine = toxicity.Machine(0.3, rng.normal(size=5), rng.normal(size=(5, 3)), np.arange(5))
    features = [0, 2, 3]
    pairs = sum(machine.vectors[a] @ machine.vectors[b] for a in features for b in features if a < b)
    expected = 1 / (1 + math.exp(-(0.3 + machine.weights[features].sum() + pairs)))
    found = machine.score(np.zeros(3, np.int64), np.array(features), 1)
    assert found[0] == pytest.approx(expected)


def test_flat_trees_are_walked_as_trees():
    rng = np.random.default_rng(4)
    rows = rng.normal(size=(500, len(quality.STATISTICS)))
    forest = quality.fit(rows, (rows[:, 0] * rows[:, 1] > 0).astype(float))

    def walk(row):
        margin = forest.base
        for tree in range(len(forest.leaf)):
            node = 0
            while node < forest.feature.shape[1]:
                node = 2 * node + (2 if row[forest.feature[tree, node]] > forest.threshold[tree, node] else 1)
            margin += forest.leaf[tree, node - forest.feature.shape[1]]
        return 1 / (1 + math.exp(-margin))

    assert forest.score(rows) == pytest.approx([walk(r) for r in rows])
    assert ((forest.score(rows) > 0.5) == (rows[:, 0] * rows[:, 1] > 0)).mean() > 0.95


def test_statistics_of_a_text():
    found = quality.statistics(pa.array(["Ab, cd\nAb, cd!", None, "", "é"]))
    row = dict(zip(quality.STATISTICS, found[0]))
    assert row["log_bytes"] == pytest.approx(math.log1p(14)) and row["log_words"] == pytest.approx(math.log1p(4))
    assert row["upper"] == pytest.approx(2 / 8) and row["exclaims"] == pytest.approx(1 / 14)
    assert row["distinct_words"] == pytest.approx(3 / 4) and row["distinct_lines"] == 1
    assert not found[1].any() and not found[2].any()


# --- languages -------------------------------------------------------------------------------------------------------


def plain_phrases(text, sample):
    total = 0
    for low in range(0, len(text), language.STRETCH):
        part, at = text[low : low + language.STRETCH], 0
        total += 1
        match = b""
        while at < len(part):
            longer = match + part[at : at + 1]
            if longer in sample:
                match = longer
            else:
                total += 1
                match = part[at : at + 1] if part[at : at + 1] in sample else b""
            at += 1
    return total


def test_phrases_are_longest_matches():
    rng = np.random.default_rng(6)
    draw = lambda letters, n: bytes(rng.choice(list(letters), n).tolist())
    samples = {"x": draw(b"abc ", 300), "y": draw(b"cde ", 200)}
    batch = [draw(b"abcde z", n) for n in (0, 1, 5, 100, 511, 512, 513, 1500)]
    found = language.Parser(samples).phrases(batch)
    expected = [[plain_phrases(t, s) for s in samples.values()] for t in batch]
    # A first byte that no sample has breaks at once in the tables; the plain version counts the same.
    assert found.tolist() == expected


def test_automaton_accepts_substrings_only():
    data = b"abcabxabcd"
    moves = language.suffix_automaton(data)
    every = {data[i:j] for i in range(len(data)) for j in range(i, len(data) + 1)}

    def accepts(word):
        state = 0
        for byte in word:
            if byte not in moves[state]:
                return False
            state = moves[state][byte]
        return True

    assert all(accepts(w) for w in every)
    assert not any(accepts(w + b"x") for w in every if w + b"x" not in every)


def test_language_of_every_row(spark, docs, rows, nothing):
    texts = [(i, t, l) for i, (t, l) in enumerate([("the cat sat on the mat " * 5, "en"), ("le chat est sur la table " * 5, "fr")] * 20)]
    odd = [(100, None, "en"), (101, "", "fr"), (102, "12 34 !!", "en"), (None, "the mat", None), (103, "LE CHAT", None), (103, "the cat", None)]
    made = spark.createDataFrame(texts + odd, "doc_id bigint, text string, lang string")
    parser = language.train(made, fold("doc_id", 4, 2))
    found = language.predict(made, parser)
    by = {(r.doc_id, r.lang_pred): r.score for r in found.collect()}
    assert all((i, l) in by for i, _, l in texts)
    assert by[(100, "und")] == by[(101, "und")] == by[(102, "und")] == 0.0
    assert {(None, "en"), (103, "fr"), (103, "en")} <= set(by) and all(0 <= s <= 1 for s in by.values())
    assert found.count() == len(texts) + len(odd)
    nobody = language.train(made.where("false"), F.lit(False))
    assert {r.lang_pred for r in language.predict(docs, nobody).collect()} == {"und"}
    assert language.predict(nothing, parser).count() == 0


def test_held_out_accuracy(spark):
    pytest.importorskip("duckdb")
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(3000).cache()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    held_out = fold("doc_id", 4, 2)
    scored = quality.score(docs, quality.train(docs, labels, "quality", held_out))
    assert accuracy(scored, labels, "quality", held_out) > 0.95
    found = language.predict(docs, language.train(docs, held_out))
    joined = found.join(docs.select("doc_id", "lang"), "doc_id").where(held_out & F.col("lang").isNotNull())
    assert joined.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.95
