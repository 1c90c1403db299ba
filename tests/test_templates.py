import math
import random
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from logweave.operators import dialects, rule_index, classify, grouping, metrics, mining, patterns
from logweave.operators.mining import GROUP, mine

# --- a plain sequential miner, written from the description of the algorithm ---------------------------------------


def sequential(messages, depth, threshold, max_children, best):
    trees, clusters, out = {}, [], []
    for text in messages:
        tokens = text.split()
        n = len(tokens)
        path = tokens[: min(depth - (3 if best else 2), n - 1)] if depth > 2 else []
        root = trees.setdefault(n, {"children": {}, "ids": []})
        node = root
        for token in path:
            node = node["children"].get(token) or node["children"].get("<*>")
            if node is None:
                break
        chosen = None
        if node is not None:
            scored = []
            for i in node["ids"]:
                template = clusters[i]
                wild = sum(t == "<*>" for t in template)
                equal = sum(a == b for a, b in zip(tokens, template) if b != "<*>")
                if best:
                    scored.append((equal / n, wild, -i))
                elif (equal + wild) / n >= threshold:
                    chosen = i
                    break
            if best and scored and max(scored)[0] >= threshold:
                chosen = -max(scored)[2]
        if chosen is None:
            clusters.append(list(tokens))
            chosen = len(clusters) - 1
            node = root
            for token in path:
                children = node["children"]
                if token in children:
                    name = token
                elif best:
                    if any(c.isdigit() for c in token):
                        name = "<*>"
                    elif "<*>" in children:
                        name = token if len(children) < max_children else "<*>"
                    else:
                        name = token if len(children) + 1 < max_children else "<*>"
                else:
                    name = token if token[0].isalnum() and len(children) < max_children else "<*>"
                node = children.setdefault(name, {"children": {}, "ids": []})
            node["ids"].append(chosen)
        else:
            clusters[chosen] = [b if a == b else "<*>" for a, b in zip(tokens, clusters[chosen])]
        out.append((chosen, " ".join(clusters[chosen])))
    return out, [" ".join(c) for c in clusters]


def random_messages(seed, n=400):
    rng = random.Random(seed)
    words = ["a", "b", "c", "-x", "_y", "1z", "d", "e", "f", "g"]
    out = []
    for i in range(n):
        # New words keep turning up, so that the tree keeps changing.
        extra = [f"w{chr(97 + i // 40)}"]
        size = rng.choice([1, 2, 3, 3, 3, 3, 4])
        out.append(" ".join(rng.choice(words + extra) for _ in range(size)))
    return out


def token_frame(spark, messages, config="c"):
    rows = [(config, "o", len(m.split()), i, m) for i, m in enumerate(messages)]
    return spark.createDataFrame(rows, "config string, origin string, n_tokens int, seq bigint, text string")


@pytest.mark.parametrize("best", [False, True])
@pytest.mark.parametrize("seed,params,chunk", [(1, (4, 0.5, 3), 1000), (2, (4, 0.6, 4), 40), (3, (5, 0.4, 100), 25), (4, (3, 0.34, 5), 16)])
def test_equals_one_sequential_pass(spark, seed, params, chunk, best):
    messages = random_messages(seed)
    expected, templates = sequential(messages, *params, best)
    mined = mine(token_frame(spark, messages), {"c": params}, best, chunk_rows=chunk)
    shift = 1 if best else 0
    rows = mined.assignments.orderBy("seq").collect()
    assert [(r["cluster_id"] - shift, r["template_at_assignment"]) for r in rows] == expected
    final = mined.clusters.orderBy("cluster_id").collect()
    assert [r["template"] for r in final] == templates
    assert sum(r["size"] for r in final) == len(messages)


@pytest.mark.parametrize("best", [False, True])
def test_resume_equals_one_run(spark, best):
    messages, params = random_messages(9), (4, 0.5, 4)
    configs = {"c": params}
    df = token_frame(spark, messages)
    first = mine(df.filter("seq < 230"), configs, best)
    second = mine(df.filter("seq >= 230"), configs, best, model=first.clusters, chunk_rows=50)
    whole = mine(df, configs, best)
    columns = ["cluster_id", "template", "size", "first_template"]
    assert second.clusters.select(columns).orderBy("cluster_id").collect() == whole.clusters.select(columns).orderBy("cluster_id").collect()
    late = whole.assignments.filter("seq >= 230").orderBy("seq").collect()
    assert second.assignments.orderBy("seq").collect() == late


def test_masked_messages(spark):
    rows = [(i, f"job {i + 10} done") for i in range(6)] + [(6, "job x failed now"), (7, "job x failed now")]
    df = spark.createDataFrame([("o", i, m) for i, m in rows], "origin string, seq bigint, message string")
    for result in (mining.mine_templates_first_match(df), mining.mine_templates_best_match(df)):
        found = sorted((r["size"], r["n_tokens"]) for r in result.clusters.collect())
        assert found == [(2, 4), (6, 3)]
        assert result.assignments.count() == 8
    assert set(mining.mine_templates_best_match(df).clusters.first()["template"].split()) & {"<NUM>", "failed"}


def test_two_configs_side_by_side(spark):
    messages = random_messages(5)
    tokens = token_frame(spark, messages)
    configs = {"tight": (4, 0.9, 100), "loose": (4, 0.2, 100)}
    mined = mining.sweep_configs(tokens, configs)
    for name, params in configs.items():
        expected = sequential(messages, *params, False)[1]
        got = [r["template"] for r in mined.clusters.filter(F.col("config") == name).orderBy("cluster_id").collect()]
        assert got == expected
    assert metrics.metrics_by_config(mined.clusters).count() == 2
    assert set(GROUP) == {"config", "origin", "n_tokens"}


def test_quality(spark):
    rows = [("even", s, "a <*> NUM") for s in (1, 1, 1, 1)] + [("odd", s, "x") for s in (7, 1)]
    found = {r["origin"]: r for r in metrics.cluster_quality(spark.createDataFrame(rows, "origin string, size bigint, template string")).collect()}
    assert (found["even"]["entropy"], found["even"]["gini_coefficient"], found["even"]["avg_wildcards_per_template"]) == (2.0, 0.0, 2.0)
    assert found["odd"]["gini_coefficient"] == 0.375
    assert found["odd"]["entropy"] == round(-(7 / 8 * math.log2(7 / 8) + 1 / 8 * math.log2(1 / 8)), 3)


# --- groups --------------------------------------------------------------------------------------------------------


def average_linkage(vectors, threshold):
    """Merge the closest pair of groups until none is closer than the threshold."""
    distance = 1 - vectors @ vectors.T
    groups = [[i] for i in range(len(vectors))]
    while len(groups) > 1:
        best = min(
            (np.mean([distance[a, b] for a in x for b in y]), i, j)
            for i, x in enumerate(groups)
            for j, y in enumerate(groups)
            if i < j
        )
        if best[0] >= threshold:
            break
        groups[best[1]] += groups[best[2]]
        del groups[best[2]]
    return {frozenset(g) for g in groups}


def groups_of(rows, label):
    found = {}
    for row in rows:
        found.setdefault(row[label], set()).add(row["id"])
    return {frozenset(g) for g in found.values()}


@pytest.mark.parametrize("seed,block", [(0, 4096), (1, 4096), (2, 10), (3, 7)])
def test_groups_equal_average_linkage(spark, seed, block):
    rng = np.random.RandomState(seed)
    vectors = rng.normal(size=(40, 5))
    vectors[30:34] = vectors[3]
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    df = spark.createDataFrame([("o", i, v.tolist()) for i, v in enumerate(vectors)], "origin string, id bigint, embedding array<double>")
    thresholds = [0.1, 0.4, 0.7]
    rows = grouping.link(df, thresholds, block).collect()
    assert len(rows) == 40
    for i, threshold in enumerate(thresholds):
        labelled = [{"id": r["id"], "g": r["labels"][i]} for r in rows]
        assert groups_of(labelled, "g") == average_linkage(vectors, threshold)
    assert groups_of(grouping.group_templates(df, 0.4, block).collect(), "group_id") == average_linkage(vectors, 0.4)


def test_rounds_keep_neighbours(spark, monkeypatch):
    """Only nodes that merged, or whose neighbour did, look for their nearest node again: about 4 times each, not in all rounds."""
    rng = np.random.RandomState(9)
    vectors = rng.normal(size=(600, 6))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    df = spark.createDataFrame([("o", i, v.tolist()) for i, v in enumerate(vectors)], "origin string, id bigint, embedding array<double>")
    looked, best = [], grouping._best_others
    monkeypatch.setattr(grouping, "_best_others", lambda rows, own, centres: looked.append(len(rows)) or best(rows, own, centres))
    nodes = [(i, v, 1.0, i, float("nan")) for i, v in enumerate(vectors)]
    made = grouping._link_locally([0.1, 0.3])(pd.DataFrame(nodes, columns=["node", "vec", "weight", "other", "similarity"]).assign(origin="o"))
    assert looked[0] == 600 and len(looked) > 5 and sum(looked) < 5 * 600
    monkeypatch.undo()
    # Rounds over blocks give the same groups.
    rows = {r["id"]: list(r["labels"]) for r in grouping.link(df, [0.1, 0.3], 400).collect()}
    assert rows == {n: list(x) for n, x in zip(made["node"], made["labels"])}


def test_silhouettes_of_a_sweep(spark):
    """Against all distances; single members count as zero."""
    rng = np.random.RandomState(3)
    vectors = rng.normal(size=(60, 4))
    df = spark.createDataFrame([("o", i, v.tolist()) for i, v in enumerate(vectors)], "origin string, id bigint, embedding array<double>")
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    distance = 1 - unit @ unit.T
    thresholds = [0.001, 0.1, 0.3, 0.6]
    found = {r["threshold"]: r for r in grouping.threshold_sweep(df, thresholds).collect()}
    for threshold in thresholds:
        groups = [sorted(g) for g in average_linkage(unit, threshold)]
        assert found[threshold]["n_groups"] == len(groups)
        scores = []
        for group in groups:
            for x in group:
                a = distance[x, group].sum() / max(1, len(group) - 1)
                b = min((distance[x, g].mean() for g in groups if g is not group), default=0)
                scores.append(0 if len(group) == 1 else (b - a) / max(a, b))
        wanted = None if len(groups) in (1, 60) else pytest.approx(np.mean(scores))
        assert found[threshold]["silhouette"] == wanted


def scratch_tables(spark, label="*"):
    from logweave import session

    return {f: sum(x.stat().st_size for x in f.glob("*.parquet")) for f in Path(session._own_scratch(spark)).glob(f"{label}-*")}


def stored_plans(monkeypatch):
    """Plans of what grouping stores, by label."""
    plans, store = {}, grouping.materialize

    def stored(df, label, *args, **kwargs):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return store(df, label, *args, **kwargs)

    monkeypatch.setattr(grouping, "materialize", stored)
    return plans


def random_vectors(spark, n, places, seed):
    vectors = np.random.RandomState(seed).normal(size=(n, places))
    return spark.createDataFrame([("o", i, v.tolist()) for i, v in enumerate(vectors)], "origin string, id bigint, embedding array<double>")


def test_rounds_of_linkage_neither_copy_vectors_nor_keep_old_tables(spark, monkeypatch):
    """Blocks meet without a shuffle, and tables of earlier rounds are gone."""
    plans, before = stored_plans(monkeypatch), scratch_tables(spark, "link-nodes")
    assert grouping.link(random_vectors(spark, 400, 8, 12), [0.1, 0.5], 150).count() == 400
    assert "CartesianProduct" in plans["nearest-parts"] and "Exchange" not in plans["nearest-parts"]
    assert len(scratch_tables(spark, "link-nodes").keys() - before.keys()) == 1


def test_a_sweep_holds_no_vector_for_each_threshold(spark, monkeypatch):
    """Vectors meet the means of their groups without a shuffle, and no table of means is left."""
    plans, before, thresholds = stored_plans(monkeypatch), scratch_tables(spark), [round(0.01 * i, 2) for i in range(1, 15)]
    df = random_vectors(spark, 400, 4, 14)
    found = {r["threshold"]: r for r in grouping.threshold_sweep(df, thresholds).collect()}
    assert "CartesianProduct" in plans["silhouette-parts"] and "Exchange" not in plans["silhouette-parts"]
    assert not [f for f in scratch_tables(spark).keys() - before.keys() if f.name.startswith(("silhouette-left", "silhouette-right", "silhouette-means"))]
    labels = {r["id"]: list(r["labels"]) for r in grouping.link(df, thresholds).collect()}
    rows = df.join(spark.createDataFrame([(k, v[-1]) for k, v in labels.items()], "id bigint, label bigint"), "id")
    assert found[thresholds[-1]]["silhouette"] == pytest.approx(grouping.silhouette(rows))


def test_pairs_keep_one_table_of_vectors(spark):
    before = scratch_tables(spark)
    pairs = grouping.cosine_pairs(random_vectors(spark, 200, 4, 15).select("origin", F.col("id").alias("node"), F.col("embedding").alias("vec")), 2.5, 50)
    assert pairs.count() == pairs.where("a < b and similarity >= 2.5").count() > 0
    assert not [f for f in scratch_tables(spark).keys() - before.keys() if f.name.startswith(("pair-vectors", "sided-vectors"))]


def test_silhouette_of_odd_labels(spark):
    """A group without a label is a neighbour whose members are not scored; labels may be of any type."""
    rows = [([1.0, 0.0], "a"), ([0.9, 0.1], "a"), ([0.0, 1.0], None), ([0.1, 0.9], None), ([0.7, 0.7], "b")]
    vectors = np.array([v for v, _ in rows])
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    distance = 1 - unit @ unit.T
    scores = [1 - distance[0, 1] / min(distance[x, [2, 3]].mean(), distance[x, 4]) for x in (0, 1)]
    assert grouping.silhouette(spark.createDataFrame(rows, "embedding array<double>, label string")) == pytest.approx(sum(scores) / 5)
    # More rows than a batch, a block or the number of rows that add up together.
    many = np.random.RandomState(5).normal(size=(20000, 3)) + np.repeat([[4, 0, 0], [0, 4, 0]], 10000, axis=0)
    frame = spark.createDataFrame(pd.DataFrame({"embedding": list(many), "label": np.repeat([0, 1], 10000)}))
    unit = many / np.linalg.norm(many, axis=1)[:, None]
    means = unit[:10000].mean(axis=0), unit[10000:].mean(axis=0)
    inside = np.concatenate([1 - unit[:10000] @ means[0], 1 - unit[10000:] @ means[1]]) * 10000 / 9999
    outside = np.concatenate([1 - unit[:10000] @ means[1], 1 - unit[10000:] @ means[0]])
    assert grouping.silhouette(frame) == pytest.approx(np.mean((outside - inside) / np.maximum(inside, outside)))


@pytest.mark.parametrize("block", [4096, 9])
def test_pairs(spark, block):
    rng = np.random.RandomState(4)
    vectors = rng.normal(size=(50, 4))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    df = spark.createDataFrame([("o", i, v.tolist()) for i, v in enumerate(vectors)], "origin string, node bigint, vec array<double>")
    found = {(r["a"], r["b"]) for r in grouping.cosine_pairs(df, 0.5, block).collect()}
    similarity = vectors @ vectors.T
    assert found == {(i, j) for i in range(50) for j in range(i + 1, 50) if similarity[i, j] >= 0.5}


def test_vectors_go_to_no_more_tasks_when_there_are_more(spark):
    """All directions, so no pair of blocks is left out: four times the vectors met in four times as many blocks."""
    met = []
    for n in (400, 1600):
        vectors = np.random.RandomState(8).normal(size=(n, 6))
        vectors /= np.linalg.norm(vectors, axis=1)[:, None]
        df = spark.createDataFrame([("o", i, v.tolist()) for i, v in enumerate(vectors)], "origin string, node bigint, vec array<double>")
        block = grouping.pair_block(df, 20)
        met.append(grouping.near_blocks(df, 0.0, block)[1].where("near").count())
        found = {(r["a"], r["b"]) for r in grouping.cosine_pairs(df, 0.8, 20).collect()}
        i, j = np.nonzero(np.triu(vectors @ vectors.T >= 0.8, 1))
        assert found == set(zip(i.tolist(), j.tolist()))
    assert met[1] <= met[0] * 1.5
    assert grouping.pair_block(df.where("false"), 20) == 20 and grouping.pair_block(df, 2000) == 2000


def test_far_blocks_do_not_meet(spark):
    """Vectors around few directions: the same pairs, from fewer pairs of blocks."""
    rng = np.random.RandomState(6)
    centres = rng.normal(size=(8, 24))
    vectors = np.concatenate([c + rng.normal(size=(40, 24)) * 0.15 for c in centres])
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    df = spark.createDataFrame([("o", i, v.tolist()) for i, v in enumerate(vectors)], "origin string, node bigint, vec array<double>")
    _, pairs = grouping.near_blocks(df, 0.8, 40)
    counts = pairs.agg(F.count(F.lit(1)).alias("all"), F.count_if("near").alias("near")).first()
    assert counts["near"] < counts["all"] / 2
    found = {(r["a"], r["b"]) for r in grouping.cosine_pairs(df, 0.8, 40).collect()}
    similarity = vectors @ vectors.T
    assert found == {(i, j) for i in range(320) for j in range(i + 1, 320) if similarity[i, j] >= 0.8}


def test_silhouette_and_embedding(spark):
    vectors = [(0, [1.0, 0.0], 0), (1, [0.9, 0.1], 0), (2, [0.0, 1.0], 1), (3, [0.1, 0.9], 1)]
    df = spark.createDataFrame(vectors, "id int, embedding array<double>, label int")
    assert grouping.silhouette(df) > 0.9
    assert grouping.silhouette(df.withColumn("label", F.col("id"))) is None
    assert grouping.silhouette(df.withColumn("label", F.lit(1))) is None
    templates = [(0, "open file <NUM>"), (1, "open file <NUM> again"), (2, "user left"), (3, "user <*> left"), (4, "open file <HEX>")]
    embedded = grouping.embed_templates(spark.createDataFrame(templates, "id bigint, template string")).orderBy("id").collect()
    matrix = np.array([r["embedding"] for r in embedded])
    assert np.allclose(np.linalg.norm(matrix, axis=1), 1)
    assert np.allclose(matrix[0], matrix[4])  # equal once placeholders are
    assert matrix[0] @ matrix[1] > matrix[0] @ matrix[2]


def test_templates_without_terms_are_one_group(spark):
    templates = [(0, ""), (1, "   "), (2, "disk full"), (3, "disk is full")]
    frame = spark.createDataFrame(templates, "id bigint, template string")
    found = {r["id"]: np.array(r["embedding"]) for r in grouping.embed_templates(frame, 64).collect()}
    assert np.allclose(found[0], found[1]) and abs(found[0] @ found[2]) < 1e-12 and found[2] @ found[3] > 0.2


def test_arrival_numbers_over_files(spark):
    rows = [("o", f, n, f"job {f}{n}") for f in "ab" for n in range(1, 5)] + [("p", "a", 9, "x")]
    df = spark.createDataFrame(rows, "origin string, file_path string, line_no bigint, message string").repartition(3)
    found = {(r["origin"], r["file_path"], r["line_no"]): r["seq"] for r in mining.number_arrivals(df).collect()}
    assert found == {("o", f, n): 4 * "ab".index(f) + n for f in "ab" for n in range(1, 5)} | {("p", "a", 9): 1}
    with pytest.raises(ValueError, match="unique"):
        mining.mine_templates_best_match(df.selectExpr("origin", "line_no as seq", "message"))


# --- rules ---------------------------------------------------------------------------------------------------------


def members(spark, *groups):
    rows = [("o", g, i, str(i), t) for g, templates in enumerate(groups) for i, t in enumerate(templates)]
    return spark.createDataFrame(rows, "origin string, group_id bigint, ord int, cluster_id string, template string")


def test_group_patterns(spark):
    found = {
        r["group_id"]: r
        for r in patterns.synthesize_group_patterns(
            members(
                spark,
                ["open file <NUM> (ok)", "open file <NUM> (bad)"],
                ["user left the room", "connection to <IP> refused"],
                ["a b c d", "a b c d e"],
                ["x <STACKTRACE> y"],
            )
        ).collect()
    }
    import re

    compiled = {g: re.compile(r["pattern"].replace(r"\z", r"\Z")) for g, r in found.items()}
    assert compiled[0].match("open file 12 (ok)") and compiled[0].match("open file 3 (bad)") and not compiled[0].match("open file 3 (odd)")
    assert compiled[1].match("user left the room") and compiled[1].match("connection to 1.2.3.4 refused") and not compiled[1].match("user left")
    assert compiled[2].match("a b c d") and compiled[2].match("a b c d e")
    assert compiled[3].pattern.count("|") == 1 and not compiled[3].match("x")
    assert found[0]["merged_template"] == "open file <NUM> <*>"


def test_template_to_pattern(spark):
    df = spark.createDataFrame([("User <*> at <IP>: 50% [x]", "User bob at 10.0.0.1: 50% [x]", "User bob at home: 50% [x]")], "t string, yes string, no string")
    pattern = patterns.template_to_pattern(F.col("t"))
    row = df.select(pattern.alias("p"), "yes", "no").selectExpr("yes rlike p", "no rlike p").first()
    assert tuple(row) == (True, False)


def test_rules_round_trip(spark):
    from logweave.plans.template_cycle import generate_templates

    texts = [f"job {i} finished on node{i % 3}" for i in range(10, 40)] + [f"disk {i} is full" for i in range(10, 20)] + ["all quiet"] * 4
    df = spark.createDataFrame([("app", i, t) for i, t in enumerate(texts)], "origin string, seq bigint, message string")
    made = generate_templates(df, distance_threshold=0.6)
    assert made.groups.agg(F.sum("num_members")).first()[0] == made.clusters.count()
    checked = patterns.validate_rules(made.rules).collect()
    assert all(r["compiles"] for r in checked)
    reviews = made.rules.select("representative_template", F.lit("batch").alias("event_type"), F.lit("low").alias("severity"))
    rules = patterns.review_rules(made.rules, reviews)
    records = df.withColumnRenamed("origin", "log_type")
    found = classify.classify_by_template(records, rules).collect()
    assert {r["event_type"] for r in found} == {"batch"}
    assert classify.unclassified(classify.classify_by_template(records, made.rules)).count() == len(texts)
    assert classify.uncovered_groups(made.groups, made.rules).count() <= made.groups.count()


def delimited():
    """Messages with delimiters outside their masked parts, and odd ones."""
    texts = [f"user=bob{i} id:{10 + i} path=/a/b{i} ok" for i in range(20)]
    texts += [f"retry [{10 + i}] of job(batch), code: {70 + i}" for i in range(20)]
    texts += [f"all {i + 10} done" for i in range(20)]
    texts += ["*****\n=====\nstart [block] 12", "value <NUM> of <*>", "key={a:1},[b]|c", "(1, 2, 3, 4, 5, 6, 7) list", "x " + "QUJD" * 12 + "1 end"]
    texts += ["2023-10-11 12:34:56 begin 77", "Time: 06-JUL-2026 21:12:31 stop", "select a, b from t where x = 1; done", "naïve café=9 über:10", " padded 12 "]
    texts += ["took-12ms at 0x1f, see https://h/p?q=1 [now]", '{"a": 1, "b": [2]} sent', "/u01/app/ora_12345.trc written", "a.b.c=1.2.3.4:8080"]
    return texts


@pytest.mark.parametrize("best", [True, False])
@pytest.mark.parametrize("literal", [0, 2_000])
def test_mined_rules_match_their_messages(spark, monkeypatch, best, literal):
    from logweave.plans.template_cycle import generate_templates

    monkeypatch.setattr(classify, "LITERAL_RULES", literal)
    texts = delimited()
    df = spark.createDataFrame([("app", i, t) for i, t in enumerate(texts)], "origin string, seq bigint, message string")
    made = generate_templates(df, best=best, distance_threshold=0.6)
    assert all(r["compiles"] for r in patterns.validate_rules(made.rules).collect())
    reviews = made.rules.select("representative_template", F.lit("e").alias("event_type"), F.lit("s").alias("severity"))
    records = df.withColumnRenamed("origin", "log_type")
    found = classify.classify_by_template(records, patterns.review_rules(made.rules, reviews))
    assert [r.message for r in classify.unclassified(found).collect()] == []
    dialect = dialects.best_match_dialect() if best else dialects.first_match_dialect()
    by_cluster = classify.classify_by_cluster(df.withColumn("id", F.col("seq")), made.clusters, dialect=dialect)
    assert by_cluster.where("cluster_id is null").count() == 0


def test_many_rules_and_clusters(spark):
    rules = [("app", i, f"r{i}", rf"^word{i} ", "e", "s") for i in range(450)]
    schema = "origin string, group_id bigint, representative_template string, pattern string, event_type string, severity string"
    messages = spark.createDataFrame([("app", f"word{i} x") for i in (0, 199, 200, 449)] + [("app", "none")], "log_type string, message string")
    found = classify.classify_by_template(messages, spark.createDataFrame(rules, schema)).collect()
    assert [r["template_group_id"] for r in found] == [0, 199, 200, 449, None]


def test_many_reviewed_rules_stay_distributed(spark, monkeypatch):
    """Above the bound the same rules give the same answers by a join, also with one dominant first word."""
    rules = [("app", i, f"r{i}", rf"(?s)^(?:ERROR\s+word{i}\s+.*)$", f"e{i}", "s") for i in range(40)]
    rules += [("app", 90, "any", "(?s)^(?:INFO|WARN) ", "other", "low"), ("web", 1, "w", r"^ERROR", "web", "s"), ("app", 95, "late", "^ERROR", "rest", "s")]
    schema = "origin string, group_id bigint, representative_template string, pattern string, event_type string, severity string"
    table = spark.createDataFrame(rules, schema)
    messages = [("app", "ERROR word3 x"), ("app", "ERROR word39  y"), ("app", "WARN a"), ("web", "ERROR word3 x"), ("app", "none"), ("app", None), ("app", "ERROR")]
    df = spark.createDataFrame(messages, "log_type string, message string")
    few = sorted(map(str, classify.classify_by_template(df, table).select("log_type", "message", "template_group_id", "event_type", "severity").collect()))
    monkeypatch.setattr(classify, "LITERAL_RULES", 0)
    many = sorted(map(str, classify.classify_by_template(df, table).select("log_type", "message", "template_group_id", "event_type", "severity").collect()))
    assert few == many and "e39" in str(few) and "rest" in str(few)


def test_classify_by_cluster(spark):
    clusters = spark.createDataFrame(
        [(0, "job <NUM> done"), (1, "<*> failed"), (2, "job <*>"), (3, "<ALPHANUM> seen")], "cluster_id bigint, template string"
    )
    messages = spark.createDataFrame([(i, m) for i, m in enumerate(["job 7 done", "job x", "it failed", "job failed", "u7 seen", "no"])], "id bigint, message string")
    found = {r["id"]: r["cluster_id"] for r in classify.classify_by_cluster(messages, clusters).collect()}
    assert found == {0: 0, 1: 2, 2: 1, 3: 1, 4: 3, 5: None}


def test_classify_by_cluster_keeps_null_messages(spark):
    messages = spark.createDataFrame([(1, "user bob in"), (2, None), (3, None)], "id bigint, message string")
    clusters = spark.createDataFrame([(7, "user <*> in")], "cluster_id bigint, template string")
    found = classify.classify_by_cluster(messages, clusters).collect()
    assert sorted((r["id"], r["cluster_id"]) for r in found) == [(1, 7), (2, None), (3, None)]


def test_words_that_rules_require(spark):
    cases = {
        r"(?s)^(?:abc\s+)?rest$": [[]],
        r"^(?:abc\s+x)*$": [[]],
        r"^(?:abc\s+)?(?:rest)$": [[]],
        r"(?s)^(?:abc\s+rest)$": [["abc", "rest"]],
        r"(?s)^(?:abc\s+de\s+(\S+?)\s+(?:x(?:y)z)[^\s]\))$": [["abc", "de"]],
        r"^abc\s+(?:de)?$": [["abc"]],
        r"\A(?:^(?:one two|three\-four)$)": [["one", "two"], ["three", "four"]],
        r"\A(?:START block)": [["START"]],
        r"\A.*? failed\: [a-z]+ now\z": [["failed", "now"]],
        r"ab?c d{2} e\d f\.g": [["f"]],
        r"^x y.z (?:p|q) last$": [["x", "last"]],
        r"(?i)^Abc def$": [[]],
        r"^[\s:|]+key[\s:|]*=value$": [["value"]],
        r"^a|b c$|(?:d)|^e f$": [[], ["c"], [], ["e", "f"]],
        r"(?:a)b(?:c)": [[]],
        r"^word\Qx\E$": [[]],
    }
    rows = spark.createDataFrame([(p,) for p in cases], "p string")
    assert {r.p: r.w for r in rows.select("p", rule_index.required_words(F.col("p")).alias("w")).collect()} == cases


def test_rule_index_is_trying_every_rule(spark):
    import random
    import re

    rnd = random.Random(9)
    words = ["red", "blue", "x1", "on", "off", "a_b", "io"]
    parts = ["red", "blue", r"\s+", r"\d+", ".*?", "(?:on|off)", r"\-", " ", "x1", r"[\s:]+", "a_b?", "(?:io )?", "$", "|"]
    rules = []
    for i in range(400):
        pattern = "".join(rnd.choices(parts, k=rnd.randint(1, 6))).replace("$$", "$")
        pattern = rnd.choice(["{}", "^{}", "^(?:{})$", "(?s)^(?:{})", r"\A{}\z", r"\A(?:{})\z"]).format(pattern)
        rules.append((rnd.choice(["p", "q"]), i, pattern))
    texts = [(s, rnd.choice(["", "-", ": "]).join(rnd.choices([*words, " ", "42", "\n"], k=rnd.randint(0, 7)))) for s in "pq" for _ in range(150)]
    texts = list(dict.fromkeys(texts))
    expected = {}
    for scope, text in texts:
        hits = [i for s, i, p in rules if s == scope and re.search(p.replace(r"\z", r"\Z"), text)]
        if hits:
            expected[scope, text] = min(hits)
    found = rule_index.first_rules(
        spark.createDataFrame(texts, "scope string, text string"), spark.createDataFrame(rules, "scope string, rule int, regex string")
    )
    assert {(r.scope, r.text): r.rule for r in found.collect()} == expected


def test_a_hundred_thousand_open_rules(spark):
    """Rules that begin with a placeholder, none of them a literal of the plan."""
    rules = spark.range(100_000).selectExpr("0 as scope", "id as rule", r"concat('\\A.*? user', id, ' in \\S+ left\\z') as regex")
    texts = spark.range(0, 100_000, 5).selectExpr("0 as scope", "concat('at ', id % 7, ' user', id, ' in x', id, ' left') as text", "id")
    found = rule_index.first_rules(texts, rules)
    assert found.join(texts, "text").where("rule = id").count() == 20_000


@pytest.mark.parametrize("literal", [0, 2_000])
def test_optional_group_in_both_plans(spark, monkeypatch, literal):
    monkeypatch.setattr(classify, "LITERAL_RULES", literal)
    records = spark.createDataFrame([("a", "rest"), ("a", "abc rest"), ("a", "other")], "log_type string, message string")
    rules = spark.createDataFrame(
        [("a", 1, r"(?s)^(?:abc\s+)?rest$", "E", "low")], "origin string, group_id bigint, pattern string, event_type string, severity string"
    ).withColumn("reviewed", F.lit(True))
    found = classify.classify_by_template(records, rules).collect()
    assert {r.message: r.event_type for r in found} == {"rest": "E", "abc rest": "E", "other": None}
