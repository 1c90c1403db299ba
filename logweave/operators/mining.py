"""Template mining with a fixed-depth prefix tree (Drain, ICWS 2017) as an exact distributed job.

Messages with different token counts never meet in the tree, so ``(config, origin, n_tokens)`` groups are independent.
Inside a group the algorithm is sequential, and one group may hold a large share of all messages. It is still run in
parallel, by speculation that is checked:

1. Only few messages change the tree: those that found a cluster or make a template more general. The *trajectory* is
   the ordered list of these changes.
2. A large group is cut into chunks of arrival order. Every chunk starts from the state the trajectory gives for its
   first message and runs the plain algorithm. A change that the trajectory does not know of is a violation.
3. Violations join the candidates, the candidates alone are replayed in order to give a new trajectory, and step 2 is
   repeated until no chunk reports a violation. Then, by induction over arrival order, every chunk has started from the
   true state, and the result equals that of one sequential run. Each round settles at least the earliest violation.

Tasks stream over rows sorted by Spark and hold one tree each; what is replayed in one task are changes, not messages.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from logweave.functions.masking import mask_custom, mask_domain, tokenize, tokenize_message
from logweave.functions.text import condense_trace_json, filter_message_lines, strip_leading_separators
from logweave.functions.regex import strip
from logweave.operators.events import number_events
from logweave.rules.masks import DEFAULT_PROFILE, DRAIN_PROFILES, QUICK_SWEEP
from logweave.rules.origins import BY_NAME
from logweave.session import materialize, sized_broadcast

CHUNK_ROWS = 1 << 18
WILDCARD = "<*>"
_BEFORE = 1 << 62
GROUP = ["config", "origin", "n_tokens"]
Params = tuple[int, float, int]

_ASSIGNED = (
    "config string, origin string, n_tokens int, seq bigint, cluster_seq bigint, template string, change_type string"
)
_CHANGE = "config string, origin string, n_tokens int, seq bigint, cluster_seq bigint, text string, template string"


# --- preparation ---------------------------------------------------------------------------------------------------


def profile_of(origin: Column) -> Column:
    """Profile an origin declares, or the default for unknown ones."""
    pairs = [F.lit(item) for o in BY_NAME.values() for item in (o.name, o.profile)]
    return F.coalesce(F.element_at(F.create_map(*pairs), origin), F.lit(DEFAULT_PROFILE))


def _as_tokens(df: DataFrame, tokens: Column, config: Column) -> DataFrame:
    """Token rows of messages that have any. A generator, so that the masks run once and not again for a filter."""
    filled = F.explode(F.filter(F.array(tokens), lambda t: F.size(t) > 0)).alias("tokens")
    return df.select(config.alias("config"), "origin", "seq", filled).select(
        "config", "origin", F.size("tokens").alias("n_tokens"), "seq", F.array_join("tokens", " ").alias("text")
    )


def prepare_first_match(
    messages: DataFrame, ignore: Sequence[str] = (), timestamps: Sequence[str] = (), config: Column | None = None
) -> DataFrame:
    """``(origin, seq, message)`` to masked tokens for the first-match miner; works on raw lines and on messages."""
    text = filter_message_lines(condense_trace_json(F.col("message")), ignore)
    cleaned = messages.withColumn("message", text)
    config = profile_of(F.col("origin")) if config is None else config
    return _as_tokens(cleaned, tokenize(mask_custom(F.col("message"), timestamps)), config)


def prepare_best_match(
    messages: DataFrame,
    ignore: Sequence[str] = (),
    timestamps: Sequence[str] = (),
    raw: bool = False,
    config: Column | None = None,
) -> DataFrame:
    """The same for the best-match miner; raw lines also have timestamps masked and no extra delimiters."""
    text = filter_message_lines(strip_leading_separators(strip(F.col("message"))), ignore)
    cleaned = messages.withColumn("message", text)
    masked = mask_domain(F.col("message"), raw, timestamps)
    tokens = tokenize(masked, "") if raw else tokenize_message(masked)
    config = profile_of(F.col("origin")) if config is None else config
    return _as_tokens(cleaned, tokens, config)


def for_configs(tokens: DataFrame, configs: Mapping[str, Params]) -> DataFrame:
    """Repeat prepared messages per configuration; masking is not repeated."""
    names = F.array(*[F.lit(name) for name in configs])
    return tokens.withColumn("config", F.explode(names)).select(tokens.columns)


# --- the algorithm of one group ------------------------------------------------------------------------------------


class _Tree:
    """Prefix tree and clusters of one group. A node is ``{token: node}``; a leaf keeps its clusters under ``None``."""

    def __init__(self, params: Params, best: bool):
        depth, self.threshold, self.max_children = params
        self.best = best
        self.prefix = max(depth - 3, 0) if best else max(depth - 2, 0)
        self.root: dict = {}
        self.clusters: dict[int, list[str]] = {}
        self.version = 0
        self.seen: dict[str, tuple[int, int]] = {}

    def _path(self, tokens: list[str]) -> list[str]:
        return tokens[: min(self.prefix, len(tokens) - 1)]

    def _leaf(self, tokens: list[str]) -> dict | None:
        node = self.root
        for token in self._path(tokens):
            node = node.get(token) or node.get(WILDCARD)
            if node is None:
                return None
        return node

    def _branch(self, node: dict, token: str) -> str:
        """Name of the child a new cluster's token goes to."""
        if token in node:
            return token
        children = len(node)
        if not self.best:
            plain = token[:1].isalnum() or token == WILDCARD
            return token if plain and children < self.max_children else WILDCARD
        if any(c.isdigit() for c in token):
            return WILDCARD
        room = children < self.max_children if WILDCARD in node else children + 1 < self.max_children
        return token if room else WILDCARD

    def create(self, cluster: int, tokens: list[str]) -> None:
        node = self.root
        for token in self._path(tokens):
            node = node.setdefault(self._branch(node, token), {})
        node.setdefault(None, []).append(cluster)
        self.clusters[cluster] = tokens
        self.version += 1

    def update(self, cluster: int, template: list[str]) -> None:
        self.clusters[cluster] = template
        self.version += 1

    def _match_first(self, candidates: list[int], tokens: list[str]) -> int | None:
        for cluster in candidates:
            same = sum(a == b or b == WILDCARD for a, b in zip(tokens, self.clusters[cluster], strict=True))
            if same / len(tokens) >= self.threshold:
                return cluster
        return None

    def _match_best(self, candidates: list[int], tokens: list[str]) -> int | None:
        found, best = None, (-1, -1)
        for cluster in candidates:
            template = self.clusters[cluster]
            wild = template.count(WILDCARD)
            same = sum(a == b and b != WILDCARD for a, b in zip(tokens, template, strict=True))
            if (same, wild) > best:
                found, best = cluster, (same, wild)
        return found if found is not None and best[0] / len(tokens) >= self.threshold else None

    def feed(self, seq: int, text: str) -> tuple[int, str]:
        """Cluster of a message and what it did: ``created``, ``changed`` or ``none``."""
        known = self.seen.get(text)
        if known is not None and known[0] == self.version:
            return known[1], "none"
        tokens = text.split(" ")
        leaf = self._leaf(tokens)
        cluster = None
        if leaf is not None:
            candidates = leaf.get(None, [])
            cluster = self._match_best(candidates, tokens) if self.best else self._match_first(candidates, tokens)
        if cluster is None:
            self.create(seq, tokens)
            return seq, "created"
        template = self.clusters[cluster]
        merged = [b if a == b or b == WILDCARD else WILDCARD for a, b in zip(tokens, template, strict=True)]
        if merged != template:
            self.update(cluster, merged)
            return cluster, "changed"
        if len(self.seen) > 50_000:
            self.seen.clear()
        self.seen[text] = (self.version, cluster)
        return cluster, "none"


_NAMES = {"created": "cluster_created", "changed": "cluster_template_changed", "none": "none"}


def _worker(configs: Mapping[str, Params], best: bool, emit_assignments: bool, chunk_rows: int | None):
    """A streaming pass over rows sorted by group, chunk, kind and arrival; kind 0 are known changes, 1 messages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, tree, expected = None, None, set()
        for batch in batches:
            out = []
            chunks = batch["chunk"] if chunk_rows else [0] * len(batch)
            kinds = batch["kind"] if chunk_rows else [1] * len(batch)
            clusters = batch["cluster_seq"] if chunk_rows else [0] * len(batch)
            templates = batch["template"] if chunk_rows else [None] * len(batch)
            columns = (batch["config"], batch["origin"], batch["n_tokens"], chunks, kinds, batch["seq"], batch["text"])
            rows = zip(*columns, clusters, templates, strict=True)
            for config, origin, n_tokens, chunk, kind, seq, text, cluster, template in rows:
                if (config, origin, n_tokens, chunk) != current:
                    current, tree, expected = (config, origin, n_tokens, chunk), _Tree(configs[config], best), set()
                if kind == 0:
                    if seq >= chunk * chunk_rows:
                        expected.add(seq)
                    elif seq == cluster:
                        tree.create(cluster, text.split(" "))
                    else:
                        tree.update(cluster, template.split(" "))
                    continue
                cluster, change = tree.feed(seq, text)
                if emit_assignments:
                    out.append((config, origin, n_tokens, seq, cluster, " ".join(tree.clusters[cluster]), _NAMES[change]))
                elif change != "none" and seq not in expected:
                    out.append((config, origin, n_tokens, seq, cluster, text, " ".join(tree.clusters[cluster])))
            names = ["config", "origin", "n_tokens", "seq", "cluster_seq"]
            names += ["template", "change_type"] if emit_assignments else ["text", "template"]
            yield pd.DataFrame(out, columns=names)

    return run


def _sequential(rows: DataFrame, configs: Mapping[str, Params], best: bool, emit_assignments: bool) -> DataFrame:
    ordered = rows.repartition(*GROUP).sortWithinPartitions(*GROUP, "seq")
    return ordered.mapInPandas(_worker(configs, best, emit_assignments, None), _ASSIGNED if emit_assignments else _CHANGE)


def _chunked(
    rows: DataFrame, trajectory: DataFrame, configs: Mapping[str, Params], best: bool, emit_assignments: bool, chunk_rows: int
) -> DataFrame:
    key = [*GROUP, "chunk"]
    messages = rows.select(
        *key, F.lit(1).alias("kind"), "seq", "text", F.lit(0).cast("bigint").alias("cluster_seq"),
        F.lit(None).cast("string").alias("template"),
    )
    known = (
        rows.select(*key)
        .distinct()
        .join(trajectory, GROUP)
        .filter(F.col("seq") < (F.col("chunk") + 1) * chunk_rows)
        .select(*key, F.lit(0).alias("kind"), "seq", "text", "cluster_seq", "template")
    )
    ordered = messages.unionByName(known).repartition(*key).sortWithinPartitions(*key, "kind", "seq")
    return ordered.mapInPandas(
        _worker(configs, best, emit_assignments, chunk_rows), _ASSIGNED if emit_assignments else _CHANGE
    )


# --- the distributed run -------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Mined:
    """``assignments``: one row per message. ``clusters``: one row per template."""

    assignments: DataFrame
    clusters: DataFrame


def _model_changes(model: DataFrame) -> DataFrame:
    """Stored clusters as the changes that lead to them, numbered below every new arrival."""
    base = [F.col(c) for c in GROUP]
    cluster = (F.col("created_seq") - _BEFORE).alias("cluster_seq")
    created = model.select(
        *base, (F.col("created_seq") - _BEFORE).alias("seq"), cluster, F.col("first_template").alias("text"),
        F.col("first_template").alias("template"),
    )
    changed = model.filter(F.col("template") != F.col("first_template")).select(
        *base, (F.col("changed_seq") - _BEFORE).alias("seq"), cluster, F.col("first_template").alias("text"), "template"
    )
    return created.unionByName(changed)


def _settle(
    hot: DataFrame, start: DataFrame | None, configs: Mapping[str, Params], best: bool, chunk_rows: int
) -> DataFrame:
    """Repeat the chunk pass until the trajectory predicts every change."""
    fixed = start
    if fixed is None:
        # The first chunk of a group is exact on its own; its changes spare the others from learning them again.
        first = hot.groupBy(*GROUP).agg(F.min("chunk").alias("chunk"))
        warm = hot.join(first, [*GROUP, "chunk"], "left_semi")
        candidates = materialize(_sequential(warm, configs, best, False), "mining-candidates")
        trajectory = candidates
    else:
        candidates, trajectory = None, fixed
    while True:
        violations = materialize(
            _chunked(hot, trajectory, configs, best, False, chunk_rows), "mining-violations"
        )
        if violations.isEmpty():
            return trajectory
        candidates = materialize(
            violations if candidates is None else candidates.unionByName(violations), "mining-candidates"
        )
        trajectory = materialize(_replay(candidates, fixed, configs, best), "mining-trajectory")


def _replay(candidates: DataFrame, fixed: DataFrame | None, configs: Mapping[str, Params], best: bool) -> DataFrame:
    """Changes the candidates make, in order, on top of a stored model."""
    messages = candidates.select(*GROUP, "seq", "text").distinct()
    if fixed is None:
        return _sequential(messages, configs, best, False)
    one_chunk = messages.withColumn("chunk", F.lit(0).cast("bigint"))
    return fixed.unionByName(_chunked(one_chunk, fixed, configs, best, False, _BEFORE))


def mine(
    tokens: DataFrame,
    configs: Mapping[str, Params] = DRAIN_PROFILES,
    best: bool = False,
    model: DataFrame | None = None,
    chunk_rows: int = CHUNK_ROWS,
) -> Mined:
    """Mine prepared messages ``(config, origin, n_tokens, seq, text)``; ``seq`` is the arrival order, unique per origin.

    ``model`` continues from stored clusters; its arrival numbers lie before those of the new messages.
    """
    configs = dict(configs)
    tokens = materialize(tokens.select(*GROUP, "seq", "text"), "mining-tokens")
    known = None if model is None else materialize(_model_changes(model), "mining-model")
    sizes = materialize(tokens.groupBy(*GROUP).count(), "mining-sizes")
    hot_groups = sizes.filter(F.col("count") > chunk_rows)
    chunk = F.floor(F.col("seq") / F.lit(chunk_rows)).cast("bigint")
    parts = []
    if known is not None:
        # A stored state has to be loaded in any case, so all groups take the chunk pass.
        rows = tokens.withColumn("chunk", chunk)
        trajectory = _settle(rows, known, configs, best, chunk_rows)
        parts.append(_chunked(rows, trajectory, configs, best, True, chunk_rows))
    elif hot_groups.isEmpty():
        parts.append(_sequential(tokens, configs, best, True))
    else:
        hot = tokens.join(hot_groups.select(*GROUP), GROUP, "left_semi").withColumn("chunk", chunk)
        trajectory = _settle(hot, None, configs, best, chunk_rows)
        parts.append(_sequential(tokens.join(hot_groups.select(*GROUP), GROUP, "left_anti"), configs, best, True))
        parts.append(_chunked(hot, trajectory, configs, best, True, chunk_rows))
    assigned = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    stored_seq = F.when(F.col("cluster_seq") < 0, F.col("cluster_seq") + _BEFORE).otherwise(F.col("cluster_seq"))
    assigned = materialize(assigned.withColumn("cluster_seq", stored_seq), "mining-assignments")
    return _finish(assigned, model, 1 if best else 0)


def _finish(assigned: DataFrame, model: DataFrame | None, first_id: int) -> Mined:
    """Global ids in order of first arrival, sizes and final templates."""
    key = [*GROUP, "cluster_seq"]
    sizes = assigned.groupBy(*key).agg(F.count(F.lit(1)).alias("size"))
    changes = (
        assigned.filter(F.col("change_type") != "none")
        .groupBy(*key)
        .agg(
            F.max_by("template", "seq").alias("template"),
            F.min_by("template", "seq").alias("first_template"),
            F.max("seq").alias("changed_seq"),
        )
    )
    clusters = sizes.join(changes, key, "left").withColumnRenamed("cluster_seq", "created_seq")
    if model is not None:
        stored = model.select(
            *GROUP, "created_seq", F.col("size").alias("s_size"), F.col("template").alias("s_template"),
            F.col("first_template").alias("s_first"), F.col("changed_seq").alias("s_changed"),
        )
        clusters = clusters.join(stored, [*GROUP, "created_seq"], "full_outer").select(
            *GROUP,
            "created_seq",
            (F.coalesce("size", F.lit(0)) + F.coalesce("s_size", F.lit(0))).alias("size"),
            F.coalesce("template", "s_template").alias("template"),
            F.coalesce("s_first", "first_template").alias("first_template"),
            F.coalesce("changed_seq", "s_changed").alias("changed_seq"),
        )
    ranked = W.partitionBy("config", "origin").orderBy("created_seq")
    clusters = materialize(
        clusters.withColumn("cluster_id", F.row_number().over(ranked).cast("bigint") - 1 + first_id), "mining-clusters"
    )
    ids = clusters.select("config", "origin", F.col("created_seq").alias("cluster_seq"), "cluster_id")
    # One cluster may hold a large share of the messages; the clusters themselves are usually few.
    assignments = assigned.join(sized_broadcast(ids, "mining-ids"), ["config", "origin", "cluster_seq"]).select(
        "config", "origin", "seq", "cluster_id", F.col("template").alias("template_at_assignment"), "change_type"
    )
    return Mined(assignments, clusters)


def number_arrivals(records: DataFrame, file: str = "file_path", line: str = "line_no", origin: str = "origin") -> DataFrame:
    """``records`` with ``seq``: dense numbers from 1 per origin, files in name order, lines in order within a file.

    Numbers come from sums over blocks of lines and over files, so no window holds a file or an origin.
    """
    key = F.struct(origin, file).alias("__file")
    numbered = number_events(records.withColumn("__file", key), F.lit(True), key="__file", order=(line,))
    numbered = numbered.drop("in_event", "is_start")
    files = materialize(numbered.groupBy("__file").agg(F.count(F.lit(1)).alias("__n")), "arrival-files")
    earlier = W.partitionBy(f"__file.{origin}").orderBy(f"__file.{file}").rowsBetween(W.unboundedPreceding, -1)
    offsets = files.select("__file", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    joined = numbered.join(sized_broadcast(offsets, "arrival-offsets"), "__file")
    return joined.withColumn("seq", F.col("__before") + F.col("event_no")).drop("__file", "__before", "event_no")


def _unique_arrivals(messages: DataFrame) -> DataFrame:
    """The messages, stored, so that what led to them runs once for this check and for mining.

    A cluster is named by the message that made it, so equal numbers would merge clusters."""
    messages = materialize(messages, "mining-messages")
    twice = messages.groupBy("origin", "seq").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"seq must be unique per origin ({twice[0]['origin']}: {twice[0]['seq']}); see number_arrivals")
    return messages


def mine_templates_first_match(
    messages: DataFrame, params: Params | None = None, *, numbered: bool = False, **rules
) -> Mined:
    """First cluster of the leaf that is similar enough; profiles per origin unless ``params`` are given.

    ``numbered``: ``seq`` is from ``number_arrivals`` and needs no check.
    """
    if not numbered:
        messages = _unique_arrivals(messages)
    return _mine_with(prepare_first_match(messages, **rules), params, False)


def mine_templates_best_match(
    messages: DataFrame, params: Params | None = None, *, numbered: bool = False, **rules
) -> Mined:
    """Most similar cluster of the leaf."""
    if not numbered:
        messages = _unique_arrivals(messages)
    return _mine_with(prepare_best_match(messages, **rules), params, True)


def _mine_with(tokens: DataFrame, params: Params | None, best: bool) -> Mined:
    if params is None:
        return mine(tokens, DRAIN_PROFILES, best)
    return mine(tokens.withColumn("config", F.lit("given")), {"given": params}, best)


def sweep_configs(tokens: DataFrame, configs: Mapping[str, Params] = QUICK_SWEEP, best: bool = False) -> Mined:
    """Several configurations over messages prepared once."""
    return mine(for_configs(tokens, configs), configs, best)


# --- patterns of mined clusters ------------------------------------------------------------------------------------


def cluster_regex(template: Column) -> Column:
    """Tokens joined by white space: masked ones by their pattern, with or without brackets, others as they are."""
    from logweave.operators.patterns import escape_literal
    from logweave.rules.masks import CLUSTER_TOKEN_PATTERNS

    known = {**CLUSTER_TOKEN_PATTERNS, **{k.strip("<>"): v for k, v in CLUSTER_TOKEN_PATTERNS.items() if k != WILDCARD}}
    pairs = [F.lit(item) for pair in known.items() for item in pair]
    lookup = F.create_map(*pairs)
    parts = F.transform(
        F.split(template, " "), lambda t: F.coalesce(F.element_at(lookup, t), escape_literal(t))
    )
    return F.array_join(parts, r"\s+")
