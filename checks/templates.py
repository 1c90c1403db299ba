"""Queries for template mining, grouping, rules and classification."""

from __future__ import annotations



from pyspark.sql import functions as F

from checks import inputs as I
from checks.parsing import _nested
from logweave.operators import classify, dialects, grouping, metrics, mining, patterns, serve, storage
from logweave.rules.masks import CUSTOM_MASKS, DEFAULT_PROFILE, PLACEHOLDER_PATTERNS, QUICK_SWEEP
from logweave.rules.origins import BY_NAME
from logweave.session import scratch_path
from logweave.sources import tables

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def check(name: str, sql: str | None = None):
    def register(query):
        QUERIES[name] = query
        if sql is not None:
            ORACLE[name] = sql
        return query

    return register


def _messages(spark, sf):
    """``(origin, seq, message)`` of all records, one origin per file."""
    return I.records(spark, sf).filter("message is not null").select(
        F.replace("file", F.lit(".log"), F.lit("")).alias("origin"), F.col("line_no").alias("seq"), "message"
    )


# Masks that can match these ASCII messages, without the ones RE2 cannot run.
_SAFE = [(p, r) for p, r in CUSTOM_MASKS if r in ("<ALPHANUM>", "<IP>", "<UUID>", "<NUM>", "<HEX>", "<PATH>", "<LONG_LIST>")]
_MASKED = _nested(_SAFE, "message")
_TOKENS = (
    "array_to_string(list_filter(regexp_split_to_array(translate("
    + _MASKED
    + ", '=:,()[]{}<>', '           '), '\\s+'), lambda t: t <> ''), ' ')"
)
_MESSAGES_CTE = (
    I.RECORDS_CTE
    + f", messages as (select replace(file, '.log', '') as origin, line_no as seq, message, {_TOKENS} as text from records where message is not null)"
)
# With threshold 1 a cluster is one distinct token list, which SQL can count.
_EXACT_CTE = (
    _MESSAGES_CTE
    + ", groups as (select origin, text as template, count(*) as size, min(seq) as created from messages group by origin, text), "
    "clusters as (select *, row_number() over (partition by origin order by created) - 1 as cluster_id from groups)"
)


def _exact(spark, sf):
    tokens = mining.prepare_first_match(_messages(spark, sf), config=F.lit("exact"))
    return mining.mine(tokens, {"exact": (4, 1.0, 100)})


@check("min_1_first_match_exact", f"with {_EXACT_CTE} select origin, cluster_id, template, size from clusters")
def _min_1_exact(spark, sf):
    return _exact(spark, sf).clusters.select("origin", "cluster_id", "template", "size")


@check(
    "min_1_first_match_exact_assignments",
    f"with {_EXACT_CTE} select m.origin, m.seq, c.cluster_id, m.text as template_at_assignment from messages m join clusters c on m.origin = c.origin and m.text = c.template",
)
def _min_1_assigned(spark, sf):
    return _exact(spark, sf).assignments.select("origin", "seq", "cluster_id", "template_at_assignment")


def _mined_sql(at: str) -> str:
    """The miner with one leaf per number of tokens, message after message: ``cl`` are the clusters so far, ``at`` finds
    the one a message belongs to (0 for none). Groups of equally many tokens run side by side."""
    return (
        f"with recursive {_MESSAGES_CTE}, m as (select *, row_number() over (partition by origin, n order by seq) as k "
        "from (select origin, seq, string_split(text, ' ') as w, len(string_split(text, ' ')) as n from messages where text <> '')), "
        "run as (select distinct origin, n, 0::bigint as k, []::struct(id bigint, t varchar[])[] as cl, 0::bigint as seq, 0::bigint as hit, '' as change "
        "from m union all "
        "select r.origin, r.n, m.k, "
        "case when f.at = 0 then list_append(r.cl, {'id': m.seq, 't': m.w}) "
        "else list_transform(r.cl, lambda c, i: case when i = f.at then {'id': c.id, 't': g.t} else c end) end, "
        "m.seq, case when f.at = 0 then m.seq else r.cl[f.at].id end, "
        "case when f.at = 0 then 'cluster_created' when g.t <> r.cl[f.at].t then 'cluster_template_changed' else 'none' end "
        f"from run r join m on m.origin = r.origin and m.n = r.n and m.k = r.k + 1, lateral (select coalesce({at}, 0) as at) f, "
        "lateral (select list_transform(range(1, r.n + 1), lambda i: case when r.cl[f.at].t[i] in (m.w[i], '<*>') then r.cl[f.at].t[i] else '<*>' end) as t) g), "
        "sizes as (select origin, hit, count(*) as size from run where k > 0 group by origin, hit), "
        "final as (select origin, unnest(arg_max(cl, k)) as c from run group by origin, n), "
        "clusters as (select f.origin, row_number() over (partition by f.origin order by f.c.id) as place, array_to_string(f.c.t, ' ') as template, size "
        "from final f join sizes s on s.origin = f.origin and s.hit = f.c.id) "
    )


_SAME = "len(list_filter(range(1, r.n + 1), lambda i: c.t[i] = m.w[i] or c.t[i] = '<*>'))::double / r.n"
_FIRST_MATCH = _mined_sql(f"list_position(list_transform(r.cl, lambda c: {_SAME} >= 0.6), true)")
# Equal tokens count, then wildcards; the first of the best clusters wins.
_SCORES = (
    "list_transform(r.cl, lambda c: 1000 * len(list_filter(range(1, r.n + 1), lambda i: c.t[i] = m.w[i] and c.t[i] <> '<*>')) "
    "+ len(list_filter(c.t, lambda x: x = '<*>')))"
)
_BEST_MATCH = _mined_sql(
    f"case when (list_max({_SCORES}) // 1000)::double / r.n >= 0.6 then list_position({_SCORES}, list_max({_SCORES})) end"
)


def _one_leaf(spark, sf, best: bool):
    tokens = mining.prepare_first_match(_messages(spark, sf), config=F.lit("leaf"))
    return mining.mine(tokens, {"leaf": (3 if best else 2, 0.6, 100)}, best=best, chunk_rows=300)


@check("min_1_first_match_below_1", _FIRST_MATCH + "select origin, place - 1 as cluster_id, template, size from clusters")
def _min_1_below(spark, sf):
    return _one_leaf(spark, sf, False).clusters.select("origin", "cluster_id", "template", "size")


@check("min_2_best_match_below_1", _BEST_MATCH + "select origin, place as cluster_id, template, size from clusters")
def _min_2_below(spark, sf):
    return _one_leaf(spark, sf, True).clusters.select("origin", "cluster_id", "template", "size")


@check("min_2_change_types_below_1", _BEST_MATCH + "select origin, seq, change as change_type from run where k > 0")
def _min_2_changes_below(spark, sf):
    return _one_leaf(spark, sf, True).assignments.select("origin", "seq", "change_type")


@check("min_6_resume_below_1", _FIRST_MATCH + "select origin, place - 1 as cluster_id, template, size from clusters")
def _min_6_below(spark, sf):
    """Two runs, the second on top of what the first has stored."""
    tokens = mining.prepare_first_match(_messages(spark, sf), config=F.lit("leaf")).withColumn("late", F.col("seq") >= 500)
    configs = {"leaf": (2, 0.6, 100)}
    first = mining.mine(tokens.filter("not late").drop("late"), configs)
    return mining.mine(tokens.filter("late").drop("late"), configs, model=first.clusters).clusters.select(
        "origin", "cluster_id", "template", "size"
    )


@check("min_1_mine_first_match")
def _min_1(spark, sf):
    return mining.mine_templates_first_match(_messages(spark, sf)).clusters.select("origin", "cluster_id", "template", "size")


@check(
    "min_1_every_message_once",
    f"with {_MESSAGES_CTE} select origin, count(*) as assigned, count(*) as in_clusters from messages where text <> '' group by origin",
)
def _min_1_once(spark, sf):
    mined = mining.mine_templates_first_match(_messages(spark, sf))
    assigned = mined.assignments.groupBy("origin").agg(F.count(F.lit(1)).alias("assigned"))
    sizes = mined.clusters.groupBy("origin").agg(F.sum("size").alias("in_clusters"))
    return assigned.join(sizes, "origin")


@check("min_2_mine_best_match")
def _min_2(spark, sf):
    return mining.mine_templates_best_match(_messages(spark, sf)).clusters.select("origin", "cluster_id", "template", "size")


@check(
    "min_2_change_types",
    f"with {_MESSAGES_CTE} select origin, seq, case when row_number() over (partition by origin, text order by seq) = 1 "
    "then 'cluster_created' else 'none' end as change_type from messages where text <> ''",
)
def _min_2_changes(spark, sf):
    """At threshold 1 each distinct text makes its cluster when it first arrives and changes nothing later."""
    tokens = mining.prepare_first_match(_messages(spark, sf), config=F.lit("exact"))
    return mining.mine(tokens, {"exact": (4, 1.0, 100)}, best=True).assignments.select("origin", "seq", "change_type")


@check(
    "min_3_arrival_numbers",
    f"with {I.LINES_CTE} select file, line_no, row_number() over (order by file, line_no) as seq from log_lines",
)
def _min_3_numbers(spark, sf):
    """One origin with all files."""
    lines = I.log_lines(spark, sf).withColumn("origin", F.lit("app"))
    return mining.number_arrivals(lines, file="file").select("file", "line_no", "seq")


@check("min_3_mine_raw_lines")
def _min_3(spark, sf):
    raw = I.log_lines(spark, sf).select(F.replace("file", F.lit(".log"), F.lit("")).alias("origin"), F.col("line_no").alias("seq"), F.col("value").alias("message"))
    prepared = mining.prepare_best_match(raw, I.APP.ignore, raw=True)
    return mining.mine(prepared, best=True).clusters.select("origin", "cluster_id", "template", "size")


_PARTS = (
    "list_transform(string_split(template, ' '), lambda t: case t when 'NUM' then '\\d+' when 'ALPHANUM' then '[A-Za-z0-9_]+' "
    "when 'IP' then '\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}' else regexp_replace(t, '([\\\\.^$|?*+()\\[\\]{}&~#\\-])', '\\\\\\1', 'g') end)"
)


@check("min_4_cluster_regex", f"with {_EXACT_CTE} select origin, template, array_to_string({_PARTS}, '\\s+') as regex from clusters")
def _min_4(spark, sf):
    return _exact(spark, sf).clusters.select("origin", "template", mining.cluster_regex(F.col("template")).alias("regex"))


@check("min_5_sweep_configs")
def _min_5(spark, sf):
    tokens = mining.prepare_first_match(_messages(spark, sf))
    return metrics.metrics_by_config(mining.sweep_configs(tokens, QUICK_SWEEP).clusters)


@check("min_6_resume_mining", f"with {_EXACT_CTE} select origin, cluster_id, template, size from clusters")
def _min_6(spark, sf):
    tokens = mining.prepare_first_match(_messages(spark, sf), config=F.lit("exact")).withColumn("late", F.col("seq") >= 500)
    configs = {"exact": (4, 1.0, 100)}
    first = mining.mine(tokens.filter("not late").drop("late"), configs)
    return mining.mine(tokens.filter("late").drop("late"), configs, model=first.clusters).clusters.select(
        "origin", "cluster_id", "template", "size"
    )


_KIND = "case o_orderkey % 4 when 0 then 'bssv' when 1 then 'listener' when 2 then 'nowhere' else 'jas' end"


@check(
    "min_7_drain_profile",
    f"with o as (select o_orderkey, {_KIND} as origin from orders) select o_orderkey, origin, case origin "
    + " ".join(f"when '{n}' then '{BY_NAME[n].profile}'" for n in ("bssv", "listener", "jas"))
    + f" else '{DEFAULT_PROFILE}' end as profile from o",
)
def _min_7(spark, sf):
    origins = I.table(spark, sf, "orders").selectExpr("o_orderkey", f"{_KIND} as origin")
    return origins.select("o_orderkey", "origin", mining.profile_of(F.col("origin")).alias("profile"))


@check("min_8_profile_new_origin")
def _min_8(spark, sf):
    from logweave.plans.template_cycle import profile_new_origin
    from logweave.sources.files import sample_lines

    # The sample size is the operator's own setting.
    sample = sample_lines(I.log_lines(spark, sf), 500, seed=1).select(F.col("line_no").alias("seq"), "value")
    profile = profile_new_origin(sample, "new")
    return profile.top.withColumn("line_pattern", F.lit(profile.line_pattern))


# --- cluster metrics -----------------------------------------------------------------------------------------------


@check(
    "agg_4_cluster_stats",
    f"with {_EXACT_CTE}, r as (select m.origin, c.cluster_id, m.seq, m.message, row_number() over (partition by m.origin, c.cluster_id order by m.seq) as n "
    "from messages m join clusters c on m.origin = c.origin and m.text = c.template), "
    "e as (select origin, cluster_id, string_agg(message, '|' order by seq) as examples from r where n <= 5 group by all) "
    "select c.origin, c.cluster_id, template, size, round(size * 100.0 / sum(size) over (partition by c.origin), 2) as percentage, examples "
    "from clusters c join e on c.origin = e.origin and c.cluster_id = e.cluster_id",
)
def _agg_4(spark, sf):
    mined = _exact(spark, sf)
    stats = metrics.cluster_stats(mined.assignments, _messages(spark, sf), mined.clusters, n_examples=5)
    return stats.withColumn("examples", F.array_join("examples", "|"))


def _quality_sql(source: str, by: str) -> str:
    return (
        f"t as (select {by}, size, length(template) - length(regexp_replace(template, '\\b(NUM|IP|ALPHANUM|HEX|UUID|PATH)\\b', '', 'g')) as unused, "
        f"len(regexp_extract_all(template, '<\\*>|\\b(?:ALPHANUM|NUM|IP|HEX|UUID|PATH|LIBCODE|JDECODE|CONTEXT_ID)\\b')) as wild, "
        f"row_number() over (partition by {by} order by size) as up, row_number() over (partition by {by} order by size desc) as down, "
        f"sum(size) over (partition by {by}) as total from {source}) "
        f"select {by}, count(*) as num_clusters, cast(sum(size) as bigint) as total_logs, round(-sum(size / total * log2(size / total)), 3) as entropy, "
        "round(coalesce(sum(size) filter (where down <= 10), 0) / sum(size), 3) as top_10_coverage, round(coalesce(sum(size) filter (where down <= 20), 0) / sum(size), 3) as top_20_coverage, "
        "round(sum(size) / count(*), 2) as avg_cluster_size, round(sum(wild) / count(*), 2) as avg_wildcards_per_template, "
        f"round(2 * sum(up * size) / (count(*) * sum(size)) - (count(*) + 1) / count(*), 3) as gini_coefficient from t group by {by}"
    )


@check("agg_5_cluster_quality", f"with {_EXACT_CTE}, {_quality_sql('clusters', 'origin')}")
def _agg_5(spark, sf):
    return metrics.cluster_quality(_exact(spark, sf).clusters)


@check(
    "agg_15_metrics_by_config",
    f"with {_EXACT_CTE}, pair as (select origin, 'exact' as config, template, size from clusters union all "
    "select origin, 'merged', min(template), cast(sum(size) as bigint) from clusters group by origin, length(template)), "
    f"{_quality_sql('pair', 'origin, config')}",
)
def _agg_15(spark, sf):
    exact = _exact(spark, sf).clusters.select("origin", "config", "template", "size")
    merged = exact.groupBy("origin", F.length("template").alias("n")).agg(F.min("template").alias("template"), F.sum("size").alias("size"))
    return metrics.metrics_by_config(exact.unionByName(merged.select("origin", F.lit("merged").alias("config"), "template", "size")))


# --- templates as rows: one per distinct masked message -----------------------------------------------------------

_TEMPLATE_SQL = (
    I.RECORDS_CTE
    + f", masked as (select {_MASKED} as template, line_no from records where message is not null), "
    "templates as (select template, count(*) as size, min(line_no) as cluster_id from masked group by template)"
)


def _templates(spark, sf):
    """Distinct masked messages, each named after its first line; stored, as most queries read them several times."""
    from logweave.functions.masking import apply_masks

    masked = _messages(spark, sf).select(apply_masks(F.col("message"), _SAFE).alias("template"), "seq")
    sizes = masked.groupBy("template").agg(F.count(F.lit(1)).alias("size"), F.min("seq").alias("cluster_id"))
    return storage.materialize(sizes.withColumn("origin", F.lit("app")), "check-templates")


@check(
    "top_1_top_clusters",
    f"with {_TEMPLATE_SQL}, r as (select *, row_number() over (order by size desc, cluster_id) as rank, sum(size) over () as total from templates) "
    "select rank, cluster_id, size, round(size * 100.0 / total, 2) as percentage, template from r where rank <= 10",
)
def _top_1(spark, sf):
    return serve.top_clusters(_templates(spark, sf), 10)


@check("top_3_cluster_detail", f"with {_TEMPLATE_SQL} select template, size from templates where cluster_id = 0")
def _top_3(spark, sf):
    return serve.cluster_detail(_templates(spark, sf), 0).select("template", "size")


@check(
    "prs_14_search_templates",
    f"with {_TEMPLATE_SQL} select template, size from templates where contains(lower(template), 'host') order by cluster_id limit 20",
)
def _prs_14(spark, sf):
    return serve.search_templates(_templates(spark, sf), "HOST", 20).select("template", "size")


_FIRST = "min(template) over (partition by substr(template, 1, 4)) as representative_template"


@check("top_5_groups_by_members", f"with {_TEMPLATE_SQL} select substr(template, 1, 4) as name, count(*) as num_members, min(cluster_id) as group_id from templates group by 1")
def _top_5(spark, sf):
    groups = _templates(spark, sf).groupBy(F.substring("template", 1, 4).alias("name")).agg(
        F.count(F.lit(1)).alias("num_members"), F.min("cluster_id").alias("group_id")
    )
    return serve.groups_by_members(groups)


@check("src_7_read_templates", f"with {_TEMPLATE_SQL} select cast(cluster_id as varchar) as cluster_id, template, size from templates union all select concat('m', cluster_id), template, size from templates")
def _src_7(spark, sf):
    """A template file is one JSON document; both of its layouts."""
    path = scratch_path(spark, "check-templates")
    clusters = _templates(spark, sf).select(F.col("cluster_id").cast("string"), "template", "size")
    entry = F.struct("cluster_id", "template", "size")
    clusters.agg(F.collect_list(entry).alias("clusters")).write.json(f"{path}/list")
    named = F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("m"), "cluster_id"), F.struct("template", "size"))))
    clusters.agg(named.alias("clusters")).write.json(f"{path}/map")
    both = tables.read_templates(spark, f"{path}/list").unionByName(tables.read_templates(spark, f"{path}/map"))
    return both.select("cluster_id", "template", "size")


@check("snk_9_write_clusters", f"with {_TEMPLATE_SQL}, n as (select sum(size) as total from templates) select cluster_id, size, round(size * 100.0 / total, 2) as percentage, template from templates, n")
def _snk_9(spark, sf):
    path = scratch_path(spark, "check-clusters")
    clusters = _templates(spark, sf)
    total = clusters.agg(F.sum("size")).first()[0] or 1
    storage.write_clusters(clusters.withColumn("percentage", F.round(F.col("size") / total * 100, 2)), path)
    schema = "cluster_id bigint, size bigint, percentage double, template string"
    return spark.read.schema(schema).option("header", "true").option("escape", '"').csv(f"{path}/csv")


@check("src_7_read_written", f"with {_TEMPLATE_SQL} select cast(cluster_id as varchar) as cluster_id, template, size from templates")
def _src_7_written(spark, sf):
    """What ``write_clusters`` leaves is read back."""
    path = scratch_path(spark, "check-clusters-read")
    clusters = _templates(spark, sf)
    storage.write_clusters(clusters.withColumn("percentage", F.lit(1.0)), path)
    return tables.read_templates(spark, f"{path}/full").select("cluster_id", "template", "size")


_ESCAPED = r"regexp_replace(regexp_replace(template, '([\\.^$|?*+()\[\]{}&~#\-])', '\\\1', 'g'), '(\s)', '\\\1', 'g')"
_PATTERN = _ESCAPED
for _name in sorted(PLACEHOLDER_PATTERNS, key=len, reverse=True):
    _body = PLACEHOLDER_PATTERNS[_name].replace(r"\Z", r"\z").replace("'", "''")
    _PATTERN = "replace({}, '{}', '(?:{})')".format(_PATTERN, _name.replace("*", r"\*"), _body)
_PATTERN_SQL = f"concat('(?s)^', {_PATTERN}, '$')"


@check("tpl_7_template_to_pattern", f"with {_TEMPLATE_SQL} select template, {_PATTERN_SQL} as pattern from templates")
def _tpl_7(spark, sf):
    return _templates(spark, sf).select("template", patterns.template_to_pattern(F.col("template")).alias("pattern"))


# --- classification ------------------------------------------------------------------------------------------------

# A rule table as a reviewer leaves it: the third rule is not reviewed.
_RULES = [
    (1, r"^(?s)ORA\-\d+ request failed for user \d+$", "database", "high"),
    (2, r"^PROTOCOL=tcp.*PORT=(?:\d{5})\)", "connection", "low"),
    (3, r"^START block", None, None),
    (4, r"^(?:START|User: U1)", "session", "info"),
    (5, r"^PROTOCOL=tcp", "connection", "info"),
]


def _rules(spark):
    rows = [("app", g, p, p, e, s) for g, p, e, s in _RULES]
    schema = "origin string, group_id bigint, representative_template string, pattern string, event_type string, severity string"
    return spark.createDataFrame(rows, schema)


_REVIEWED = [(g, p.replace("^(?s)", "^"), e, s) for g, p, e, s in _RULES if e]


def _choose(index: int) -> str:
    cases = " ".join(f"when regexp_matches(coalesce(message, ''), '{r[1]}') then {r[index]!r}" for r in _REVIEWED)
    return f"case {cases} end"


@check(
    "joi_2_classify_by_template",
    f"with {I.RECORDS_CTE} select file, line_no, {_choose(2)} as event_type, {_choose(3)} as severity, {_choose(0)} as template_group_id from records",
)
def _joi_2(spark, sf):
    found = classify.classify_by_template(I.records(spark, sf), _rules(spark))
    return found.select("file", "line_no", "event_type", "severity", "template_group_id")


@check("joi_2_unclassified", f"with {I.RECORDS_CTE} select file, line_no, message from records where {_choose(0)} is null")
def _joi_2_missed(spark, sf):
    found = classify.classify_by_template(I.records(spark, sf), _rules(spark))
    return classify.unclassified(found).select("file", "line_no", "message")


def _own_input_sql(delimiters: str) -> str:
    """All messages that have a token, per origin, twice."""
    return (
        f"with {I.RECORDS_CTE} select replace(file, '.log', '') as origin, count(*) as messages, count(*) as classified "
        f"from records where regexp_matches(message, '[^\\s{delimiters}]') group by 1"
    )


def _own_input(found, column: str):
    return found.groupBy("origin").agg(F.count(F.lit(1)).alias("messages"), F.count(column).alias("classified"))


@check("joi_2_mined_rules_classify_own_input", _own_input_sql(r":|/=,\[\]()"))
def _joi_2_own(spark, sf):
    """The whole cycle: mine, group, build rules, review all of them, classify the messages that were mined."""
    from logweave.plans.template_cycle import generate_templates

    messages = _messages(spark, sf).where(r"message rlike '[^\\s:|/=,\\[\\]()]'")
    messages = storage.materialize(messages, "check-messages")
    made = generate_templates(messages, ignore=I.APP.ignore)
    reviews = made.rules.select("representative_template", F.lit("any").alias("event_type"), F.lit("low").alias("severity"))
    rules = patterns.review_rules(made.rules, reviews)
    found = classify.classify_by_template(messages.withColumnRenamed("origin", "log_type"), rules)
    return _own_input(found.withColumnRenamed("log_type", "origin"), "event_type")


@check("joi_5_mined_clusters_classify_own_input", _own_input_sql(r"=:,()\[\]{}<>"))
def _joi_5_own(spark, sf):
    """Clusters of the first-match miner account for the messages they were mined from."""
    messages = _messages(spark, sf).where(r"message rlike '[^\\s=:,()\\[\\]{}<>]'")
    clusters = mining.mine_templates_first_match(messages).clusters
    # Clusters of all origins in one list; ids are unique per origin.
    ids = clusters.select(F.concat_ws(":", "origin", "cluster_id").alias("cluster_id"), "template")
    keyed = messages.withColumn("id", F.concat_ws(":", "origin", "seq"))
    found = classify.classify_by_cluster(keyed, ids, dialect=dialects.first_match_dialect())
    return _own_input(keyed.join(found, "id"), "cluster_id")


_GROUPS = f"{_TEMPLATE_SQL}, groups as (select cluster_id as group_id, template as representative_template, size from templates), stored as (select group_id, representative_template from groups where group_id % 2 = 0)"


def _groups(spark, sf):
    return _templates(spark, sf).select(F.col("cluster_id").alias("group_id"), F.col("template").alias("representative_template"), "size")


@check("joi_3_new_groups_by_key", f"with {_GROUPS} select group_id, representative_template from groups where representative_template not in (select representative_template from stored)")
def _joi_3(spark, sf):
    groups = _groups(spark, sf)
    return classify.new_groups_by_key(groups, groups.filter("group_id % 2 = 0")).select("group_id", "representative_template")


_STORED = [(1, r"^ORA\-<NUM>.*$"), (2, r"^START block \d$"), (3, r"^User: .*$")]


@check(
    "joi_4_uncovered_groups",
    f"with {_GROUPS} select group_id, representative_template from groups where not ("
    + " or ".join(f"regexp_full_match(representative_template, '{p}')" for _, p in _STORED)
    + ")",
)
def _joi_4(spark, sf):
    stored = spark.createDataFrame(_STORED, "group_id bigint, pattern string")
    return classify.uncovered_groups(_groups(spark, sf), stored).select("group_id", "representative_template")


@check(
    "joi_5_classify_by_cluster_regex",
    f"with {_TEMPLATE_SQL}, p as (select cluster_id, template, {_PATTERN_SQL} as pattern from templates), "
    "m as (select file, line_no, message from records where message is not null), "
    "d as (select distinct message from m), h as (select message, min(cluster_id) as cluster_id from d join p on regexp_full_match(message, pattern) "
    "and split_part(message, ' ', 1) <> '' group by message) select m.file, m.line_no, h.cluster_id from m left join h on m.message = h.message",
)
def _joi_5(spark, sf):
    records = I.records(spark, sf).filter("message is not null").select("file", "line_no", "message")
    ids = storage.materialize(records.withColumn("id", F.concat_ws("#", "file", "line_no")), "check-messages")
    found = classify.classify_by_cluster(ids, _templates(spark, sf), "id")
    return ids.join(found, "id").select("file", "line_no", "cluster_id")


@check("joi_6_new_clusters_only", f"with {_TEMPLATE_SQL} select cluster_id, template from templates where cluster_id % 3 <> 0")
def _joi_6(spark, sf):
    clusters = _templates(spark, sf)
    return classify.new_clusters_only(clusters, clusters.filter("cluster_id % 3 = 0")).select("cluster_id", "template")


@check("snk_10_write_rules", f"with {_GROUPS} select representative_template, case when group_id % 2 = 0 then -1 else size end as size from groups")
def _snk_10(spark, sf):
    groups = _groups(spark, sf).select("representative_template", "size", "group_id")
    stored = groups.filter("group_id % 2 = 0").withColumn("size", F.lit(-1).cast("bigint"))
    return classify.merge_rules(groups, stored).select("representative_template", "size")


@check(
    "set_2_stored_wins",
    f"with {_TEMPLATE_SQL} select cluster_id, case when cluster_id % 3 = 0 then 'kept' else template end as template from templates",
)
def _set_2(spark, sf):
    """Rules by another key: a third is stored already, with other texts."""
    new = _templates(spark, sf).select("cluster_id", "template")
    stored = new.filter("cluster_id % 3 = 0").withColumn("template", F.lit("kept"))
    return classify.merge_rules(new, stored, key="cluster_id").select("cluster_id", "template")


def _member_groups(templates):
    """Groups of templates that begin alike; every second member has no template of its own."""
    own = F.when(F.col("cluster_id") % 2 == 0, F.col("template"))
    member = F.struct(F.col("cluster_id").cast("string").alias("cluster_id"), own.alias("template"), "size")
    return (
        templates
        .groupBy("origin", F.ascii(F.substring("template", 1, 1)).cast("bigint").alias("group_id"))
        .agg(F.array_sort(F.collect_list(member)).alias("member_cluster_ids"), F.min("template").alias("representative_template"))
    )


@check("joi_7_attach_member_templates", f"with {_TEMPLATE_SQL} select ascii(template) as group_id, cast(cluster_id as varchar) as cluster_id, case when cluster_id % 5 = 1 then min(template) over (partition by ascii(template)) else template end as template from templates")
def _joi_7(spark, sf):
    # Some clusters are not stored any more, so their members fall back to the representative.
    templates = _templates(spark, sf)
    stored = templates.filter("cluster_id % 5 <> 1")
    groups = _member_groups(templates)
    forgotten = F.transform(
        "member_cluster_ids",
        lambda m: F.struct(
            m["cluster_id"].alias("cluster_id"),
            F.when(m["cluster_id"].cast("bigint") % 5 != 1, m["template"]).alias("template"),
            m["size"].alias("size"),
        ),
    )
    attached = patterns.attach_member_templates(groups.withColumn("member_cluster_ids", forgotten), stored)
    return attached.select("group_id", "cluster_id", "template")


_TOKEN_PATTERN = _PATTERN.replace("(template,", "(token,")
# Groups by first character; per number of tokens and place the tokens found there, then shapes, then groups.
_GROUP_PATTERNS = (
    _TEMPLATE_SQL
    + ", m as (select distinct ascii(template) as group_id, template, string_split_regex(template, '\\s+') as w from templates), "
    "placed as (select group_id, template, len(w) as n, unnest(w) as token, unnest(range(len(w))) as pos from m), "
    f"tokens as (select token, {_TOKEN_PATTERN} as f from (select distinct token from placed)), "
    "found as (select distinct group_id, n, pos, token, f from placed join tokens using (token)), "
    "slots as (select group_id, n, pos, count(*) as c, case when count(*) = 1 then min(f) else concat('(?:', string_agg(f, '|' order by token), ')') end as slot, "
    "case when count(*) = 1 then min(token) else '<*>' end as readable from found group by all), "
    "shapes as (select group_id, n, count(*) filter (c = 1) >= n * 0.5 as mergeable, string_agg(slot, '\\s+' order by pos) as body, "
    "string_agg(readable, ' ' order by pos) as readable from slots group by group_id, n), "
    "whole as (select group_id, n, template, string_agg(f, '\\s+' order by pos) as body from placed join tokens using (token) group by group_id, n, template), "
    "listed as (select group_id, n, string_agg(body, '|' order by template) as body, string_agg(template, ' | ' order by template) as readable from whole group by group_id, n), "
    "every as (select group_id, n, body, readable from shapes where mergeable union all "
    "select l.* from listed l join shapes s on l.group_id = s.group_id and l.n = s.n where not mergeable), "
    "rules as (select group_id, concat('(?s)^(?:', string_agg(body, '|' order by n), ')$') as pattern, "
    "string_agg(readable, ' | ' order by n) as merged_template from every group by group_id)"
)


@check("tpl_8_synthesize_group_pattern", f"with {_GROUP_PATTERNS} select group_id, pattern from rules")
def _tpl_8(spark, sf):
    templates = _templates(spark, sf)
    members = patterns.attach_member_templates(_member_groups(templates), templates)
    return patterns.synthesize_group_patterns(members).select("group_id", "pattern")


@check(
    "tpl_8_patterns_match_members",
    f"with {_TEMPLATE_SQL} select ascii(template) as group_id, count(*) as members, count(*) as matched from templates group by 1",
)
def _tpl_8_members(spark, sf):
    """Placeholders replaced by samples, every member must match its group's pattern."""
    templates = _templates(spark, sf)
    members = patterns.attach_member_templates(_member_groups(templates), templates)
    rules = patterns.synthesize_group_patterns(members)
    sample = F.col("template")
    for name, value in (("<NUM>", "42"), ("<ALPHANUM>", "p7"), ("<IP>", "10.0.0.1"), ("<PATH>", "/a/b"), ("<*>", "x")):
        sample = F.replace(sample, F.lit(name), F.lit(value))
    return (
        members.withColumn("sample", sample)
        .join(rules, ["origin", "group_id"])
        .groupBy("group_id")
        .agg(F.count(F.lit(1)).alias("members"), F.count_if(F.expr("sample rlike pattern")).alias("matched"))
    )


@check("tpl_9_merged_template", f"with {_GROUP_PATTERNS} select group_id, merged_template from rules")
def _tpl_9(spark, sf):
    templates = _templates(spark, sf)
    members = patterns.attach_member_templates(_member_groups(templates), templates)
    return patterns.synthesize_group_patterns(members).select("group_id", "merged_template")


@check(
    "tpl_10_validate_rules",
    f"with {_TEMPLATE_SQL} select cluster_id as group_id, template as representative_template, cluster_id % 3 <> 0 as compiles, "
    f"case when cluster_id % 3 = 0 then false when cluster_id % 3 = 1 then true else false end as matches_representative from templates",
)
def _tpl_10(spark, sf):
    """A third of the patterns is broken, a third quotes its representative, a third wants something else before it."""
    quoted = F.concat(F.lit("^"), patterns.escape_literal(F.col("template")))
    pattern = F.when(F.col("cluster_id") % 3 == 0, F.concat(F.lit("("), quoted)).when(F.col("cluster_id") % 3 == 1, quoted)
    rules = _templates(spark, sf).select(
        "origin", F.col("cluster_id").alias("group_id"), F.col("template").alias("representative_template"),
        pattern.otherwise(F.concat(F.lit("^never "), patterns.escape_literal(F.col("template")))).alias("pattern"),
    )
    return patterns.validate_rules(rules).select("group_id", "representative_template", "compiles", "matches_representative")


@check(
    "tpl_11_review_rules",
    f"with {_GROUPS} select group_id, representative_template, 'e' as event_type, concat('s', group_id % 7) as severity from groups where group_id % 3 = 0",
)
def _tpl_11(spark, sf):
    groups = _groups(spark, sf).withColumns({"event_type": F.lit(None).cast("string"), "severity": F.lit(None).cast("string")})
    reviews = _groups(spark, sf).filter("group_id % 3 = 0 or group_id % 5 = 0").select(
        "representative_template", F.lit("e").alias("event_type"),
        F.when(F.col("group_id") % 3 == 0, F.concat(F.lit("s"), F.col("group_id") % 7)).alias("severity"),
    )
    return patterns.reviewed(patterns.review_rules(groups, reviews)).select("group_id", "representative_template", "event_type", "severity")


# --- vectors -------------------------------------------------------------------------------------------------------

_UNIT = I.VECTORS_CTE + ", unit as (select id, label, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) as u from vectors)"
_CLOSE = 0.35


def _unit(spark, sf):
    return grouping.unit_vectors(I.vectors(spark, sf))


@check(
    "tpl_2_cosine_pairs",
    f"with {_UNIT} select a.id as a, b.id as b, round(list_dot_product(a.u, b.u), 5) as similarity from unit a join unit b on a.id < b.id where list_dot_product(a.u, b.u) >= {_CLOSE}",
)
def _tpl_2(spark, sf):
    vectors = _unit(spark, sf).select("origin", F.col("id").alias("node"), F.col("embedding").alias("vec"))
    return grouping.cosine_pairs(vectors, _CLOSE).select("a", "b", F.round("similarity", 5).alias("similarity"))


# TF-IDF in SQL: words, numbers, marks and neighbouring pairs; a hash gives each term its place and sign.
_NORMAL = "trim(regexp_replace(regexp_replace(template, '<[A-Z_*]+>', 'X', 'g'), '\\s+', ' ', 'g'))"
_TFIDF = (
    _TEMPLATE_SQL
    + f", words as (select cluster_id as id, regexp_extract_all(lower({_NORMAL}), '[A-Za-z_]+|\\d+|[^\\sA-Za-z0-9]') as w from templates), "
    "terms as (select id, unnest(w) as term from words union all "
    "select id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as term from words), "
    "tf as (select id, term, count(*) as tf from terms group by all), df as (select term, count(*) as df from tf group by term), "
    "n as (select count(*) as n from templates), "
    "weights as (select id, term, tf * (ln((1 + n) / (1 + df)) + 1) as weight from tf join df using (term), n), "
    "hashed as (select id, weight, cast('0x' || substr(md5(term), 1, 15) as bigint) as h from weights), "
    "folded as (select id, (h // 2) % 256 as place, sum(case when h % 2 = 1 then weight else -weight end) as w from hashed group by all), "
    "norms as (select id, sqrt(sum(w * w)) as norm from folded group by id)"
)


@check("tpl_1_tfidf", f"with {_TFIDF} select id, term, round(weight, 6) as weight from weights")
def _tpl_1_weights(spark, sf):
    found = grouping.tfidf(_templates(spark, sf).select(F.col("cluster_id").alias("id"), "template"))
    return found.select("id", "term", F.round("weight", 6).alias("weight"))


@check("tpl_1_embed_templates", f"with {_TFIDF} select id, place, round(w / norm, 5) as value from folded join norms using (id) where round(w / norm, 5) <> 0")
def _tpl_1(spark, sf):
    found = grouping.embed_templates(_templates(spark, sf).select(F.col("cluster_id").alias("id"), "template"))
    places = found.select("id", F.posexplode("embedding").alias("place", "value"))
    return places.select("id", F.col("place").cast("bigint").alias("place"), F.round("value", 5).alias("value")).where("value <> 0")


@check("tpl_3_group_templates")
def _tpl_3(spark, sf):
    return grouping.group_templates(I.vectors(spark, sf), 0.6)


@check("tpl_3_groups_are_apart", f"with {I.VECTORS_CTE} select count(*) as grouped, 0 as too_close, 0 as too_wide from vectors")
def _tpl_3_apart(spark, sf):
    """Where average linkage has stopped no two groups are nearer than the threshold on average, and every group was
    joined below it, so its members are nearer than that on average. Means of unit vectors give both."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    unit = _unit(spark, sf)
    labelled = unit.join(grouping.group_templates(I.vectors(spark, sf), 0.6), ["origin", "id"])
    means = labelled.groupBy("origin", F.col("group_id").alias("node")).agg(
        Summarizer.mean(array_to_vector("embedding")).alias("m"), F.count(F.lit(1)).alias("n")
    )
    means = storage.materialize(means.select("origin", "node", "n", vector_to_array("m").alias("vec")), "group-means")
    close = grouping.cosine_pairs(means, 1 - 0.6 + 1e-9).agg(F.count(F.lit(1)).alias("too_close"))
    # Mean distance of different members: the mean's square has each with itself as well.
    square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    inside = 1 - (square * F.col("n") - 1) / (F.col("n") - 1)
    sizes = means.agg(F.sum("n").alias("grouped"), F.count_if((F.col("n") > 1) & (inside >= 0.6 + 1e-9)).alias("too_wide"))
    return storage.one_row(sizes, close)


_CENTRES = (
    _UNIT
    + ", flat as (select label, i, avg(u[i]) as c from unit, lateral (select unnest(range(1, len(u) + 1)) as i) x group by label, i), "
    "centre as (select label, list(c order by i) as c from flat group by label), "
    "d as (select u.label, u.id, sqrt(list_sum(list_transform(list_zip(u.u, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) as distance "
    "from unit u join centre c on u.label = c.label)"
)


@check("tpl_4_representative", f"with {_CENTRES} select label, arg_min(id, distance) as representative, round(min(distance), 5) as distance from d group by label")
def _tpl_4(spark, sf):
    return grouping.representative(_unit(spark, sf), "label").select("label", "representative", F.round("distance", 5).alias("distance"))


@check(
    "tpl_5_silhouette",
    f"with {_UNIT}, s as (select a.id, a.label as own, b.label as other, sum(1 - list_dot_product(a.u, b.u)) as t, count(*) as n from unit a join unit b on a.id <> b.id group by all), "
    "m as (select id, avg(t / n) filter (where own = other) as a, min(t / n) filter (where own <> other) as b from s group by id) "
    "select round(avg(case when a is null then 0 else (b - a) / greatest(a, b) end), 5) as silhouette from m",
)
def _tpl_5(spark, sf):
    value = grouping.silhouette(_unit(spark, sf), "label")
    return spark.range(1).select(F.round(F.lit(value).cast("double"), 5).alias("silhouette"))


@check("tpl_6_threshold_sweep")
def _tpl_6(spark, sf):
    return grouping.threshold_sweep(I.vectors(spark, sf))


@check("top_4_best_config", "select label as threshold, cast(avg(vec_id) as double) as silhouette from embeddings group by label order by 2 desc limit 1")
def _top_4(spark, sf):
    results = I.vectors(spark, sf).groupBy(F.col("label").alias("threshold")).agg(F.avg("id").alias("silhouette"))
    return serve.best_config(results)
