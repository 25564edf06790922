"""Queries on run records and consistency gates: events are runs, their JSON properties metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as m
from ..operators import evaluation, gates, runs
from .bindings import Bound, with_sql
from .registry import query, rounded


def records(b: Bound) -> DataFrame:
    """Events as runs: tool = type, sample = user, metrics that come now and then; some lack a tool, a sample, a
    database or its name."""
    e = b.t("events")
    k = F.col("user_id")
    entry = lambda name, v: F.struct(F.lit(name).alias("key"), v.cast("variant").alias("value"))
    odd = F.when(F.col("event_id") % 11 == 0, F.parse_json(F.lit("true"))).when(F.col("event_id") % 11 == 1, F.parse_json(F.lit('"3.5"'))).when(F.col("event_id") % 11 == 2, F.parse_json(F.lit("null"))).when(F.col("event_id") % 11 == 3, F.parse_json(F.lit("7")))
    metrics = F.map_from_entries(F.filter(F.array(
        entry("flag", odd), entry("run_elapsed_seconds", F.when(F.col("event_id") % 4 != 0, F.col("value"))), entry("resource_max_rss_gb", F.when(F.col("event_id") % 3 == 0, F.col("value") / 2)),
        entry("per_read_f1_species", F.when(F.col("event_id") % 5 != 1, F.col("event_id") % 97 / 97)), entry("purity_genus", F.when(F.col("event_id") % 9 == 0, F.lit(0.5))), entry("profile_metric_version", F.when(F.col("event_id") % 18 == 0, F.lit(evaluation.VERSION)).when(F.col("event_id") % 9 == 0, F.lit("v0"))), entry("exact_per_read_f1_species", F.when(F.col("event_id") % 2 == 0, F.col("event_id") % 89 / 89)),
    ), lambda x: x["value"].isNotNull()))
    return e.select(
        F.when(k % 3 != 0, F.concat(F.lit("coll"), k % 3)).alias("collection"), F.when(k % 7 == 0, "Shown").alias("display"), F.concat(F.lit("ds"), k % 5).alias("dataset"),
        F.when(F.col("event_id") % 20 != 3, k.cast("string")).alias("sample"), F.when(F.col("event_id") % 50 == 0, "").otherwise(F.col("event_type")).alias("tool"), F.when(F.col("event_id") % 10 != 9, F.concat(F.lit("/db"), F.col("event_id") % 3, F.lit("/x"), k % 2, F.when(F.col("event_id") % 4 == 0, "/").otherwise(""))).alias("db"),
        F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("x"), k % 2)).when(F.col("event_id") % 8 == 0, "").alias("db_name"),
        F.map_from_entries(F.filter(F.array(entry("max_rss_kb", F.col("event_id") % 5 * 1048576), entry("user_time_seconds", F.when(F.col("event_id") % 3 != 0, F.col("value")))), lambda x: x["value"].isNotNull())).alias("resource"),
        (F.col("event_id") % 2).alias("source"), F.col("event_id").alias("ord"), F.col("value").alias("elapsed"), (F.col("event_id") % 5 * 1048576).alias("max_rss_kb"), metrics.alias("metrics"),
        F.when(F.col("event_id") % 6 == 0, F.lit(1)).when(F.col("event_id") % 6 < 4, F.lit(0)).cast("int").alias("return_code"), F.concat(F.lit("exp"), k % 2).alias("exp"),
    )


RUNS = """runs as (select case when user_id % 3 <> 0 then 'coll' || (user_id % 3) end as collection, 'ds' || (user_id % 5) as dataset, case when event_id % 20 <> 3 then user_id::varchar end as sample, case when event_id % 50 = 0 then '' else event_type end as tool, case when user_id % 7 = 0 then 'Shown' end as display,
  case when event_id % 10 <> 9 then '/db' || (event_id % 3) || '/x' || (user_id % 2) || case when event_id % 4 = 0 then '/' else '' end end as db, case when event_id % 4 <> 0 then 'x' || (user_id % 2) when event_id % 8 = 0 then '' end as db_name, event_id % 2 as source, event_id as ord, value as elapsed, event_id % 5 * 1048576 as max_rss_kb,
  case when event_id % 4 <> 0 then value end as m_elapsed, case when event_id % 3 = 0 then value / 2 end as m_rss, case when event_id % 5 <> 1 then event_id % 97 / 97 end as m_f1, case when event_id % 9 = 0 then 0.5::double end as m_purity, case when event_id % 18 = 0 then 'now' when event_id % 9 = 0 then 'v0' end as m_version, case when event_id % 11 = 3 then 7.0::double end as m_flag, case when event_id % 2 = 0 then event_id % 89 / 89 end as m_exact,
  case when event_id % 6 = 0 then 1 when event_id % 6 < 4 then 0 end as rc, 'exp' || (user_id % 2) as exp from events)"""


@query("prefer_later", with_sql(RUNS) + """select ord from runs where tool = '' union all
select arg_max(ord, source * 1000000000 + ord) as ord from runs where tool <> '' group by coalesce(collection, display, dataset), case when collection is not null then coalesce(sample, dataset) end, tool, coalesce(db_name, '')""")
def q_prefer(b: Bound) -> DataFrame:
    return runs.prefer_later(records(b)).select("ord")


@query("metric_alias", with_sql(RUNS) + "select ord, round(coalesce(m_exact, m_f1), 6) as f1 from runs")
def q_alias(b: Bound) -> DataFrame:
    found = runs.metric_aliases(F.col("metrics"), ["per_read_f1_species"])
    return rounded(records(b).select("ord", m.number(m.of(found, "per_read_f1_species")).alias("f1")))


@query("run_fields", with_sql(RUNS) + "select ord, round(coalesce(m_elapsed, elapsed), 6) as elapsed, round(coalesce(m_rss, case when max_rss_kb > 0 then (max_rss_kb / 1048576)::double end), 6) as rss_gb, coalesce(nullif(db_name, ''), regexp_extract(rtrim(db, '/'), '[^/]*$')) as db_name, case tool when 'click' then 'Click!' else tool end as tool_name from runs")
def q_fields(b: Bound) -> DataFrame:
    made = runs.run_fields(records(b), {"click": "Click!"})
    of = lambda name: m.number(m.of(F.col("metrics"), name))
    return rounded(made.select("ord", of("run_elapsed_seconds").alias("elapsed"), of("resource_max_rss_gb").alias("rss_gb"), "db_name", "tool_name"))


METRICS = {"run_elapsed_seconds": "m_elapsed", "resource_max_rss_gb": "m_rss", "per_read_f1_species": "m_f1", "exact_per_read_f1_species": "m_exact", "purity_genus": "m_purity", "flag": "m_flag"}
COLLECTION = f"""long as (select *, unnest([{', '.join(f"'{m}'" for m in METRICS)}]) as metric, unnest([{', '.join(METRICS.values())}]) as v from runs),
g as (select collection, tool, coalesce(db_name, '') as db_name, coalesce(arg_min(display, source * 1000000000 + ord) filter (display is not null), collection) as display_dataset, list_sort(list(distinct coalesce(sample, dataset))) as ids from runs where collection is not null and tool <> '' group by 1, 2, 3),
v as (select collection, tool, coalesce(db_name, '') as db_name, metric, case metric when 'run_elapsed_seconds' then sum(v) when 'resource_max_rss_gb' then max(v) else avg(v) end as value from long where collection is not null and tool <> '' and v is not null group by 1, 2, 3, 4)
select g.collection as dataset, g.display_dataset, g.tool, g.db_name, len(ids)::bigint as sample_count, array_to_string(ids, ',') as sample_ids, metric, round(value, 4) as value from g left join v on v.collection = g.collection and v.tool = g.tool and v.db_name = g.db_name
union all select dataset, dataset, tool, db_name, null, null, metric, round(v, 4) from long where collection is null and v is not null
union all select dataset, dataset, tool, db_name, null, null, null, null from runs where collection is null and coalesce({', '.join(METRICS.values())}) is null"""


@query("collection_agg", with_sql(RUNS, COLLECTION))
def q_collection(b: Bound) -> DataFrame:
    made = runs.collection_aggregate(records(b))
    return rounded(made.select("dataset", "display_dataset", "tool", "db_name", "sample_count", F.array_join("sample_ids", ",").alias("sample_ids"), F.explode_outer(m.numbers(F.col("metrics"))).alias("metric", "value")), 4)


@query("display_dataset", with_sql(RUNS) + "select ord, coalesce(display, collection, dataset) as shown from runs")
def q_display(b: Bound) -> DataFrame:
    return records(b).select("ord", runs.display_dataset().alias("shown"))


@query("metric_family", with_sql(RUNS) + "select ord, m_f1 is not null as has_reads, m_purity is not null as has_profile, coalesce(m_purity is not null and m_version = 'now', false) as current from runs")
def q_family(b: Bound) -> DataFrame:
    return runs.metric_family(records(b), evaluation.VERSION).select("ord", "has_reads", "has_profile", "current")


@query("step_resources", "select user_id, max(event_id % 1000) filter (event_type <> 'view') as max_rss_kb, round(sum(value) filter (event_type <> 'view'), 4) as user_seconds, null::double as system_seconds from events group by user_id")
def q_steps(b: Bound) -> DataFrame:
    step = F.when(F.col("event_type") != "view", F.struct((F.col("event_id") % 1000).alias("max_rss_kb"), F.col("value").alias("user_seconds"), F.lit(None).cast("double").alias("system_seconds")))
    made = b.t("events").groupBy("user_id").agg(F.collect_list(step).alias("steps"))
    return rounded(runs.step_resources(made, "user_id"), 4)


@query("metric_wide", with_sql(RUNS) + f"""select dataset, tool, round(m_exact, 6) as exact_per_read_f1_species, case event_id % 11 when 0 then 'true' when 1 then '"3.5"' when 2 then 'null' when 3 then '7' end as flag, round(m_f1, 6) as per_read_f1_species,
case m_version when 'now' then '"{evaluation.VERSION}"' when 'v0' then '"v0"' end as profile_metric_version, m_purity as purity_genus, round(m_rss, 6) as resource_max_rss_gb, round(m_elapsed, 6) as run_elapsed_seconds from (select *, ord as event_id from runs)""")
def q_wide(b: Bound) -> DataFrame:
    """A row for each run, though many have the same keys; of two metrics the values as JSON, of the others the numbers."""
    wide = runs.metric_wide(records(b), ["dataset", "tool"])
    shown = {"flag": F.to_json("flag"), "profile_metric_version": F.to_json("profile_metric_version")}
    return rounded(wide.select("dataset", "tool", *[shown.get(c, m.number(F.col(c))).alias(c) for c in wide.columns if c not in ("dataset", "tool")]))


@query("summary_records", with_sql(RUNS) + "select ord, round(elapsed, 6) as elapsed_seconds, max_rss_kb::double as rss_kb, round(case when ord % 3 <> 0 then elapsed end, 6) as user_seconds, round(m_f1, 6) as f1 from runs where exp = 'exp1' and coalesce(rc, 0) = 0")
def q_summary(b: Bound) -> DataFrame:
    made = runs.summary_records(records(b), "exp1")
    of = lambda name: m.number(m.of(F.col("metrics"), name))
    return rounded(made.select("ord", of("run_elapsed_seconds").alias("elapsed_seconds"), of("resource_max_rss_kb").alias("rss_kb"), of("resource_user_time_seconds").alias("user_seconds"), of("per_read_f1_species").alias("f1")))


@query("result_tables", with_sql(RUNS) + "select dataset, tool, db, row_number() over (partition by dataset order by tool, db nulls first, ord) as place, ord from runs")
def q_tables(b: Bound) -> DataFrame:
    return runs.result_tables(records(b)).select("dataset", "tool", "db", "place", "ord")


MERGE = """old as (select 'd' || (o_orderkey % 40) as dataset, o_orderpriority as tool, 'db' || (o_orderkey % 3) as db, max(o_totalprice) as v from orders group by 1, 2, 3),
new0 as (select 'd' || (o_orderkey % 60) as dataset, o_orderpriority as tool, case when o_orderkey % 2 = 0 then '' else 'db1' end as db, min(o_totalprice) as v from orders where o_orderkey % 60 >= 30 group by 1, 2, 3),
only_ as (select dataset, tool, max(db) as one from old group by 1, 2 having count(*) = 1),
new as (select dataset, tool, coalesce(nullif(db, ''), one, '') as db, v from new0 left join only_ using (dataset, tool))"""


@query("row_merge", f"with {MERGE} select dataset, tool, db, round(coalesce(n.v, o.v), 4) as v from old o full join new n using (dataset, tool, db)")
def q_merge(b: Bound) -> DataFrame:
    o, k = b.t("orders"), F.col("o_orderkey")
    old = o.groupBy(F.concat(F.lit("d"), k % 40).alias("dataset"), F.col("o_orderpriority").alias("tool"), F.concat(F.lit("db"), k % 3).alias("db")).agg(F.max("o_totalprice").alias("v"))
    new = o.filter(k % 60 >= 30).groupBy(F.concat(F.lit("d"), k % 60).alias("dataset"), F.col("o_orderpriority").alias("tool"), F.when(k % 2 == 0, "").otherwise("db1").alias("db")).agg(F.min("o_totalprice").alias("v"))
    return rounded(runs.row_merge(old, new, ["v"]), 4)


@query("build_table", with_sql(RUNS) + "select tool, db, max(ord) as started_at, max(ord) + 5 as finished_at, arg_max(max_rss_kb, ord)::bigint as max_rss_kb, round(arg_max(elapsed, ord), 6) as elapsed, max(max_rss_kb)::bigint as size from runs where rc = 0 and tool <> 'view' group by 1, 2")
def q_builds(b: Bound) -> DataFrame:
    return rounded(runs.build_table(records(b).withColumn("started_at", F.col("ord")).withColumn("finished_at", F.col("ord") + 5).withColumn("size", F.col("max_rss_kb")), "view"))


@query("build_summary", with_sql(RUNS) + "select tool, db_name, round(max_rss_kb / 1048576, 6) as max_rss_gb, ord from runs where tool in ('click', 'view') and db_name = 'x1'")
def q_build_summary(b: Bound) -> DataFrame:
    return rounded(runs.build_summary(records(b), ["click", "view"], "x1").select("tool", "db_name", "max_rss_gb", "ord"))


FORMAL = """rolled as (select 'ds' || (user_id % 5) as dataset, event_type as tool, count(distinct user_id) as sample_count, round(avg(value), 4) as value, case when user_id % 5 in (1, 2) then 'ds' || (user_id % 5) end as collection from events group by 1, 2, 5),
grid as (select dataset, tool, case when collection is null then 3 else sample_count end as samples from rolled where tool <> 'view')"""


@query("formal_tables", f"with {FORMAL} select dataset, tool, collection, sample_count, samples, value, 'complete' as status, 'main' as paper_scope, case tool when 'click' then 'v1' else 'v2' end as tool_version from rolled join grid using (dataset, tool)")
def q_formal(b: Bound) -> DataFrame:
    """Sample counts are checked for collections alone; others may differ."""
    rolled = b.t("events").groupBy(F.concat(F.lit("ds"), F.col("user_id") % 5).alias("dataset"), F.col("event_type").alias("tool")).agg(F.count_distinct("user_id").alias("sample_count"), F.avg("value").alias("value"))
    rolled = rolled.withColumn("collection", F.when(F.col("dataset").isin("ds1", "ds2"), F.col("dataset")))
    grid = rolled.filter("tool <> 'view'").select("dataset", "tool", F.when(F.col("collection").isNull(), F.lit(3)).otherwise(F.col("sample_count")).cast("long").alias("samples"))
    tools = [r["tool"] for r in grid.select("tool").distinct().collect()]  # a few event types
    return rounded(runs.formal_table(rolled, grid, ["ds3", "ds1"], {t: "v1" if t == "click" else "v2" for t in tools}, "main"), 4)


@query("sample_table", with_sql(RUNS) + "select coalesce(sample, dataset) as sample, tool, ord from runs where collection = 'coll1'")
def q_sample_table(b: Bound) -> DataFrame:
    return runs.sample_table(records(b), "coll1").select("sample", "tool", "ord")


@query("manifest", "select 'classify' as task, event_type as dataset, 'a' as tool, count(*) as samples, 'default' as parameter_policy from events group by 2 union all select 'profile', o_orderpriority, 'b', count(*), 'own' from orders group by 2")
def q_manifest(b: Bound) -> DataFrame:
    one = b.t("events").groupBy(F.col("event_type").alias("dataset")).agg(F.count(F.lit(1)).alias("samples")).select(F.lit("classify").alias("task"), "dataset", F.lit("a").alias("tool"), "samples")
    two = b.t("orders").groupBy(F.col("o_orderpriority").alias("dataset")).agg(F.count(F.lit(1)).alias("samples")).select(F.lit("profile").alias("task"), "dataset", F.lit("b").alias("tool"), "samples")
    return runs.manifest([one, two], "default", {"b": "own"})


@query("sample_counts", "select user_id::varchar as dataset, case when user_id % 4 = 0 then user_id when user_id % 4 = 1 then count(*) when user_id % 4 = 2 then case when user_id % 3 = 0 then 0 else count(distinct event_type) end when user_id % 8 = 3 then count(*) else 1 end as samples from events group by user_id")
def q_sample_counts(b: Bound) -> DataFrame:
    """Some lists of sample ids are empty; read files count in one group."""
    k = F.col("user_id")
    made = b.t("events").groupBy("user_id").agg(F.collect_list("event_id").alias("all"), F.collect_set("event_type").alias("types"))
    ids = F.when(k % 4 == 2, F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(F.col("types")))
    made = made.select(k.cast("string").alias("dataset"), F.when(k % 4 == 0, k).alias("samples"), F.when(k % 4 == 1, F.col("all")).alias("sample_list"), ids.alias("sample_ids"), F.when(k % 4 >= 2, F.col("all").cast("array<string>")).alias("reads"), F.when(k % 8 == 3, "marine").otherwise("other").alias("group"))
    return runs.sample_counts(made, "marine")


@query("run_records", with_sql(RUNS) + "select ord, rc::integer as return_code from runs where rc is null or rc = 0")
def q_run_records(b: Bound) -> DataFrame:
    from ..sources.records import keep_good, parse_meta

    js = F.when(F.col("ord") < 0, F.lit("broken {")).otherwise(F.to_json(F.struct("ord", "return_code", "tool", "dataset"), {"ignoreNullFields": "false"}))
    rows = records(b).select(F.concat(F.lit("d"), F.col("ord")).alias("dir"), js.alias("value"))
    bad = rows.limit(3).select("dir", F.lit("{broken").alias("value"))
    return keep_good(parse_meta(rows.union(bad), "ord long, return_code int, tool string, dataset string")).select("ord", "return_code")


MATRIX = """rows_ as (select 'd' || (user_id % 4) as dataset, event_type as tool, count(*) as n from events where user_id % 7 <> 0 group by 1, 2 having count(*) > 20),
m as (select dataset, tool from rows_ union all select dataset, tool from rows_ where dataset = 'd1'), grid as (select 'd' || i as dataset, t as tool from range(1, 6) r(i), (values ('click'), ('view'), ('none')) v(t)),
c as (select dataset, tool, count(*) as n from m group by 1, 2)"""


@query("gate_matrix", f"with {MATRIX} select dataset, tool, 'missing' as problem from grid anti join c using (dataset, tool) union all select dataset, tool, 'extra' from c anti join grid using (dataset, tool) union all select dataset, tool, 'duplicate' from c where n > 1")
def q_matrix(b: Bound) -> DataFrame:
    rows = b.t("events").filter("user_id % 7 <> 0").groupBy(F.concat(F.lit("d"), F.col("user_id") % 4).alias("dataset"), F.col("event_type").alias("tool")).agg(F.count(F.lit(1)).alias("n")).filter("n > 20").drop("n")
    rows = rows.union(rows.filter("dataset = 'd1'"))
    grid = b.spark.range(1, 6).select(F.concat(F.lit("d"), F.col("id")).alias("dataset"), F.explode(F.array(*map(F.lit, ["click", "view", "none"]))).alias("tool"))
    return gates.matrix(rows, grid, ["dataset", "tool"])


@query("gate_coverage", """with s as (select distinct user_id::varchar as sample from events), t as (select unnest(['click', 'view']) as tool), r as (select distinct user_id::varchar as sample, event_type as tool from events where user_id % 5 <> 0),
g as (select sample, tool from s, t)
select sample, tool, 'missing' as problem from g anti join r using (sample, tool) union all select null, tool, 'unexpected tool' from (select distinct tool from r where tool not in ('click', 'view'))""")
def q_cover(b: Bound) -> DataFrame:
    e = b.t("events").select(F.col("user_id").cast("string").alias("sample"), F.col("event_type").alias("tool"))
    tools = e.select("tool").filter(F.col("tool").isin("click", "view")).distinct()
    return gates.tool_coverage(e.filter(F.col("sample").cast("long") % 5 != 0).distinct(), tools, e)


@query("gate_same_samples", "select o_custkey as id, 'left' as side from (select o_custkey from orders except select c_custkey from customer where c_custkey % 3 > 0) union all select c_custkey, 'right' from (select c_custkey from customer where c_custkey % 3 > 0 except select o_custkey from orders)")
def q_same(b: Bound) -> DataFrame:
    return gates.same_samples(b.t("orders").select(F.col("o_custkey").alias("id")), b.t("customer").filter("c_custkey % 3 > 0").select(F.col("c_custkey").alias("id")), "id")


@query("gate_sample_count", "with o as (select o_custkey as id, count(*) as observed from orders group by 1), x as (select c_custkey as id, c_custkey % 12 as expected from customer) select id, observed, expected from o full join x using (id) where observed is distinct from expected")
def q_count(b: Bound) -> DataFrame:
    o = b.t("orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("observed"))
    return gates.sample_count(o, b.t("customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 12).alias("expected")), "id")


@query("gate_audit", "select event_id from events where event_id % 3 + event_id % 2 <> (event_id % 6)")
def q_gate_audit(b: Bound) -> DataFrame:
    k = F.col("event_id")
    rows = b.t("events").select(k, (k % 3).alias("strict"), (k % 2).alias("tied"), (k % 6).alias("supported"), (k * 0).alias("non_target"), (k * 0).alias("unmapped"), (k % 3 + k % 2).alias("candidate"), (k * 0).alias("missing"))
    return gates.audit_closure(rows).select("event_id")


@query("gate_one_match", """with p as (select o_custkey as a, o_orderkey % 900 as b from orders), n as (select c_custkey as a, count(b) as n from customer left join p on a = c_custkey group by 1), m as (select s_suppkey as b, count(a) as n from supplier left join p on b = s_suppkey group by 1)
select a::varchar as id, 'not one match' as problem from n where n <> 1 union all select b::varchar, 'matched twice' from m where n > 1 union all select b::varchar, 'left over' from m where n = 0""")
def q_one_match(b: Bound) -> DataFrame:
    p = b.t("orders").select(F.col("o_custkey").alias("a"), (F.col("o_orderkey") % 900).alias("b"))
    return gates.one_match(p, b.t("customer").select(F.col("c_custkey").alias("a")), b.t("supplier").select(F.col("s_suppkey").alias("b")), "a", "b")


@query("gate_tolerance", "select o_orderkey from orders where o_orderkey % 10 = 3 or o_orderkey % 7 = 0")
def q_tolerance(b: Bound) -> DataFrame:
    k = F.col("o_orderkey")
    rows = b.t("orders").select(k, F.col("o_totalprice").alias("a"), (F.col("o_totalprice") + F.when(k % 10 == 3, 1e-3).otherwise(0.0)).alias("b"), F.col("o_orderpriority").alias("s"), F.when(k % 7 == 0, "other").otherwise(F.lower("o_orderpriority")).alias("t"))
    return gates.tolerance(rows, [("a", "b")], [("s", "t")]).select("o_orderkey")


@query("gate_values", "select distinct event_type as tool from events where event_type not in ('click', 'view')")
def q_values(b: Bound) -> DataFrame:
    e = b.t("events").select(F.col("event_type").alias("tool"))
    return gates.unknown_values(e, "tool", e.filter(F.col("tool").isin("click", "view")).distinct())


@query("tsv_union", "select o_orderkey as k, o_orderpriority as x, null as y from orders union all select c_custkey, null, c_name from customer")
def q_tsv(b: Bound) -> DataFrame:
    from ..operators.durable import shared_folder
    from ..sources.lines import read_tsv
    from ..sources.sinks import write_tsv
    import uuid

    base = f"{shared_folder(b.spark)}/tsv-{uuid.uuid4().hex}"
    write_tsv(b.t("orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("x")), f"{base}/a", ["k", "x"])
    write_tsv(b.t("customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("y")), f"{base}/b", ["k", "y"])
    got = read_tsv(b.spark, [f"{base}/a", f"{base}/b"])
    return got.select(F.col("k").cast("long").alias("k"), "x", "y")


