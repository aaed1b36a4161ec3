"""Profiling and leakage queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue.cohort import FIRST, derived
from catalogue.sampling import SPLIT_CTE, split_orders
from catalogue.shared import ladder_cte, metrics_sql, order_ladder, orders_scored_cte, rounded, scored_orders, table
from veritally.operators import leakage as lk
from veritally.operators import profile as pr
from veritally.operators.bounded import scratch_path
from veritally.operators.discrimination import ladder_metrics
from veritally.plans import hospital
from veritally.sources.manifest import RunManifest, written_rows

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

TOKENS = "('?', '', 'NULL', 'Unknown/Invalid')"


def _audited(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", "user_id", F.when(F.col("event_type") == "error", "?").otherwise(F.col("event_type")).alias("kind"), "props"
    )


def audit(spark, sf):
    return pr.raw_audit(_audited(spark, sf), hospital.MISSING_TOKENS).drop("dtype")


def _audit_sql(column: str) -> str:
    return f"""select '{column}' as "column", count(distinct {column}) as n_unique,
      sum(({column} is null or {column}::varchar in {TOKENS})::int)::bigint as n_missing,
      round(100 * sum(({column} is null or {column}::varchar in {TOKENS})::int)::double / count(*), 2) as pct_missing,
      (select string_agg(v || '=' || n, '; ' order by n desc, v) from (select coalesce({column}::varchar, 'nan') as v, count(*) as n
        from e group by 1 order by n desc, v limit 5)) as top_values from e"""


QUERIES["profile_raw_audit"] = audit
ORACLES["profile_raw_audit"] = """with e as (select event_id, user_id, case when event_type = 'error' then '?' else event_type end as kind, props from events)
""" + " union all ".join(_audit_sql(c) for c in ("event_id", "user_id", "kind", "props"))


def counts(spark, sf):
    return pr.count_gate_stats(table(spark, sf, "orders"), "o_custkey")


QUERIES["profile_row_and_entity_counts"] = counts
ORACLES["profile_row_and_entity_counts"] = "select count(*) as n_rows, count(distinct o_custkey) as n_entities from orders"


def dictionary(spark, sf):
    nation = table(spark, sf, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    region = table(spark, sf, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    df = table(spark, sf, "customer").join(F.broadcast(nation), "c_nationkey").join(F.broadcast(region), "n_regionkey")
    df = df.withColumn("segment", F.when(F.col("c_custkey") % 9 != 0, F.col("c_mktsegment")))
    df = df.withColumn("balance", F.when(F.col("c_custkey") % 8 != 0, F.col("c_acctbal")))
    return rounded(pr.variable_dictionary(df, ["segment", "n_name", "r_name", "balance", "c_nationkey"]).drop("summary"))


def _dict_cat(c: str) -> str:
    return f"""select '{c}' as variable, 'categorical' as type, count(distinct {c}) as n_levels,
      (select string_agg({c}, '; ' order by {c}) from (select distinct {c} from d where {c} is not null order by {c} limit 12)) as levels,
      round(100 * sum(({c} is null)::int)::double / count(*), 3) as missing_pct, null::double as q25, null::double as median, null::double as q75,
      (select {c} from d where {c} is not null group by {c} order by count(*) desc, {c} limit 1) as mode from d"""


def _dict_num(c: str) -> str:
    return f"""select '{c}', 'continuous', null, null, round(100 * sum(({c} is null)::int)::double / count(*), 3),
      round(quantile_cont({c}::double, 0.25), 6), round(quantile_cont({c}::double, 0.5), 6), round(quantile_cont({c}::double, 0.75), 6), null from d"""


QUERIES["profile_variable_dictionary"] = dictionary
ORACLES["profile_variable_dictionary"] = """with d as (select *, case when c_custkey % 9 <> 0 then c_mktsegment end as segment,
    case when c_custkey % 8 <> 0 then c_acctbal end as balance from customer join nation on c_nationkey = n_nationkey
    join region on n_regionkey = r_regionkey) """ + " union all ".join(
    [*[_dict_cat(c) for c in ("segment", "n_name", "r_name")], *[_dict_num(c) for c in ("balance", "c_nationkey")]]
)


def baseline(spark, sf):
    df = table(spark, sf, "orders").select(
        (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("target"),
        "o_totalprice",
        F.col("o_custkey").alias("customer"),
        "o_orderstatus",
        F.date_format("o_orderdate", "yyyy-MM").alias("month"),
    )
    return rounded(pr.baseline_table(df, "target", ["o_totalprice", "customer"], ["o_orderstatus", "month"]))


def _base_num(c: str) -> str:
    return f"""select '{c}', 'mean (SD)', null, null, null, avg({c}), stddev_samp({c}), avg({c}) filter (y = 0), stddev_samp({c}) filter (y = 0),
      avg({c}) filter (y = 1), stddev_samp({c}) filter (y = 1), (avg({c}) filter (y = 1) - avg({c}) filter (y = 0)) /
      sqrt((stddev_samp({c}) filter (y = 1) ** 2 + stddev_samp({c}) filter (y = 0) ** 2) / 2) from b"""


def _base_cat(c: str) -> str:
    return f"""select '{c}', {c}, n, n0, n1, n::double / t, null, n0::double / t0, null, n1::double / t1, null,
      (n1::double / t1 - n0::double / t0) / sqrt(((n1::double / t1) * (1 - n1::double / t1) + (n0::double / t0) * (1 - n0::double / t0)) / 2)
      from (select {c}, count(*) as n, sum(1 - y)::bigint as n0, sum(y)::bigint as n1 from b group by {c} order by n desc, {c} limit 8),
      (select count(*) as t, sum(1 - y)::bigint as t0, sum(y)::bigint as t1 from b)"""


QUERIES["profile_baseline_table"] = baseline
ORACLES["profile_baseline_table"] = """with b as (select (o_orderpriority = '1-URGENT')::int as y, o_totalprice, o_custkey as customer, o_orderstatus,
    strftime(o_orderdate, '%Y-%m') as month from orders),
  result(variable, level, n_all, n_0, n_1, mean_all, sd_all, mean_0, sd_0, mean_1, sd_1, smd) as (
    select 'N', '', count(*), sum(1 - y)::bigint, sum(y)::bigint, null::double, null::double, null::double, null::double, null::double,
      null::double, null::double from b union all """ + " union all ".join(
    [_base_num("o_totalprice"), _base_num("customer"), _base_cat("o_orderstatus"), _base_cat("month")]
) + """) select variable, level, n_all, n_0, n_1, round(mean_all, 6) as mean_all, round(sd_all, 6) as sd_all, round(mean_0, 6) as mean_0,
  round(sd_0, 6) as sd_0, round(mean_1, 6) as mean_1, round(sd_1, 6) as sd_1, round(smd, 6) as smd from result"""
ORACLES["profile_baseline_table"] = ORACLES["profile_baseline_table"].replace("filter (y", "filter (where y")


# --- leakage -----------------------------------------------------------------------


def forbidden(spark, sf):
    df = table(spark, sf, "orders")
    names = lk.forbidden_present(df, ["o_custkey", "o_orderkey", "readmitted"])
    return df.agg(F.count(F.lit(1)).alias("n")).select(F.explode(F.array(*[F.lit(n) for n in names])).alias("column"), "n")


QUERIES["leakage_forbidden_columns"] = forbidden
ORACLES["leakage_forbidden_columns"] = """select 'o_custkey' as "column", count(*) as n from orders union all select 'o_orderkey', count(*) from orders"""


def surviving(spark, sf):
    raw = table(spark, sf, "orders")
    whole = lk.surviving_exclusions(raw, raw, "o_orderkey", "o_orderstatus", ["P"]).select(F.lit("raw").alias("part"))
    kept = lk.surviving_exclusions(derived(spark, sf), raw, "o_orderkey", "o_orderstatus", ["P"]).select(F.lit("cohort").alias("part"))
    base = raw.limit(0).select(F.lit("none").alias("part"))
    return base.unionAll(whole).unionAll(kept).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


QUERIES["leakage_surviving_exclusions"] = surviving
ORACLES["leakage_surviving_exclusions"] = f"""with {FIRST}, r as (select 'raw' as part from orders where o_orderstatus = 'P'
  union all select 'cohort' from first where o_orderkey in (select o_orderkey from orders where o_orderstatus = 'P'))
  select part, count(*) as n from r group by part"""


def correlations(spark, sf):
    df = table(spark, sf, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("int").alias("target"), "l_quantity", "l_extendedprice", "l_discount",
        (F.lit(2.0) - 3 * (F.col("l_returnflag") == "R").cast("int")).alias("proxy"),
    )
    return rounded(lk.target_correlations(df, "target")).withColumn("leaks", F.abs(F.col("r")) > 0.95)


QUERIES["leakage_target_correlation"] = correlations
ORACLES["leakage_target_correlation"] = """with d as (select (l_returnflag = 'R')::int as y, l_quantity, l_extendedprice, l_discount,
    2.0::double - 3 * (l_returnflag = 'R')::int as proxy from lineitem) """ + " union all ".join(
    f"select '{c}' as variable, round(corr({c}, y), 6) as r, abs(corr({c}, y)) > 0.95 as leaks from d"
    for c in ("l_quantity", "l_extendedprice", "l_discount", "proxy")
)


def overlap(spark, sf):
    s = split_orders(spark, sf)
    dev, hold = s.where("split = 'development'"), s.where("split = 'holdout'")
    same = lk.identical_rows(dev, hold, ["o_orderstatus", "o_orderpriority", "o_custkey"])
    ids = lk.shared_ids(dev, hold, "o_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return same.select(F.lit("identical features").alias("check"), F.col("n_identical").alias("n")).unionByName(
        ids.select(F.lit("shared ids").alias("check"), "n")
    )


QUERIES["leakage_row_overlap"] = overlap
ORACLES["leakage_row_overlap"] = f"""with {SPLIT_CTE} select 'identical features' as "check", count(*) as n from
    (select o_orderstatus, o_orderpriority, o_custkey from split where split = 'development'
     intersect select o_orderstatus, o_orderpriority, o_custkey from split where split = 'holdout')
  union all select 'shared ids', count(*) from (select o_orderkey from split where split = 'development'
     intersect select o_orderkey from split where split = 'holdout')"""


def report(spark, sf):
    return rounded(lk.split_report(split_orders(spark, sf), "target"))


QUERIES["leakage_split_report"] = report
ORACLES["leakage_split_report"] = f"""with {SPLIT_CTE} select split, count(*) as n, sum(target)::bigint as events, round(avg(target), 6) as prevalence
  from split group by split"""


def split_gate(spark, sf):
    return lk.split_gates(split_orders(spark, sf), "target")


QUERIES["leakage_split_gate"] = split_gate
ORACLES["leakage_split_gate"] = f"""with {SPLIT_CTE}, g as (select abs(avg(target) filter (where split = 'development')
    - avg(target) filter (where split = 'holdout')) as gap from split)
  select 'split_prevalence_match' as name, gap < 0.002 as passed, true as fatal,
    printf('gap = %.6f', gap) as detail from g"""


def mean_prediction(spark, sf):
    return rounded(lk.mean_prediction_gates(scored_orders(spark, sf)))


QUERIES["leakage_mean_prediction"] = mean_prediction
ORACLES["leakage_mean_prediction"] = f"""with {orders_scored_cte()} select model, round(avg(p), 6) as mean_p, round(avg(y), 6) as prevalence,
  abs(avg(p) - avg(y)) < 0.05 as passed from scored group by model"""


def ceiling(spark, sf):
    metrics = ladder_metrics(order_ladder(spark, sf), ["model"], ["auroc"])
    return lk.auroc_ceiling(metrics, 0.75, fatal=False).drop("detail")


QUERIES["leakage_auroc_ceiling"] = ceiling
ORACLES["leakage_auroc_ceiling"] = f"""with {orders_scored_cte()}, {ladder_cte(['model'])}, m as (select model, {metrics_sql(['auroc'])} from ladder group by model)
  select 'auroc_plausible' as name, max(auroc) <= 0.75 as passed, false as fatal from m"""


def recorded(spark, sf):
    log = RunManifest(spark, scratch_path(spark, "manifest"), "run-2")
    for name in ("orders", "part"):
        log.record_rows(name, written_rows(spark, f"{sf}/{name}.parquet"))
    return lk.recorded_gates(log.read(), {"orders": "rows", "part": "rows", "thresholds": "stage"}, fatal=False)


QUERIES["leakage_recorded_artifacts"] = recorded
ORACLES["leakage_recorded_artifacts"] = """with m(name) as (select 'orders' from (select count(*) as n from orders) where n > 0
    union all select 'part' from (select count(*) as n from part) where n > 0),
  r(name, kind) as (values ('orders', 'rows'), ('part', 'rows'), ('thresholds', 'stage')),
  c as (select r.name, r.kind, count(m.name) as n from r left join m using (name) group by r.name, r.kind)
  select 'recorded_' || name as name, n > 0 as passed, false as fatal, kind || ' ' || name || ': ' || n as detail from c"""
