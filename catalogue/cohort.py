"""Cohort queries on orders (customer = entity, order = record) and events."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from catalogue.shared import rounded, table
from veritally.operators import cohort as co
from veritally.operators.gates import Gate, evaluate_gates
from veritally.operators.split import column_roles

QUERIES: dict = {}
ORACLES: dict[str, str] = {}



def _urgent():
    return co.binary_outcome("o_orderpriority", "1-URGENT")

def _steps():
    return [
        co.Exclusion("After excluding pending orders", co.code_in("o_orderstatus", ["P"]), "status P"),
        co.Exclusion("After excluding unspecified priority", F.col("o_orderpriority") == "4-NOT SPECIFIED", "priority unknown"),
    ]


def excluded_codes(spark, sf):
    return co.exclude_codes(table(spark, sf, "orders"), "o_orderstatus", ["P"]).select("o_orderkey", "o_orderstatus")


QUERIES["cohort_exclude_codes"] = excluded_codes
ORACLES["cohort_exclude_codes"] = "select o_orderkey, o_orderstatus from orders where not coalesce(o_orderstatus in ('P'), false)"


def excluded_code_table(spark, sf):
    codes = table(spark, sf, "part").where(F.col("p_size") > 40).select("p_partkey")
    return co.exclude_codes(table(spark, sf, "lineitem"), "l_partkey", codes).groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("l_linenumber").cast("bigint")).alias("lines")
    )


QUERIES["cohort_exclude_code_table"] = excluded_code_table
ORACLES["cohort_exclude_code_table"] = """select l_returnflag, count(*) as n, sum(l_linenumber)::bigint as lines from lineitem
  where l_partkey not in (select p_partkey from part where p_size > 40) group by l_returnflag"""


def excluded_level(spark, sf):
    return co.eligible(table(spark, sf, "orders"), _steps()[1:]).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


QUERIES["cohort_exclude_level"] = excluded_level
ORACLES["cohort_exclude_level"] = """select o_orderpriority, count(*) as n from orders
  where not coalesce(o_orderpriority = '4-NOT SPECIFIED', false) group by o_orderpriority"""


def first_order(spark, sf):
    return co.first_per_entity(co.eligible(table(spark, sf, "orders"), _steps()), "o_custkey", "o_orderkey").select(
        "o_custkey", "o_orderkey", "o_totalprice"
    )


QUERIES["cohort_first_per_entity"] = first_order
FIRST = """eligible as (select * from orders where not coalesce(o_orderstatus in ('P'), false)
    and not coalesce(o_orderpriority = '4-NOT SPECIFIED', false)),
  first as (select * from (select *, row_number() over (partition by o_custkey order by o_orderkey) as rn from eligible) where rn = 1)"""
ORACLES["cohort_first_per_entity"] = f"with {FIRST} select o_custkey, o_orderkey, o_totalprice from first"


def first_event(spark, sf):
    df = table(spark, sf, "events").where(F.col("event_type") != "error")
    return co.first_per_entity(df, "user_id", "ts", tie="event_id").select("user_id", "event_id", "event_type", "value")


QUERIES["cohort_first_event_per_user"] = first_event
ORACLES["cohort_first_event_per_user"] = """select user_id, event_id, event_type, value from
  (select *, row_number() over (partition by user_id order by ts, event_id) as rn from events where event_type <> 'error') where rn = 1"""


def outcome(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", _urgent().alias("target"))


QUERIES["cohort_binary_outcome"] = outcome
ORACLES["cohort_binary_outcome"] = "select o_orderkey, coalesce(o_orderpriority = '1-URGENT', false)::int as target from orders"


def derived(spark, sf):
    return co.derive_cohort(table(spark, sf, "orders"), _steps(), "o_custkey", "o_orderkey", _urgent())


def cohort_rows(spark, sf):
    return derived(spark, sf).select("o_custkey", "o_orderkey", "o_orderstatus", "target")


QUERIES["cohort_derive"] = cohort_rows
ORACLES["cohort_derive"] = f"""with {FIRST} select o_custkey, o_orderkey, o_orderstatus,
  coalesce(o_orderpriority = '1-URGENT', false)::int as target from first"""


def flow(spark, sf):
    return co.participant_flow(table(spark, sf, "orders"), _steps(), "o_custkey", "o_orderkey", _urgent())


QUERIES["cohort_participant_flow"] = flow
ORACLES["cohort_participant_flow"] = f"""with {FIRST},
  s0 as (select count(*) as n from orders),
  s1 as (select count(*) as n from orders where not coalesce(o_orderstatus in ('P'), false)),
  s2 as (select count(*) as n from eligible),
  s3 as (select count(*) as n, sum((o_orderpriority = '1-URGENT')::int)::bigint as events from first)
  select 0 as step_no, 'Raw records' as step, n, 0::bigint as excluded, '-' as reason from s0
  union all select 1, 'After excluding pending orders', s1.n, s0.n - s1.n, 'status P' from s0, s1
  union all select 2, 'After excluding unspecified priority', s2.n, s1.n - s2.n, 'priority unknown' from s1, s2
  union all select 3, 'After retaining the first record per entity', s3.n, s2.n - s3.n, 'repeat records removed' from s2, s3
  union all select 4, 'Final cohort', s3.n, 0, events || ' events' from s3"""


def gates(spark, sf):
    return co.cohort_gates(derived(spark, sf), "target", "o_orderpriority", (1, 10**9), (0.1, 0.2))


QUERIES["cohort_gates"] = gates
ORACLES["cohort_gates"] = f"""with {FIRST}, s as (select count(*) as n, avg((o_orderpriority = '1-URGENT')::int) as prev,
    count(o_orderpriority) as labelled from first)
  select 'cohort_size' as name, n between 1 and 1000000000 as passed, true as fatal, 'n = ' || n as detail from s
  union all select 'outcome_prevalence', prev between 0.1 and 0.2, true, printf('prevalence = %.6f', prev) from s
  union all select 'outcome_partition', labelled = n, true, 'labelled = ' || labelled from s"""


def gate_per_group(spark, sf):
    stats = table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))
    return evaluate_gates(
        stats,
        [
            Gate("enough_rows", F.col("n") >= 1000, F.concat_ws(" ", "event_type", "n")),
            Gate("plausible_value", F.col("top") < 1000, F.col("event_type"), fatal=False),
        ],
    )


QUERIES["gate_evaluation"] = gate_per_group
ORACLES["gate_evaluation"] = """with s as (select event_type, count(*) as n, max(value) as top from events group by event_type)
  select 'enough_rows' as name, n >= 1000 as passed, true as fatal, event_type || ' ' || n as detail from s
  union all select 'plausible_value', top < 1000, false, event_type from s"""


def without_ids(spark, sf):
    return table(spark, sf, "orders").drop("o_custkey", "o_orderdate").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


QUERIES["cohort_drop_identifiers"] = without_ids
ORACLES["cohort_drop_identifiers"] = "select o_orderkey, o_orderstatus, o_totalprice, o_orderpriority from orders"


def complete(spark, sf):
    df = table(spark, sf, "orders").withColumns(
        {
            "priority": F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "Unknown").otherwise(F.col("o_orderpriority")),
            "status": F.when(F.col("o_orderstatus") == "P", "Unknown").otherwise(F.col("o_orderstatus")),
        }
    )
    return co.complete_cases(df, ["priority", "status"]).select("o_orderkey", "priority", "status")


QUERIES["cohort_complete_cases"] = complete
ORACLES["cohort_complete_cases"] = """select o_orderkey, o_orderpriority as priority, o_orderstatus as status from orders
  where o_orderpriority <> '4-NOT SPECIFIED' and o_orderstatus <> 'P'"""


def ablated(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice", "p_brand", "p_type")
    roles = column_roles(df, ["p_partkey"]).without(["p_brand"])
    rows = VectorAssembler(inputCols=roles.continuous, outputCol="v").transform(df)
    v = vector_to_array("v")
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    return rounded(rows.select("p_partkey", F.size(v).alias("slots"), total.alias("total"), F.lit(len(roles.categorical)).alias("categorical")), 4)


QUERIES["cohort_feature_subset"] = ablated
ORACLES["cohort_feature_subset"] = """select p_partkey, 2 as slots, round(p_size::double + p_retailprice, 4) as total, 1 as categorical from part"""
