"""Stand-in tables for the queries, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritally.operators.ladder import score_ladder


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6, skip: tuple = ()) -> DataFrame:
    """All double columns rounded, so that two engines print the same value."""
    return df.select(
        *[F.round(F.col(f"`{c}`"), digits).alias(c) if t == "double" and c not in skip else F.col(f"`{c}`") for c, t in df.dtypes]
    )


def rounded_sql(body: str, plain: list[str], doubles: list[str], digits: int = 6) -> str:
    """``body`` is a WITH chain ending in a CTE named result."""
    columns = plain + [f"round({c}, {digits}) as {c}" for c in doubles]
    return f"{body} select {', '.join(columns)} from result"


# --- the keyed hash in SQL ----------------------------------------------------


def h(seed: int, purpose: str, *keys: str) -> str:
    parts = ", ".join([f"'{seed}'", f"'{purpose}'", *[f"({k})::varchar" for k in keys]])
    return f"(('0x' || substring(md5(concat_ws('-', {parts})), 1, 12))::bigint)"


def u(seed: int, purpose: str, *keys: str) -> str:
    return f"({h(seed, purpose, *keys)}::double / 281474976710656::double)"


def choice(draw: str, values: list, weights: list[float], quote: bool = True) -> str:
    edge, out = 0.0, "case"
    for value, weight in list(zip(values, weights))[:-1]:
        edge = round(edge + weight, 12)
        shown = f"'{value}'" if quote else value
        out += f" when {draw} < {edge!r} then {shown}"
    last = f"'{values[-1]}'" if quote else values[-1]
    return f"{out} else {last} end" if len(values) > 1 else str(last)


# --- scored tables --------------------------------------------------------------
# orders: unique keys, continuous scores. lineitem: no key, heavily tied scores.

ORDER_MODELS = ["pa", "pb", "pc"]


def scored_orders_wide(spark: SparkSession, sf: str) -> DataFrame:
    y = (F.col("o_orderpriority") == "1-URGENT").cast("int")

    digest = F.md5(F.concat_ws("-", F.lit("7"), F.lit("score"), F.col("o_orderkey").cast("string")))
    rows = table(spark, sf, "orders").select("*", y.alias("y"), digest.alias("digest"))

    def draw(start: int, length: int):
        part = F.conv(F.substring("digest", start, length), 16, 10).cast("bigint")
        return part / F.lit(float(16**length))

    rows = rows.withColumns({"u1": draw(1, 12), "u2": draw(13, 12), "u3": draw(25, 8)})
    return rows.select(
        F.col("o_orderkey").alias("row_id"),
        "y",
        F.col("o_orderstatus").alias("status"),
        F.year("o_orderdate").cast("string").alias("yr"),
        (F.lit(0.05) + 0.5 * F.col("u1") + 0.2 * F.col("y") * F.col("u2")).alias("pa"),
        (F.lit(0.05) + 0.4 * F.col("u2") + 0.1 * F.col("y") * F.col("u1")).alias("pb"),
        (F.lit(0.1) + 0.2 * F.col("u3")).alias("pc"),
    )


def long_scores(wide: DataFrame, models: list[str], keep: list[str]) -> DataFrame:
    pairs = [F.struct(F.lit(m).alias("model"), F.col(m).cast("double").alias("p")) for m in models]
    return wide.select(*keep, F.inline(F.array(*pairs)))


def scored_orders(spark: SparkSession, sf: str, models: list[str] | None = None) -> DataFrame:
    return long_scores(scored_orders_wide(spark, sf), models or ORDER_MODELS, ["row_id", "y", "status", "yr"])


def orders_wide_cte() -> str:
    def draw(start: int, length: int) -> str:
        digest = "md5(concat_ws('-', '7', 'score', o_orderkey::varchar))"
        return f"('0x' || substring({digest}, {start}, {length}))::bigint::double / {16**length}::double"

    return f"""drawn_scores as (select *, (o_orderpriority = '1-URGENT')::int as y, {draw(1, 12)} as u1, {draw(13, 12)} as u2, {draw(25, 8)} as u3 from orders),
    wide as (select o_orderkey as row_id, y, o_orderstatus as status, year(o_orderdate)::varchar as yr,
      0.05::double + 0.5::double * u1 + 0.2::double * y * u2 as pa,
      0.05::double + 0.4::double * u2 + 0.1::double * y * u1 as pb,
      0.1::double + 0.2::double * u3 as pc from drawn_scores)"""


def orders_scored_cte(models: list[str] | None = None) -> str:
    parts = [f"select row_id, y, status, yr, '{m}' as model, {m} as p from wide" for m in models or ORDER_MODELS]
    return f"{orders_wide_cte()}, scored as ({' union all '.join(parts)})"


LINE_MODELS = ["pa", "pb"]


def scored_lines(spark: SparkSession, sf: str) -> DataFrame:
    wide = table(spark, sf, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        F.col("l_linestatus").alias("status"),
        F.round(F.col("l_discount") * 5 + F.col("l_tax"), 4).alias("pa"),
        F.round(F.col("l_quantity") / 60, 4).alias("pb"),
    )
    return long_scores(wide, LINE_MODELS, ["y", "status"])


LINES_CTE = """wide as (select (l_returnflag = 'R')::int as y, l_linestatus as status,
      round(l_discount * 5 + l_tax, 4) as pa, round(l_quantity / 60, 4) as pb from lineitem),
    scored as (select y, status, 'pa' as model, pa as p from wide union all select y, status, 'pb', pb from wide)"""


def line_ladder(spark: SparkSession, sf: str) -> DataFrame:
    return score_ladder(scored_lines(spark, sf), ["model"])


def order_ladder(spark: SparkSession, sf: str, models: list[str] | None = None) -> DataFrame:
    return score_ladder(scored_orders(spark, sf, models), ["model"])


def ladder_cte(keys: list[str], source: str = "scored", weight: str | None = None, name: str = "ladder") -> str:
    k = ", ".join(keys)
    w = f"{weight} * " if weight else ""
    lead = f"{k}, " if keys else ""
    part = f"partition by {k} " if keys else ""
    win = f"over ({part}order by p rows between unbounded preceding and 1 preceding)"
    return f"""{name}_cells as (select {lead}p, sum({w}y)::bigint as pos, sum({w}(1 - y))::bigint as neg from {source} group by {lead}p),
    {name} as (select {lead}p, pos, neg, coalesce(sum(pos) {win}, 0)::bigint as pos_below,
      coalesce(sum(neg) {win}, 0)::bigint as neg_below, (sum(pos) over ({part}))::bigint as pos_total,
      (sum(neg) over ({part}))::bigint as neg_total from {name}_cells)"""


# Metrics over ladder rows, written out in SQL.
SQL_METRICS = {
    "auroc": "sum(pos::double * (neg_below + neg::double / 2)) / nullif(max(pos_total)::double * max(neg_total), 0)",
    "auprc": "sum(pos::double * (pos_total - pos_below) / (pos_total - pos_below + neg_total - neg_below)) / nullif(max(pos_total), 0)",
    "auprc_baseline": "sum(pos)::double / sum(pos + neg)",
    "log_loss": "sum(-(pos * ln(greatest(least(p, 1 - 1e-12), 1e-12)) + neg * ln(1 - greatest(least(p, 1 - 1e-12), 1e-12)))) / sum(pos + neg)",
    "brier": "sum(pos * (1 - p) * (1 - p) + neg * p * p) / sum(pos + neg)",
    "mean_predicted_risk": "sum((pos + neg) * p) / sum(pos + neg)",
}
SQL_METRICS["brier_scaled"] = (
    f"1 - ({SQL_METRICS['brier']}) / nullif((sum(pos)::double / sum(pos + neg)) * (1 - sum(pos)::double / sum(pos + neg)), 0)"
)


def metrics_sql(names: list[str]) -> str:
    return ", ".join(f"round({SQL_METRICS[n]}, 6) as {n}" for n in names)


def fits_cte(keys: list[str], cells: str, steps: int = 25, name: str = "fits") -> str:
    """Newton steps of the recalibration fits as a recursive query over score cells."""
    k = ", ".join(keys)
    rk = ", ".join(f"s.{c}" for c in keys)
    on = " and ".join(f"s.{c} = d.{c}" for c in keys)
    return f"""{name}_data as (select {k}, ln(greatest(least(p, 1 - 1e-12), 1e-12) / (1 - greatest(least(p, 1 - 1e-12), 1e-12))) as x,
      pos::double as pos, (pos + neg)::double as n from {cells}),
    {name}_steps as (
      select 0 as it, {k}, 0.0::double as a, 0.0::double as b, 0.0::double as c
        from {name}_data group by {k} having sum(pos) > 0 and sum(pos) < sum(n)
      union all
      select it + 1, {k},
        a + greatest(least((h11 * g0 - h01 * g1) / nullif(h00 * h11 - h01 * h01, 0), 5), -5),
        b + greatest(least((h00 * g1 - h01 * g0) / nullif(h00 * h11 - h01 * h01, 0), 5), -5),
        greatest(least(c + greatest(least(coalesce(gc / nullif(hc, 0), 0), 5), -5), 10), -10)
      from (select it, {k}, a, b, c,
          sum(pos - n * q) as g0, sum((pos - n * q) * x) as g1,
          sum(n * q * (1 - q)) as h00, sum(n * q * (1 - q) * x) as h01, sum(n * q * (1 - q) * x * x) as h11,
          sum(pos - n * qc) as gc, sum(n * qc * (1 - qc)) as hc
        from (select s.it, {rk}, s.a, s.b, s.c, d.pos, d.n, d.x,
            1 / (1 + exp(-(s.a + s.b * d.x))) as q, 1 / (1 + exp(-(s.c + d.x))) as qc
          from {name}_steps s join {name}_data d on {on} where s.it < {steps}) as joined
        group by it, {k}, a, b, c) as sums
    ),
    {name} as (select {k}, b as calibration_slope, c as calibration_intercept from {name}_steps where it = {steps})"""
