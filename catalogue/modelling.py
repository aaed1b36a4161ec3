"""Model fitting, search and recalibration."""

from __future__ import annotations

import math

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from catalogue.sampling import SPLIT_CTE, split_orders
from catalogue.shared import LINES_CTE, ladder_cte, metrics_sql, orders_scored_cte, rounded, scored_lines, scored_orders, table, u
from catalogue.visits import order_visits
from veritally.operators import models as mo
from veritally.operators import tuning as tu
from veritally.operators.bounded import scratch_path, stored
from veritally.operators.discrimination import ladder_metrics
from veritally.operators.imputation import impute_level
from veritally.operators.ladder import score_ladder
from veritally.operators.recalibration import apply_platt, calibrated_scores, platt_fits
from veritally.operators.split import ColumnRoles
from veritally.plans import hospital, study
from veritally.sources.trials import TrialStore

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

# Small ensembles keep a check run short; the parameters are the caller's.
SMALL = {
    "parsimonious_lr": {},
    "penalised_lr": {"C": 1.0, "l1_ratio": 0.5},
    "random_forest": {"n_estimators": 10, "max_depth": 6, "min_samples_leaf": 15},
    "boosted_depthwise": {"n_estimators": 5, "max_depth": 3},
    "boosted_leafwise": {"n_estimators": 5, "num_leaves": 15},
}
ROLES = ColumnRoles(["o_totalprice", "o_custkey"], ["o_orderstatus"], {"o_totalprice": 9, "o_custkey": 9, "o_orderstatus": 3})


def split_model(key: str):
    def run(spark, sf):
        s = stored(split_orders(spark, sf))
        model = mo.fit_model(key, s.where("split = 'development'"), ROLES, "target", SMALL[key])
        scored = model.score(s, ["o_orderkey", "split", F.col("target").alias("y")])
        return rounded(ladder_metrics(score_ladder(scored, ["model", "split"]), ["model", "split"]))

    return run


for _key in SMALL:
    QUERIES[f"model_{_key}"] = split_model(_key)


# --- fits against their own optimality conditions ------------------------------------------


def optimality(key: str, params: dict):
    """What is left of the conditions that only the minimum of the penalised loss fulfils, for each design column and the intercept.

    With C the loss is the sum of log losses plus 1 / C times (l1_ratio * |w| + (1 - l1_ratio) / 2 * w ** 2); without it the sum alone.
    """

    def run(spark, sf):
        dev = stored(split_orders(spark, sf)).where("split = 'development'")
        model = mo.fit_model(key, dev, ROLES, "target", params)
        scored = model.classifier.transform(model.encoding.transform(dev))
        x = vector_to_array("features")
        residual = F.col("target") - vector_to_array("probability")[1]
        weights = [float(w) for w in model.classifier.coefficients]
        n = F.count(F.lit(1))
        sums = scored.agg(*[F.sum(x[j] * residual).alias(f"g{j}") for j in range(len(weights))], F.sum(residual).alias("g"), n.alias("n"))
        strength, l1 = (1 / params["C"], params["l1_ratio"]) if "C" in params else (0.0, 0.0)
        rows = [F.struct(F.lit("intercept").alias("part"), (F.col("g") / F.col("n")).alias("left_over"))]
        for j, w in enumerate(weights):
            g = F.col(f"g{j}")
            pull = F.lit(strength * (l1 * math.copysign(1, w) + (1 - l1) * w))
            left = F.greatest(F.abs(g) - strength * l1, F.lit(0.0)) if w == 0 else g - pull
            rows.append(F.struct(F.lit(f"column {j}").alias("part"), (left / F.col("n")).alias("left_over")))
        found = sums.select("n", F.inline(F.array(*rows)))
        return found.select("part", F.abs(F.round("left_over", 4)).alias("left_over"), F.col("n").cast("bigint").alias("n"))

    return run


def _optimality_sql(columns: int) -> str:
    parts = " union all ".join([f"select 'column {j}' as part from n" for j in range(columns)])
    return f"""with {SPLIT_CTE}, n as (select count(*) as n from split where split = 'development'), parts as (select 'intercept' as part union all {parts})
  select part, 0.0::double as left_over, n from parts, n"""


# two standardised columns and two levels of three
for _name, _key, _params in (("parsimonious", "parsimonious_lr", {}), ("penalised", "penalised_lr", {"C": 1.0, "l1_ratio": 0.5}), ("sparse", "penalised_lr", {"C": 0.02, "l1_ratio": 0.9})):
    QUERIES[f"model_optimality_{_name}"] = optimality(_key, _params)
    ORACLES[f"model_optimality_{_name}"] = _optimality_sql(4)


def hospital_study(spark, sf):
    """Encounters to hold-out metrics of two linear models."""
    matrix, roles = study.prepare(order_visits(spark, sf))
    done = study.fit_and_score(matrix, roles, {k: SMALL[k] for k in ("parsimonious_lr", "penalised_lr")})
    return rounded(ladder_metrics(score_ladder(done.holdout, ["model"]), ["model"]))


QUERIES["hospital_study"] = hospital_study


# --- search spaces -----------------------------------------------------------------------


def candidates(key: str):
    def run(spark, sf):
        return rounded(mo.candidate_points(table(spark, sf, "part").select(F.col("p_partkey").alias("trial")), "trial", mo.SPACES[key]))

    return run


def _draw_sql(spec: tuple) -> str:
    name, kind, *rest = spec
    v = u(42, f"space-{name}", "p_partkey")
    if kind == "choice":
        values = ", ".join(f"'{x}'" for x in rest[0])
        return f"([{values}])[(floor({v} * {len(rest[0])}) + 1)::int] as {name}"
    low, high = float(rest[0]), float(rest[1])
    if kind == "linear":
        sql = f"{low!r}::double + {v} * {high - low!r}::double"
    elif kind == "log":
        sql = f"exp({math.log(low)!r}::double + {v} * {math.log(high) - math.log(low)!r}::double)"
    elif kind == "int":
        sql = f"floor({low!r}::double + {v} * {high - low + 1!r}::double)"
    elif kind == "step":
        step = float(rest[2])
        sql = f"{low!r}::double + {step!r}::double * floor({v} * {(high - low) / step + 1!r}::double)"
    else:
        top = math.log(high + 0.5) - math.log(low - 0.5)
        sql = f"least(greatest(round(exp({math.log(low - 0.5)!r}::double + {v} * {top!r}::double), 0), {low!r}), {high!r})::double"
    return f"round({sql}, 6) as {name}"


for _key, _space in mo.SPACES.items():
    QUERIES[f"search_space_{_key}"] = candidates(_key)
    ORACLES[f"search_space_{_key}"] = f"select p_partkey as trial, {', '.join(_draw_sql(s) for s in _space)} from part"


# --- search ----------------------------------------------------------------------------------


def search(spark, sf):
    """Two trials of a small search, then one more after a restart."""
    store = TrialStore(spark, scratch_path(spark, "trials"))
    dev = stored(split_orders(spark, sf)).where("split = 'development'")
    tu.tune_model("penalised_lr", dev, ROLES, "target", "o_orderkey", store, n_trials=1, k=2, fixed={"max_iter": 20})
    tu.tune_model("parsimonious_lr", dev, ROLES, "target", "o_orderkey", store, k=2)
    trials = tu.tune_model("penalised_lr", dev, ROLES, "target", "o_orderkey", store, n_trials=2, k=2, fixed={"max_iter": 20})
    return rounded(store.read().select("study", "trial", "state", "folds", "value", "auroc"))


QUERIES["tuning_search"] = search


def replay(spark, sf):
    """One search over the event values of all users, in one go and in three with restarts between: what is pruned must agree."""
    keys = (F.lit("replay").alias("study"), F.col("user_id").cast("int").alias("trial"), F.pmod("event_id", F.lit(5)).cast("int").alias("step"))
    reports = stored(table(spark, sf, "events").groupBy(*keys).agg(F.avg("value").alias("value")))
    whole = tu.replayed(reports)
    third = reports.agg(F.count_distinct("trial").alias("n")).first()["n"] // 3
    parts, known = None, None
    for low, high in ((0, third), (third, third + 5), (third + 5, 1 << 31)):
        done = stored(tu.replayed(reports.where(F.col("trial").between(low, high - 1)), known))
        parts = done if parts is None else parts.unionByName(done)
        known = parts.where("state = 'COMPLETE'").select("study", "trial", "fold_values")
    b = parts.select("study", "trial", F.struct("state", "folds", "fold_values").alias("b"))
    both = whole.join(b, ["study", "trial"], "full")
    return both.select("trial", F.struct("state", "folds", "fold_values").eqNullSafe(F.col("b")).alias("same"))


QUERIES["tuning_replay"] = replay
ORACLES["tuning_replay"] = "select distinct user_id::int as trial, true as same from events"


def fold_table(spark, sf):
    scored = scored_lines(spark, sf).withColumn("fold", F.when(F.col("status") == "F", 0).otherwise(1))
    return rounded(tu.cross_validated(tu.fold_scores(scored, ["model"]), ["model"]))


QUERIES["tuning_fold_scores"] = fold_table
ORACLES["tuning_fold_scores"] = f"""with {LINES_CTE}, f as (select *, (status <> 'F')::int as fold from scored), {ladder_cte(['model', 'fold'], 'f')},
  m as (select model, fold, {metrics_sql(['log_loss', 'auroc']).replace('round(', '(').replace(', 6)', ')')} from ladder group by model, fold)
  select model, round(avg(-log_loss), 6) as neg_log_loss_mean, round(stddev_samp(-log_loss), 6) as neg_log_loss_sd,
    round(avg(auroc), 6) as roc_auc_mean, round(stddev_samp(auroc), 6) as roc_auc_sd from m group by model"""


def _trials(spark, sf):
    """Trials derived from events: one study per user, numbered by event id."""
    state = F.when(F.col("event_type") == "error", "PRUNED").when(F.col("event_type") == "signup", "RUNNING").otherwise("COMPLETE")
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf, "events").select(
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("study"),
        F.col("event_id").cast("int").alias("trial"),
        state.alias("state"),
        (-F.col("value") / 1000).alias("value"),
        F.create_map(F.lit("trial"), F.col("event_id").cast("string"), F.lit("kind"), F.col("event_type")).alias("params"),
        ts.alias("started"),
        (ts + F.make_dt_interval(secs=F.round(F.col("value"), 2).cast("decimal(18,6)"))).alias("completed"),
    )


TRIALS_CTE = """trials as (select 'user-' || user_id as study, event_id::int as trial,
    case event_type when 'error' then 'PRUNED' when 'signup' then 'RUNNING' else 'COMPLETE' end as state, -value / 1000 as value, value as v, event_type as kind from events)"""


def history(spark, sf):
    h = tu.trial_history(_trials(spark, sf), bucket_trials=500)
    return rounded(h.select("study", "trial", "state", "value", "best_so_far", "duration_seconds"))


QUERIES["tuning_history"] = history
ORACLES["tuning_history"] = f"""with {TRIALS_CTE} select study, trial, state, round(value, 6) as value,
  round(max(case when state = 'COMPLETE' then value end) over (partition by study order by trial rows between unbounded preceding and current row), 6) as best_so_far,
  round(round(v, 2), 6) as duration_seconds from trials"""


def converged(spark, sf):
    return tu.convergence(_trials(spark, sf))


QUERIES["tuning_convergence"] = converged
ORACLES["tuning_convergence"] = f"""with {TRIALS_CTE}, c as (select *, row_number() over (partition by study order by trial desc) as back from trials where state = 'COMPLETE'),
  s as (select study, count(*) as n, max(value) as best, max(value) filter (where back > 10) as prev from c group by study),
  b as (select study, min(trial) as best_at from c join s using (study) where value = best group by study),
  p as (select study, sum((state = 'PRUNED')::int)::bigint as pruned from trials group by study)
  select study, coalesce(n, 0) as n_complete, case when n >= 15 then pruned end as n_pruned, case when n >= 15 then round(best, 6) end as best_objective,
    case when n >= 15 then best_at end as best_at_trial, case when n >= 15 then round(best - prev, 6) end as improvement,
    case when n >= 15 then round(abs((best - prev) / nullif(prev, 0)), 6) end as relative_improvement,
    n >= 15 and coalesce(abs((best - prev) / nullif(prev, 0)) < 0.001, false) as converged
  from p left join s using (study) left join b using (study)"""


def tuning_summary(spark, sf):
    return tu.tuning_table(_trials(spark, sf))


QUERIES["tuning_table"] = tuning_summary
ORACLES["tuning_table"] = f"""with {TRIALS_CTE}, c as (select *, row_number() over (partition by study order by value desc, trial) as rn from trials where state = 'COMPLETE'),
  n as (select study, sum((state = 'COMPLETE')::int)::bigint as n_trials from trials group by study)
  select study, n_trials, 'kind=' || kind || '; trial=' || trial::double as selected_hyperparameters, round(value, 5) as best_cv_objective
  from n left join (select * from c where rn = 1) using (study)"""


def pruning(spark, sf):
    """Running fold means: study = event type, trial = user, step = hour block."""
    e = table(spark, sf, "events")
    reports = e.groupBy(
        F.col("event_type").alias("study"), F.col("user_id").alias("trial"), F.pmod("event_id", F.lit(5)).cast("int").alias("step")
    ).agg(F.avg("value").alias("value"))
    state = F.when(F.col("trial") % 4 == 0, "RUNNING").otherwise("COMPLETE")
    return rounded(tu.median_pruned(reports.withColumn("state", state)))


QUERIES["tuning_median_pruning"] = pruning
ORACLES["tuning_median_pruning"] = """with r as (select event_type as study, user_id as trial, (event_id % 5)::int as step, avg(value) as value from events group by 1, 2, 3),
  m as (select study, step, quantile_cont(value, 0.5) as median, count(*) as n from r where trial % 4 <> 0 group by study, step)
  select study, trial, step, round(value, 6) as value, round(median, 6) as median,
    step >= 1 and coalesce(n, 0) >= 8 and coalesce(value < median, false) as pruned from r left join m using (study, step)"""


# --- recalibration --------------------------------------------------------------------------------


def platt(spark, sf):
    scored = scored_orders(spark, sf)
    fits = platt_fits(scored, ["model"])
    after = apply_platt(scored, fits, ["model"]).groupBy("model").agg(F.avg("p").alias("mean_after"))
    return rounded(fits.join(after, "model"), 4)


QUERIES["recalibration_platt"] = platt
ORACLES["recalibration_platt"] = f"""with recursive {orders_scored_cte()},
  n as (select model, sum(y)::double as np, sum(1 - y)::double as nn from scored group by model),
  d as (select model, p as x, case when y = 1 then (np + 1) / (np + 2) else 1 / (nn + 2) end as t from scored join n using (model)),
  steps as (select 0 as it, model, 0.0::double as a, 0.0::double as b from n
    union all select it + 1, model, a + greatest(least((h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), 5), -5),
      b + greatest(least((h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01), 5), -5)
    from (select it, model, a, b, sum(t - q) as g0, sum((t - q) * x) as g1, sum(q * (1 - q)) as h00, sum(q * (1 - q) * x) as h01, sum(q * (1 - q) * x * x) as h11
      from (select s.it, s.model, s.a, s.b, d.x, d.t, 1 / (1 + exp(-(s.a + s.b * d.x))) as q from steps s join d on s.model = d.model where s.it < 12) as j
      group by it, model, a, b) as sums),
  f as (select model, a, b from steps where it = 12)
  select model, round(a, 4) as intercept, round(b, 4) as slope, round(avg(1 / (1 + exp(-(a + b * p)))), 4) as mean_after
  from scored join f using (model) group by model, a, b"""


def recalibrated(method: str):
    def run(spark, sf):
        s = stored(split_orders(spark, sf))
        dev, hold = s.where("split = 'development'"), s.where("split = 'holdout'")
        scored = calibrated_scores("parsimonious_lr", dev, hold, ROLES, "target", "o_orderkey", method=method)
        return rounded(ladder_metrics(score_ladder(scored, ["model"]), ["model"]))

    return run


QUERIES["recalibration_sigmoid"] = recalibrated("sigmoid")
QUERIES["recalibration_isotonic"] = recalibrated("isotonic")


def wide(spark, sf):
    return rounded(mo.wide_predictions(scored_orders(spark, sf), "row_id", "y", ["pa", "pb", "pc"], ["status"]))


QUERIES["predictions_wide"] = wide
ORACLES["predictions_wide"] = f"""with {orders_scored_cte()} select row_id, y, status, round(max(p) filter (where model = 'pa'), 6) as pa,
  round(max(p) filter (where model = 'pb'), 6) as pb, round(max(p) filter (where model = 'pc'), 6) as pc from scored group by row_id, y, status"""


def imputed_levels(spark, sf):
    df = table(spark, sf, "orders").withColumn(
        "status", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderstatus")).otherwise("Unknown")
    )
    done = impute_level(df, "status", "o_orderkey", ["o_totalprice", "o_custkey"], draws=3)
    return done.groupBy("draw", "status").agg(F.count(F.lit(1)).alias("n"))


QUERIES["model_based_imputation"] = imputed_levels
