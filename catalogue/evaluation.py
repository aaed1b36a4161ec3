"""Evaluation of scored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue.shared import (
    LINES_CTE,
    ORDER_MODELS,
    fits_cte,
    h,
    ladder_cte,
    line_ladder,
    metrics_sql,
    order_ladder,
    orders_scored_cte,
    orders_wide_cte,
    rounded,
    scored_lines,
    scored_orders,
    scored_orders_wide,
    table,
    u,
)
from veritally.operators import bootstrap as bs
from veritally.operators import calibration as ca
from veritally.operators import discrimination as di
from veritally.operators import inference as inf
from veritally.operators import subgroups as sg
from veritally.operators import thresholds as th
from veritally.operators.ladder import ladder_quantiles, score_ladder
from veritally.operators.quantiles import exact_quantiles
from veritally.operators.smoothing import isotonic_pools, isotonic_values
from veritally.plans import evaluation as plan

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

LINES = f"{LINES_CTE}, {ladder_cte(['model'])}"
ORDERS = f"{orders_scored_cte()}, {ladder_cte(['model'])}"


# --- ladder, discrimination ---------------------------------------------------------


def ladder(spark, sf):
    return line_ladder(spark, sf)


QUERIES["score_ladder"] = ladder
ORACLES["score_ladder"] = f"with {LINES} select * from ladder"


def ladder_bucketed(spark, sf):
    scored = scored_orders(spark, sf)
    return rounded(score_ladder(scored, ["model"], bucket_rows=2000), 9)


QUERIES["score_ladder_bucketed"] = ladder_bucketed
ORACLES["score_ladder_bucketed"] = f"""with {ORDERS} select model, round(p, 9) as p, pos, neg, pos_below, neg_below, pos_total, neg_total from ladder"""


def discrimination_lines(spark, sf):
    return rounded(di.discrimination_metrics(line_ladder(spark, sf), ["model"]))


QUERIES["discrimination_tied_scores"] = discrimination_lines
ORACLES["discrimination_tied_scores"] = f"""with {LINES} select model, {metrics_sql(['auroc', 'auprc', 'auprc_baseline', 'log_loss'])} from ladder group by model"""


def all_metrics(spark, sf):
    return rounded(di.ladder_metrics(order_ladder(spark, sf), ["model"]))


QUERIES["discrimination_and_brier"] = all_metrics
ORACLES["discrimination_and_brier"] = f"""with {ORDERS} select model, {metrics_sql(['auroc', 'auprc', 'auprc_baseline', 'log_loss', 'brier', 'brier_scaled', 'mean_predicted_risk'])}
  from ladder group by model"""


def curves(spark, sf):
    ladder = line_ladder(spark, sf)
    roc, pr = di.roc_points(ladder, ["model"]), di.pr_points(ladder, ["model"])
    return rounded(roc.join(pr, ["model", "p"]))


QUERIES["roc_and_pr_points"] = curves
ORACLES["roc_and_pr_points"] = f"""with {LINES} select model, round(p, 6) as p, round((neg_total - neg_below)::double / neg_total, 6) as fpr,
  round((pos_total - pos_below)::double / pos_total, 6) as tpr, round((pos_total - pos_below)::double / pos_total, 6) as recall,
  round((pos_total - pos_below)::double / (pos_total - pos_below + neg_total - neg_below), 6) as precision from ladder"""


def histogram(spark, sf):
    return di.score_histogram(order_ladder(spark, sf), ["model"], 50)


QUERIES["score_histogram"] = histogram
ORACLES["score_histogram"] = f"""with {orders_scored_cte()} select model, least(floor(p / (1.0::double / 50)), 49)::bigint as bin, count(*) as n
  from scored where p between 0 and 1 group by 1, 2"""


def score_quantiles(spark, sf):
    q = ladder_quantiles(order_ladder(spark, sf), ["model"], [0.0, 0.1, 0.5, 0.9, 0.995, 1.0], "q")
    names = ["q0", "q10", "q50", "q90", "q995", "q100"]
    return rounded(q.select("model", *[F.col("q")[i].alias(n) for i, n in enumerate(names)]))


QUERIES["score_quantiles"] = score_quantiles
ORACLES["score_quantiles"] = f"""with {orders_scored_cte()} select model, """ + ", ".join(
    f"round(quantile_cont(p, {q}), 6) as {n}"
    for q, n in [(0.0, "q0"), (0.1, "q10"), (0.5, "q50"), (0.9, "q90"), (0.995, "q995"), (1.0, "q100")]
) + " from scored group by model"


def column_quantiles(spark, sf):
    q = exact_quantiles(table(spark, sf, "lineitem"), "l_extendedprice", [0.25, 0.5, 0.75], ["l_returnflag"])
    return rounded(q.select("l_returnflag", "n", *[F.col("q")[i].alias(c) for i, c in enumerate(["q25", "q50", "q75"])]))


QUERIES["exact_quantiles_by_group"] = column_quantiles
ORACLES["exact_quantiles_by_group"] = """select l_returnflag, count(*) as n, round(quantile_cont(l_extendedprice, 0.25), 6) as q25,
  round(quantile_cont(l_extendedprice, 0.5), 6) as q50, round(quantile_cont(l_extendedprice, 0.75), 6) as q75 from lineitem group by l_returnflag"""


# --- calibration ----------------------------------------------------------------------


def fits_lines(spark, sf):
    return rounded(ca.calibration_fits(line_ladder(spark, sf), ["model"]), 5)


QUERIES["calibration_slope_intercept_tied"] = fits_lines
ORACLES["calibration_slope_intercept_tied"] = f"""with recursive {LINES}, {fits_cte(['model'], 'ladder')}
  select model, round(calibration_slope, 5) as calibration_slope, round(calibration_intercept, 5) as calibration_intercept from fits"""


def fits_orders(spark, sf):
    return rounded(ca.calibration_fits(order_ladder(spark, sf), ["model"]), 5)


QUERIES["calibration_slope_intercept"] = fits_orders
ORACLES["calibration_slope_intercept"] = f"""with recursive {ORDERS}, {fits_cte(['model'], 'ladder')}
  select model, round(calibration_slope, 5) as calibration_slope, round(calibration_intercept, 5) as calibration_intercept from fits"""


def lowess_cte(points: int = 200) -> str:
    """``ici`` (model, ici) of ``ladder``: local lines at the fit points, each with its own sorted distances."""
    return f"""lc as (select model, p, (pos + neg)::double as w, pos::double as pos, pos_below + neg_below as below, pos + neg as rows from ladder),
  lk as (select model, floor(0.6::double * sum(w) + 1e-10)::double as k, count(*) as cells, min(2 * below + rows) as lo, max(2 * below + rows) as hi from lc group by model),
  fit_at as (select model, min(p) as x0 from lc join lk using (model)
    group by model, case when cells <= {points} then p else ((2 * below + rows - lo) * {points - 1} // greatest(hi - lo, 1))::double end),
  distances as (select a.model, a.x0, b.p as x, b.w, b.pos, abs(b.p - a.x0) as d,
    sum(b.w) over (partition by a.model, a.x0 order by abs(b.p - a.x0), b.p) as upto from fit_at a join lc b on a.model = b.model),
  width as (select model, x0, min(d) filter (where upto >= k - 1e-9) as hw from distances join lk using (model) group by model, x0),
  tricube as (select model, x0, x - x0 as u, pos, w, case when hw > 0 and d < hw then pow(1 - pow(d / hw, 3), 3) else 0 end as t
    from distances join width using (model, x0)),
  lsum as (select model, x0, sum(w * t) as s0, sum(w * t * u) as s1, sum(w * t * u * u) as s2, sum(pos * t) as y0, sum(pos * t * u) as y1
    from tricube group by model, x0),
  fit as (select model, x0, y0 / s0 - ((y1 - s1 * y0 / s0) / (s2 - s1 * s1 / s0)) * s1 / s0 as f from lsum),
  below_it as (select lc.*, fit.x0 as xa, fit.f as fa from lc asof left join fit on lc.model = fit.model and lc.p >= fit.x0),
  around as (select b.*, fit.x0 as xb, fit.f as fb from below_it b asof left join fit on b.model = fit.model and b.p <= fit.x0),
  smooth as (select model, p, w, case when xa is null then fb when xb is null or xb = xa then fa else fa + (fb - fa) * (p - xa) / (xb - xa) end as f from around),
  ici as (select model, sum(w * abs(f - p)) / sum(w) as ici from smooth group by model)"""


def ici_lines(spark, sf):
    return rounded(ca.integrated_calibration_index(line_ladder(spark, sf), ["model"]), 5)


QUERIES["calibration_ici_tied"] = ici_lines
ORACLES["calibration_ici_tied"] = f"with {LINES}, {lowess_cte()} select model, round(ici, 5) as ici from ici"


def ici_orders(spark, sf):
    return rounded(ca.integrated_calibration_index(order_ladder(spark, sf), ["model"]), 5)


QUERIES["calibration_ici"] = ici_orders
ORACLES["calibration_ici"] = f"with {ORDERS}, {lowess_cte()} select model, round(ici, 5) as ici from ici"


def ici_isotonic(spark, sf):
    return rounded(ca.integrated_calibration_index(line_ladder(spark, sf), ["model"], method="isotonic"))


def isotonic_sql(ladder: str = "ladder") -> str:
    """``iso`` (model, p, w, f): the min-max formula, f(i) = max over a <= i of the min over b >= i of the mean of cells a to b."""
    return f"""ic as (select model, p, pos + neg as w, pos_below + neg_below as w0, pos_below as s0, pos_below + neg_below + pos + neg as w1, pos_below + pos as s1,
      row_number() over (partition by model order by p) as i from {ladder}),
    low as (select a.model, a.i as a, b.i as i, min((b.s1 - a.s0)::double / (b.w1 - a.w0)) over (partition by a.model, a.i order by b.i desc) as m
      from ic a join ic b on a.model = b.model and a.i <= b.i),
    iso as (select ic.model, ic.p, ic.w, max(m) as f from low join ic on ic.model = low.model and ic.i = low.i group by ic.model, ic.p, ic.w)"""


QUERIES["calibration_ici_isotonic"] = ici_isotonic
ORACLES["calibration_ici_isotonic"] = f"with {LINES}, {isotonic_sql()} select model, round(sum(w * abs(f - p)) / sum(w), 6) as ici from iso group by model"


def isotonic_scores(spark, sf):
    scored = scored_orders(spark, sf).withColumn("p", F.round("p", 3))
    pools = isotonic_pools(score_ladder(scored.where("row_id % 2 = 1"), ["model"]), ["model"])
    ahead = scored_orders(spark, sf).where("row_id % 2 = 0").select("row_id", "model", "p")
    return rounded(isotonic_values(ahead, pools, ["model"]))


QUERIES["recalibration_isotonic_new_scores"] = isotonic_scores
ORACLES["recalibration_isotonic_new_scores"] = f"""with {orders_scored_cte()}, half as (select model, y, round(p, 3) as p from scored where row_id % 2 = 1),
  {ladder_cte(['model'], 'half')}, {isotonic_sql()},
  ahead as (select row_id, model, p from scored where row_id % 2 = 0),
  below_it as (select ahead.*, iso.p as xa, iso.f as fa from ahead asof left join iso on ahead.model = iso.model and ahead.p >= iso.p),
  around as (select b.*, iso.p as xb, iso.f as fb from below_it b asof left join iso on b.model = iso.model and b.p <= iso.p)
  select row_id, model, round(case when xa is null then fb when xb is null or xb = xa then fa else fa + (fb - fa) * (p - xa) / (xb - xa) end, 6) as p from around"""


def quantile_bins(spark, sf):
    return rounded(ca.calibration_curve(order_ladder(spark, sf), ["model"], 10))


def _bins_sql(source: str, edges: str) -> str:
    return f"""with {source}, e as ({edges}),
  b as (select s.model, s.y, s.p, len(list_filter(e.edges[2:len(e.edges) - 1], lambda x: x < s.p)) as bin
    from scored s join e on s.model = e.model where len(e.edges) > 1),
  g as (select model, bin::int as bin, count(*) as n, avg(p) as mp, avg(y) as obs from b group by model, bin),
  z as (select *, sqrt(greatest(obs * (1 - obs), 1e-12) / n) as se from g)
  select model, bin, n, round(mp, 6) as mean_predicted, round(obs, 6) as observed, round(greatest(0, obs - 1.96 * se), 6) as ci_low,
    round(least(1, obs + 1.96 * se), 6) as ci_high from z"""


QUERIES["calibration_bins_quantile"] = quantile_bins
ORACLES["calibration_bins_quantile"] = _bins_sql(
    orders_scored_cte(),
    "select model, list_sort(list_distinct(quantile_cont(p, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) as edges from scored group by model",
)


def quantile_bins_tied(spark, sf):
    return rounded(ca.calibration_curve(line_ladder(spark, sf), ["model"], 10))


QUERIES["calibration_bins_quantile_tied"] = quantile_bins_tied
ORACLES["calibration_bins_quantile_tied"] = _bins_sql(
    LINES_CTE,
    "select model, list_sort(list_distinct(quantile_cont(p, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) as edges from scored group by model",
)


def uniform_bins(spark, sf):
    return rounded(ca.calibration_curve(order_ladder(spark, sf), ["model"], 10, "uniform"))


QUERIES["calibration_bins_uniform"] = uniform_bins
ORACLES["calibration_bins_uniform"] = _bins_sql(
    orders_scored_cte(),
    "select model, ["
    + ", ".join(f"min(p) + (max(p) - min(p)) * {i / 10}::double" for i in range(10))
    + ", max(p)] as edges from scored group by model",
)


# --- thresholds -------------------------------------------------------------------------


def thresholds(spark, sf):
    return rounded(th.select_thresholds(order_ladder(spark, sf), ["model"]))


THRESHOLDS = """j as (select model, p, round((pos_total - pos_below)::double / pos_total - (neg_total - neg_below)::double / neg_total, 12) as j,
    (pos_total - pos_below)::double / greatest(pos_total, 1) as sens from {ladder}),
  q as (select model, quantile_cont(p, 0.9) as capacity from {scored} group by model),
  thr as (select j.model, max(q.capacity) as capacity, case when max(j) > 0 then least(greatest((arg_max(p, (j, p))), 0), 1) else 1 end as youden,
    coalesce(max(p) filter (where sens >= 0.5), min(p)) as fixed_sensitivity from j join q using (model) group by j.model)"""


def thresholds_cte(ladder: str = "ladder", scored: str = "scored") -> str:
    return THRESHOLDS.replace("{ladder}", ladder).replace("{scored}", scored)


QUERIES["threshold_selection"] = thresholds
ORACLES["threshold_selection"] = f"""with {ORDERS}, {thresholds_cte()} select model, round(capacity, 6) as capacity,
  round(youden, 6) as youden, round(fixed_sensitivity, 6) as fixed_sensitivity from thr"""


def thresholds_tied(spark, sf):
    return rounded(th.select_thresholds(line_ladder(spark, sf), ["model"]))


QUERIES["threshold_selection_tied"] = thresholds_tied
ORACLES["threshold_selection_tied"] = f"""with {LINES}, {thresholds_cte()} select model, round(capacity, 6) as capacity,
  round(youden, 6) as youden, round(fixed_sensitivity, 6) as fixed_sensitivity from thr"""

RATIOS = """round(tp::double / nullif(tp + fn, 0), 6) as sensitivity, round(tn::double / nullif(tn + fp, 0), 6) as specificity,
  round(tp::double / nullif(tp + fp, 0), 6) as ppv, round(tn::double / nullif(tn + fn, 0), 6) as npv,
  round(coalesce(2 * tp::double / nullif(2 * tp + fp + fn, 0), 0), 6) as f1,
  round((tp::double / nullif(tp + fn, 0) + tn::double / nullif(tn + fp, 0)) / 2, 6) as balanced_accuracy,
  round((tp + tn)::double / (tn + fp + fn + tp), 6) as accuracy, round((tp + fp)::double / (tn + fp + fn + tp), 6) as alert_rate,
  round(1 / nullif(tp::double / nullif(tp + fp, 0), 0), 6) as nne"""
COUNTS = """sum((y = 0 and p < threshold)::int)::bigint as tn, sum((y = 0 and p >= threshold)::int)::bigint as fp,
    sum((y = 1 and p < threshold)::int)::bigint as fn, sum((y = 1 and p >= threshold)::int)::bigint as tp"""


def split_by_year(spark, sf):
    scored = scored_orders(spark, sf)
    return scored.where(F.col("yr") < "1997"), scored.where(F.col("yr") >= "1997")


def threshold_performance(spark, sf):
    dev, hold = split_by_year(spark, sf)
    return rounded(plan.threshold_table(dev, hold))


QUERIES["threshold_performance"] = threshold_performance
ORACLES["threshold_performance"] = f"""with {orders_scored_cte()}, dev as (select * from scored where yr < '1997'), hold as (select * from scored where yr >= '1997'),
  {ladder_cte(['model'], 'dev')}, {thresholds_cte('ladder', 'dev')},
  points as (select model, 'capacity' as operating_point, capacity as threshold from thr union all select model, 'youden', youden from thr
    union all select model, 'fixed_sensitivity', fixed_sensitivity from thr),
  c as (select model, operating_point, threshold, {COUNTS} from hold join points using (model) group by model, operating_point, threshold)
  select model, operating_point, round(threshold, 6) as threshold, tn, fp, fn, tp, {RATIOS} from c"""


def classification_fixed(spark, sf):
    points = spark.createDataFrame([("low", 0.2), ("mid", 0.4), ("none", 2.0)], "operating_point string, threshold double")
    models = line_ladder(spark, sf)
    cut = models.select("model").distinct().select("model", F.inline(F.array(*[
        F.struct(F.lit(n).alias("operating_point"), F.lit(t).alias("threshold")) for n, t in points.collect()
    ])))
    return rounded(th.classification_metrics(models, cut, ["model"]))


QUERIES["classification_at_thresholds"] = classification_fixed
ORACLES["classification_at_thresholds"] = f"""with {LINES_CTE}, points(operating_point, threshold) as (values ('low', 0.2::double), ('mid', 0.4), ('none', 2.0)),
  c as (select model, operating_point, threshold, {COUNTS} from scored cross join points group by model, operating_point, threshold)
  select model, operating_point, threshold, tn, fp, fn, tp, {RATIOS} from c"""


def decision(spark, sf):
    return rounded(plan.decision_curves(scored_orders(spark, sf)))


QUERIES["decision_curve"] = decision
ORACLES["decision_curve"] = f"""with {orders_scored_cte()}, grid as (select unnest(range(2, 61))::double / 200 as threshold),
  c as (select model, threshold, sum((y = 1 and p >= threshold)::int)::bigint as tp, sum((y = 0 and p >= threshold)::int)::bigint as fp,
    count(*) as n, avg(y) as pi from scored cross join grid group by model, threshold)
  select model, round(threshold, 6) as threshold, round(tp::double / n - fp::double / n * (threshold / (1 - threshold)), 6) as net_benefit_model,
    round(pi - (1 - pi) * (threshold / (1 - threshold)), 6) as net_benefit_treat_all, 0.0::double as net_benefit_treat_none, tp + fp as n_flagged from c"""


# --- bootstrap -----------------------------------------------------------------------------

REPS = 2000


def draws(spark, sf):
    rows = scored_orders_wide(spark, sf).select("row_id", "y")
    return bs.bootstrap_draws(rows, "y", "row_id", 10).groupBy("rep", "times").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("row_id").alias("keys")
    )


PRIME = 2147483647


def residues(seed: int, purpose: str, *keys: str) -> str:
    """h1 and h2 of a row."""
    parts = ", ".join([f"'{seed}'", f"'{purpose}'", *[f"({k})::varchar" for k in keys]])
    digest = f"md5(concat_ws('-', {parts}))"
    return ", ".join(f"('0x' || substring({digest}, {at}, 12))::bigint % {PRIME} as h{i}" for i, at in ((1, 1), (2, 13)))


def coefficients(seed: int, purpose: str, prefix: str) -> str:
    return ", ".join(f"{h(seed, purpose, f"'a{i}'", 'rep')} % {PRIME} as {prefix}{i}" for i in range(4))


def polynomial(prefix: str) -> str:
    c = [f"{prefix}{i}" for i in range(4)]
    return f"((({c[2]} * h1 + {c[1]}) % {PRIME} * h1 + {c[0]}) % {PRIME} + ({c[3]} * h2) % {PRIME}) % {PRIME}"


POISSON = " ".join(f"when v < {c!r}::double then {k}" for k, c in enumerate(bs.poisson_cuts()))
TIMES = f"case {POISSON} else {len(bs.poisson_cuts())} end"


def draws_cte(reps: int, rows: str = "wide", stratum: str = "y", row_id: str = "row_id") -> str:
    """``drawn``: Poisson counts, put right to the size of each stratum by draws added or taken back."""
    return f"""pos_ix as (select {row_id}, {stratum} as s, row_number() over (partition by {stratum} order by {h(42, 'boot-index', row_id)}, {row_id}) as idx,
      count(*) over (partition by {stratum}) as n from {rows}),
    reps as (select unnest(range(1, {reps + 1})) as rep),
    coefs as (select rep, {coefficients(42, 'poisson', 'a')}, {coefficients(42, 'boot-ball', 'b')} from reps),
    hashed as (select {row_id}, s, n, {residues(42, 'poisson', row_id)} from pos_ix),
    valued as (select {row_id}, s, n, h1, h2, rep, ({polynomial('a')}) / {PRIME}::double as v from hashed cross join coefs),
    first_times as (select {row_id}, s, n, h1, h2, rep, {TIMES} as times from valued),
    lacks as (select s, rep, (max(n) - sum(times))::bigint as lack, max(n) as n from first_times group by s, rep),
    added as (select s, {h(42, 'boot-add', 's', 'rep', 'd')} % n + 1 as idx, rep from lacks, unnest(range(1, lack + 1)) as x(d) where lack > 0),
    balls as (select {row_id}, s, rep, copy, lack, (h1 + copy * {bs.COPY}) % {PRIME} as h1, h2
      from first_times join lacks using (s, rep), unnest(range(1, times + 1)) as x(copy) where lack < 0),
    keyed as (select {row_id}, s, rep, copy, lack, {polynomial('b')} as k from balls join coefs using (rep)),
    taken as (select {row_id}, rep from keyed qualify row_number() over (partition by s, rep order by k, {row_id}, copy) <= -lack),
    drawn as (select {row_id}, rep, sum(times)::bigint as times from (select {row_id}, rep, times from first_times where times > 0
        union all select p.{row_id}, a.rep, 1 from added a join pos_ix p on p.s = a.s and p.idx = a.idx union all select {row_id}, rep, -1 from taken)
      group by {row_id}, rep having sum(times) > 0)"""


QUERIES["bootstrap_draws"] = draws
ORACLES["bootstrap_draws"] = f"""with {orders_wide_cte()}, {draws_cte(10)}
  select rep::int as rep, times, count(*) as rows, sum(row_id)::bigint as keys from drawn group by rep, times"""


def intervals(spark, sf):
    return rounded(bs.bootstrap_ci(scored_orders(spark, sf, ["pa", "pb"]), ["model"], n_resamples=REPS))


def replicate_sql(scored: str, weights: str, keys: str, metrics: list[str], alpha: float = 0.05) -> str:
    """Interval rows (keys, metric, ci_low, ci_high, se, n_resamples) of weighted replicates."""
    return f"""weighted as (select s.*, w.rep, w.times from {scored} s join {weights} w using (row_id)),
    {ladder_cte([*keys.split(', '), 'rep'], 'weighted', 'times', 'rl')},
    rm as (select {keys}, rep, {', '.join(f'{m_sql} as {m}' for m, m_sql in _plain(metrics).items())} from rl group by {keys}, rep),
    rv as ({' union all '.join(f"select {keys}, '{m}' as metric, {m} as value from rm" for m in metrics)}),
    ci as (select {keys}, metric, quantile_cont(value, {alpha / 2}) as ci_low, quantile_cont(value, {1 - alpha / 2}) as ci_high,
      stddev_samp(value) as se, count(*) as n_resamples from rv group by {keys}, metric),
    {ladder_cte(keys.split(', '), scored, None, 'whole')},
    wm as (select {keys}, {', '.join(f'{m_sql} as {m}' for m, m_sql in _plain(metrics).items())} from whole group by {keys}),
    est as ({' union all '.join(f"select {keys}, '{m}' as metric, {m} as estimate from wm" for m in metrics)})"""


def _plain(metrics: list[str]) -> dict[str, str]:
    from catalogue.shared import SQL_METRICS

    return {m: SQL_METRICS[m] for m in metrics}


CI_OUT = """round(estimate, 6) as estimate, round(ci_low, 6) as ci_low, round(ci_high, 6) as ci_high, round(se, 6) as se, n_resamples"""
QUERIES["bootstrap_intervals_exact"] = intervals
ORACLES["bootstrap_intervals_exact"] = f"""with {orders_scored_cte(['pa', 'pb'])}, {draws_cte(REPS)},
  {replicate_sql('scored', 'drawn', 'model', ['auroc', 'auprc', 'brier'])}
  select model, metric, {CI_OUT} from est join ci using (model, metric)"""


def custom_intervals(spark, sf):
    gap = {"mean_score_gap": lambda: F.sum(F.col("pos") * F.col("p")) / F.sum("pos") - F.sum(F.col("neg") * F.col("p")) / F.sum("neg")}
    return rounded(bs.bootstrap_ci(scored_orders(spark, sf, ["pa"]), ["model"], metrics=gap, n_resamples=200))


QUERIES["bootstrap_custom_metric"] = custom_intervals
ORACLES["bootstrap_custom_metric"] = f"""with {orders_scored_cte(['pa'])}, {draws_cte(200)},
  r as (select rep, sum(times * y * p) / sum(times * y) - sum(times * (1 - y) * p) / sum(times * (1 - y)) as value
    from scored join drawn using (row_id) group by rep),
  e as (select sum(y * p) / sum(y) - sum((1 - y) * p) / sum(1 - y) as estimate from scored),
  ci as (select quantile_cont(value, 0.025) as ci_low, quantile_cont(value, 0.975) as ci_high, stddev_samp(value) as se, count(*) as n_resamples from r)
  select 'pa' as model, 'mean_score_gap' as metric, round(estimate, 6) as estimate, round(ci_low, 6) as ci_low, round(ci_high, 6) as ci_high,
    round(se, 6) as se, n_resamples from e, ci"""


def plain_intervals(spark, sf):
    return rounded(bs.bootstrap_ci(scored_orders(spark, sf, ["pa"]), ["model"], metrics=["auroc"], n_resamples=REPS, stratified=False))


QUERIES["bootstrap_intervals_unstratified"] = plain_intervals
ORACLES["bootstrap_intervals_unstratified"] = f"""with {orders_scored_cte(['pa'])}, one as (select row_id, 0 as z from wide), {draws_cte(REPS, 'one', 'z')},
  {replicate_sql('scored', 'drawn', 'model', ['auroc'])} select model, metric, {CI_OUT} from est join ci using (model, metric)"""


def poisson_intervals(spark, sf):
    return rounded(bs.bootstrap_ci(scored_orders(spark, sf, ["pa", "pb"]), ["model"], n_resamples=REPS, mode="poisson"))


QUERIES["bootstrap_intervals_poisson"] = poisson_intervals
ORACLES["bootstrap_intervals_poisson"] = f"""with {orders_scored_cte(['pa', 'pb'])}, reps as (select unnest(range(1, {REPS + 1})) as rep),
  coefs as (select rep, {coefficients(42, 'poisson', 'a')} from reps), hashed as (select row_id, {residues(42, 'poisson', 'row_id')} from wide),
  pw as (select row_id, rep, ({polynomial('a')}) / {PRIME}::double as v from hashed cross join coefs),
  drawn as (select row_id, rep, {TIMES} as times from pw),
  hit as (select * from drawn where times > 0), {replicate_sql('scored', 'hit', 'model', ['auroc', 'auprc', 'brier'])}
  select model, metric, {CI_OUT} from est join ci using (model, metric)"""


OWN = {
    "mean_score_gap": bs.BlockMetric(
        lambda t: t["event_score"] / t["events"] - t["other_score"] / t["others"],
        terms={
            "event_score": lambda p, pos, neg: p @ pos, "events": lambda p, pos, neg: pos.sum(0),
            "other_score": lambda p, pos, neg: p @ neg, "others": lambda p, pos, neg: neg.sum(0),
        },
    ),
    "mean_events_above_others": bs.BlockMetric(  # a metric of ranks
        lambda t: t["above"] / t["others"],
        terms={"others": lambda p, pos, neg: neg.sum(0)},
        ranked={"above": lambda p, pos, neg, pos_above, neg_above: (neg * pos_above).sum(0)},
    ),
}


def own_intervals(mode):
    def run(spark, sf):
        return rounded(bs.bootstrap_ci(scored_orders(spark, sf, ["pa"]), ["model"], metrics=OWN, n_resamples=REPS, mode=mode), 5)

    return run


def _own_sql(drawn: str, name: str) -> str:
    return f"""with {orders_scored_cte(['pa'])}, {drawn},
  w as (select rep, times, y, p from scored join {name} using (row_id) union all select 0, 1, y, p from scored),
  g as (select rep, p, sum(times * y) as pos, sum(times * (1 - y)) as neg from w group by rep, p),
  r as (select *, sum(pos) over (partition by rep order by p desc rows unbounded preceding) - pos as above from g),
  m as (select rep, sum(pos * p) / sum(pos) - sum(neg * p) / sum(neg) as mean_score_gap, sum(neg * above)::double / sum(neg) as mean_events_above_others from r group by rep),
  v as (unpivot m on mean_score_gap, mean_events_above_others into name metric value value),
  ci as (select metric, quantile_cont(value, 0.025) as ci_low, quantile_cont(value, 0.975) as ci_high, stddev_samp(value) as se, count(*) as n_resamples
    from v where rep > 0 group by metric)
  select 'pa' as model, metric, round(value, 5) as estimate, round(ci_low, 5) as ci_low, round(ci_high, 5) as ci_high, round(se, 5) as se, n_resamples
  from ci join v using (metric) where rep = 0"""


def _poisson_cte(reps: int) -> str:
    return f"""reps as (select unnest(range(1, {reps + 1})) as rep),
  coefs as (select rep, {coefficients(42, 'poisson', 'a')} from reps), hashed as (select row_id, {residues(42, 'poisson', 'row_id')} from wide),
  pw as (select row_id, rep, ({polynomial('a')}) / {PRIME}::double as v from hashed cross join coefs),
  hit as (select * from (select row_id, rep, {TIMES} as times from pw) where times > 0)"""


for _mode, _drawn, _name in (("exact", draws_cte(REPS), "drawn"), ("poisson", _poisson_cte(REPS), "hit")):
    QUERIES[f"bootstrap_own_metrics_{_mode}"] = own_intervals(_mode)
    ORACLES[f"bootstrap_own_metrics_{_mode}"] = _own_sql(_drawn, _name)


def difference(metric):
    def run(spark, sf):
        return rounded(bs.bootstrap_difference(scored_orders(spark, sf, ["pa", "pb"]), "pa", "pb", metric, n_resamples=REPS))

    return run


def _difference_sql(metric: str) -> str:
    return f"""with {orders_scored_cte(['pa', 'pb'])}, {draws_cte(REPS)}, {replicate_sql('scored', 'drawn', 'model', [metric])},
  gap as (select rep, max({metric}) filter (where model = 'pa') - max({metric}) filter (where model = 'pb') as value from rm group by rep),
  b as (select quantile_cont(value, 0.025) as lo, quantile_cont(value, 0.975) as hi from gap),
  d as (select max(estimate) filter (where model = 'pa') - max(estimate) filter (where model = 'pb') as diff from est)
  select '{metric}' as metric, round(diff, 6) as difference, round(lo, 6) as ci_low, round(hi, 6) as ci_high, lo > 0 or hi < 0 as excludes_zero from d, b"""


for _metric in ("auprc", "brier"):
    QUERIES[f"bootstrap_difference_{_metric}"] = difference(_metric)
    ORACLES[f"bootstrap_difference_{_metric}"] = _difference_sql(_metric)


def cluster(spark, sf):
    rows = table(spark, sf, "orders")
    d = bs.cluster_draws(rows, "o_custkey", 10)
    return rows.join(d, "o_custkey").groupBy("rep").agg(F.sum("times").alias("rows"), F.sum(F.col("times") * F.col("o_orderkey")).alias("keys"))


QUERIES["bootstrap_cluster_draws"] = cluster
ORACLES["bootstrap_cluster_draws"] = f"""with e as (select distinct o_custkey, 0 as z from orders), {draws_cte(10, 'e', 'z', 'o_custkey')}
  select rep::int as rep, sum(times)::bigint as rows, sum(times * o_orderkey)::bigint as keys from orders join drawn using (o_custkey) group by rep"""


# --- inference ---------------------------------------------------------------------------


def ranks(spark, sf):
    return rounded(inf.midranks(line_ladder(spark, sf), ["model"]))


QUERIES["inference_midranks"] = ranks
ORACLES["inference_midranks"] = f"""with {LINES_CTE}, r as (select model, p, rank() over (partition by model order by p) as rk from scored)
  select model, round(p, 6) as p, round(max(rk) + (count(*) - 1) / 2.0::double, 6) as midrank from r group by model, p"""

DELONG = f"""{ladder_cte(['model'])},
  v as (select s.row_id, s.y, s.model, case when s.y = 1 then (neg_below + neg / 2.0::double) / neg_total
    else 1 - (pos_below + pos / 2.0::double) / pos_total end as v from scored s join ladder l on s.model = l.model and s.p = l.p),
  vw as (select row_id, y, max(v) filter (where model = 'pa') as pa, max(v) filter (where model = 'pb') as pb,
    max(v) filter (where model = 'pc') as pc from v group by row_id, y),
  pairs as (select 'pa' as model_a, 'pb' as model_b, y, pa as a, pb as b from vw union all select 'pa', 'pc', y, pa, pc from vw
    union all select 'pb', 'pc', y, pb, pc from vw),
  m as (select model_a, model_b, y, count(*) as n, avg(a) as ma, avg(b) as mb, var_samp(a) + var_samp(b) - 2 * covar_samp(a, b) as vd
    from pairs group by model_a, model_b, y),
  dl as (select model_a, model_b, max(ma) filter (where y = 1) as auc_a, max(mb) filter (where y = 1) as auc_b, sqrt(sum(vd / n)) as se
    from m group by model_a, model_b)"""


def delong(spark, sf):
    return rounded(inf.delong_test(scored_orders(spark, sf), ORDER_MODELS).drop("p_value"))


QUERIES["inference_delong"] = delong
ORACLES["inference_delong"] = f"""with {orders_scored_cte()}, {DELONG} select model_a, model_b, round(auc_a, 6) as auc_a, round(auc_b, 6) as auc_b,
  round(auc_a - auc_b, 6) as difference, round(se, 6) as se, round((auc_a - auc_b) / se, 6) as z,
  round(auc_a - auc_b - 1.96 * se, 6) as ci_low, round(auc_a - auc_b + 1.96 * se, 6) as ci_high from dl"""


def comparisons(spark, sf):
    return rounded(inf.compare_models(scored_orders(spark, sf), ORDER_MODELS, ("pb", "pa")))


# erfc(|z| / sqrt(2)) by Simpson's rule over 400 steps of the normal density
NORMAL_P = """greatest(0, 1 - 2 * abs(z) / 1200 / sqrt(2 * pi()) * list_sum(list_transform(range(0, 401),
    lambda i: case when i = 0 or i = 400 then 1 when i % 2 = 1 then 4 else 2 end * exp(-pow(z * i / 400, 2) / 2))))"""
QUERIES["inference_model_comparisons"] = comparisons
ORACLES["inference_model_comparisons"] = f"""with {orders_scored_cte()}, {DELONG},
  turned as (select model_a = 'pa' and model_b = 'pb' as flip, * from dl),
  t as (select case when flip then 'pb' else model_a end as model_a, case when flip then 'pa' else model_b end as model_b, case when flip then auc_b else auc_a end as auc_a,
    case when flip then auc_a else auc_b end as auc_b, se, case when flip then 'primary' else 'secondary' end as type from turned),
  d as (select *, auc_a - auc_b as difference, (auc_a - auc_b) / se as z, model_a || ' vs ' || model_b as comparison from t),
  p as (select *, {NORMAL_P} as p_value from d),
  r as (select *, row_number() over (partition by type order by p_value, comparison) as rn, count(*) over (partition by type) as m from p)
  select model_a, model_b, round(auc_a, 6) as auc_a, round(auc_b, 6) as auc_b, round(difference, 6) as difference, round(se, 6) as se, round(z, 6) as z,
    round(difference - 1.96 * se, 6) as ci_low, round(difference + 1.96 * se, 6) as ci_high, round(p_value, 6) as p_value, comparison, type,
    round(least(1, max((m - rn + 1) * p_value) over (partition by type order by p_value, comparison rows unbounded preceding)), 6) as p_adjusted from r"""


def mcnemar(spark, sf):
    return rounded(inf.mcnemar_counts(scored_orders_wide(spark, sf), F.col("pa"), F.col("pb"), 0.45, 0.4))


QUERIES["inference_mcnemar"] = mcnemar
ORACLES["inference_mcnemar"] = f"""with {orders_wide_cte()}, r as (select ((pa >= 0.45::double)::int = y) as a, ((pb >= 0.4::double)::int = y) as b from wide),
  n as (select sum((a and not b)::int)::bigint as n01, sum((not a and b)::int)::bigint as n10 from r)
  select n01, n10, round(coalesce(pow(abs(n01 - n10) - 1, 2) / nullif(n01 + n10, 0), 0), 6) as statistic from n"""


def mcnemar_p(spark, sf):
    wide = scored_orders_wide(spark, sf)
    return rounded(inf.mcnemar_test(wide, F.col("pa"), F.col("pb"), 0.45, 0.4))


QUERIES["inference_mcnemar_exact_p"] = mcnemar_p
ORACLES["inference_mcnemar_exact_p"] = f"""with {orders_wide_cte()}, r as (select ((pa >= 0.45::double)::int = y) as a, ((pb >= 0.4::double)::int = y) as b from wide),
  n as (select sum((a and not b)::int)::bigint as n01, sum((not a and b)::int)::bigint as n10 from r),
  t as (select n01, n10, n01 + n10 as n, unnest(range(0, least(n01, n10) + 1)) as k from n),
  tail as (select sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2))) as half from t where n > 0)
  select n01, n10, round(coalesce(pow(abs(n01 - n10) - 1, 2) / nullif(n01 + n10, 0), 0), 6) as statistic,
    round(least(1, 2 * coalesce(half, 0.5)), 6) as p_value from n, tail"""


def holm(spark, sf):
    tests = scored_orders_wide(spark, sf).select("row_id", F.concat_ws("-", "status", "yr").alias("family"), (F.col("pc") / 20).alias("p"))
    return rounded(inf.holm(tests, "p", "row_id", ["family"], buckets=8))


QUERIES["inference_holm"] = holm
ORACLES["inference_holm"] = f"""with {orders_wide_cte()}, t as (select row_id, status || '-' || yr as family, pc / 20 as p from wide),
  r as (select *, row_number() over (partition by family order by p, row_id) as rn, count(*) over (partition by family) as m from t)
  select row_id, family, round(p, 6) as p,
    round(least(1, max((m - rn + 1) * p) over (partition by family order by p, row_id rows between unbounded preceding and current row)), 6) as p_adjusted from r"""


# --- bundles ---------------------------------------------------------------------------------


def performance(spark, sf):
    return rounded(plan.performance_table(scored_orders(spark, sf, ["pa", "pb"]), n_resamples=REPS), 5)


_PARTS = [
    f"round(max(case when metric = '{m}' then {c} end), 5) as {m if c == 'estimate' else f'{m}_{c}'}"
    for m in ("auroc", "auprc", "brier")
    for c in ("estimate", "ci_low", "ci_high", "se")
]
QUERIES["performance_table"] = performance
ORACLES["performance_table"] = f"""with recursive {orders_scored_cte(['pa', 'pb'])}, {draws_cte(REPS)},
  {replicate_sql('scored', 'drawn', 'model', ['auroc', 'auprc', 'brier'])}, {ladder_cte(['model'])}, {fits_cte(['model'], 'ladder')}, {lowess_cte()},
  wide_ci as (select model, {', '.join(_PARTS)} from est join ci using (model, metric) group by model),
  disc as (select model, {metrics_sql(['auprc_baseline', 'log_loss', 'brier_scaled']).replace(', 6)', ', 5)')} from ladder group by model)
  select wide_ci.*, auprc_baseline, log_loss, brier_scaled, round(calibration_slope, 5) as calibration_slope, round(calibration_intercept, 5) as calibration_intercept,
    round(ici, 5) as ici from wide_ci join disc using (model) join fits using (model) join ici using (model)"""


def best(spark, sf):
    return rounded(plan.best_model(di.ladder_metrics(order_ladder(spark, sf), ["model"], ["auroc"])))


QUERIES["best_model"] = best
ORACLES["best_model"] = f"""with {ORDERS}, m as (select model, {metrics_sql(['auroc'])} from ladder group by model)
  select arg_max(model, auroc) as best_model, max(auroc) as auroc from m"""

# --- subgroups -----------------------------------------------------------------------------------

ATTRIBUTES = ["status", "yr", "rare"]


def _attributed(spark, sf):
    rare = F.when(F.col("row_id") % 100 == 0, "few").otherwise("many")
    return scored_orders(spark, sf, ["pa", "pb"]).withColumn("rare", rare)


def audit(spark, sf):
    cuts = th.select_thresholds(order_ladder(spark, sf, ["pa", "pb"]), ["model"]).select("model", F.col("capacity").alias("threshold"))
    return sg.subgroup_audit(_attributed(spark, sf), ATTRIBUTES, cuts)


GROUPED = """grouped as (select model, row_id, y, p, 'status' as attribute, status as level from scored union all select model, row_id, y, p, 'yr', yr from scored
    union all select model, row_id, y, p, 'rare', case when row_id % 100 = 0 then 'few' else 'many' end from scored)"""
G = ["model", "attribute", "level"]
QUERIES["subgroup_audit"] = audit
ORACLES["subgroup_audit"] = f"""with recursive {orders_scored_cte(['pa', 'pb'])}, {GROUPED}, {ladder_cte(G, 'grouped')},
  sizes as (select model, attribute, level, sum(pos + neg)::bigint as n, sum(pos)::bigint as events from ladder group by model, attribute, level),
  ok as (select * from sizes where n >= 200 and events >= 20 and events < n),
  judged as (select l.* from ladder l join ok using (model, attribute, level)),
  m as (select model, attribute, level, {', '.join(f'{s} as {k}' for k, s in _plain(['auroc', 'auprc', 'brier']).items())} from judged group by model, attribute, level),
  {fits_cte(G, 'judged')},
  cut as (select model, quantile_cont(p, 0.9) as threshold from scored group by model),
  c as (select model, attribute, level, {COUNTS} from grouped join cut using (model) group by model, attribute, level),
  o as (select model, {COUNTS} from scored join cut using (model) group by model)
  select sizes.model, sizes.attribute, sizes.level, sizes.n, sizes.events, round(sizes.events::double / sizes.n, 4) as prevalence, m.auroc is not null as estimable,
    round(m.auroc, 4) as auroc, round(auprc, 4) as auprc, round(calibration_slope, 3) as calibration_slope, round(calibration_intercept, 3) as calibration_intercept,
    round(brier, 4) as brier, case when m.auroc is not null then round(c.tp::double / nullif(c.tp + c.fn, 0), 4) end as sensitivity,
    case when m.auroc is not null then round(c.tp::double / nullif(c.tp + c.fp, 0), 4) end as ppv,
    case when m.auroc is not null then round((c.tp + c.fp)::double / sizes.n, 4) end as alert_rate,
    case when m.auroc is not null then round(c.tp::double / nullif(c.tp + c.fn, 0) - o.tp::double / nullif(o.tp + o.fn, 0), 4) end as equal_opportunity_difference
  from sizes left join m using (model, attribute, level) left join fits using (model, attribute, level) join c using (model, attribute, level) join o using (model)"""


def subgroup_ci(spark, sf):
    scored = _attributed(spark, sf).where(F.col("model") == "pa")
    return rounded(sg.subgroup_intervals(scored, ["status", "rare"], n_resamples=20, wide_above=0.035))


QUERIES["subgroup_intervals"] = subgroup_ci
ORACLES["subgroup_intervals"] = f"""with {orders_scored_cte(['pa'])}, {GROUPED.replace("union all select model, row_id, y, p, 'yr', yr from scored", "")},
  sizes as (select model, attribute, level, count(*) as n, sum(y)::bigint as events from grouped group by model, attribute, level),
  judged as (select model, attribute, level, y, p, attribute || '|' || level || '|' || row_id as row_id, attribute || '|' || level || '|' || y as z
    from grouped join (select * from sizes where n >= 200 and events >= 20 and events < n) using (model, attribute, level)),
  {draws_cte(20, 'judged', 'z')}, {replicate_sql('judged', 'drawn', 'model, attribute, level', ['auroc'])}
  select model, attribute, level, sizes.n, sizes.events, estimate is not null as estimable, round(estimate, 6) as auroc, round(ci_low, 6) as ci_low,
    round(ci_high, 6) as ci_high, round(ci_high - ci_low, 6) as ci_width,
    case when estimate is null then 'not estimable' when ci_high - ci_low <= 0.035 then 'adequate' else 'imprecise' end as precision_tier
  from sizes left join est using (model, attribute, level) left join ci using (model, attribute, level)"""


def subgroup_ci_all(spark, sf):
    """Both models and all attributes with the operator's own number of resamples."""
    return rounded(sg.subgroup_intervals(_attributed(spark, sf), ATTRIBUTES))


QUERIES["subgroup_intervals_all"] = subgroup_ci_all
ORACLES["subgroup_intervals_all"] = f"""with {orders_scored_cte(['pa', 'pb'])}, {GROUPED},
  sizes as (select model, attribute, level, count(*) as n, sum(y)::bigint as events from grouped group by model, attribute, level),
  judged as (select model, attribute, level, y, p, attribute || '|' || level || '|' || row_id as row_id, attribute || '|' || level || '|' || y as z
    from grouped join (select * from sizes where n >= 200 and events >= 20 and events < n) using (model, attribute, level)),
  cells as (select distinct row_id, z from judged), {draws_cte(2000, 'cells', 'z')}, {replicate_sql('judged', 'drawn', 'model, attribute, level', ['auroc'])}
  select model, attribute, level, sizes.n, sizes.events, estimate is not null as estimable, round(estimate, 6) as auroc, round(ci_low, 6) as ci_low,
    round(ci_high, 6) as ci_high, round(ci_high - ci_low, 6) as ci_width,
    case when estimate is null then 'not estimable' when ci_high - ci_low <= 0.1 then 'adequate' else 'imprecise' end as precision_tier
  from sizes left join est using (model, attribute, level) left join ci using (model, attribute, level)"""
