"""Importance measures and sensitivity arms."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from catalogue.evaluation import CI_OUT, REPS, draws_cte, replicate_sql
from catalogue.modelling import ROLES, SMALL
from catalogue.sampling import SPLIT_CTE, split_orders, target_orders
from catalogue.shared import h, ladder_cte, metrics_sql, orders_scored_cte, rounded, scored_orders, table, u
from catalogue.sources import COEFS, LINEAR_SHAP_CTE, SLOTS
from veritally.functions.hashing import key_uniform
from veritally.operators import explain as ex
from veritally.operators import sensitivity as se
from veritally.operators.bounded import stored
from veritally.operators.encoding import drop_helpers, parent_features
from veritally.operators.inference import auc_variances
from veritally.operators.ladder import score_ladder
from veritally.operators.models import fit_model
from veritally.operators.pooling import pooled

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def sampled(spark, sf):
    return ex.sample_rows(table(spark, sf, "orders"), "o_orderkey", 500).select("o_orderkey")


QUERIES["explain_row_sample"] = sampled
ORACLES["explain_row_sample"] = f"select o_orderkey from orders order by {h(42, 'sample', 'o_orderkey')}, o_orderkey limit 500"

PARENTS = ["p_type", "p", "p_brand", "p_name"]


def parents(spark, sf):
    df = table(spark, sf, "part")
    names = df.select(F.concat(F.lit("cat__p_type_"), "p_type").alias("encoded_feature")).unionByName(
        df.select(F.concat(F.lit("cat__p_brand_"), "p_brand").alias("encoded_feature"))
    ).unionByName(df.select(F.concat(F.lit("cat__p_"), "p_name").alias("encoded_feature"))).unionByName(
        df.select(F.lit("num__p_size").alias("encoded_feature"))
    ).unionByName(df.select(F.lit("num__other").alias("encoded_feature")))
    return parent_features(names, PARENTS).groupBy("encoded_feature", "feature").agg(F.count(F.lit(1)).alias("n"))


QUERIES["explain_parent_feature"] = parents
ORACLES["explain_parent_feature"] = """with n as (select 'cat__p_type_' || p_type as e from part union all select 'cat__p_brand_' || p_brand from part
    union all select 'cat__p_' || p_name from part union all select 'num__p_size' from part union all select 'num__other' from part),
  b as (select e, regexp_replace(e, '^.*?__', '') as bare from n),
  k as (select unnest(['p_type', 'p', 'p_brand', 'p_name']) as c),
  m as (select distinct e, bare from b),
  f as (select e, arg_max(c, length(c)) as c from m join k on bare = c or starts_with(bare, c || '_') group by e)
  select e as encoded_feature, coalesce(max(f.c), max(bare)) as feature, count(*) as n from b left join f using (e) group by e"""


def shap_linear(spark, sf):
    phis = ex.linear_shap(table(spark, sf, "embeddings"), "vec_id", "embedding", COEFS)
    # Slots e0..e63 are named after their first digit, so that several share a parent.
    names = [f"cat__g{s[1]}_{s}" for s in SLOTS]
    return rounded(ex.mean_abs_shap(phis, names, [f"g{i}" for i in range(10)]))


QUERIES["explain_linear_shap"] = shap_linear
ORACLES["explain_linear_shap"] = f"""with {LINEAR_SHAP_CTE}, s as (select feature as slot, avg(abs(phi)) as v from phis group by feature),
  g as (select 'g' || substring(slot, 2, 1) as feature, sum(v) as v from s group by 1)
  select feature, round(v, 6) as mean_abs_shap, (row_number() over (order by v desc, feature))::int as rank_shap from g"""


def _forest(spark, sf, key):
    df = target_orders(spark, sf)
    return df, fit_model(key, df, ROLES, "target", SMALL[key])


def shap_tree(key: str):
    def run(spark, sf):
        df, model = _forest(spark, sf, key)
        encoded = drop_helpers(model.encoding.transform(df)).select("o_orderkey", "features")
        phis = ex.tree_shap(encoded, "o_orderkey", model.classifier)
        return rounded(ex.mean_abs_shap(phis, model.encoding.names, ROLES.features))

    return run


def shap_adds_up(key: str):
    """Whether the attributions of each row and the base add up to the model's output for that row."""

    def run(spark, sf):
        df, model = _forest(spark, sf, key)
        encoded = drop_helpers(model.encoding.transform(df)).select("o_orderkey", "features")
        phis = ex.tree_shap(encoded, "o_orderkey", model.classifier)
        raw = "rawPrediction" if key == "boosted_depthwise" else "probability"
        out = vector_to_array(raw)[1].alias("raw")
        told = model.classifier.transform(encoded).select("o_orderkey", out)
        total = F.col("base") + F.aggregate("phi", F.lit(0.0), lambda t, x: t + x)
        return phis.join(told, "o_orderkey").select("o_orderkey", (F.abs(total - F.col("raw")) < 1e-6).alias("adds_up"))

    return run


for _key, _name in (("boosted_depthwise", "boosted"), ("random_forest", "forest")):
    QUERIES[f"explain_tree_shap_{_name}_adds_up"] = shap_adds_up(_key)
    ORACLES[f"explain_tree_shap_{_name}_adds_up"] = "select o_orderkey, true as adds_up from orders"

QUERIES["explain_tree_shap_boosted"] = shap_tree("boosted_depthwise")
QUERIES["explain_tree_shap_forest"] = shap_tree("random_forest")


def gain(spark, sf):
    _, model = _forest(spark, sf, "boosted_depthwise")
    return rounded(ex.gain_importance(model.classifier, model.encoding.names, ROLES.features, spark))


QUERIES["explain_gain_importance"] = gain

FORMULA = ["price", "recent"]


def _formula_rows(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(
        "o_orderkey",
        (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("target"),
        F.col("o_totalprice").alias("price"),
        (F.year("o_orderdate") - 1990 + 3 * (F.col("o_orderpriority") == "1-URGENT").cast("int")).alias("recent"),
    )


def _formula(df):
    return df.withColumn("p", F.col("price") / 1000000.0 + F.col("recent") / 20.0)


def permutation(spark, sf):
    return rounded(ex.permutation_importance(_formula_rows(spark, sf), "o_orderkey", "target", FORMULA, _formula))


QUERIES["explain_permutation_importance"] = permutation
ORACLES["explain_permutation_importance"] = f"""with d as (select o_orderkey, (o_orderpriority = '1-URGENT')::int as y, o_totalprice as price,
    year(o_orderdate) - 1990 + 3 * (o_orderpriority = '1-URGENT')::int as recent from orders),
  b as (select *, row_number() over (order by {h(42, 'permutation-base', 'o_orderkey')}, o_orderkey) as idx from d),
  k as (select f as feature, r as rep from (select unnest(['price', 'recent']) as f), (select unnest(range(10)) as r)),
  g as (select rep, price as gp, recent as gr, row_number() over (partition by rep
    order by {h(42, 'permutation', 'rep', 'o_orderkey')}, o_orderkey) as idx from d cross join (select distinct rep from k)),
  s as (select k.feature, k.rep, y, (case when k.feature = 'price' then gp else price end) / 1000000.0::double
    + (case when k.feature = 'recent' then gr else recent end) / 20.0::double as p from b join g using (idx) join k using (rep)),
  {ladder_cte(['feature', 'rep'], 's')},
  a as (select feature, rep, {metrics_sql(['auroc']).replace('round(', '(').replace(', 6)', ')')} from ladder group by feature, rep),
  w as (select y, price / 1000000.0::double + recent / 20.0::double as p from d), {ladder_cte([], 'w', None, 'wl')},
  t as (select {metrics_sql(['auroc']).replace('round(', '(').replace(', 6)', ')')} from wl),
  i as (select feature, avg(t.auroc - a.auroc) as m, stddev_pop(t.auroc - a.auroc) as sd from a, t group by feature)
  select feature, round(m, 6) as permutation_importance, round(sd, 6) as permutation_sd,
    (row_number() over (order by m desc, feature))::int as rank_permutation from i"""


def _rank_tables(spark, sf):
    """Three rankings of brands by different measures, each missing some brands."""
    part = table(spark, sf, "part")
    base = part.groupBy(F.col("p_brand").alias("feature")).agg(
        F.sum("p_retailprice").alias("a"), F.avg("p_size").alias("b"), F.count(F.lit(1)).alias("c")
    )
    parts = {"shap": ("a", "Brand#1"), "permutation": ("b", "Brand#2"), "gain": ("c", "Brand#3")}
    return {n: ex.ranked(base.where(F.col("feature") != gone), by, f"rank_{n}") for n, (by, gone) in parts.items()}


RANK_CTE = """base as (select p_brand as feature, sum(p_retailprice) as a, avg(p_size) as b, count(*) as c from part group by p_brand),
  r1 as (select feature, row_number() over (order by a desc, feature) as rank_shap from base where feature <> 'Brand#1'),
  r2 as (select feature, row_number() over (order by b desc, feature) as rank_permutation from base where feature <> 'Brand#2'),
  r3 as (select feature, row_number() over (order by c desc, feature) as rank_gain from base where feature <> 'Brand#3'),
  compared as (select feature, rank_shap::int as rank_shap, rank_permutation::int as rank_permutation, rank_gain::int as rank_gain,
    (greatest(rank_shap, rank_permutation, rank_gain) - least(rank_shap, rank_permutation, rank_gain))::int as rank_disagreement
    from r1 full join r2 using (feature) full join r3 using (feature))"""


def compared(spark, sf):
    return ex.compare_ranks(_rank_tables(spark, sf))


QUERIES["explain_rank_comparison"] = compared
ORACLES["explain_rank_comparison"] = f"with {RANK_CTE} select * from compared"


def top(spark, sf):
    return ex.top_ranked(compared(spark, sf), "rank_permutation", 10)


QUERIES["explain_top_features"] = top
ORACLES["explain_top_features"] = f"with {RANK_CTE} select * from compared order by rank_permutation nulls last, feature limit 10"


# --- sensitivity -----------------------------------------------------------------------------


def _arm_split(spark, sf):
    status = F.when(F.col("o_orderkey") % 3 == 0, "Unknown").otherwise(F.col("o_orderstatus"))
    s = stored(split_orders(spark, sf).withColumn("o_orderstatus", status))
    return s.where("split = 'development'"), s.where("split = 'holdout'")


def imbalance(spark, sf):
    dev, hold = _arm_split(spark, sf)
    arms = [se.Arm("imbalance", a, a) for a in ("none", "class_weight", "smote", "undersample")]
    return se.arm_table(se.score_arms(arms, "boosted_depthwise", dev, hold, ROLES, "target", "o_orderkey"))


QUERIES["sensitivity_imbalance_arms"] = imbalance


def smote_arm(spark, sf):
    dev, hold = _arm_split(spark, sf)
    arms = [se.Arm("imbalance", a, a) for a in ("none", "smote")]
    scored = se.score_arms(arms, "parsimonious_lr", dev, hold, ROLES, "target", "o_orderkey")
    return rounded(se.imbalance_contrast(se.arm_table(scored, with_ici=False)))


QUERIES["sensitivity_smote_contrast"] = smote_arm


def ablation(spark, sf):
    dev, hold = _arm_split(spark, sf)
    arms = [se.Arm("status", "included"), se.Arm("status", "excluded", drop=["o_orderstatus"])]
    return se.arm_table(se.score_arms(arms, "parsimonious_lr", dev, hold, ROLES, "target", "o_orderkey"), with_ici=False)


QUERIES["sensitivity_ablation_arms"] = ablation


def missing_arms(spark, sf):
    dev, hold = _arm_split(spark, sf)
    arms = [se.Arm("missing_data", "explicit_category"), se.Arm("missing_data", "complete_case", complete_case=["o_orderstatus"])]
    scored = se.score_arms(arms, "parsimonious_lr", dev, hold, ROLES, "target", "o_orderkey")
    return scored.groupBy("arm").agg(F.max("n_development").alias("n_development"), F.max("n_holdout").alias("n_holdout"), F.count("p").alias("scored"))


QUERIES["sensitivity_missing_data_arms"] = missing_arms
ORACLES["sensitivity_missing_data_arms"] = f"""with {SPLIT_CTE},
  arms as (select 'explicit_category' as arm, split, target from split
    union all select 'complete_case', split, target from split where o_orderkey % 3 <> 0),
  n as (select arm, sum((split = 'development')::int)::bigint as n_development, sum((split = 'holdout')::int)::bigint as n_holdout,
    count(distinct target) filter (where split = 'holdout') as classes from arms group by arm)
  select arm, n_development, n_holdout, case when n_holdout >= 200 and classes = 2 then n_holdout else 0 end::bigint as scored from n"""


def arm_metrics(spark, sf):
    scored = scored_orders(spark, sf).select(
        F.lit("model").alias("analysis"), F.col("model").alias("arm"), "y", "p",
        F.lit(None).cast("bigint").alias("n_development"), F.lit(None).cast("bigint").alias("n_holdout"),
    )
    names = ["analysis", "arm", "auroc", "auprc", "auprc_baseline", "log_loss", "mean_predicted_risk", "brier", "brier_scaled"]
    return se.arm_table(scored, with_ici=False).select(*names)


QUERIES["sensitivity_arm_table"] = arm_metrics
ORACLES["sensitivity_arm_table"] = f"""with {orders_scored_cte()}, {ladder_cte(['model'])} select 'model' as analysis, model as arm,
  {metrics_sql(['auroc', 'auprc', 'auprc_baseline', 'log_loss', 'mean_predicted_risk', 'brier', 'brier_scaled']).replace(', 6)', ', 4)')} from ladder group by model"""


# --- arms over every record, and over imputed tables ---------------------------------------------


def _with_customer(spark, sf):
    owner = table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), "o_custkey")
    return scored_orders(spark, sf, ["pa"]).join(owner, "row_id")


def records_intervals(spark, sf):
    return rounded(se.all_records_intervals(_with_customer(spark, sf), "row_id", "o_custkey", n_resamples=REPS))


QUERIES["sensitivity_all_records_intervals"] = records_intervals
ORACLES["sensitivity_all_records_intervals"] = f"""with {orders_scored_cte(['pa'])}, e as (select distinct o_custkey, 0 as z from orders), {draws_cte(REPS, 'e', 'z', 'o_custkey')},
  owned as (select s.*, o.o_custkey from scored s join orders o on o.o_orderkey = s.row_id),
  row_draws as (select row_id, rep, times from owned join drawn using (o_custkey)), {replicate_sql('scored', 'row_draws', 'model', ['auroc', 'auprc', 'brier'])}
  select 'cohort' as analysis, 'all_records' as arm, model, metric, {CI_OUT}, (select count(*) from orders) as n_rows, (select count(distinct o_custkey) from orders) as n_entities
  from est join ci using (model, metric)"""


def records_arm(spark, sf):
    orders = table(spark, sf, "orders").withColumn("target", (F.col("o_orderpriority") == "1-URGENT").cast("int"))
    return rounded(se.all_records_arm("parsimonious_lr", orders, ROLES, "target", "o_orderkey", "o_custkey"))


QUERIES["sensitivity_all_records_arm"] = records_arm


def pooled_draws(spark, sf):
    """Five tables in which the scores of every tenth row are drawn."""
    drawn = scored_orders(spark, sf, ["pa", "pb"]).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(5))))
    more = F.when(F.col("row_id") % 10 == 0, 0.3 * key_uniform(42, "filled", "draw", "row_id")).otherwise(0.0)
    ladder = score_ladder(drawn.withColumn("p", F.col("p") + more), ["model", "draw"])
    return rounded(pooled(auc_variances(ladder, ["model", "draw"]).withColumnRenamed("auroc", "estimate"), ["model"]))


QUERIES["imputation_pooled"] = pooled_draws
ORACLES["imputation_pooled"] = f"""with {orders_scored_cte(['pa', 'pb'])},
  filled as (select model, draw, y, p + case when row_id % 10 = 0 then 0.3::double * {u(42, 'filled', 'draw', 'row_id')} else 0 end as p
    from scored, unnest(range(1, 6)) as x(draw)), {ladder_cte(['model', 'draw'], 'filled')},
  placed as (select model, draw, pos, neg, (neg_below + neg::double / 2) / neg_total as won, 1 - (pos_below + pos::double / 2) / pos_total as lost from ladder),
  m as (select *, sum(pos * won) over w / sum(pos) over w as mw, sum(neg * lost) over w / sum(neg) over w as ml from placed window w as (partition by model, draw)),
  each as (select model, draw, max(mw) as q, sum(pos * (won - mw) * (won - mw)) / (sum(pos) - 1) / sum(pos) + sum(neg * (lost - ml) * (lost - ml)) / (sum(neg) - 1) / sum(neg) as v
    from m group by model, draw),
  pool as (select model, count(*) as draws, avg(q) as estimate, avg(v) as within, var_samp(q) as between from each group by model),
  t as (select *, within + (1 + 1.0::double / draws) * between as total, (1 + 1.0::double / draws) * between as extra from pool),
  f as (select *, (draws - 1) / pow(extra / total, 2) as df, 1.959963984540054::double as z from t),
  h as (select *, sqrt(total) * (z + (pow(z, 3) + z) / 4 / df + (5 * pow(z, 5) + 16 * pow(z, 3) + 3 * z) / 96 / pow(df, 2)
    + (3 * pow(z, 7) + 19 * pow(z, 5) + 17 * pow(z, 3) - 15 * z) / 384 / pow(df, 3)) as half from f)
  select model, draws, round(estimate, 6) as estimate, round(within, 6) as within, round(between, 6) as between, round(sqrt(total), 6) as se, round(df, 6) as df,
    round(extra / total, 6) as missing_share, round(estimate - half, 6) as ci_low, round(estimate + half, 6) as ci_high from h"""


def imputation_arm(spark, sf):
    dev, hold = _arm_split(spark, sf)
    return rounded(se.imputed_arm("parsimonious_lr", dev, hold, ROLES, "target", "o_orderkey", "o_orderstatus", ["o_totalprice", "o_custkey"]))


QUERIES["sensitivity_imputation_arm"] = imputation_arm
