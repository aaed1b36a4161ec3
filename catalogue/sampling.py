"""Split, folds, encoding, weights and resampling."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from catalogue.shared import h, rounded, table, u
from veritally.operators import split as sp
from veritally.operators.encoding import fit_encoding
from veritally.operators.neighbours import nearest_neighbours
from veritally.operators.resampling import class_weights, smote, undersample
from veritally.operators.row_index import stratified_index
from veritally.operators.split import ColumnRoles

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def target_orders(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice",
        (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("target"),
    )


TARGET_CTE = "t as (select *, (o_orderpriority = '1-URGENT')::int as target from orders)"


def indexed(spark, sf):
    return stratified_index(target_orders(spark, sf), ["target"], "o_orderkey", 42, "index").select("o_orderkey", "target", "idx", "stratum_n")


QUERIES["sampling_row_index"] = indexed
ORACLES["sampling_row_index"] = f"""with {TARGET_CTE} select o_orderkey, target,
  row_number() over (partition by target order by {h(42, 'index', 'o_orderkey')}, o_orderkey) as idx,
  count(*) over (partition by target) as stratum_n from t"""


def split_orders(spark, sf):
    return sp.stratified_split(target_orders(spark, sf), "target", "o_orderkey", 0.2, 42)


SPLIT_CTE = f"""{TARGET_CTE}, sizes as (select target, count(*) as n, sum(count(*)) over () as total from t group by target),
  quota as (select *, total - ceil(0.2::double * total) as dev, n * (total - ceil(0.2::double * total)) / total as share from sizes),
  alloc as (select target, floor(share) + (row_number() over (order by share - floor(share) desc, target)
    <= dev - sum(floor(share)) over ())::int as n_dev from quota),
  split as (select t.*, case when row_number() over (partition by t.target order by {h(42, 'split', 'o_orderkey')}, o_orderkey) <= n_dev
    then 'development' else 'holdout' end as split from t join alloc using (target))"""


def split_rows(spark, sf):
    return split_orders(spark, sf).select("o_orderkey", "target", "split")


QUERIES["sampling_stratified_split"] = split_rows
ORACLES["sampling_stratified_split"] = f"with {SPLIT_CTE} select o_orderkey, target, split from split"


def folds(spark, sf):
    return sp.stratified_folds(target_orders(spark, sf), "target", "o_orderkey", 5, 2).select("o_orderkey", "repeat", "fold")


FOLD_CTE = f"""{TARGET_CTE}, r as (select * from t cross join (select unnest([0, 1]) as repeat)),
  folds as (select *, ((row_number() over (partition by repeat, target order by {h(42, 'fold', 'repeat', 'o_orderkey')}, o_orderkey) - 1) % 5)::int as fold from r)"""
QUERIES["sampling_repeated_folds"] = folds
ORACLES["sampling_repeated_folds"] = f"with {FOLD_CTE} select o_orderkey, repeat, fold from folds"


def first_fold(spark, sf):
    folded = sp.stratified_folds(target_orders(spark, sf), "target", "o_orderkey", 5, 2)
    return sp.first_training_fold(folded).groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


QUERIES["sampling_first_training_fold"] = first_fold
ORACLES["sampling_first_training_fold"] = f"""with {FOLD_CTE} select target, count(*) as n, sum(o_orderkey)::bigint as keys
  from folds where repeat = 0 and fold <> 0 group by target"""


def entity_folds(spark, sf):
    return sp.grouped_folds(table(spark, sf, "orders"), "o_custkey", 5).select("o_orderkey", "fold")


QUERIES["sampling_entity_folds"] = entity_folds
ORACLES["sampling_entity_folds"] = f"select o_orderkey, ({h(42, 'group-fold', 'o_custkey')} % 5)::int as fold from orders"


def roles(spark, sf):
    df = table(spark, sf, "lineitem").select(
        "l_quantity", "l_tax", (F.col("l_quantity") > 25).cast("int").alias("big"), "l_returnflag", "l_linestatus"
    )
    found = sp.column_roles(df, [])
    counts = sp.distinct_counts(df, df.columns)
    kind = F.when(F.col("variable").isin(found.continuous), "continuous").otherwise("categorical")
    return counts.withColumn("role", kind).withColumn("parameters", F.lit(found.n_parameters))


QUERIES["sampling_column_roles"] = roles
ORACLES["sampling_column_roles"] = """with c as (
    select 'l_quantity' as variable, count(distinct l_quantity) as n_distinct, true as num from lineitem
    union all select 'l_tax', count(distinct l_tax), true from lineitem
    union all select 'big', count(distinct l_quantity > 25), true from lineitem
    union all select 'l_returnflag', count(distinct l_returnflag), false from lineitem
    union all select 'l_linestatus', count(distinct l_linestatus), false from lineitem),
  r as (select variable, n_distinct, case when num and n_distinct > 2 then 'continuous' else 'categorical' end as role from c)
  select *, (select sum(case when role = 'continuous' then 1 else greatest(n_distinct - 1, 1) end) from r)::int as parameters from r"""


def _slot_sums(spark, sf, scale, drop_first):
    df = target_orders(spark, sf)
    used = ColumnRoles(["o_totalprice"], ["o_orderstatus", "o_orderpriority"], {"o_totalprice": 9, "o_orderstatus": 3, "o_orderpriority": 5})
    train = df.where(F.col("o_orderpriority") != "5-LOW")
    enc = fit_encoding(train, used, scale=scale, drop_first=drop_first)
    rows = enc.transform(df)
    if scale:
        first = vector_to_array("features")[0].alias("scaled")
        return rounded(rows.select("o_orderkey", first))
    sums = rows.agg(vector_to_array(Summarizer.sum(F.col("features"))).alias("s"))
    names = F.array(*[F.lit(n) for n in enc.names])
    pairs = sums.select(F.explode(F.arrays_zip(names.alias("name"), F.col("s"))).alias("x")).select("x.name", "x.s")
    return pairs.where(F.col("name").startswith("cat__")).select("name", F.col("s").cast("bigint").alias("n"))


def one_hot(spark, sf):
    return _slot_sums(spark, sf, False, False)


def one_hot_reference(spark, sf):
    return _slot_sums(spark, sf, False, True)


def scaled(spark, sf):
    return _slot_sums(spark, sf, True, True)


LEVELS = """l as (select 'cat__o_orderstatus_' || o_orderstatus as name, count(*) as n from orders group by o_orderstatus
  union all select 'cat__o_orderpriority_' || o_orderpriority, count(*) from orders where o_orderpriority <> '5-LOW' group by o_orderpriority)"""
QUERIES["sampling_one_hot"] = one_hot
ORACLES["sampling_one_hot"] = f"with {LEVELS} select name, n from l"
QUERIES["sampling_one_hot_drop_first"] = one_hot_reference
ORACLES["sampling_one_hot_drop_first"] = f"with {LEVELS} select name, n from l where name not in ('cat__o_orderstatus_F', 'cat__o_orderpriority_1-URGENT')"
QUERIES["sampling_standardise"] = scaled
ORACLES["sampling_standardise"] = """with s as (select avg(o_totalprice) as m, stddev_pop(o_totalprice) as d from orders where o_orderpriority <> '5-LOW')
  select o_orderkey, round((o_totalprice - m) / d, 6) as scaled from orders, s"""


def sizes(spark, sf):
    return rounded(sp.sample_size(target_orders(spark, sf), "target", 24))


QUERIES["sampling_sample_size"] = sizes
ORACLES["sampling_sample_size"] = f"""with {TARGET_CTE}, c as (select count(*) as n, sum(target)::bigint as e from t),
  p as (select *, e::double / n as pi from c),
  q as (select *, 24 / ((0.9 - 1)::double * ln(1 - 0.15::double * (1 - pow(pow(pi, pi) * pow(1 - pi, 1 - pi), 2)) / 0.9::double)) as c1,
    pow(1.96::double / 0.05::double, 2) * pi * (1 - pi) as c3 from p)
  select n as n_available, e as events, round(pi, 6) as prevalence, 24::bigint as candidate_parameters, round(e::double / 24, 2) as events_per_parameter,
    round(c1, 1) as minimum_n_criterion1, round(c3, 1) as minimum_n_criterion3, round(greatest(c1, c3), 1) as minimum_n_required,
    n >= greatest(c1, c3) as adequate from q"""


def weights(spark, sf):
    df = target_orders(spark, sf)
    both = class_weights(df, "target", "balanced", "balanced")
    both = class_weights(both, "target", "ratio", "ratio")
    return rounded(both.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.avg("balanced").alias("balanced"), F.avg("ratio").alias("ratio")))


QUERIES["sampling_class_weights"] = weights
ORACLES["sampling_class_weights"] = f"""with {TARGET_CTE}, s as (select target, count(*) as n from t group by target)
  select target, n, round((select sum(n) from s)::double / (2 * n), 6) as balanced,
    round(case when target = 1 then (select n from s where target = 0)::double / n else 1.0 end, 6) as ratio from s"""


def undersampled(spark, sf):
    return undersample(target_orders(spark, sf), "target", "o_orderkey").select("o_orderkey", "target")


QUERIES["sampling_undersample"] = undersampled
ORACLES["sampling_undersample"] = f"""with {TARGET_CTE}, i as (select *, row_number() over (partition by target
    order by {h(42, 'undersample', 'o_orderkey')}, o_orderkey) as idx from t)
  select o_orderkey, target from i where target = 1 or idx <= (select sum(target) from t)"""


def neighbours(spark, sf):
    return rounded(nearest_neighbours(table(spark, sf, "embeddings"), "vec_id", "embedding", 5))


KNN_SQL = """select a.vec_id as id, b.vec_id as nb,
    sqrt(list_sum(list_transform(range(1, 65), lambda i: (a.embedding[i]::double - b.embedding[i]::double) * (a.embedding[i]::double - b.embedding[i]::double)))) as d"""
QUERIES["sampling_nearest_neighbours"] = neighbours
ORACLES["sampling_nearest_neighbours"] = f"""with d as ({KNN_SQL} from embeddings a join embeddings b on a.vec_id <> b.vec_id),
  r as (select *, row_number() over (partition by id order by d, nb) as rank from d)
  select id as vec_id, rank::int as rank, nb as neighbour_id, round(d, 6) as distance from r where rank <= 5"""


def smote_rows(spark, sf):
    df = table(spark, sf, "embeddings").withColumn("y", (F.col("label") < 2).cast("int"))
    made = smote(df, "y", "vec_id", "embedding")
    return rounded(
        made.select(
            "sample", "base_id", "neighbour_id", "lam", F.element_at("embedding", 1).alias("first"), F.element_at("embedding", -1).alias("last")
        )
    )


QUERIES["sampling_smote"] = smote_rows
ORACLES["sampling_smote"] = f"""with pos as (select vec_id, embedding, row_number() over (order by {h(42, 'smote-index', 'vec_id')}, vec_id) as idx
    from embeddings where label < 2),
  d as ({KNN_SQL} from pos a join pos b on a.vec_id <> b.vec_id),
  r as (select *, row_number() over (partition by id order by d, nb) as rank from d),
  n as (select sum((label < 2)::int)::bigint as p, sum((label >= 2)::int)::bigint as q from embeddings),
  s as (select unnest(range(1, q - p + 1)) as sample, p from n),
  c as (select sample, {h(42, 'smote-base', 'sample')} % p + 1 as idx, {h(42, 'smote-neighbour', 'sample')} % 5 + 1 as rank,
    {u(42, 'smote-gap', 'sample')} as lam from s)
  select sample, a.vec_id as base_id, b.vec_id as neighbour_id, round(lam, 6) as lam,
    round(a.embedding[1]::double + lam * (b.embedding[1]::double - a.embedding[1]::double), 6) as first,
    round(a.embedding[64]::double + lam * (b.embedding[64]::double - a.embedding[64]::double), 6) as last
  from c join pos a using (idx) join r on r.id = a.vec_id and r.rank = c.rank join pos b on b.vec_id = r.nb"""
