"""Reading, writing and stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue.shared import rounded, table
from veritally.operators.bounded import scratch_path
from veritally.operators.explain import linear_shap
from veritally.operators.models import fit_model
from veritally.operators.split import ColumnRoles
from veritally.sources import tables as io
from veritally.sources.manifest import RunManifest, written_rows
from veritally.sources.model_store import load_model, save_model
from veritally.sources.trials import TrialStore, unfinished

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


def csv_text(spark, sf):
    path = io.write_table(table(spark, sf, "customer"), scratch_path(spark, "customer-csv"))
    return io.read_text_table(spark, path, CUSTOMER).select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")


QUERIES["io_csv_text"] = csv_text
ORACLES["io_csv_text"] = """select c_custkey::varchar as c_custkey, c_name, c_nationkey::varchar as c_nationkey, c_mktsegment from customer"""


def coercion(spark, sf):
    text = table(spark, sf, "part").select(
        "p_partkey",
        F.when(F.col("p_size") % 5 == 0, "?").otherwise(F.col("p_size").cast("string")).alias("size"),
        F.regexp_replace("p_brand", "Brand#", "").alias("brand_no"),
        F.col("p_type").alias("kind"),
    )
    return io.coerce_numeric(text, {"size": "bigint", "brand_no": "double", "kind": "double", "absent": "double"})


QUERIES["io_numeric_coercion"] = coercion
ORACLES["io_numeric_coercion"] = """select p_partkey, try_cast(case when p_size % 5 = 0 then '?' else p_size::varchar end as bigint) as size,
  try_cast(replace(p_brand, 'Brand#', '') as double) as brand_no, try_cast(p_type as double) as kind from part"""


def parquet_partitioned(spark, sf):
    path = io.write_parquet(table(spark, sf, "orders").drop("o_orderdate"), scratch_path(spark, "orders"), ["o_orderstatus"])
    part = io.read_parquet(spark, path, ["o_orderkey", "o_totalprice", "o_orderstatus"])
    return part.where(F.col("o_orderstatus") == "F")


QUERIES["io_parquet_partitioned"] = parquet_partitioned
ORACLES["io_parquet_partitioned"] = "select o_orderkey, o_totalprice, o_orderstatus from orders where o_orderstatus = 'F'"


def result_table(spark, sf):
    stats = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("l_discount"), 6).alias("mean_discount")
    )
    path = io.write_table(stats, scratch_path(spark, "result"))
    return io.read_table(spark, path, "l_returnflag string, l_linestatus string, n bigint, mean_discount double")


QUERIES["io_result_table_csv"] = result_table
ORACLES["io_result_table_csv"] = """select l_returnflag, l_linestatus, count(*) as n, round(avg(l_discount), 6) as mean_discount
  from lineitem group by l_returnflag, l_linestatus"""


def json_round_trip(spark, sf):
    stats = table(spark, sf, "events").groupBy("event_type").agg(
        F.struct(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean")).alias("metrics")
    )
    path = io.write_json(stats, scratch_path(spark, "metrics"))
    back = io.read_json(spark, path, "event_type string, metrics struct<n: bigint, mean: double>")
    return back.select("event_type", "metrics.n", "metrics.mean")


QUERIES["io_json_metrics"] = json_round_trip
ORACLES["io_json_metrics"] = "select event_type, count(*) as n, round(avg(value), 6) as mean from events group by event_type"


def manifest(spark, sf):
    path = scratch_path(spark, "manifest")
    log = RunManifest(spark, path, "run-1")
    for name in ("orders", "events"):
        out = io.write_parquet(table(spark, sf, name), scratch_path(spark, name))
        log.record_rows(name, written_rows(spark, out))
    log.record_stage("loaded", tables=2)
    return log.read().select("run_id", "kind", "name", "payload")


QUERIES["io_run_manifest"] = manifest
ORACLES["io_run_manifest"] = """select 'run-1' as run_id, 'rows' as kind, 'orders' as name, '{"n": ' || count(*) || '}' as payload from orders
  union all select 'run-1', 'rows', 'events', '{"n": ' || count(*) || '}' from events
  union all select 'run-1', 'stage', 'loaded', '{"tables": 2}'"""


def digests(spark, sf):
    files = io.file_digests(spark, sf)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "bytes", "sha256")


QUERIES["io_file_digests"] = digests


def pieces(spark, sf):
    files = io.piece_digests(spark, sf, 1 << 20)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "bytes", "pieces", "sha256")


QUERIES["io_file_piece_digests"] = pieces


def model_store(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_orderkey", "o_totalprice", "o_orderstatus", (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("target")
    )
    roles = ColumnRoles(["o_totalprice"], ["o_orderstatus"], {"o_totalprice": 3, "o_orderstatus": 3})
    model = fit_model("parsimonious_lr", orders, roles, "target")
    again = load_model(spark, save_model(spark, model, scratch_path(spark, "model")))
    both = model.score(orders, ["o_orderkey"]).join(
        again.score(orders, ["o_orderkey"]).select("o_orderkey", F.col("p").alias("again")), "o_orderkey"
    )
    return both.select("o_orderkey", (F.abs(F.col("p") - F.col("again")) < 1e-12).alias("same"))


QUERIES["io_model_store"] = model_store
ORACLES["io_model_store"] = "select o_orderkey, true as same from orders"


def trial_resume(spark, sf):
    store = TrialStore(spark, scratch_path(spark, "trials"))
    part = table(spark, sf, "part")
    planned = part.select(F.col("p_type").alias("study"), F.col("p_partkey").cast("int").alias("trial"))
    state = F.when(F.col("p_size") % 3 == 0, "COMPLETE").when(F.col("p_size") % 3 == 1, "PRUNED").otherwise("RUNNING")
    none = F.lit(None)
    store.append(
        part.where(F.col("p_retailprice") < 1000).select(
            F.col("p_type").alias("study"),
            F.col("p_partkey").cast("int").alias("trial"),
            state.alias("state"),
            F.col("p_retailprice").alias("value"),
            none.cast("double").alias("auroc"),
            F.lit(5).alias("folds"),
            F.array(F.col("p_retailprice")).alias("fold_values"),
            F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.col("p_brand")).alias("params"),
            none.cast("timestamp").alias("started"),
            none.cast("timestamp").alias("completed"),
        )
    )
    return unfinished(planned, store.finished())


QUERIES["io_trial_resume"] = trial_resume
ORACLES["io_trial_resume"] = """select p_type as study, p_partkey::int as trial from part
  where not (p_retailprice < 1000 and p_size % 3 in (0, 1))"""

SLOTS = [f"e{i}" for i in range(64)]
COEFS = [round((-1) ** i * (0.1 + i / 100), 4) for i in range(64)]


def attributions(spark, sf):
    phis = linear_shap(table(spark, sf, "embeddings"), "vec_id", "embedding", COEFS)
    path = io.write_attributions(phis, "vec_id", SLOTS, scratch_path(spark, "phi"))
    return rounded(io.read_parquet(spark, path))


QUERIES["io_attribution_matrix"] = attributions
LINEAR_SHAP_CTE = f"""bg as (select embedding as e from embeddings),
  slots as (select unnest(range(1, 65)) as i),
  means as (select i, avg(e[i]::double) as m from bg cross join slots group by i),
  coefs as (select i, ([{', '.join(map(str, COEFS))}])[i]::double as c from slots),
  phis as (select vec_id, 'e' || (i - 1) as feature, c * (embedding[i]::double - m) as phi
    from embeddings cross join slots join means using (i) join coefs using (i))"""
ORACLES["io_attribution_matrix"] = f"with {LINEAR_SHAP_CTE} select vec_id, feature, round(phi, 6) as phi from phis"
