"""The paths that only large or skewed tables take, forced on small ones."""

import hashlib
import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from catalogue import registry
from veritally.operators import bootstrap as bs
from veritally.operators import explain as ex
from veritally.operators import inference as inf
from veritally.operators import sensitivity
from veritally.operators.bootstrap import bootstrap_ci
from veritally.operators.bounded import bounded, scratch_path
from veritally.operators.calibration import calibration_fits, integrated_calibration_index
from veritally.operators.discrimination import ladder_metrics
from veritally.operators import smoothing as sm
from veritally.operators import tuning as tu
from veritally.operators.pooling import pooled, t_quantile
from veritally.operators.ladder import score_ladder
from veritally.operators.models import fit_model, make_estimator
from veritally.operators.neighbours import nearest_neighbours
from veritally.operators.quantiles import exact_quantiles
from veritally.operators.row_index import stratified_index
from veritally.operators.running import running
from veritally.operators.split import ColumnRoles
from veritally.sources import tables
from veritally.sources.tables import file_digests, piece_digests


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows share one score; the rest is continuous or tied."""
    rng = np.random.default_rng(5)
    n = 6000
    p = np.where(np.arange(n) % 3 == 0, 0.25, np.where(np.arange(n) % 3 == 1, rng.random(n), rng.integers(0, 20, n) / 20))
    y = rng.binomial(1, 0.1 + 0.3 * p)
    pdf = pd.DataFrame({"row_id": np.arange(n), "model": np.where(np.arange(n) % 2 == 0, "a", "b"), "y": y, "p": p})
    return pdf, spark.createDataFrame(pdf).cache()


def rows_of(df, digits=9):
    return sorted(tuple(round(v, digits) if isinstance(v, float) else v for v in r) for r in df.collect())


def test_bucketed_ladder_equals_plain_ladder(skewed):
    _, df = skewed
    assert rows_of(score_ladder(df, ["model"], bucket_rows=100)) == rows_of(score_ladder(df, ["model"]))
    assert rows_of(score_ladder(df, [], bucket_rows=100)) == rows_of(score_ladder(df, []))


@pytest.mark.parametrize("buckets", [1, 7, 64])
def test_quantiles_of_a_hot_value(skewed, buckets):
    pdf, df = skewed
    probs = [0.0, 0.1, 0.333, 0.5, 0.9, 1.0]
    for r in exact_quantiles(df, "p", probs, ["model"], buckets=buckets).collect():
        part = pdf[pdf["model"] == r["model"]]["p"]
        assert r["n"] == len(part)
        assert r["q"] == pytest.approx(list(np.quantile(part, probs)), abs=1e-12)


@pytest.mark.parametrize("bits", [0, 3, 8])
def test_row_index_is_a_permutation_whatever_the_buckets(skewed, bits):
    _, df = skewed
    one = stratified_index(df, ["y"], "row_id", 1, "t", bucket_bits=bits).select("row_id", "y", "idx", "stratum_n")
    two = stratified_index(df, ["y"], "row_id", 1, "t", bucket_bits=5).select("row_id", "y", "idx", "stratum_n")
    assert rows_of(one) == rows_of(two)
    for y, part in one.toPandas().groupby("y"):
        assert sorted(part["idx"]) == list(range(1, len(part) + 1))


def test_running_over_buckets(skewed):
    pdf, df = skewed
    out = running(df, ["model"], F.floor(F.col("row_id") / 100), ["row_id"], {"s": F.col("y")}, {"m": F.col("p")}).toPandas()
    for _, part in out.sort_values("row_id").groupby("model"):
        assert list(part["s"]) == list(part["y"].cumsum())
        assert list(part["m"]) == list(part["p"].cummax())


def test_holm_buckets_agree(skewed):
    _, df = skewed
    one = inf.holm(df.drop("y"), "p", "row_id", ["model"], buckets=1)
    many = inf.holm(df.drop("y"), "p", "row_id", ["model"], buckets=9)
    assert rows_of(one.select("row_id", "p_adjusted")) == rows_of(many.select("row_id", "p_adjusted"))


def test_ladder_join_with_hot_scores(skewed, monkeypatch):
    _, df = skewed
    plain = rows_of(inf.placements(df))
    monkeypatch.setattr(inf, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(inf, "HOT_ROWS", 500)
    assert rows_of(inf.placements(df)) == plain


@pytest.mark.parametrize("mode", ["exact", "poisson"])
def test_replicates_equal_weighted_ladders(skewed, mode, monkeypatch):
    """Salted hot scores, many blocks and replicate chunks give the plain weighted metrics."""
    _, df = skewed
    monkeypatch.setattr(bs, "MATRIX_CELLS", 700)
    names = ["auroc", "auprc", "brier", "log_loss", "brier_scaled", "mean_predicted_risk", "auprc_baseline"]
    fast = bs.replicate_metrics(df, ["model"], "row_id", names, 7, mode=mode, block_rows=150)
    w = bs.bootstrap_draws(df.select("row_id", "y").distinct(), "y", "row_id", 7, mode=mode)
    slow = ladder_metrics(score_ladder(df.join(w, "row_id"), ["model", "rep"], weight=F.col("times")), ["model", "rep"], names)
    assert rows_of(fast) == rows_of(slow.select(fast.columns))


@pytest.mark.parametrize("mode", ["exact", "poisson"])
def test_own_metrics_equal_built_in_ones(skewed, mode, monkeypatch):
    _, df = skewed
    monkeypatch.setattr(bs, "MATRIX_CELLS", 700)
    own = {
        "area": bs.BlockMetric(
            lambda t: t["won"] / (t["p"] * t["n"]),
            terms={"p": lambda p, pos, neg: pos.sum(0), "n": lambda p, pos, neg: neg.sum(0)},
            ranked={"won": lambda p, pos, neg, pos_above, neg_above: (neg * (pos_above + pos / 2)).sum(0)},
        ),
        "risk": bs.BlockMetric(lambda t: t["p"] / t["n"], terms={"p": lambda p, pos, neg: p @ (pos + neg), "n": lambda p, pos, neg: (pos + neg).sum(0)}),
    }
    found = bs.replicate_metrics(df, ["model"], "row_id", ["auroc", "mean_predicted_risk"], 7, mode=mode, block_rows=150, own=own)
    rows = found.collect()
    assert len(rows) == 14
    assert all(r["area"] == pytest.approx(r["auroc"], abs=1e-12) and r["risk"] == pytest.approx(r["mean_predicted_risk"], abs=1e-12) for r in rows)
    point = {(r["model"], r["metric"]): r["value"] for r in bs.own_points(df, ["model"], "row_id", own).collect()}
    for r in ladder_metrics(score_ladder(df, ["model"]), ["model"], ["auroc", "mean_predicted_risk"]).collect():
        assert (point[r["model"], "area"], point[r["model"], "risk"]) == pytest.approx((r["auroc"], r["mean_predicted_risk"]), abs=1e-12)


def test_exact_draws_are_multinomial(spark):
    """Class sizes hold in every replicate, and counts have the mean, variance and covariance of draws with replacement."""
    rows = spark.range(300).select(F.col("id").alias("row_id"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    reps = 2000
    pdf = bs.bootstrap_draws(rows, "y", "row_id", reps, seed=5).toPandas()
    m = np.zeros((300, reps))
    m[pdf["row_id"], pdf["rep"] - 1] = pdf["times"]
    first = np.arange(300) % 3 == 0
    assert (m[first].sum(0) == 100).all() and (m[~first].sum(0) == 200).all()
    assert m[first].mean(1).std() < 3 * math.sqrt(0.99 / reps) and m[first].var(1).mean() == pytest.approx(1 - 1 / 100, abs=0.02)
    c = np.cov(m[first])
    assert c[~np.eye(100, dtype=bool)].mean() == pytest.approx(-1 / 100, abs=0.002)
    assert (m[first] == 0).mean() == pytest.approx(0.99**100, abs=0.005)


def test_half_crowded_scores_do_not_share_one_block(spark, monkeypatch):
    """Many scores just below the crowding limit must spread over many blocks."""
    rows = spark.range(4000).select(
        F.col("id").alias("row_id"), F.lit("m").alias("model"), (F.col("id") % 3 == 0).cast("int").alias("y"), (F.col("id") % 50 / 50).alias("p")
    )
    seen = []
    plain = bs.add_bucket
    monkeypatch.setattr(bs, "add_bucket", lambda df, c, edges, out: seen.append(len(edges)) or plain(df, c, edges, out))
    bs.replicate_metrics(rows, ["model"], "row_id", ["auroc"], 3, mode="poisson", block_rows=100).collect()
    assert seen[0] >= 35


def test_poisson_weights_have_mean_and_variance_one(spark):
    rows = spark.range(20000).select(F.col("id").alias("row_id"), F.lit(1).alias("y"))
    pdf = bs._with_draws(rows, "row_id", 50, 3, "poisson", True, "y").toPandas()
    w = np.concatenate([m for _, m in bs._Weights(50, 3).chunks(pdf)], axis=1)
    assert w.mean() == pytest.approx(1, abs=0.01) and w.var() == pytest.approx(1, abs=0.03)
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.03
    assert w.sum(0).std() == pytest.approx(math.sqrt(20000), rel=0.35)


def lowess_index(y, p, frac=0.6):
    k, n = int(frac * len(p) + 1e-10), len(p)
    fit = np.empty(n)
    for i in range(n):
        d = np.abs(p - p[i])
        h = np.sort(d)[k - 1]
        w = np.where(d < h, (1 - (d / h) ** 3) ** 3, 0.0)
        x = p - p[i]
        s0, s1, s2, t0, t1 = w.sum(), (w * x).sum(), (w * x * x).sum(), (w * y).sum(), (w * x * y).sum()
        slope = (t1 - s1 * t0 / s0) / (s2 - s1 * s1 / s0)
        fit[i] = t0 / s0 - slope * s1 / s0
    return np.abs(fit - p).mean()


@pytest.mark.parametrize("block_rows", [500_000, 90])
def test_calibration_index_equals_full_lowess(spark, block_rows):
    rng = np.random.default_rng(3)
    lp = rng.normal(-2, 1, 2500)
    p, y = 1 / (1 + np.exp(-lp - 0.4)), rng.binomial(1, 1 / (1 + np.exp(-lp)))
    df = spark.createDataFrame(pd.DataFrame({"y": y, "p": p}))
    found = integrated_calibration_index(score_ladder(df, []), [], block_rows=block_rows).first()["ici"]
    assert found == pytest.approx(lowess_index(y, p), abs=2e-5)


@pytest.mark.parametrize("block_rows", [500_000, 64])
def test_window_widths_are_exact(spark, block_rows):
    rng = np.random.default_rng(8)
    p = np.round(rng.beta(2, 5, 900), 2)  # ties
    q = rng.random(700)
    df = spark.createDataFrame(pd.DataFrame({"m": ["p"] * 900 + ["q"] * 700, "y": rng.integers(0, 2, 1600), "p": np.r_[p, q]}))
    cells = sm._blocked(score_ladder(df, ["m"]), ["m"], block_rows)
    at = sm.fit_points(cells, ["m"], 50)
    found = sm.window_widths(cells, ["m"], at, 0.6, block_rows).collect()
    assert len(found) > 60
    for r in found:
        x = {"p": p, "q": q}[r["m"]]
        assert r["width"] == pytest.approx(np.sort(np.abs(x - r["at"]))[int(0.6 * len(x)) - 1], abs=1e-12)


def min_max(w, s):
    """Isotonic fit by its min-max formula."""
    W, S = np.r_[0, np.cumsum(w)], np.r_[0, np.cumsum(s)]
    n = len(w)
    a, b = np.arange(n)[:, None], np.arange(n)[None, :]
    means = np.where(b >= a, (S[b + 1] - S[a]) / np.maximum(W[b + 1] - W[a], 1e-9), np.inf)
    low = np.minimum.accumulate(means[:, ::-1], axis=1)[:, ::-1]  # over b >= i
    return np.where(a <= b, low, -np.inf).max(axis=0)


@pytest.mark.parametrize("block_rows", [500_000, 7])
def test_isotonic_fits_of_many_groups(spark, block_rows):
    rng = np.random.default_rng(4)
    groups = 1000
    df = pd.DataFrame({"g": np.repeat(np.arange(groups), 20), "p": np.round(rng.random(20 * groups), 1), "y": rng.integers(0, 2, 20 * groups)})
    ladder = score_ladder(spark.createDataFrame(df), ["g"])
    found = {r["g"]: r["ici"] for r in sm.isotonic_index(ladder, ["g"], block_rows).collect()}
    assert len(found) == groups
    for g, part in list(df.groupby("g"))[::25]:
        cells = part.groupby("p")["y"].agg(["count", "sum"])
        fit = min_max(cells["count"].to_numpy(), cells["sum"].to_numpy())
        assert found[g] == pytest.approx((cells["count"] * np.abs(fit - cells.index.to_numpy())).sum() / len(part), abs=1e-12)


@pytest.mark.parametrize("block_rows", [500_000, 50])
def test_isotonic_values_on_new_scores(spark, block_rows):
    rng = np.random.default_rng(6)
    p = rng.random(800)
    y = rng.binomial(1, p**2)
    pools = sm.isotonic_pools(score_ladder(spark.createDataFrame(pd.DataFrame({"y": y, "p": p})), []), [], block_rows)
    new = spark.createDataFrame(pd.DataFrame({"k": 1, "i": np.arange(200), "p": np.r_[rng.random(198), -1.0, 2.0]}))
    found = {r["i"]: r["p"] for r in sm.isotonic_values(new, pools.withColumn("k", F.lit(1).cast("long")), ["k"], 30).collect()}
    order = np.argsort(p)
    fit = min_max(np.ones(800), y[order])
    for r in new.collect():
        assert found[r["i"]] == pytest.approx(np.interp(r["p"], p[order], fit), abs=1e-12)


def test_calibration_index_with_zero_width_windows(spark):
    p = np.r_[np.full(700, 0.2), np.linspace(0.3, 0.9, 300)]
    y = np.r_[np.tile([1, 0, 0, 0], 175), np.tile([1, 0], 150)]
    df = spark.createDataFrame(pd.DataFrame({"y": y, "p": p}))
    assert 0.04 < integrated_calibration_index(score_ladder(df, []), []).first()["ici"] < 0.3


@pytest.mark.parametrize("block_rows", [2048, 40])
def test_neighbours_equal_brute_force(spark, block_rows):
    """Clusters, ties and a third of all rows being copies of one vector."""
    rng = np.random.default_rng(8)
    v = np.concatenate([rng.normal(c, 0.3, (100, 4)) for c in (0, 3, 6)] + [np.zeros((150, 4))])
    v = np.round(v, 1)
    ids = rng.permutation(len(v)) * 3
    df = spark.createDataFrame([(int(i), [float(x) for x in row]) for i, row in zip(ids, v)], "id bigint, v array<double>")
    found = nearest_neighbours(df, "id", "v", 5, block_rows=block_rows).toPandas()
    d = np.sqrt(((v[:, None, :] - v[None, :, :]) ** 2).sum(2))
    for a in range(len(v)):
        others = [b for b in range(len(v)) if b != a]
        best = sorted(others, key=lambda b: (d[a, b], ids[b]))[:5]
        mine = found[found["id"] == ids[a]].sort_values("rank")
        assert list(mine["neighbour_id"]) == [ids[b] for b in best]
        assert list(mine["distance"]) == pytest.approx([d[a, b] for b in best])


@pytest.fixture(scope="module")
def tree_data(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.random((600, 3)), 2)
    y = rng.binomial(1, 0.2 + 0.5 * (x[:, 0] > 0.5) * (x[:, 1] > 0.3))
    pdf = pd.DataFrame({"row_id": np.arange(600), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "target": y})
    return pdf, spark.createDataFrame(pdf)


ROLES = ColumnRoles(["a", "b", "c"], [], {"a": 9, "b": 9, "c": 9})


@pytest.mark.parametrize("key", ["boosted_depthwise", "random_forest"])
def test_tree_shap_adds_up_to_the_raw_output(tree_data, key):
    _, df = tree_data
    params = {"n_estimators": 6, "max_depth": 4, "min_samples_leaf": 5, "subsample": 1.0, "colsample": 1.0}
    model = fit_model(key, df, ROLES, "target", params)
    encoded = model.encoding.transform(df)
    phis = ex.tree_shap(encoded.select("row_id", "features"), "row_id", model.classifier)
    scored = model.score(df, ["row_id"])
    rows = phis.join(scored, "row_id").toPandas()
    raw = np.array([sum(p) + b for p, b in zip(rows["phi"], rows["base"])])
    expected = rows["p"] if key == "random_forest" else 0.5 * np.log(rows["p"] / (1 - rows["p"]))
    assert raw == pytest.approx(expected.to_numpy(), abs=1e-6)


def test_tree_shap_equals_brute_force(spark, tree_data):
    _, df = tree_data
    model = fit_model("boosted_depthwise", df, ROLES, "target", {"n_estimators": 2, "max_depth": 3, "subsample": 1.0, "colsample": 1.0})
    nodes, weights = ex.tree_nodes(spark, model.classifier)
    tables = {t: {r["id"]: r for r in part.to_dict("records")} for t, part in nodes.groupby("tree")}

    def value(tree, node, x, known):
        n = tables[tree][node]
        if n["left"] < 0:
            return n["prediction"]
        f, cut = int(n["feature"]), n["threshold"][0]
        if f in known:
            return value(tree, n["left"] if x[f] <= cut else n["right"], x, known)
        left, right = tables[tree][n["left"]], tables[tree][n["right"]]
        share = left["cover"] / n["cover"]
        return share * value(tree, n["left"], x, known) + right["cover"] / n["cover"] * value(tree, n["right"], x, known)

    rows = df.limit(15)
    phis = ex.tree_shap(model.encoding.transform(rows).select("row_id", "features"), "row_id", model.classifier).toPandas()
    xs = {r["row_id"]: [r["a"], r["b"], r["c"]] for r in rows.collect()}
    for row_id, phi in zip(phis["row_id"], phis["phi"]):
        x = xs[row_id]
        v = {s: sum(w * value(t, 0, x, set(s)) for t, w in enumerate(weights)) for k in range(4) for s in itertools.combinations(range(3), k)}
        for j in range(3):
            rest = [i for i in range(3) if i != j]
            expected = sum(
                math.factorial(len(s)) * math.factorial(2 - len(s)) / 6 * (v[tuple(sorted((*s, j)))] - v[s])
                for k in range(3)
                for s in itertools.combinations(rest, k)
            )
            assert phi[j] == pytest.approx(expected, abs=1e-9)


def test_penalty_follows_the_sum_of_losses():
    lr = make_estimator("penalised_lr", {"C": 0.5, "l1_ratio": 0.3}, 1000.0)
    assert lr.getRegParam() == pytest.approx(1 / 500)
    assert lr.getElasticNetParam() == 0.3 and not lr.getStandardization()


def test_absent_feature_raises(tree_data):
    _, df = tree_data
    with pytest.raises(KeyError, match="age"):
        fit_model("parsimonious_lr", df, ROLES, "target", features=["a", "age"])


def test_broadcast_is_only_hinted_when_small(spark):
    def plan(df):
        return df._jdf.queryExecution().logical().toString()

    assert "ResolvedHint" in plan(bounded(spark.range(10), 20)) or "broadcast" in plan(bounded(spark.range(10), 20)).lower()
    assert "broadcast" not in plan(bounded(spark.range(50), 20)).lower()


HEAVY = [
    "score_ladder_bucketed", "discrimination_and_brier", "calibration_bins_quantile", "threshold_performance",
    "decision_curve", "bootstrap_intervals_poisson", "inference_delong", "subgroup_audit", "cohort_first_per_entity",
    "sampling_stratified_split", "sampling_smote", "explain_permutation_importance", "profile_raw_audit",
]


@pytest.mark.parametrize("name", HEAVY)
def test_no_cross_join(spark, sf, name):
    plan = registry.all_queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_first_per_entity_limits_before_the_shuffle(spark, sf):
    plan = registry.all_queries()["cohort_first_per_entity"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


class _Cluster:
    """As much of a session as the shared folder is asked of."""

    def __init__(self, master, folder=None):
        self.conf = {"spark.checkpoint.dir": folder}
        self.sparkContext = self
        self.master = master

    def getCheckpointDir(self):
        return None


@pytest.mark.parametrize("master", ["yarn", "local-cluster[3,2,1024]", "k8s://host"])
def test_a_cluster_without_a_shared_folder_raises(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_path(_Cluster(master), "x")
    assert scratch_path(_Cluster(master, "hdfs://shared/"), "x").startswith("hdfs://shared/x-")


def test_fits_of_a_thousand_groups_and_of_one_agree(spark):
    """One rule of convergence, whether the coefficients fit on the driver or not."""
    rows = spark.range(40_000).selectExpr("id % 1000 as g", "(id div 1000) / 50.0 + 0.1 as p", "cast(xxhash64(id) % 3 = 0 as int) as y")
    cells = rows.groupBy("g", "p").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    whole = {r["g"]: r for r in calibration_fits(cells, ["g"]).collect()}
    assert len(whole) == 1000
    one = calibration_fits(cells.where("g = 7"), ["g"]).first()
    assert whole[7]["calibration_slope"] == pytest.approx(one["calibration_slope"], abs=1e-9)


def test_file_digests(spark, tmp_path):
    import hashlib

    content = {"a.bin": b"x", "b.bin": bytes(range(256)) * 4000}
    for name, data in content.items():
        (tmp_path / name).write_bytes(data)
    found = {r["path"].rsplit("/", 1)[1]: (r["bytes"], r["sha256"]) for r in file_digests(spark, str(tmp_path)).collect()}
    assert found == {n: (len(d), hashlib.sha256(d).hexdigest()) for n, d in content.items()}


def test_piece_digests(spark, tmp_path):
    import hashlib

    content = {"a.bin": b"x", "b.bin": bytes(range(256)) * 9, "c.bin": b"y" * 2000}
    for name, data in content.items():
        (tmp_path / name).write_bytes(data)
    found = {r["path"].rsplit("/", 1)[1]: (r["bytes"], r["pieces"], r["sha256"]) for r in piece_digests(spark, str(tmp_path), 1000).collect()}
    for name, data in content.items():
        parts = [data[k : k + 1000] for k in range(0, len(data), 1000)]
        joined = "".join(hashlib.sha256(x).hexdigest() for x in parts)
        assert found[name] == (len(data), len(parts), hashlib.sha256(joined.encode()).hexdigest())


@pytest.mark.parametrize("block", [2, 8])
def test_replayed_searches_follow_the_rule(spark, block):
    """The grouped replay against the rule written out, for two studies at once."""
    rng = np.random.default_rng(5)
    rows = [(s, t, k, float(v)) for s in (1, 2) for t in range(40) for k, v in enumerate(rng.normal(size=3))]
    found = tu.replayed(spark.createDataFrame(rows, "study long, trial long, step int, value double"), steps=3, startup=4, block=block)
    values = {(s, t): [r[3] for r in rows if r[:2] == (s, t)] for s in (1, 2) for t in range(40)}
    want, pruned = {}, 0
    for s in (1, 2):
        done: dict = {}
        for t in range(40):
            earlier = [h for u, h in done.items() if u // block < t // block]
            state, used = "COMPLETE", 3
            for k in range(1, 3):
                medians = [np.mean(h[: k + 1]) for h in earlier]
                if len(earlier) >= 4 and np.mean(values[s, t][: k + 1]) < np.median(medians):
                    state, used = "PRUNED", k + 1
                    pruned += 1
                    break
            if state == "COMPLETE":
                done[t] = values[s, t]
            want[s, t] = (state, used)
    assert {(r["study"], r["trial"]): (r["state"], r["folds"]) for r in found.collect()} == want and pruned > 10


def test_pooling_by_hand(spark):
    q, v = [0.6, 0.64, 0.61, 0.66], [0.001, 0.0012, 0.0009, 0.001]
    df = spark.createDataFrame([("a", k, x, y) for k, (x, y) in enumerate(zip(q, v))] + [("b", 0, 0.5, 0.01)], "model string, draw int, estimate double, variance double")
    r = {x["model"]: x for x in pooled(df, ["model"]).collect()}
    between, within = np.var(q, ddof=1), np.mean(v)
    total = within + 1.25 * between
    assert (r["a"]["estimate"], r["a"]["within"], r["a"]["between"], r["a"]["se"]) == pytest.approx((np.mean(q), within, between, math.sqrt(total)))
    assert r["a"]["df"] == pytest.approx(3 * (total / (1.25 * between)) ** 2)
    assert r["b"]["ci_high"] - 0.5 == pytest.approx(0.1 * 1.959963984540054)
    ten = spark.range(1).select(t_quantile(1.959963984540054, F.lit(10.0)).alias("t")).first()["t"]
    assert ten == pytest.approx(2.2281, abs=2e-3)  # the 97.5th percentile of t with ten degrees of freedom


def test_search_prunes_alike_in_any_order():
    from veritally.operators.tuning import should_stop

    earlier = [[float(k), float(k)] for k in range(9)]
    assert should_stop(earlier, 1, 3.9, 8, 1) and not should_stop(earlier, 1, 4.1, 8, 1)
    assert not should_stop(earlier, 0, 0.0, 8, 1) and not should_stop(earlier[:7], 1, 0.0, 8, 1)


def test_functions_as_metrics_are_drawn_exactly_or_not_at_all(spark):
    with pytest.raises(ValueError, match="exact"):
        bootstrap_ci(spark.range(3).selectExpr("id as row_id", "1 as y", "0.5 as p"), [], metrics={"x": lambda: F.count("p")}, mode="poisson")


def test_replay_of_one_search_has_every_trial(spark, sf):
    from catalogue.modelling import QUERIES

    users = spark.read.parquet(f"{sf}/events.parquet").select("user_id").distinct().count()
    found = QUERIES["tuning_replay"](spark, sf).collect()
    assert found[0].asDict().keys() == {"trial", "same"} and len(found) == users and all(r["same"] for r in found)


@pytest.fixture
def exploded_sizes(spark, tmp_path):
    """A table small on disk, joins of which Spark would like to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100MB")
    yield spark.range(600).selectExpr("id as row_id", "cast(id % 3 = 0 as int) as y", "'m' as model", "id % 97 / 97.0 as p", "id * 1.0 as x")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan_of(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_repeats_of_rows_are_never_broadcast(exploded_sizes):
    """Sizes are estimated before ``explode``: such sides would go through the driver whole."""
    from veritally.operators.explain import permuted_rows

    plan = plan_of(permuted_rows(exploded_sizes, "row_id", ["x"], 3))
    assert "SortMergeJoin [rep" in plan
    changes = bs._changes(bs._positioned(exploded_sizes, "y", "row_id", 42, True), "row_id", 5, 42)
    assert "SortMergeJoin [_s" in plan_of(changes)


def test_fast_draws_are_those_of_the_polynomial():
    from veritally.functions.hashing import PRIME, polynomial

    rng = np.random.default_rng(1)
    h1, h2 = (np.r_[rng.integers(0, PRIME, 3000), 0, PRIME - 1] for _ in range(2))
    draws = bs._Poisson(40, 42)
    want = np.searchsorted(np.array(bs.poisson_cuts()), polynomial(h1[:, None], h2[:, None], {k: v[None] for k, v in draws.c.items()}) / float(PRIME), side="right")
    assert (draws.counts(h1, h2, 0, 40) == want).all()
    ball, reps = draws.table(40, 42, "boot-ball"), np.arange(3, 40, 2)
    limit = np.full(len(reps), PRIME // 3)
    found = {(c, a, r, k) for c, at, rep, key in bs._taken_back(draws, ball, h1, h2, reps, limit) for a, r, k in zip(at, rep, key)}
    right = set()
    for copy in range(1, want.max() + 1):
        key = bs._removed_key(h1[:, None], h2[:, None], copy, {k: v[None] for k, v in ball.items()})
        right |= {(copy, a, r, key[a, r]) for a, r in zip(*np.nonzero((want >= copy) & (key < PRIME // 3))) if r in reps}
    assert found == right


def test_functions_as_metrics_see_the_ladder_of_every_replicate(spark):
    rows = spark.range(900).selectExpr("id as row_id", "cast(id % 4 = 0 as int) as y", "'m' as model", "cast(id % 50 as double) / 50 as p")
    draws = bs.bootstrap_draws(rows.select("row_id", "y"), "y", "row_id", 6)
    want = score_ladder(rows.join(draws, "row_id"), ["model", "rep"], weight=F.col("times"))
    found = bs.replicate_ladder(rows, ["model"], "row_id", 6, block_rows=100)  # scores of 18 rows, blocks of 100
    crowded = bs.replicate_ladder(rows, ["model"], "row_id", 6, block_rows=10)
    columns = ["model", "rep", "p", "pos", "neg", "pos_below", "neg_below", "pos_total", "neg_total"]
    expected = sorted(map(tuple, want.select(columns).collect()))
    assert expected == sorted(map(tuple, found.select(columns).collect())) == sorted(map(tuple, crowded.select(columns).collect()))


def test_isotonic_index_with_blocks_inside_long_ties(spark):
    """Blocks that hold nothing but a part of a tie have no cells."""
    rows = spark.range(3000).selectExpr("'m' as model", "cast(id % 3 as double) / 4 as p", "cast(id % 7 < id % 3 as int) as y")
    ladder = score_ladder(rows, ["model"])
    want = sm.isotonic_index(ladder, ["model"]).first()["ici"]
    assert sm.isotonic_index(ladder, ["model"], 100).first()["ici"] == pytest.approx(want, abs=1e-12)


def test_running_sums_of_events_keep_the_weights():
    rng = np.random.default_rng(3)
    n = 5 * bs.EVENT_ROWS + 7
    p = np.sort(np.r_[rng.random(n // 2).round(2), np.full(n - n // 2, 0.5)])  # a tie over several runs of rows
    y, w = (rng.random(n) < 0.2).astype(float), rng.integers(0, 9, (n, 4)).astype(float)
    before, at = w.copy(), np.flatnonzero(y)
    own, below, upto, others = bs._Events(p, y).split(w)
    assert (w == before).all() and (own == w[at]).all() and (others == w[y == 0].sum(0)).all()
    assert (below == [w[(y == 0) & (p < x)].sum(0) for x in p[at]]).all() and (upto == [w[(y == 0) & (p <= x)].sum(0) for x in p[at]]).all()


def test_draws_of_a_small_table_are_made_in_many_tasks(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(bs, "stored", lambda df: kept.append(df) or df)
    rows = spark.range(200).selectExpr("id as row_id", "cast(id % 3 = 0 as int) as y")
    bs.bootstrap_draws(rows, "y", "row_id", 3)
    assert any("h1" in k.columns and "RepartitionByExpression" in k._jdf.queryExecution().logical().toString() for k in kept)


def test_visits_are_found_and_handed_over_in_small_frames():
    from veritally.operators import neighbours as nn

    rng = np.random.default_rng(4)
    n, asked = 700, []
    rows = pd.DataFrame({"id": np.arange(n), "v": list(rng.random((n, 3))), "cell": 0, "block": "0-0-0", "reach": np.inf})
    names, cells, lows, highs = np.array([f"0-0-{k}" for k in range(40)]), np.zeros(40, int), np.zeros(40), np.ones(40)

    def to_pivots(v):
        asked.append(len(v))
        return np.ones((len(v), 1))

    found = list(nn._visits([rows, rows.iloc[:0]], to_pivots, np.ones((1, 1)), names, cells, lows, highs))
    assert max(asked) <= nn.VISIT_ROWS and max(map(len, found)) <= nn.VISITS
    assert set(zip(*pd.concat(found)[["id", "target"]].to_numpy().T)) == {(k, x) for k in range(n) for x in names[1:]}


def test_blocks_of_smoothers_stay_small_frames(spark):
    rows = spark.range(3 * 65_536).selectExpr("'m' as model", "id / 200000.0 as p", "cast(id % 3 = 0 as int) as y")
    blocks = sm._blocked(score_ladder(rows, ["model"]), ["model"], sm.BLOCK_ROWS).groupBy("block").count().collect()
    assert len(blocks) == 3 and max(r["count"] for r in blocks) <= 65_536


def test_blocks_read_again_keep_a_task_of_their_own(spark):
    from veritally.operators.bootstrap import replicate_metrics

    rows = spark.range(300).selectExpr("id as row_id", "'m' as model", "cast(id % 5 = 0 as int) as y", "id % 97 / 97.0 as p")
    table = replicate_metrics(rows, ["model"], "row_id", ["auroc", "auprc"], 3, block_rows=50)
    assert table._jdf.queryExecution().toString().count("REPARTITION_BY_NUM") >= 2  # both sides of the second look


def test_counts_are_those_of_the_cuts(spark):
    import veritally.operators.bootstrap as bs

    draws = bs._Poisson(2000, 7)
    h1, h2 = (np.random.default_rng(k).integers(0, bs.PRIME, 700) for k in (1, 2))
    found = draws.counts(h1, h2, 0, 2000)
    value = bs.polynomial(h1[:, None], h2[:, None], draws.c)
    assert (found == np.searchsorted(draws.cuts, value, side="right")).all() and found.max() >= 7


def blocks_and_points(n_blocks, n, seed=3):
    """Blocks of rings around pivots, and points with the reach of their own neighbours, as ``nearest_neighbours`` has them."""
    rng = np.random.default_rng(seed)
    pivots = rng.random((20, 3))
    gaps = np.maximum(np.sqrt(((pivots[:, None] - pivots[None]) ** 2).sum(2)), 1e-300)
    to_pivots = lambda v: np.sqrt(((v[:, None, :] - pivots[None]) ** 2).sum(2))
    cells = rng.integers(0, 19, n_blocks).astype("int32")  # the last cell has no block
    lows = rng.random(n_blocks)
    highs, names = lows + 0.5 / n_blocks, np.array([f"b{k}" for k in range(n_blocks)], object)
    v = rng.random((n, 3))
    reach = np.where(np.arange(n) % 50 == 7, math.inf, rng.random(n) * 2 / n_blocks)
    points = pd.DataFrame({"id": np.arange(n), "v": list(v), "cell": to_pivots(v).argmin(1).astype("int32"), "reach": reach, "block": names[rng.integers(0, n_blocks, n)]})
    return points, to_pivots, gaps, names, cells, lows, highs


def visits_one_by_one(points, to_pivots, gaps, names, cells, lows, highs):
    d = to_pivots(np.array(points["v"].tolist()))
    out = set()
    for row, (i, mine, limit, home) in enumerate(zip(points["id"], points["cell"], points["reach"], points["block"])):
        plane = (d[row, cells] ** 2 - d[row, mine] ** 2) / (2 * gaps[mine, cells])
        plane[cells == mine] = 0.0
        lower = np.maximum(np.maximum(lows - d[row, cells], d[row, cells] - highs), plane)
        out |= {(i, x) for x in names[(lower <= limit * (1 + 1e-9) + 1e-12) & (names != home)]}
    return out


def test_visits_by_cell_equal_those_of_every_block(monkeypatch):
    from veritally.operators import neighbours as nn

    monkeypatch.setattr(nn, "LOOKS", 1000)
    points, *rest = blocks_and_points(400, 1200)
    frames = list(nn._visits([points[:500], points[500:]], *rest))
    found = [(i, x) for f in frames for i, x in zip(f["id"], f["target"])]
    assert len(found) == len(set(found)) and set(found) == visits_one_by_one(points, *rest)
    assert list(nn._visits([points[:0]], *rest)) == []


def test_finding_visits_does_not_look_at_every_block_for_every_point():
    import time

    from veritally.operators import neighbours as nn

    points, *rest = blocks_and_points(30_000, 2000)
    points = points[np.isfinite(points["reach"])]
    began = time.process_time()
    frames = list(nn._visits([points], *rest))
    whole = time.process_time() - began
    few = points[:100]
    began = time.process_time()
    expected = visits_one_by_one(few, *rest)
    each = (time.process_time() - began) * len(points) / len(few)
    assert {(i, x) for f in frames for i, x in zip(f["id"], f["target"]) if i <= few["id"].max()} == expected
    assert whole < each / 2


def test_a_point_is_no_neighbour_of_its_own_in_a_block_of_k():
    from veritally.operators import neighbours as nn

    v, ids = np.arange(10.0).reshape(5, 2), np.arange(5) * 3
    found = nn._nearest(v, ids, np.full(5, np.inf), v, ids, 5)
    assert len(found) == 20 and (found["q"] != found["nb"]).all()
    none = nn._nearest(v[:0], ids[:0], np.zeros(0), v, ids, 5)
    assert len(none) == 0 and list(none.dtypes.astype(str)) == ["int64", "int64", "float64"]
    limited = nn._nearest(v[:1], ids[:1], np.array([3.0]), v, ids, 5)
    assert limited["nb"].tolist() == [3]


def test_nearest_in_tiles_equals_one_by_one(monkeypatch):
    from veritally.operators import neighbours as nn

    monkeypatch.setattr(nn, "TILE", 1000)
    rng = np.random.default_rng(4)
    v, ids = rng.integers(0, 6, (90, 3)).astype(float), rng.integers(0, 70, 90)  # ties, and ids that repeat
    reach = np.where(np.arange(90) % 3 == 0, math.inf, rng.random(90) * 4)
    found = nn._nearest(v, ids, reach, v, ids, 4)
    expected = []
    for q in range(90):
        near = sorted((math.dist(v[q], v[j]), ids[j]) for j in range(90) if ids[j] != ids[q] and math.dist(v[q], v[j]) <= reach[q] + 1e-9)[:4]
        expected += [(ids[q], i, round(d, 9)) for d, i in near]
    assert [(a, b, round(d, 9)) for a, b, d in found.itertuples(index=False)] == expected


def test_imbalance_arms_run_all_rounds(spark, tmp_path, monkeypatch):
    rows = [(k, k % 7, "FOP"[k % 3], ["1-URGENT", "5-LOW"][k % 2], float(k)) for k in range(60)]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string, o_totalprice double")
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    asked = []

    def fitted(arm, key, dev, roles, target, row_id, params, seed):
        asked.append((arm.name, make_estimator(key, params, 1.0)))
        raise InterruptedError

    monkeypatch.setattr(sensitivity, "fit_arm", fitted)
    with pytest.raises(InterruptedError):
        registry.all_queries()["sensitivity_imbalance_arms"](spark, str(tmp_path))
    assert "none" in {a for a, _ in asked} and {(e.getMaxIter(), e.getMaxDepth()) for _, e in asked} == {(500, 5)}


def test_arms_come_in_order_however_many_are_fitted_at_a_time(spark, monkeypatch):
    class Model:
        def __init__(self, p):
            self.p = p

        def score(self, df, keep):
            return df.select(*keep, F.lit(self.p).alias("p"))

    monkeypatch.setattr(sensitivity, "fit_arm", lambda arm, *a: Model(float(arm.name)))
    df = spark.createDataFrame([(1, 0), (2, 1)], "id long, t int")
    arms = [sensitivity.Arm("a", str(k)) for k in range(5)]
    for parallel in (1, 3):
        found = sensitivity.score_arms(arms, "boosted_depthwise", df, df, None, "t", "id", parallel=parallel).collect()
        assert [(r.arm, r.y, r.p) for r in found] == [(str(k), y, float(k)) for k in range(5) for y in (0, 1)]


@pytest.mark.parametrize("whole", [100, 1 << 24])
def test_files_larger_than_a_row_are_digested(spark, tmp_path, monkeypatch, whole):
    sizes = {"none": 0, "small": 10, "equal": 1000, "above it, 100%25 #1": 1001, "large": 9_000_000}
    data = {n: np.random.default_rng(k).bytes(size) for k, (n, size) in enumerate(sizes.items())}
    for name, content in data.items():
        (tmp_path / name).write_bytes(content)
    monkeypatch.setattr(tables, "WHOLE_BYTES", whole)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 1000)  # stands for the 2 GB of a row
    try:
        found = {r.path.rsplit("/", 1)[1]: (r.bytes, r.sha256) for r in file_digests(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert found == {n: (len(x), hashlib.sha256(x).hexdigest()) for n, x in data.items() if x}
    assert file_digests(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("group_rows", [1 << 17, 100])
def test_vectors_travel_by_group_of_blocks_where_nothing_is_ruled_out(spark, monkeypatch, group_rows):
    from veritally.operators import neighbours as nn

    rng = np.random.default_rng(6)
    v = rng.normal(size=(600, 16)).astype("float32")
    v /= np.linalg.norm(v, axis=1)[:, None]
    v[5::60] = -v[4::60]
    ids = rng.permutation(600)
    df = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v)], "id long, v array<float>")
    kept = []
    keep = nn.stored
    monkeypatch.setattr(nn, "GROUP_ROWS", group_rows)
    monkeypatch.setattr(nn, "stored", lambda t: kept.append(keep(t)) or kept[-1])
    found = nearest_neighbours(df, "id", "v", 4, block_rows=20).toPandas().sort_values(["id", "rank"])
    d = np.sqrt(((v[:, None].astype(float) - v[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    for a in range(600):
        best = sorted(range(600), key=lambda b: (d[a, b], ids[b]))[:4]
        mine = found[found["id"] == ids[a]]
        assert mine["neighbour_id"].tolist() == [ids[b] for b in best] and mine["distance"].tolist() == pytest.approx([d[a, b] for b in best])
    assert all(t.groupBy("id").count().agg(F.max("count")).first()[0] == 1 for t in kept if {"id", "v"} <= set(t.columns))
    visits = next(t for t in kept if "visits" in t.columns).select("id", F.explode("groups").alias("group"))
    groups = visits.agg(F.count_distinct("group")).first()[0]
    assert groups >= 600 / max(group_rows, 600 / 4) and visits.count() <= 600 * groups


def test_queries_of_blocks_visit_only_theirs():
    from veritally.operators import neighbours as nn

    rng = np.random.default_rng(7)
    q, points = rng.integers(0, 5, (40, 3)).astype(float), rng.integers(0, 5, (90, 3)).astype(float)
    qid, ids, bits = np.arange(40), 100 + rng.permutation(90), rng.choice([0, 5, 63], 90)
    visits = sum((rng.random(40) < 0.6).astype("uint64") << np.uint64(b) for b in (0, 5, 63))
    reach = np.where(np.arange(40) % 3 == 0, np.inf, 2.5)
    found = nn._nearest_in_blocks(q, qid, reach, visits, points, ids, bits, 4)
    for a in range(40):
        own = [(math.dist(q[a], points[b]), ids[b]) for b in range(90) if int(visits[a]) >> int(bits[b]) & 1]
        best = sorted(x for x in own if x[0] <= reach[a] + 1e-9)[:4]
        mine = found[found["q"] == a].sort_values(["distance", "nb"])
        assert mine["nb"].tolist() == [i for _, i in best] and mine["distance"].tolist() == pytest.approx([x for x, _ in best])


def test_a_stored_table_leaves_no_shuffle_files(spark):
    from veritally.operators import bounded as bo

    before = spark.conf.get(bo.CLEANUP)
    with bo.shuffles_dropped(spark), bo.shuffles_dropped(spark):
        assert spark.conf.get(bo.CLEANUP) == "true"
    assert spark.conf.get(bo.CLEANUP) == before
    assert bo.stored(spark.range(50).repartition(3, "id").groupBy("id").count()).count() == 50
