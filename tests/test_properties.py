"""Statistical properties with known answers, and published values."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from veritally.functions import columns as fx
from veritally.functions.special import two_sided_normal_p, two_sided_sign_p
from veritally.operators import bootstrap as bs
from veritally.operators import calibration as ca
from veritally.operators import discrimination as di
from veritally.operators import inference as inf
from veritally.operators import thresholds as th
from veritally.operators.gates import Gate, GateError, enforce, evaluate_gates
from veritally.operators.ladder import score_ladder
from veritally.operators.split import sample_size_from_counts


def midrank_auc(y, p):
    r = pd.Series(p).rank().to_numpy()
    m = y.sum()
    return (r[y == 1].sum() - m * (m + 1) / 2) / (m * (len(y) - m))


def long(spark, y, **scores):
    parts = [pd.DataFrame({"row_id": np.arange(len(y)), "model": m, "y": y, "p": p}) for m, p in scores.items()]
    return spark.createDataFrame(pd.concat(parts)).cache()


@pytest.fixture(scope="module")
def two(spark):
    """Two scores with ties: ranks of a sine walk, lifted for events by a lot or by a little."""
    k = np.arange(3000)
    y = (k * 37 % 101 < 13).astype(int)
    walk = np.abs(np.sin(k * 1.7)) * 40
    strong, weak = np.round(walk + 18 * y) / 64, np.round(walk[::-1] + 5 * y) / 64
    return y, strong, weak, long(spark, y, strong=strong, weak=weak)


def logit(p):
    return np.log(p / (1 - p))


@pytest.fixture(scope="module")
def exact_risks(spark):
    """19 risks k / 20, each held by 40 rows of which exactly 2 k are events; and the same scores bent on the logit scale."""
    k = np.repeat(np.arange(1, 20), 40)
    y = (np.tile(np.arange(40), 19) < 2 * k).astype(int)
    p = k / 20
    bent = {"exact": p, "moved": 1 / (1 + np.exp(-(logit(p) + 0.7))), "stretched": 1 / (1 + np.exp(-2.5 * logit(p)))}
    return score_ladder(long(spark, y, **bent), ["model"])


def test_calibration_of_exact_risks_has_known_answers(exact_risks):
    fits = {r["model"]: r for r in ca.calibration_fits(exact_risks, ["model"]).collect()}
    assert fits["exact"]["calibration_slope"] == pytest.approx(1, abs=1e-6)
    assert fits["exact"]["calibration_intercept"] == pytest.approx(0, abs=1e-6)
    assert fits["moved"]["calibration_slope"] == pytest.approx(1, abs=1e-6)
    assert fits["moved"]["calibration_intercept"] == pytest.approx(-0.7, abs=1e-6)
    assert fits["stretched"]["calibration_slope"] == pytest.approx(1 / 2.5, abs=1e-6)


def test_index_of_exact_risks_is_zero_and_that_of_moved_ones_is_the_shift(exact_risks):
    k = np.arange(1, 20) / 20
    shift = np.abs(1 / (1 + np.exp(-(logit(k) + 0.7))) - k).mean()
    for method, close in (("lowess", 0.02), ("isotonic", 1e-12)):
        found = {r["model"]: r["ici"] for r in ca.integrated_calibration_index(exact_risks, ["model"], method=method).collect()}
        assert found["exact"] == pytest.approx(0, abs=1e-9)
        assert found["moved"] == pytest.approx(shift, abs=close)


def placements(y, p):
    """For each event the share of non-events below it, and the reverse, ties counting half."""
    over = np.sign(p[y == 1][:, None] - p[y == 0][None, :]) / 2 + 0.5
    return over.mean(1), over.mean(0)


def test_delong_against_placements(two):
    y, a, b, scored = two
    (xa, za), (xb, zb) = placements(y, a), placements(y, b)
    r = inf.delong_test(scored, ["strong", "weak"]).first()
    assert (r["auc_a"], r["auc_b"]) == pytest.approx((midrank_auc(y, a), midrank_auc(y, b)), abs=1e-12)
    se = np.sqrt((xa - xb).var(ddof=1) / (y == 1).sum() + (za - zb).var(ddof=1) / (y == 0).sum())
    gap = r["auc_a"] - r["auc_b"]
    assert (r["se"], r["ci_low"], r["ci_high"]) == pytest.approx((se, gap - 1.96 * se, gap + 1.96 * se), abs=1e-3 * se)
    assert r["p_value"] == pytest.approx(two_sided_normal_p(gap / se), rel=1e-6)


def test_delong_without_variance_has_no_p(spark, two):
    y, a, _, _ = two
    r = inf.delong_test(long(spark, y, one=a, double=2 * a), ["one", "double"]).first()
    assert r["difference"] == pytest.approx(0, abs=1e-12) and r["p_value"] is None


def test_one_class_has_no_fit(spark):
    ladder = score_ladder(long(spark, np.zeros(50, dtype=int), m=np.linspace(0.1, 0.9, 50)), ["model"])
    r = ca.calibration_fits(ladder, ["model"]).first()
    assert r["calibration_slope"] is None and r["calibration_intercept"] is None
    assert di.ladder_metrics(ladder, ["model"], ["auroc"]).first()["auroc"] is None


def test_decision_curve_counts_by_hand(two):
    y, a, b, scored = two
    grid = [0.05, float(y.mean()), 0.5]
    rows = di.decision_curve(score_ladder(scored, ["model"]), ["model"], grid).collect()
    assert len(rows) == 6
    for r in rows:
        t, p = r["threshold"], a if r["model"] == "strong" else b
        odds = t / (1 - t)
        assert r["net_benefit_model"] == pytest.approx(((p >= t) & (y == 1)).mean() - ((p >= t) & (y == 0)).mean() * odds, abs=1e-12)
        assert r["net_benefit_treat_all"] == pytest.approx(y.mean() - (1 - y.mean()) * odds, abs=1e-12)
        assert r["net_benefit_treat_none"] == 0


def test_operating_points_by_hand(two):
    y, a, b, scored = two
    ladder = score_ladder(scored, ["model"])
    points = th.long_thresholds(th.select_thresholds(ladder, ["model"]), ["model"])
    for r in th.classification_metrics(ladder, points, ["model"]).collect():
        p = a if r["model"] == "strong" else b
        flagged = p >= r["threshold"]
        assert (r["tp"], r["fp"]) == ((flagged & (y == 1)).sum(), (flagged & (y == 0)).sum())
        assert (r["fn"], r["tn"]) == ((~flagged & (y == 1)).sum(), (~flagged & (y == 0)).sum())
        if r["operating_point"] == "capacity":
            assert r["threshold"] == pytest.approx(np.quantile(p, 0.9))
        if r["operating_point"] == "fixed_sensitivity":
            higher = p > r["threshold"]
            assert r["sensitivity"] >= 0.5 > (higher & (y == 1)).sum() / y.sum()


def test_youden_of_a_useless_score_is_one(spark):
    y = np.array([0, 0, 1, 1])
    ladder = score_ladder(long(spark, y, m=np.array([0.9, 0.8, 0.2, 0.1])), ["model"])
    assert th.select_thresholds(ladder, ["model"]).first()["youden"] == 1.0


@pytest.mark.parametrize("mode", ["exact", "poisson"])
def test_interval_contains_the_estimate(two, mode):
    scored = two[3].where("model = 'strong'")
    for r in bs.bootstrap_ci(scored, ["model"], n_resamples=200, mode=mode).collect():
        assert r["ci_low"] < r["estimate"] < r["ci_high"]
        assert r["n_resamples"] == 200


def test_exact_draws_keep_class_sizes(two):
    y, _, _, scored = two
    rows = scored.where("model = 'strong'").select("row_id", "y")
    sums = bs.bootstrap_draws(rows, "y", "row_id", 5).join(rows, "row_id").groupBy("rep", "y").agg(F.sum("times").alias("n"))
    assert {(r["rep"], r["y"]): r["n"] for r in sums.collect()} == {
        (rep, c): int((y == c).sum()) for rep in range(1, 6) for c in (0, 1)
    }


def test_interval_width_matches_delong(two):
    scored = two[3]
    se = bs.bootstrap_ci(scored.where("model = 'weak'"), ["model"], metrics=["auroc"], n_resamples=300).first()["se"]
    place = inf.placements(scored.where("model = 'weak'")).groupBy("y").agg(F.var_samp("v").alias("v"), F.count("v").alias("n"))
    expected = np.sqrt(sum(r["v"] / r["n"] for r in place.collect()))
    assert se == pytest.approx(expected, rel=0.15)


def holm_of(spark, values, **kw):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, p double")
    return [r["p_adjusted"] for r in inf.holm(df, "p", "id", **kw).orderBy("id").collect()]


def test_holm(spark):
    assert holm_of(spark, [0.01, 0.04, 0.03]) == pytest.approx([0.03, 0.06, 0.06])
    assert holm_of(spark, [None, 0.2]) == pytest.approx([1.0, 0.4])


# Published comparison p-values and their adjusted values.
PUBLISHED = [
    (3.9649727945345603e-10, 2.378983676720736e-09),
    (1.6209256159527285e-14, 1.4588330543574557e-13),
    (3.028688411177427e-13, 2.120081887824199e-12),
    (9.281464485866309e-14, 7.425171588693047e-13),
    (0.028143454604822482, 0.11257381841928993),
    (0.008860965459030146, 0.04430482729515073),
    (0.881622653273646, 1.0),
    (0.9895475954549058, 1.0),
    (0.7699554882515667, 1.0),
]


@pytest.mark.parametrize("buckets", [None, 4])
def test_holm_reproduces_published_values(spark, buckets):
    assert holm_of(spark, [p for p, _ in PUBLISHED], buckets=buckets) == pytest.approx([a for _, a in PUBLISHED], rel=1e-12)


def test_sample_size_reproduces_published_values(spark):
    counts = spark.createDataFrame([(55989, 5028)], "n_available bigint, events bigint")
    r = sample_size_from_counts(counts, 132).first()
    assert (r["minimum_n_criterion1"], r["minimum_n_criterion3"]) == (16796.7, 125.6)
    assert r["events_per_parameter"] == 38.09 and r["adequate"]


def test_ratios_reproduce_published_values(spark):
    df = spark.createDataFrame([(11586, 1155, 1027, 230)], "tn bigint, fp bigint, fn bigint, tp bigint")
    r = df.select(*th.ratio_columns()).first()
    expected = {
        "sensitivity": 0.183, "specificity": 0.9093, "ppv": 0.1661, "npv": 0.9186, "f1": 0.1741,
        "balanced_accuracy": 0.5462, "accuracy": 0.8441, "alert_rate": 0.0989, "nne": 6.0217,
    }
    assert {k: round(r[k], 4) for k in expected} == expected


def test_mcnemar_of_a_model_with_itself(two):
    wide = inf.wide_scores(two[3], ["strong", "weak"])
    r = inf.mcnemar_test(wide, F.col("strong"), F.col("strong"), 0.15, 0.15).first()
    assert (r["n01"], r["n10"], r["statistic"], r["p_value"]) == (0, 0, 0.0, 1.0)


def test_tail_probabilities():
    assert two_sided_sign_p(445, 371) == pytest.approx(0.01055918153603778, rel=1e-9)
    assert two_sided_normal_p(2.3091452778092783) == pytest.approx(0.02093552096292073, rel=1e-9)
    assert two_sided_sign_p(5, 5) == 1.0


CODES = {
    "250.83": "Diabetes", "250": "Diabetes", "428": "Circulatory", "785": "Circulatory", "486": "Respiratory",
    "786": "Respiratory", "577": "Digestive", "787": "Digestive", "996": "Injury", "715": "Musculoskeletal",
    "584": "Genitourinary", "788.2": "Genitourinary", "197": "Neoplasms", "V57": "Other", "E878": "Other",
    "?": "Other", "": "Other", "250d": "Other", " 428 ": "Circulatory", None: "Other",
}


def test_code_groups(spark):
    df = spark.createDataFrame([(c,) for c in CODES], "code string")
    found = {r["code"]: r["g"] for r in df.select("code", fx.icd_group(F.col("code")).alias("g")).collect()}
    assert found == CODES


def test_bracket_midpoints(spark):
    expected = {"[0-10)": 5.0, "[70-80)": 75.0, "[90-100)": 95.0, "?": None, "": None}
    df = spark.createDataFrame([(c,) for c in expected], "b string")
    assert {r["b"]: r["m"] for r in df.select("b", fx.bracket_midpoint(F.col("b")).alias("m")).collect()} == expected


def test_fatal_gate_raises(spark):
    stats = spark.createDataFrame([(3,)], "n int")
    bad = evaluate_gates(stats, [Gate("big", F.col("n") > 5, F.col("n"))])
    with pytest.raises(GateError, match="big"):
        enforce(bad)
    soft = evaluate_gates(stats, [Gate("big", F.col("n") > 5, F.col("n"), fatal=False)])
    assert enforce(soft).first()["passed"] is False
