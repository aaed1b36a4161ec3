"""Preset for the hospital encounter schema: constants, cohort and feature build."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritally.functions import columns as fx
from veritally.operators.bounded import stored
from veritally.operators.cohort import Exclusion, binary_outcome, code_in, derive_cohort, participant_flow
from veritally.operators.features import collapse_rare, explicit_unknown, impute_median, near_zero_variance
from veritally.sources.tables import coerce_numeric

# Column names, code lists and label maps of the encounter schema.
MEDICATIONS = [
    "metformin", "repaglinide", "nateglinide", "chlorpropamide", "glimepiride", "acetohexamide",
    "glipizide", "glyburide", "tolbutamide", "pioglitazone", "rosiglitazone", "acarbose",
    "miglitol", "troglitazone", "tolazamide", "examide", "citoglipton", "insulin",
    "glyburide-metformin", "glipizide-metformin", "glimepiride-pioglitazone",
    "metformin-rosiglitazone", "metformin-pioglitazone",
]
NUMERIC = {
    "encounter_id": "bigint",
    "patient_nbr": "bigint",
    "admission_type_id": "bigint",
    "discharge_disposition_id": "bigint",
    "admission_source_id": "bigint",
    "time_in_hospital": "bigint",
    "num_lab_procedures": "bigint",
    "num_procedures": "bigint",
    "num_medications": "bigint",
    "number_outpatient": "bigint",
    "number_emergency": "bigint",
    "number_inpatient": "bigint",
    "number_diagnoses": "bigint",
}
MISSING_TOKENS = ["?", "", "NULL", "Unknown/Invalid"]
DEATH_OR_HOSPICE = [11, 13, 14, 19, 20, 21]
ADMISSION_TYPE = {1: "Emergency", 2: "Urgent", 3: "Elective", 4: "Newborn", 7: "Trauma"}
ADMISSION_SOURCE = {
    1: "Physician referral",
    2: "Clinic referral",
    3: "HMO referral",
    4: "Transfer from hospital",
    5: "Transfer from SNF",
    6: "Transfer from other facility",
    7: "Emergency room",
    8: "Court/law enforcement",
}
DISCHARGE = {
    1: "Home",
    2: "Short-term hospital",
    3: "SNF",
    4: "ICF",
    5: "Other inpatient care",
    6: "Home health service",
    7: "Left AMA",
    8: "Home IV provider",
    9: "Readmitted same institution",
    10: "Neonate discharge",
    12: "Still patient",
    15: "Swing bed",
    16: "Outpatient other facility",
    17: "Outpatient this institution",
    22: "Rehab facility",
    23: "Long-term care",
    24: "Medicaid nursing",
    27: "Federal hospital",
    28: "Psychiatric hospital",
    29: "Critical access",
    30: "Other facility",
}
A1C_LEVELS = {"None": "Not measured", "Norm": "Norm", ">7": ">7", ">8": ">8"}
GLUCOSE_LEVELS = {"None": "Not measured", "Norm": "Normal", ">200": "Elevated", ">300": "Elevated"}
RARE_COLUMNS = ["admission_type", "admission_source", "discharge_disposition", "medical_specialty"]
UNKNOWN_COLUMNS = ["race", "medical_specialty", "payer_code"]
GLYCAEMIC = ["A1Cresult", "max_glu_serum", "A1C_tested", "glucose_tested", "A1C_tested_x_change"]
FORBIDDEN = ["encounter_id", "patient_nbr", "readmitted"]
FAIRNESS = ["race", "gender", "age_band"]
PARSIMONIOUS = ["number_inpatient", "number_emergency", "number_diagnoses", "time_in_hospital", "age_midpoint"]
ROW_ID, TARGET = "row_id", "target"


def exclusions(drop_unknown_gender: bool = True) -> list[Exclusion]:
    out = [
        Exclusion(
            "without discharge_disposition_id " + "/".join(map(str, DEATH_OR_HOSPICE)),
            code_in("discharge_disposition_id", DEATH_OR_HOSPICE),
            "died or left for terminal care",
        )
    ]
    if drop_unknown_gender:
        out.append(
            Exclusion("without gender Unknown/Invalid", F.col("gender") == "Unknown/Invalid", "gender not recorded")
        )
    return out


def typed(raw: DataFrame) -> DataFrame:
    return coerce_numeric(raw, NUMERIC)


def cohort(raw: DataFrame, drop_unknown_gender: bool = True) -> DataFrame:
    """First eligible encounter per patient with the early-readmission outcome."""
    outcome = binary_outcome("readmitted", "<30")
    return derive_cohort(typed(raw), exclusions(drop_unknown_gender), "patient_nbr", "encounter_id", outcome, TARGET)


def flow(raw: DataFrame, drop_unknown_gender: bool = True) -> DataFrame:
    outcome = binary_outcome("readmitted", "<30")
    return participant_flow(typed(raw), exclusions(drop_unknown_gender), "patient_nbr", "encounter_id", outcome)


def row_features(rows: DataFrame) -> DataFrame:
    """All row-wise features; every expression is JVM-side and one projection."""
    present = [c for c in MEDICATIONS if c in rows.columns]
    groups = [f"diag_{i}_group" for i in (1, 2, 3)]
    out = rows.withColumns({g: fx.icd_group(F.col(g.removesuffix("_group"))) for g in groups})
    out = out.withColumns(
        {
            "comorbidity_breadth": fx.distinct_across(groups),
            "A1Cresult": fx.recode(F.col("A1Cresult"), A1C_LEVELS, "Not measured"),
            "max_glu_serum": fx.recode(F.col("max_glu_serum"), GLUCOSE_LEVELS, "Not measured"),
            "age_midpoint": fx.bracket_midpoint(F.col("age")),
            "admission_type": fx.recode(F.col("admission_type_id").cast("int"), ADMISSION_TYPE, "Unknown"),
            "admission_source": fx.recode(F.col("admission_source_id").cast("int"), ADMISSION_SOURCE, "Unknown"),
            "discharge_disposition": fx.recode(F.col("discharge_disposition_id").cast("int"), DISCHARGE, "Unknown"),
            "n_diabetes_meds": fx.count_matching([f"`{c}`" for c in present], lambda c: ~c.eqNullSafe("No")),
            "n_meds_changed": fx.count_matching([f"`{c}`" for c in present], lambda c: c.isin("Up", "Down")),
            "prior_utilisation_total": fx.row_total(["number_outpatient", "number_emergency", "number_inpatient"]),
        }
    )
    out = out.withColumns(
        {
            "A1C_tested": fx.flag_not(F.col("A1Cresult"), "Not measured"),
            "glucose_tested": fx.flag_not(F.col("max_glu_serum"), "Not measured"),
            "age_band": fx.age_band(F.col("age_midpoint")),
        }
    )
    return out.withColumn("A1C_tested_x_change", fx.interaction(F.col("A1C_tested"), F.col("change")))


@dataclass
class Screens:
    """What the data-driven steps learned."""

    dropped_medications: list[str]


def analysis_matrix(
    cohort_rows: DataFrame,
    nzv_threshold: float = 0.005,
    rare_threshold: float = 0.01,
    specialty_top: int | None = None,
    fit_on: DataFrame | None = None,
) -> tuple[DataFrame, Screens]:
    """Engineered features, screens, explicit Unknown levels; ``row_id`` stays outside the features.

    Screens are learned on the whole cohort by default, or on ``fit_on`` (say, the
    development rows of the cohort).
    """
    rows = stored(row_features(cohort_rows))
    learn = rows if fit_on is None else row_features(fit_on)
    present = [c for c in MEDICATIONS if c in rows.columns]
    dropped = near_zero_variance(learn, present, nzv_threshold)
    rows = collapse_rare(rows, RARE_COLUMNS, rare_threshold, fit_on=learn)
    if specialty_top is not None:
        rows = collapse_rare(rows, ["medical_specialty"], keep_top=specialty_top, fit_on=learn)
    unused = ["weight", "patient_nbr", "diag_1", "diag_2", "diag_3", "age", "readmitted"]
    unused += ["admission_type_id", "discharge_disposition_id", "admission_source_id", *dropped]
    rows = rows.withColumnRenamed("encounter_id", ROW_ID).drop(*unused)
    rows = explicit_unknown(rows, MISSING_TOKENS)
    return impute_median(rows, fit_on=None if fit_on is None else learn), Screens(dropped)
