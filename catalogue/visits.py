"""Orders seen as visits: a table with the hospital preset's columns, derived from ``orders`` by hash.

A customer is a patient and an order a visit. The outcome follows the order's
priority; every other column picks one of its levels by a keyed hash, all levels
alike but for those listed more than once. Spark and SQL share the rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogue.shared import h, table
from veritally.functions.hashing import key_hash
from veritally.plans.hospital import MEDICATIONS

SEED = 11
# Every 31st whole code of 1 to 999, so that each range of the grouping is met, and one of each other form.
CODES = [*map(str, range(3, 1000, 31)), "250.6", "V03", "E900", "?"]
LEVELS = {
    "race": ["?", *(f"group {k}" for k in range(4))],
    "gender": ["Female", "Male"] * 20 + ["Unknown/Invalid"],
    "age": [f"[{a}-{a + 10})" for a in range(0, 100, 10)],
    "weight": ["?", "?", "?", "[50-75)"],
    "admission_type_id": [str(k) for k in range(1, 9)],
    "discharge_disposition_id": [str(k) for k in range(1, 29)],
    "admission_source_id": [str(k) for k in range(1, 27)],
    "payer_code": ["?", "payer 1", "payer 2"],
    "medical_specialty": [*(f"ward {k % 5}" for k in range(150)), *["?"] * 40, "ward 5"],
    "max_glu_serum": ["None", "Norm", ">200", ">300"],
    "A1Cresult": ["None", "Norm", ">7", ">8"],
    "change": ["No", "Ch"],
    "diabetesMed": ["No", "Yes"],
    "diag_1": CODES,
    "diag_2": CODES,
    "diag_3": CODES,
}
WHOLE = {"time_in_hospital": 14, "num_lab_procedures": 90, "num_procedures": 6, "num_medications": 40, "number_diagnoses": 16}
WHOLE |= {"number_outpatient": 3, "number_emergency": 2, "number_inpatient": 4}
MOVING = MEDICATIONS[::6]  # taken by half of the patients; of the others every third by nobody, the rest by hardly any
STATES = ["No", "No", "No", "Steady", "Up", "Down"]


def medication_levels(name: str) -> list[str]:
    if name in MOVING:
        return STATES
    return ["No"] if MEDICATIONS.index(name) % 3 == 1 else []


def order_visits(spark, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")

    def draw(name: str):
        return key_hash(SEED, name, "o_orderkey")

    def pick(name: str, levels: list[str]):
        return F.element_at(F.array(*[F.lit(x) for x in levels]), (F.pmod(draw(name), F.lit(len(levels))) + 1).cast("int"))

    columns = [pick(c, levels).alias(c) for c, levels in LEVELS.items()]
    columns += [F.pmod(draw(c), F.lit(top + 1)).cast("string").alias(c) for c, top in WHOLE.items()]
    for m in MEDICATIONS:
        levels = medication_levels(m)
        rare = F.when(F.pmod(draw(m), F.lit(50_000)) == 0, "Steady").otherwise("No")
        columns.append((pick(m, levels) if levels else rare).alias(m))
    outcome = F.when(F.col("o_orderpriority") == "1-URGENT", "<30").when(F.col("o_orderpriority") == "2-HIGH", ">30").otherwise("NO")
    return orders.select(F.col("o_orderkey").alias("encounter_id"), F.col("o_custkey").alias("patient_nbr"), *columns, outcome.alias("readmitted"))


def visits_cte() -> str:
    def draw(name: str) -> str:
        return h(SEED, name, "o_orderkey")

    def pick(name: str, levels: list[str]) -> str:
        listed = ", ".join(f"'{x}'" for x in levels)
        return f"([{listed}])[{draw(name)} % {len(levels)} + 1]"

    columns = [f"{pick(c, levels)} as \"{c}\"" for c, levels in LEVELS.items()]
    columns += [f'({draw(c)} % {top + 1})::varchar as "{c}"' for c, top in WHOLE.items()]
    for m in MEDICATIONS:
        levels = medication_levels(m)
        rare = f"case when {draw(m)} % 50000 = 0 then 'Steady' else 'No' end"
        columns.append(f'{pick(m, levels) if levels else rare} as "{m}"')
    return f"""encounters as (select o_orderkey as encounter_id, o_custkey as patient_nbr, {', '.join(columns)},
    case o_orderpriority when '1-URGENT' then '<30' when '2-HIGH' then '>30' else 'NO' end as readmitted from orders)"""
