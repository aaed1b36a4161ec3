"""Feature queries: codes, recodes, screens, imputation, the hospital matrix."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue.shared import rounded, table
from catalogue.visits import MOVING, WHOLE, order_visits, visits_cte
from veritally.functions import columns as fx
from veritally.operators import features as fe
from veritally.plans import hospital

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

# Code strings derived from part: numeric with decimals, V and E codes, blanks, junk.
CODE_SQL = """case p_partkey % 11 when 0 then 'V' || p_size when 1 then 'E' || (p_partkey % 900) when 2 then '' when 3 then '?'
  when 4 then ' ' || (p_partkey * 37 % 1000) || ' ' when 5 then (p_partkey * 53 % 1000) || 'd'
  else ((p_partkey * 37 + p_size) % 1000)::varchar || '.' || p_size end"""


def _codes(spark, sf):
    key, size = F.col("p_partkey"), F.col("p_size").cast("string")
    m = key % 11
    code = (
        F.when(m == 0, F.concat(F.lit("V"), size))
        .when(m == 1, F.concat(F.lit("E"), (key % 900).cast("string")))
        .when(m == 2, "")
        .when(m == 3, "?")
        .when(m == 4, F.concat(F.lit(" "), (key * 37 % 1000).cast("string"), F.lit(" ")))
        .when(m == 5, F.concat((key * 53 % 1000).cast("string"), F.lit("d")))
        .otherwise(F.concat(((key * 37 + F.col("p_size")) % 1000).cast("string"), F.lit("."), size))
    )
    return table(spark, sf, "part").select("p_partkey", code.alias("code"))


def icd_case(code: str) -> str:
    v = f"(case when regexp_matches(trim({code}), '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)$') then try_cast(trim({code}) as double) end)"
    return f"""case when {v} >= 250 and {v} < 251 then 'Diabetes'
      when ({v} >= 390 and {v} < 460) or floor({v}) = 785 then 'Circulatory'
      when ({v} >= 460 and {v} < 520) or floor({v}) = 786 then 'Respiratory'
      when ({v} >= 520 and {v} < 580) or floor({v}) = 787 then 'Digestive'
      when {v} >= 800 and {v} < 1000 then 'Injury' when {v} >= 710 and {v} < 740 then 'Musculoskeletal'
      when ({v} >= 580 and {v} < 630) or floor({v}) = 788 then 'Genitourinary'
      when {v} >= 140 and {v} < 240 then 'Neoplasms' else 'Other' end"""


def icd(spark, sf):
    return _codes(spark, sf).select("p_partkey", "code", fx.icd_group(F.col("code")).alias("code_group"))


QUERIES["feature_icd_groups"] = icd
ORACLES["feature_icd_groups"] = f"with c as (select p_partkey, {CODE_SQL} as code from part) select p_partkey, code, {icd_case('code')} as code_group from c"


def three_codes(spark, sf):
    e = order_visits(spark, sf)
    groups = {f"diag_{i}_group": fx.icd_group(F.col(f"diag_{i}")) for i in (1, 2, 3)}
    return e.withColumns(groups).select("encounter_id", *groups, fx.distinct_across(list(groups)).alias("breadth"))


QUERIES["feature_code_groups_and_breadth"] = three_codes
ORACLES["feature_code_groups_and_breadth"] = f"""with {visits_cte()}, g as (select encounter_id, {icd_case('diag_1')} as diag_1_group,
    {icd_case('diag_2')} as diag_2_group, {icd_case('diag_3')} as diag_3_group from encounters)
  select *, len(list_distinct([diag_1_group, diag_2_group, diag_3_group]))::int as breadth from g"""


def recodes(spark, sf):
    e = order_visits(spark, sf)
    e = e.select(
        "encounter_id",
        "change",
        fx.recode(F.col("A1Cresult"), hospital.A1C_LEVELS, "Not measured").alias("a1c"),
        fx.recode(F.col("max_glu_serum"), hospital.GLUCOSE_LEVELS, "Not measured").alias("glucose"),
    )
    e = e.withColumns(
        {"a1c_tested": fx.flag_not(F.col("a1c"), "Not measured"), "glucose_tested": fx.flag_not(F.col("glucose"), "Not measured")}
    )
    return e.withColumn("a1c_x_change", fx.interaction(F.col("a1c_tested"), F.col("change"))).drop("change")


RECODE_SQL = """case "A1Cresult" when 'Norm' then 'Norm' when '>7' then '>7' when '>8' then '>8' else 'Not measured' end as a1c,
  case max_glu_serum when 'Norm' then 'Normal' when '>200' then 'Elevated' when '>300' then 'Elevated' else 'Not measured' end as glucose"""
QUERIES["feature_recode_flag_interaction"] = recodes
ORACLES["feature_recode_flag_interaction"] = f"""with {visits_cte()}, r as (select encounter_id, change, {RECODE_SQL} from encounters)
  select encounter_id, a1c, glucose, (a1c <> 'Not measured')::int as a1c_tested, (glucose <> 'Not measured')::int as glucose_tested,
    (a1c <> 'Not measured')::int || '_' || change as a1c_x_change from r"""


def ages(spark, sf):
    e = order_visits(spark, sf).withColumn(
        "age", F.when(F.col("encounter_id") % 17 == 0, "?").when(F.col("encounter_id") % 23 == 0, F.lit(None)).otherwise(F.col("age"))
    )
    mid = fx.bracket_midpoint(F.col("age"))
    return e.select("encounter_id", "age", mid.alias("midpoint"), fx.age_band(mid).alias("band"))


QUERIES["feature_bracket_midpoint_and_band"] = ages
ORACLES["feature_bracket_midpoint_and_band"] = f"""with {visits_cte()},
  a as (select encounter_id, case when encounter_id % 17 = 0 then '?' when encounter_id % 23 = 0 then null else age end as age from encounters),
  m as (select *, try_cast(regexp_extract(age, '^[\\[)]*([0-9]+)-', 1) as int) + 5.0::double as midpoint from a)
  select *, case when midpoint is null then 'Unknown' when midpoint < 40 then '<40' when midpoint < 65 then '40-64'
    when midpoint < 80 then '65-79' else '>=80' end as band from m"""


def labels(spark, sf):
    codes = table(spark, sf, "nation").where(F.col("n_regionkey") != 3).select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("label"))
    return fe.code_labels(table(spark, sf, "customer"), "c_nationkey", codes, "nation").select("c_custkey", "nation")


QUERIES["feature_code_labels"] = labels
ORACLES["feature_code_labels"] = """select c_custkey, coalesce(n_name, 'Unknown') as nation from customer
  left join nation on c_nationkey = n_nationkey and n_regionkey <> 3"""


def medication_share(spark, sf):
    shares = fe.active_share(order_visits(spark, sf), hospital.MEDICATIONS)
    return rounded(shares).withColumn("kept", F.col("active_share") >= 0.005)


QUERIES["feature_near_zero_variance"] = medication_share
ORACLES["feature_near_zero_variance"] = f"with {visits_cte()} " + " union all ".join(
    f"""select '{m}' as variable, round(avg(("{m}" <> 'No')::int), 6) as active_share, round(avg(("{m}" <> 'No')::int), 6) >= 0.005 as kept
    from encounters"""
    for m in hospital.MEDICATIONS
)


def medication_counts(spark, sf):
    names = [f"`{m}`" for m in hospital.MEDICATIONS]
    e = hospital.typed(order_visits(spark, sf))
    return e.select(
        "encounter_id",
        fx.count_matching(names, lambda c: ~c.eqNullSafe("No")).alias("n_active"),
        fx.count_matching(names, lambda c: c.isin("Up", "Down")).alias("n_changed"),
        fx.row_total(["number_outpatient", "number_emergency", "number_inpatient"]).alias("prior_total"),
    )


QUERIES["feature_row_counts_and_totals"] = medication_counts
ORACLES["feature_row_counts_and_totals"] = f"""with {visits_cte()} select encounter_id,
  {' + '.join(f'''("{m}" <> 'No')::int''' for m in hospital.MEDICATIONS)} as n_active,
  {' + '.join(f'''("{m}" in ('Up', 'Down'))::int''' for m in hospital.MEDICATIONS)} as n_changed,
  number_outpatient::bigint + number_emergency::bigint + number_inpatient::bigint as prior_total from encounters"""


def rare_levels(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", "lang", F.concat_ws("/", "source", "lang").alias("origin"))
    return fe.collapse_rare(df, ["origin", "lang"], 0.02).select("doc_id", "origin", "lang")


QUERIES["feature_rare_levels"] = rare_levels
ORACLES["feature_rare_levels"] = """with d as (select doc_id, lang, source || '/' || lang as origin from documents),
  o as (select origin, count(*)::double / (select count(origin) from d) as share from d group by origin),
  l as (select lang, count(*)::double / (select count(lang) from d) as share from d group by lang)
  select doc_id, case when o.share < 0.02 then 'Other' else d.origin end as origin,
    case when l.share < 0.02 then 'Other' else d.lang end as lang from d join o using (origin) join l using (lang)"""


def top_levels(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_brand")
    return fe.collapse_rare(df, ["p_brand"], keep_top=10)


QUERIES["feature_top_levels"] = top_levels
ORACLES["feature_top_levels"] = """with t as (select p_brand from part group by p_brand order by count(*) desc, p_brand limit 10)
  select p_partkey, case when p_brand in (select p_brand from t) then p_brand else 'Other' end as p_brand from part"""


def unknown_levels(spark, sf):
    df = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "P", "?").otherwise(F.col("o_orderstatus")).alias("status"),
        F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.lit(None)).otherwise(F.col("o_orderpriority")).alias("priority"),
    )
    return fe.explicit_unknown(df, hospital.MISSING_TOKENS)


QUERIES["feature_explicit_unknown"] = unknown_levels
ORACLES["feature_explicit_unknown"] = """select o_orderkey, case when o_orderstatus = 'P' then 'Unknown' else o_orderstatus end as status,
  case when o_orderpriority = '4-NOT SPECIFIED' then 'Unknown' else o_orderpriority end as priority from orders"""


def _gaps(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey",
        F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("balance"),
        F.when(F.col("c_custkey") % 5 != 0, F.col("c_nationkey").cast("double")).alias("nation"),
    )


GAPS_SQL = """g as (select c_custkey, case when c_custkey % 7 <> 0 then c_acctbal end as balance,
    case when c_custkey % 5 <> 0 then c_nationkey::double end as nation from customer)"""


def imputed(spark, sf):
    return rounded(fe.impute_median(_gaps(spark, sf)))


QUERIES["feature_median_imputation"] = imputed
ORACLES["feature_median_imputation"] = f"""with {GAPS_SQL} select c_custkey,
  round(coalesce(balance, (select quantile_cont(balance, 0.5) from g)), 6) as balance,
  round(coalesce(nation, (select quantile_cont(nation, 0.5) from g)), 6) as nation from g"""


def completeness(spark, sf):
    gaps = _gaps(spark, sf)
    return fe.completeness_gates(gaps, fe.impute_median(gaps)).withColumn("stage", F.lit("after")).unionByName(
        fe.completeness_gates(gaps, gaps).withColumn("stage", F.lit("before"))
    )


QUERIES["feature_completeness_gates"] = completeness
ORACLES["feature_completeness_gates"] = f"""with {GAPS_SQL}, n as (select count(*) as n, sum((balance is null)::int + (nation is null)::int)::bigint as miss from g)
  select 'no_row_deletion' as name, true as passed, true as fatal, 'rows = ' || n as detail, 'after' as stage from n
  union all select 'no_row_deletion', true, true, 'rows = ' || n, 'before' from n
  union all select 'zero_missing', true, true, 'missing = 0', 'after' from n
  union all select 'zero_missing', miss = 0, true, 'missing = ' || miss, 'before' from n"""


def logits(spark, sf):
    p = F.col("l_discount") * 10
    return rounded(
        table(spark, sf, "lineitem").groupBy("l_discount").agg(F.count(F.lit(1)).alias("n")).select(
            "l_discount", "n", fx.clip_probability(p).alias("clipped"), fx.logit(p).alias("logit")
        )
    )


QUERIES["feature_clip_and_logit"] = logits
ORACLES["feature_clip_and_logit"] = """with d as (select l_discount, count(*) as n, least(greatest(l_discount * 10, 1e-12::double), 1 - 1e-12::double) as p
    from lineitem group by l_discount)
  select round(l_discount, 6) as l_discount, n, round(p, 6) as clipped, round(ln(p / (1 - p)), 6) as logit from d"""

# --- the hospital preset ---------------------------------------------------------

COHORT_CTE = """kept as (select * from encounters where not coalesce(discharge_disposition_id in ('11', '13', '14', '19', '20', '21'), false)
    and not coalesce(gender = 'Unknown/Invalid', false)),
  cohort as (select *, (readmitted = '<30')::int as target from
    (select *, row_number() over (partition by patient_nbr order by encounter_id) as rn from kept) where rn = 1)"""


def hospital_flow(spark, sf):
    return hospital.flow(order_visits(spark, sf)).select("step_no", "n", "excluded")


QUERIES["hospital_participant_flow"] = hospital_flow
ORACLES["hospital_participant_flow"] = f"""with {visits_cte()}, {COHORT_CTE},
  s0 as (select count(*) as n from encounters),
  s1 as (select count(*) as n from encounters where discharge_disposition_id not in ('11', '13', '14', '19', '20', '21')),
  s2 as (select count(*) as n from kept), s3 as (select count(*) as n from cohort)
  select 0 as step_no, n, 0::bigint as excluded from s0 union all select 1, s1.n, s0.n - s1.n from s0, s1
  union all select 2, s2.n, s1.n - s2.n from s1, s2 union all select 3, s3.n, s2.n - s3.n from s2, s3
  union all select 4, s3.n, 0 from s3"""

MATRIX = [
    "row_id", "target", "race", "payer_code", "medical_specialty", "admission_type", "admission_source",
    "discharge_disposition", "diag_1_group", "comorbidity_breadth", "A1Cresult", "max_glu_serum", "A1C_tested",
    "glucose_tested", "A1C_tested_x_change", "age_midpoint", "age_band", "n_diabetes_meds", "n_meds_changed",
    "prior_utilisation_total", "gender", "change", "diabetesMed", "diag_2_group", "diag_3_group", *WHOLE, *MOVING,
]


def hospital_matrix(spark, sf):
    matrix, _ = hospital.analysis_matrix(hospital.cohort(order_visits(spark, sf)))
    return matrix if set(matrix.columns) != set(MATRIX) else matrix.select(*MATRIX)


def _label_case(column: str, labels: dict) -> str:
    return f"case {column} " + " ".join(f"when '{k}' then '{v}'" for k, v in labels.items()) + " else 'Unknown' end"


def _collapsed(c: str) -> str:
    return f"case when {c} in (select {c} from featured group by {c} having count(*)::double / (select count(*) from featured) < 0.01) then 'Other' else {c} end"


def _unknown(c: str) -> str:
    return f"case when {c} in ('?', '', 'NULL', 'Unknown/Invalid') then 'Unknown' else {c} end"


QUERIES["hospital_analysis_matrix"] = hospital_matrix
ORACLES["hospital_analysis_matrix"] = f"""with {visits_cte()}, {COHORT_CTE},
  featured as (select encounter_id as row_id, target, race, payer_code, medical_specialty, gender, "diabetesMed",
    {icd_case('diag_2')} as diag_2_group, {icd_case('diag_3')} as diag_3_group, {', '.join(f'{c}::bigint as {c}' for c in WHOLE)},
    {', '.join(f'"{m}"' for m in MOVING)},
    {_label_case('admission_type_id', hospital.ADMISSION_TYPE)} as admission_type,
    {_label_case('admission_source_id', hospital.ADMISSION_SOURCE)} as admission_source,
    {_label_case('discharge_disposition_id', hospital.DISCHARGE)} as discharge_disposition,
    {icd_case('diag_1')} as diag_1_group,
    len(list_distinct([{icd_case('diag_1')}, {icd_case('diag_2')}, {icd_case('diag_3')}]))::int as comorbidity_breadth,
    {RECODE_SQL}, change, try_cast(regexp_extract(age, '^[\\[)]*([0-9]+)-', 1) as int) + 5.0::double as age_midpoint,
    {' + '.join(f'''("{m}" <> 'No')::int''' for m in hospital.MEDICATIONS)} as n_diabetes_meds,
    {' + '.join(f'''("{m}" in ('Up', 'Down'))::int''' for m in hospital.MEDICATIONS)} as n_meds_changed,
    number_outpatient::bigint + number_emergency::bigint + number_inpatient::bigint as prior_utilisation_total from cohort)
  select row_id, target, gender, change, "diabetesMed", diag_2_group, diag_3_group, {', '.join(WHOLE)}, {', '.join(f'"{m}"' for m in MOVING)},
    {_unknown('race')} as race, {_unknown('payer_code')} as payer_code,
    {_unknown(_collapsed('medical_specialty'))} as medical_specialty, {_collapsed('admission_type')} as admission_type,
    {_collapsed('admission_source')} as admission_source, {_collapsed('discharge_disposition')} as discharge_disposition,
    diag_1_group, comorbidity_breadth, a1c as "A1Cresult", glucose as max_glu_serum, (a1c <> 'Not measured')::int as "A1C_tested",
    (glucose <> 'Not measured')::int as glucose_tested, (a1c <> 'Not measured')::int || '_' || change as "A1C_tested_x_change",
    age_midpoint, case when age_midpoint is null then 'Unknown' when age_midpoint < 40 then '<40' when age_midpoint < 65 then '40-64'
    when age_midpoint < 80 then '65-79' else '>=80' end as age_band, n_diabetes_meds, n_meds_changed, prior_utilisation_total from featured"""
