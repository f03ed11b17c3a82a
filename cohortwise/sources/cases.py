"""Nested case records to one flat row each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.functions.numeric import finite
from cohortwise.functions.text import clean_text, first_usable, max_numeric, norm_missing

CASE_SCHEMA = """
case_id string, submitter_id string, project struct<project_id: string>,
demographic struct<gender: string, vital_status: string, days_to_death: string, days_to_last_follow_up: string>,
diagnoses array<struct<age_at_diagnosis: string, ajcc_pathologic_stage: string, ajcc_clinical_stage: string,
  days_to_last_follow_up: string, days_to_recurrence: string, tumor_grade: string>>,
follow_ups array<struct<days_to_follow_up: string, progression_or_recurrence: string>>
"""

# Follow-up answers that count as a recurrence, and days per year.
RECURRENCE_WORDS = ["yes", "progression", "recurrence"]
DAYS_PER_YEAR = 365.25


def flatten_cases(cases: DataFrame) -> DataFrame:
    dx, fu, demo = F.col("diagnoses"), F.col("follow_ups"), F.col("demographic")
    follow = F.concat(
        F.array(demo["days_to_last_follow_up"]),
        F.coalesce(F.transform(dx, lambda d: d["days_to_last_follow_up"]), F.array().cast("array<string>")),
        F.coalesce(F.transform(fu, lambda f: f["days_to_follow_up"]), F.array().cast("array<string>")),
    )
    death = finite(norm_missing(demo["days_to_death"]).try_cast("double"))
    vital = clean_text(demo["vital_status"])
    again = F.coalesce(F.exists(fu, lambda f: F.coalesce(F.lower(f["progression_or_recurrence"]).isin(RECURRENCE_WORDS), F.lit(False))),
                       F.lit(False))
    recurrence_days = first_usable(dx, ["days_to_recurrence"])
    age = finite(first_usable(dx, ["age_at_diagnosis"]).try_cast("double"))
    return cases.select(
        "case_id",
        F.col("submitter_id").alias("entity"),
        F.col("project.project_id").alias("cohort"),
        F.round(age / F.lit(DAYS_PER_YEAR), 2).alias("age"),
        clean_text(demo["gender"]).alias("sex"),
        clean_text(first_usable(dx, ["ajcc_pathologic_stage", "ajcc_clinical_stage"])).alias("stage"),
        clean_text(first_usable(dx, ["tumor_grade"])).alias("grade"),
        F.when(recurrence_days.isNotNull() | again, "Yes").otherwise("Not Reported").alias("recurrence"),
        F.coalesce(death, max_numeric(follow)).alias("survival_time"),
        F.when(F.lower(vital) == "dead", "1").when(vital != "Not Reported", "0").alias("survival_event"),
        vital.alias("vital_status"),
    )
