"""One analysis from two exposures to a hazard ratio: dataset, scores, balance, matching or weights, survival."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import staged
from . import cohorts, matching, survival

#: Days of follow-up and of looking back, least prevalence and most columns of covariates, least variance, scores kept.
FOLLOW_UP, LOOK_BACK, LEAST_SHARE, MOST_COLUMNS, LEAST_VARIANCE = 365, 365, 0.01, 100, 0.001


def two_arms(target: DataFrame, comparator: DataFrame, person: DataFrame, outcomes: DataFrame, days: int = FOLLOW_UP) -> DataFrame:
    """person_id, treatment, index_date, time, event, age, male: exposure spans of two arms (the target wins), demographics at index, first outcome after it.

    target, comparator: person_id, cohort_start_date, cohort_end_date. Persons unknown to `person` keep null demographics.
    """
    arms = cohorts.target_wins(target, comparator).select("person_id", "treatment", F.col("cohort_start_date").alias("index_date"))
    arms = arms.groupBy("person_id", "treatment").agg(F.min("index_date").alias("index_date"))
    followed = arms.join(cohorts.first_outcome_after(arms.select("person_id", "index_date"), outcomes, days), "person_id")
    age = (F.year("index_date") - F.col("year_of_birth")).cast("double")
    return followed.join(person.select("person_id", "year_of_birth", "gender_concept_id"), "person_id", "left").select("person_id", "treatment", "index_date", "time", "event", age.alias("age"), (F.col("gender_concept_id") == 8507).cast("double").alias("male"))


def with_history(frame: DataFrame, events: DataFrame, days: int = LOOK_BACK, least: float = LEAST_SHARE, most: int = MOST_COLUMNS) -> tuple[DataFrame, list[str]]:
    """frame with a 0/1 column for each concept that enough persons had in the days before index, the most frequent `most`, and the columns' names.

    Columns are at most `most`, so their ids come to the driver; persons and events do not.
    """
    presence = staged(cohorts.in_lookback(frame, events, days), "history")
    chosen = [r["concept_id"] for r in cohorts.prevalent(presence, frame.agg(F.countDistinct("person_id").alias("n")), least, most).collect()]
    if not chosen:
        return frame, []
    wide = presence.where(F.col("concept_id").isin(chosen)).groupBy("person_id").agg(*(F.max((F.col("concept_id") == i).cast("double")).alias(f"c_{i}") for i in chosen))
    names = [f"c_{i}" for i in chosen]
    return frame.join(wide, "person_id", "left").na.fill(0.0, names), names


def varying(frame: DataFrame, covariates: list[str], least: float = LEAST_VARIANCE) -> list[str]:
    """The covariates whose variance says something."""
    got = frame.agg(*(F.var_samp(c).alias(c) for c in covariates)).first() if covariates else {}
    return [c for c in covariates if (got[c] or 0.0) >= least]


def long_form(frame: DataFrame, covariates: list[str], weight=None) -> DataFrame:
    facts = F.explode(F.array(*(F.struct(F.lit(c).alias("covariate"), F.col(c).alias("value")) for c in covariates))).alias("f")
    return frame.select("treatment", (F.lit(1.0) if weight is None else weight).alias("weight"), facts).select("treatment", "weight", "f.covariate", "f.value")


@dataclass
class Analysis:
    """method: IPTW, PSM, MAHALANOBIS or IPTW (fallback). rows: the rows the outcome model saw, with their weight. hazard: the treatment's log hr, hr, interval, p."""

    method: str
    caliper: float | None
    rows: DataFrame
    balance: DataFrame
    hazard: dict[str, float]


def analysed(frame: DataFrame, covariates: list[str], method: str = "IPTW", stabilised: bool = True) -> Analysis:
    """From a frame (person_id, treatment, time, event, covariates) to the treatment's hazard ratio.

    Covariates that hardly vary go; scores are fitted; PSM and MAHALANOBIS keep matched persons, and where no pair is found
    PSM falls back to weights while MAHALANOBIS is an error. The outcome model has the treatment alone, weighted or on pairs.
    """
    if method not in ("IPTW", "PSM", "MAHALANOBIS"):
        raise ValueError(f"no such method: {method}")
    used = varying(frame, covariates)
    scored = staged(survival.propensity(frame, used) if used else frame.withColumn("ps", F.lit(0.5)), "scored")
    before = survival.smd(long_form(scored, used)) if used else None
    pairs, caliper = None, None
    if method == "PSM":
        pairs, caliper = matching.by_score_or_wider(scored)
        method, pairs = (method, pairs) if caliper is not None else ("IPTW (fallback)", None)
    elif method == "MAHALANOBIS":
        pairs, caliper = matching.by_distance(scored, used), matching.CALIPER
        if not pairs.limit(1).count():
            raise ValueError("no pair within the caliper")
    if pairs is not None:
        chosen = pairs.select(F.explode(F.array("person_id", "control_id")).alias("person_id")).distinct()
        rows = scored.join(chosen, "person_id", "left_semi").withColumn("weight", F.lit(1.0))
    else:
        share = scored.agg(F.avg("treatment").alias("share"))  # one row
        weight = survival.iptw(F.col("ps"), F.col("treatment"), F.col("share") if stabilised else None)
        rows = survival.trimmed(scored.crossJoin(F.broadcast(share)).withColumn("weight", weight).drop("share"))
    rows = staged(rows, "analysed")
    after = survival.weighted_smd(long_form(rows, used, F.col("weight"))) if used else None
    balance = survival.balance_change(before, after) if used else None
    return Analysis(method, caliper, rows, balance, survival.cox(rows, ["treatment"], weight="weight")["treatment"])
