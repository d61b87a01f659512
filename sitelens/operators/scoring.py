"""From check results to scores: a fixed rubric, caps, grades."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens import constants as K


def rubric(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(K.RUBRIC)], "pos int, category string, check_id string, weight int")


def grade(score: Column) -> Column:
    (least, letter), *rest = K.GRADES
    return reduce(lambda c, g: c.when(score >= g[0], g[1]), rest, F.when(score >= least, letter)).otherwise(K.LOWEST_GRADE)


def caps(verdicts: DataFrame, blanket: DataFrame) -> DataFrame:
    """domain, cap, reason where no crawler that cites is allowed; lower if everything is shut to everyone. blanket: domain, blanket."""
    none = verdicts.where("bucket = 'citation'").groupBy("domain").agg(F.count_if("allowed").alias("n")).where("n = 0").select("domain")
    shut = F.coalesce("blanket", F.lit(False))
    return none.join(blanket, "domain", "left").select("domain", F.when(shut, K.CAP_BLANKET).otherwise(K.CAP_NO_CITATION).alias("cap"), F.when(shut, "everything is disallowed for everyone").otherwise("no citation crawler is allowed").alias("reason"))


def scores(sites: DataFrame, results: DataFrame, caps_: DataFrame | None = None) -> DataFrame:
    """domain, category, raw, final, letter, cap_applied. A check without a result counts 0; caps hold for access only."""
    wanted = sites.select("domain").withColumn("check", F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.lit(i).alias("check_id"), F.lit(w).alias("weight")) for c, i, w in K.RUBRIC])))
    wanted = wanted.select("domain", "check.*")
    summed = wanted.join(results.select("domain", "check_id", "ratio"), ["domain", "check_id"], "left").groupBy("domain", "category").agg(F.bround(F.sum(F.col("weight") * F.coalesce("ratio", F.lit(0.0))), 2).alias("raw"))
    if caps_ is None:
        summed = summed.withColumn("cap", F.lit(None).cast("int")).withColumn("reason", F.lit(None).cast("string"))
    else:
        summed = summed.join(caps_, "domain", "left")
    hit = (F.col("category") == "access") & (F.col("raw") > F.col("cap"))
    final = F.when(hit, F.col("cap").cast("double")).otherwise(F.col("raw"))
    return summed.select("domain", "category", "raw", final.alias("final"), grade(final).alias("letter"), F.when(hit, F.col("reason")).alias("cap_applied"))


def below(scores_: DataFrame, threshold: str | float) -> DataFrame:
    """Scores that fail a gate; a blank threshold fails none, one that is no number is an error."""
    if isinstance(threshold, str) and not threshold.strip():
        return scores_.limit(0)
    return scores_.where(F.col("final") < float(threshold))
