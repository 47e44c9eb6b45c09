"""What weighed samples must keep to, with the samples that don't."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: fixed values: weights of added, modified and unchanged elements in the two ways of weighing
PROFILES = {"raised": {"added": 2.0, "modified": 2.0, "unchanged": 1.0}, "damped": {"added": 1.0, "modified": 1.0, "unchanged": 0.25}}


def breaches(found: DataFrame, profile: str, base: float) -> DataFrame:
    """(key, breach) of ``samples.processed`` rows: a state with a weight that the profile hasn't got, an action with any but 1, a
    sample that isn't told by its images and its answer alike."""
    weights = F.coalesce("token_weights", F.array().cast("array<double>"))
    known = F.array(*(F.lit(float(w)) for w in sorted({base, *PROFILES[profile].values()})))
    state, odd = F.col("kind") == "state", F.size(F.array_except(weights, known)) > 0
    uneven = F.size(F.array_except(weights, F.array(F.lit(1.0)))) > 0
    breach = F.array_compact(F.array(F.when(state & odd, "weight of a state"), F.when(~state & uneven, "weight of an action"), F.when(~F.col("agrees"), "images and answer")))
    return found.select("key", F.explode(breach).alias("breach"))


def damped_share(found: DataFrame, weight: float) -> DataFrame:
    """One row: states, their tokens and those of one weight, and the share of these (null without a token)."""
    states = found.where("kind = 'state'")
    low = F.size(F.filter("token_weights", lambda w: w == weight))
    sums = states.agg(F.count("*").alias("states"), F.coalesce(F.sum(F.size("token_weights")), F.lit(0)).alias("tokens"), F.coalesce(F.sum(low), F.lit(0)).alias("low"))
    return sums.withColumn("share", F.when(F.col("tokens") > 0, F.col("low") / F.col("tokens")))
