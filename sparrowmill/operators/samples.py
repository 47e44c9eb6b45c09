"""Training samples given token weights, with what went wrong as data beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrowmill.operators import trees, weights

#: fixed values: names of the policies and of what becomes of a sample
POLICIES = ("fail", "uniform", "skip")
ACTION, OK, FAULTY = "action", "ok", "diff_fail"


def kind_of(images: Column, answer: Column) -> tuple[Column, Column]:
    """Whether a sample is an action, and whether its number of images and its answer say the same about that.

    States come with one image and an answer that is markup; where the two disagree, the sample counts as an action.
    """
    by_images = F.coalesce(F.size(images), F.lit(0)) != 1
    by_answer = F.ltrim(F.coalesce(answer, F.lit(""))).startswith("<action>")
    return by_images | by_answer, by_images == by_answer


def fault(current: Column, following: Column) -> Column:
    """Why a state can't be weighed, null if it can: markup that has no element on either side."""
    blank = lambda c: ~F.coalesce(c, F.lit("")).rlike("<[A-Za-z_]")
    return F.when(blank(following), "no next state").when(blank(current), "no current state")


def processed(samples: DataFrame, key: str, images: str, current: str, answer: str, tokens: Column, policy: str = "fail", base: float = 0.25, **table: float) -> DataFrame:
    """``key``, kind, agrees, status, error and token_weights of each sample; ``tokens`` are the (start, end) of its answer's tokens.

    Actions weigh 1 for each token (status action). States weigh by what changed since the current state (ok). A state that can't be
    weighed (diff_fail) is a row with an error, and the policy says what becomes of it: ``skip`` drops it, ``uniform`` gives it a 1
    for each token, and ``fail`` raises when its row is read, with its key.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy is one of {POLICIES}")
    is_action, agrees = kind_of(F.col(images), F.col(answer))
    rows = samples.select(F.col(key).cast("bigint").alias("key"), F.col(current).alias("current"), F.col(answer).alias("answer"), tokens.alias("tokens"), is_action.alias("is_action"), agrees.alias("agrees"))
    rows = rows.withColumn("error", F.when(~F.col("is_action"), fault(F.col("current"), F.col("answer"))))
    sound = rows.where("NOT is_action AND error IS NULL")
    pairs = trees.paired(sound, "key", "current", "answer")
    by_element = pairs.select("key", weights.element_weights(F.col("n_right"), F.col("pairs"), **table).alias("by_element"))
    weighed = sound.join(by_element, "key").withColumn("token_weights", weights.token_weights(F.col("tokens"), weights.element_spans("answer"), F.col("by_element"), base=base)).drop("by_element")
    even = F.transform("tokens", lambda t: F.lit(1.0))
    others = rows.where("is_action OR error IS NOT NULL")
    if policy == "skip":
        others = others.where("error IS NULL")
    elif policy == "fail":
        told = F.concat(F.lit("sample "), F.col("key").cast("string"), F.lit(": "), F.col("error"))
        even = F.when(F.col("error").isNotNull(), F.raise_error(told)).otherwise(even)
    both = weighed.unionByName(others.withColumn("token_weights", even))
    status = F.when(F.col("is_action"), ACTION).when(F.col("error").isNotNull(), FAULTY).otherwise(OK)
    return both.select("key", F.when(F.col("is_action"), "action").otherwise("state").alias("kind"), "agrees", status.alias("status"), "error", "token_weights")


def tally(found: DataFrame) -> DataFrame:
    """Per status: samples, those whose images and answer disagree, tokens, and states whose tokens all weigh the same."""
    flat = F.size(F.array_distinct("token_weights")) <= 1
    return found.groupBy("status").agg(
        F.count("*").alias("samples"),
        F.count_if(~F.col("agrees")).alias("disagree"),
        F.sum(F.size("token_weights")).alias("tokens"),
        F.count_if(flat & (F.col("kind") == "state")).alias("even_states"),
    )
