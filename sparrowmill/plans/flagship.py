"""Action-type accuracy per type with a grand total, over consecutive events of a user."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparrowmill.plans.registry import query

FLAGSHIP = "agg06_action_accuracy"


@query(
    FLAGSHIP,
    """
    WITH pairs AS (
      SELECT event_type AS gt, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pred
      FROM events)
    SELECT coalesce(gt, 'overall') AS action_type, count(*) AS n,
           sum(CASE WHEN gt = pred THEN 1 ELSE 0 END) AS n_correct,
           sum(CASE WHEN gt = pred THEN 1 ELSE 0 END)::DOUBLE / count(*) AS accuracy
    FROM pairs WHERE pred IS NOT NULL AND gt IS NOT NULL
    GROUP BY GROUPING SETS ((gt), ())
    """,
)
def action_accuracy(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    hit = F.sum(F.when(F.col("gt") == F.col("pred"), 1).otherwise(0))
    return (
        t["events"]
        .select(F.col("event_type").alias("gt"), F.lead("event_type").over(w).alias("pred"))
        .where("pred IS NOT NULL AND gt IS NOT NULL")
        .rollup("gt")
        .agg(F.count("*").alias("n"), hit.alias("n_correct"), (hit.cast("double") / F.count("*")).alias("accuracy"))
        .select(F.coalesce("gt", F.lit("overall")).alias("action_type"), "n", "n_correct", "accuracy")
    )
