"""Changes of the screen element by element, and the check that they add up to what the rows say."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrowmill.operators import trees
from sparrowmill.operators.trees import f1, share

STRICT = 0.9


def _long(pairs: DataFrame) -> DataFrame:
    return pairs.select("key", F.explode("pairs").alias("x")).select("key", "x.l", "x.r", "x.sim")


def _places(pairs: DataFrame, n: str) -> DataFrame:
    return pairs.where(F.col(n) > 0).select("key", F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("pos"))


def changed(pairs: DataFrame, emptied: bool = True) -> DataFrame:
    """(key, kind, pos): A (added) and M (modified) elements of the next tree (right), D (deleted) ones of the current (left).

    An empty next tree deletes all if ``emptied``, else nothing.
    """
    long = _long(pairs)
    added = _places(pairs, "n_right").join(long.select("key", F.col("r").alias("pos")), ["key", "pos"], "left_anti").withColumn("kind", F.lit("A"))
    modified = long.where("sim < 1").select("key", F.col("r").alias("pos"), F.lit("M").alias("kind"))
    claims = pairs if emptied else pairs.where("n_right > 0")
    deleted = _places(claims, "n_left").join(long.select("key", F.col("l").alias("pos")), ["key", "pos"], "left_anti").withColumn("kind", F.lit("D"))
    return reduce(DataFrame.unionByName, (added, modified, deleted)).select("key", "kind", "pos")


def marks(current_true: DataFrame) -> DataFrame:
    """(key, tree, pos, mark) of what should change: deleted elements of the current tree, added and modified ones of the next."""
    tree = F.when(F.col("kind") == "D", "current").otherwise("next")
    mark = F.element_at(F.create_map(*(F.lit(x) for x in ("D", "deleted", "A", "added", "M", "modified"))), F.col("kind"))
    return changed(current_true).select("key", tree.alias("tree"), "pos", mark.alias("mark"))


def audited(current_true: DataFrame, current_pred: DataFrame, pred_true: DataFrame, strict: float = STRICT) -> DataFrame:
    """``of_states`` of three pairings of the same keys."""
    return of_states(trees.joined(current_true, current_pred, pred_true), strict)


def _runs(sizes: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First place of each row's elements where all follow each other, and each element's row and place in it."""
    n = sizes.to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.cumsum(n) - n
    row = np.repeat(np.arange(len(n)), n)
    return first, row, np.arange(len(row)) - first[row]


def _flat(lists: pa.ListArray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both ends of all pairs, as places among the elements of all rows, and their similarities."""
    row = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64).cumsum()
    ends = lists.flatten()
    at = np.searchsorted(row, np.arange(len(ends)), side="right")
    column = lambda n: ends.field(n).to_numpy(zero_copy_only=False)
    return left[at] + column("l"), right[at] + column("r"), column("sim")


def of_states(states: DataFrame, strict: float = STRICT) -> DataFrame:
    """(key, side, kind, pos, other, sim, outcome) of each change that the true next state asks for and that the predicted one claims, from ``trees.states``.

    True side: strict or loose hit, copied (paired with an element that the prediction left as it was) or missed. Predicted side:
    strict or loose hit, nochange (paired with one that stays) or made up. Shared deletions are strict hits; other ones are missed
    or made up. ``other`` is the paired element's place. All that a state needs is in its row, so nothing is joined.
    """
    schema = pa.schema([("key", pa.int64()), ("side", pa.string()), ("kind", pa.string()), ("pos", pa.int32()), ("other", pa.int32()), ("sim", pa.float64()), ("outcome", pa.string())])

    def rows(key, name, row, pos, kind, other, sim, outcome):
        columns = [key.take(pa.array(row)), pa.array([name] * len(row), pa.string()), pa.array(kind, pa.string()), pa.array(pos, pa.int32()), pa.array(other, pa.int32(), mask=other < 0), pa.array(sim, mask=other < 0), pa.array(outcome, pa.string())]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def moves(key, name, run, changed, paired, other_run, other_changed, sim, same, none):
        """Added and modified elements of one side, paired with those of the other."""
        (_, row, pos), at = run, np.flatnonzero(changed > 0)
        other = paired[at]
        hit = (other >= 0) & (other_changed[other] > 0) if len(other_changed) else np.zeros(len(at), bool)
        outcome = np.where(other < 0, none, np.where(~hit, same, np.where(sim[at] >= strict, "strict", "loose")))
        place = np.where(other >= 0, other_run[2][other], -1) if len(other_run[2]) else np.full(len(at), -1)
        return rows(key, name, row[at], pos[at], np.where(changed[at] == 2, "M", "A"), place, sim[at], outcome)

    def audit(batches):
        for batch in batches:
            for part in (batch.slice(at, trees.PAGES) for at in range(0, len(batch), trees.PAGES)):
                key, *sizes = (part.column(k) for k in range(4))
                cur, true, pred = (_runs(n) for n in sizes)
                changed = []  # 1 added, 2 modified, 0 unchanged elements of the true and of the predicted state
                gone = []
                for which, run in ((4, true), (5, pred)):
                    left, right, sim = _flat(part.column(which), cur[0], run[0])
                    kind, lost = np.ones(len(run[1]), np.int8), np.ones(len(cur[1]), bool)
                    kind[right], lost[left] = np.where(sim < 1, 2, 0), False
                    changed.append(kind)
                    gone.append(lost)
                gone[1] &= (sizes[2].to_numpy(zero_copy_only=False) > 0)[cur[1]]  # a prediction without elements claims nothing
                left, right, sim = _flat(part.column(6), pred[0], true[0])
                ends = []
                for run, mine, theirs in ((true, right, left), (pred, left, right)):
                    other, alike = np.full(len(run[1]), -1), np.full(len(run[1]), np.nan)
                    other[mine], alike[mine] = theirs, sim
                    ends.append((other, alike))
                yield moves(key, "true", true, changed[0], ends[0][0], pred, changed[1], ends[0][1], "copied", "missed")
                yield moves(key, "predicted", pred, changed[1], ends[1][0], true, changed[0], ends[1][1], "nochange", "made_up")
                for name, mine, theirs, none in (("true", *gone, "missed"), ("predicted", *gone[::-1], "made_up")):
                    at = np.flatnonzero(mine)
                    nothing = np.full(len(at), -1)
                    yield rows(key, name, cur[1][at], cur[2][at], ["D"] * len(at), nothing, np.full(len(at), np.nan), np.where(theirs[at], "strict", none))

    names = ["key", "n_cur", "n_true", "n_pred", "current_true", "current_pred", "pred_true"]
    return states.select(*names).mapInArrow(audit, "key bigint, side string, kind string, pos int, other int, sim double, outcome string")


def summed(audit: DataFrame, current_true: DataFrame) -> DataFrame:
    """Per key the counts and scores that the audit's rows give; keys without any change have zeros."""
    of = lambda side, *cond: F.count_if(reduce(Column.__and__, cond, F.col("side") == side))
    moved, hit = F.col("kind") != "D", F.col("outcome")
    counted = audit.groupBy("key").agg(
        of("true").alias("n_change_true"),
        of("predicted").alias("n_change_pred"),
        of("true", hit == "strict").alias("strict_hits"),
        of("true", hit.isin("strict", "loose")).alias("loose_hits"),
        of("true", ~moved).alias("deleted_true"),
        of("true", moved).alias("n_addmod"),
        of("true", moved, F.col("other").isNotNull()).alias("n_addmod_hit"),
    )
    rows = current_true.select("key", F.col("n_left").alias("n_cur")).join(counted, "key", "left").fillna(0)
    score = lambda hits: f1(share(F.col(hits), F.col("n_change_pred")), share(F.col(hits), F.col("n_change_true")))
    floor = f1(share(F.col("deleted_true"), F.col("n_cur")), share(F.col("deleted_true"), F.col("n_change_true")))
    four = {"change_f1_strict": score("strict_hits"), "change_f1_loose": score("loose_hits"), "change_f1_floor": floor, "addmod_recall": F.when(F.col("n_addmod") > 0, F.col("n_addmod_hit") / F.col("n_addmod"))}
    return rows.select("*", *(F.round(c, 4).alias(n) for n, c in four.items()))


#: what both derivations say, and the scores that are defined only where anything changes
COUNTS, SCORES = ("n_change_true", "n_change_pred"), ("change_f1_strict", "change_f1_loose", "change_f1_floor", "addmod_recall")


def differences(by_audit: DataFrame, by_row: DataFrame) -> DataFrame:
    """(key, measure, audit, row) wherever the audit and the rows of ``trees.state_diff`` disagree, or only one of them has the key.

    Scores are compared where the row defines them.
    """
    long = lambda df, name: df.select("key", F.explode(F.array(*(F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias(name)) for c in (*COUNTS, *SCORES)))).alias("x")).select("key", "x.*")
    both = long(by_audit, "audit").join(long(by_row, "row"), ["key", "measure"], "full")
    lone = by_audit.select("key").join(by_row.select("key"), "key", "full").join(by_audit.select("key", F.lit(1).alias("in_audit")), "key", "left").join(by_row.select("key", F.lit(1).alias("in_row")), "key", "left")
    lone = lone.where("in_audit IS NULL OR in_row IS NULL").select("key", F.lit("key").alias("measure"), F.col("in_audit").cast("double").alias("audit"), F.col("in_row").cast("double").alias("row"))
    known = both.join(lone.select("key"), "key", "left_anti").where(F.col("measure").isin(*COUNTS) | F.col("row").isNotNull())
    return known.where("NOT (audit <=> row)").select("key", "measure", "audit", "row").unionByName(lone)
