"""Operators on UI markup: elements as rows, pairs of trees, and what is counted from the pairs with column expressions."""

from __future__ import annotations

import pickle
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from sparrowmill.functions import markup, matching
from sparrowmill.operators.ordering import held, spread

#: elements and pages after which a task hands on what it has
ROWS, PAGES = 20_000, 200
PAIRS = "array<struct<l:int,r:int,cost:double,sim:double,away:double>>"
_PAIR = pa.list_(pa.struct([("l", pa.int32()), ("r", pa.int32()), ("cost", pa.float64()), ("sim", pa.float64()), ("away", pa.float64())]))


def elements(df: DataFrame, key: str, text: str, kind: str = "full", place: str = "index", aria: bool = False) -> DataFrame:
    """(key, pos, tag, text, index, bounds, depth): a row for each element of each row's markup; null markup has none."""

    def record(keys, pos, found):
        columns = [keys, pos, *([e[n] for e in found] for n in schema.names[2:])]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def run(batches):
        for batch in batches:
            keys, pos, found = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = markup.elements(text, kind, place, aria)
                keys += [key] * len(own)
                pos += range(len(own))
                found += own
                if len(found) > ROWS:
                    yield record(keys, pos, found)
                    keys, pos, found = [], [], []
            yield record(keys, pos, found)

    schema = pa.schema([("key", pa.int64()), ("pos", pa.int32()), ("tag", pa.string()), ("text", pa.string()), ("index", pa.int64()), ("bounds", pa.string()), ("depth", pa.int32())])
    return df.select(F.col(key).cast("bigint").alias("key"), text).mapInArrow(run, "key bigint, pos int, tag string, text string, index bigint, bounds string, depth int")


@F.arrow_udf(T.BinaryType())
def tree(texts: pa.Array) -> pa.Array:
    """What pairing by index needs of a markup text, so that a text that is paired several times is read once."""
    return pa.array([zlib.compress(pickle.dumps(matching.Tree.of(markup.elements(x.as_py())), 5), 1) for x in texts], pa.binary())


def _tree(x: str | bytes | None, kind: str = "full", place: str = "index") -> matching.Tree:
    return pickle.loads(zlib.decompress(x)) if isinstance(x, bytes) else matching.Tree.of(markup.elements(x, kind, place))


def _lists(found: list[list[tuple]]) -> pa.ListArray:
    """Pairs of each row as Arrow."""
    flat = [x for row in found for x in row]
    columns = [pa.array(c, f.type) for c, f in zip(zip(*flat, strict=True) if flat else [[]] * 5, _PAIR.value_type, strict=True)]
    ends = np.cumsum([0, *map(len, found)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(_PAIR.value_type)))


def paired(df: DataFrame, key: str, left: str, right: str, kind: str = "full", place: str = "index", limit: float | None = None) -> DataFrame:
    """(key, n_left, n_right, pairs): the least assignment between the elements of two columns of markup (or ``tree``), one row for each row."""

    def run(batches):
        for batch in batches:
            for part in (batch.slice(at, PAGES) for at in range(0, len(batch), PAGES)):
                sizes, found = [], []
                for texts in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    a, b = (_tree(text, kind, place) for text in texts)
                    found.append(matching.pairs(a, b, place, limit))
                    sizes.append((len(a), len(b)))
                n = np.array(sizes, np.int32).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n[:, 0]), pa.array(n[:, 1]), _lists(found)], ["key", "n_left", "n_right", "pairs"])

    return df.select(F.col(key).cast("bigint").alias("key"), left, right).mapInArrow(run, f"key bigint, n_left int, n_right int, pairs {PAIRS}")


@F.arrow_udf(from_arrow_type(pa.struct([("n_left", pa.int32()), ("n_right", pa.int32()), ("pairs", _PAIR)])))
def pairing(left: pa.Array, right: pa.Array) -> pa.Array:
    """n_left, n_right and pairs, as ``paired`` has them, of two columns of ``tree``."""
    both = [(_tree(a), _tree(b)) for a, b in zip(left.to_pylist(), right.to_pylist(), strict=True)]
    sizes = [pa.array([len(x[k]) for x in both], pa.int32()) for k in (0, 1)]
    return pa.StructArray.from_arrays([*sizes, _lists([matching.pairs(a, b) for a, b in both])], ["n_left", "n_right", "pairs"])


def trees(df: DataFrame, key: str, text: str, **more: Column) -> DataFrame:
    """(key, tree, ..) of each row's markup and what else is wanted of it, stored: read once, in tasks of even numbers of rows."""
    return held(spread(df.select(key, text), key).select(key, tree(text).alias("tree"), *(c.alias(n) for n, c in more.items())), "trees")


def states(df: DataFrame, key: str, current: str, truth: str, pred: str) -> DataFrame:
    """(key, n_cur, n_true, n_pred, current_true, current_pred, pred_true, met): the three pairings of each row's states.

    States are markup or ``tree``. ``met`` holds the similarities of pairs of pred_true of which neither element is unchanged.
    """

    def run(batches):
        for batch in batches:
            for part in (batch.slice(at, PAGES) for at in range(0, len(batch), PAGES)):
                sizes, found, met = [], ([], [], []), []
                for texts in zip(*(part.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                    read = {x: _tree(x) for x in set(texts)}
                    c, t, p = (read[x] for x in texts)
                    made: dict[tuple, list] = {}
                    for out, a, b in zip(found, (c, c, p), (t, p, t), strict=True):
                        at = id(a), id(b)
                        if at not in made:
                            made[at] = matching.pairs(a, b)
                        out.append(made[at])
                    same_true, same_pred = ({x[1] for x in out[-1] if x[3] >= 1.0} for out in found[:2])
                    met.append([x[3] for x in found[2][-1] if x[1] not in same_true and x[0] not in same_pred])
                    sizes.append((len(c), len(t), len(p)))
                n = np.array(sizes, np.int32).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(n[:, k]) for k in range(3)), *map(_lists, found), pa.array(met, pa.list_(pa.float64()))], names)

    names = ["key", "n_cur", "n_true", "n_pred", "current_true", "current_pred", "pred_true", "met"]
    kinds = f"key bigint, n_cur int, n_true int, n_pred int, current_true {PAIRS}, current_pred {PAIRS}, pred_true {PAIRS}, met array<double>"
    return df.select(F.col(key).cast("bigint").alias("key"), current, truth, pred).mapInArrow(run, kinds)


def share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def count_if(pairs: str, test) -> Column:
    return F.size(F.filter(pairs, test))


def scores(pairs: DataFrame, near: float = 2.0) -> DataFrame:
    """Element accuracy, precision, recall, F1, mean text similarity and share of near places of predicted (left) and true (right) trees.

    ``near`` is a gap of indexes or a distance of middles; pairs whose place isn't known don't count for it. Four decimals.
    """
    k = F.size("pairs")
    p, r = share(k, F.col("n_left")), share(k, F.col("n_right"))
    text = share(F.aggregate("pairs", F.lit(0.0), lambda s, x: s + x.sim), k)
    known = count_if("pairs", lambda x: x.away.isNotNull())
    placed = share(count_if("pairs", lambda x: x.away <= near), known)
    found = {"ea": share(k, F.greatest("n_left", "n_right")), "precision": p, "recall": r, "f1": f1(p, r), "text": text, "place": placed}
    return pairs.select("key", *(F.round(F.when(F.col("n_right") > 0, v).otherwise(0.0), 4).alias(n) for n, v in found.items()))


def same(rule: str = "text"):
    """When a pair counts as unchanged: equal texts, or a cost of 0.05 at most."""
    return (lambda x: x.cost <= 0.05) if rule == "cost" else (lambda x: x.sim >= 1.0)


def changes(pairs: DataFrame, rule: str = "text", emptied: bool = True) -> DataFrame:
    """Elements of the next tree (right) that are added, modified, unchanged, and those of the current one that are deleted.

    An empty next tree deletes all if ``emptied``, else nothing is claimed.
    """
    unchanged = count_if("pairs", same(rule))
    deleted = F.col("n_left") - F.size("pairs")
    return pairs.select(
        "key",
        (F.col("n_right") - F.size("pairs")).alias("added"),
        (F.size("pairs") - unchanged).alias("modified"),
        unchanged.alias("unchanged"),
        (deleted if emptied else F.when(F.col("n_right") > 0, deleted).otherwise(0)).alias("deleted"),
    )


def copy_ratio(counted: DataFrame) -> DataFrame:
    """Share of unchanged elements among those of the next tree; 1 for an empty one."""
    total = F.col("added") + F.col("modified") + F.col("unchanged")
    return counted.withColumn("copy_ratio", F.when(total > 0, F.col("unchanged") / total).otherwise(1.0))


def changing(counted: DataFrame, limit: float = 0.95) -> DataFrame:
    """Rows that are not mere copies: a copy ratio below the limit."""
    return copy_ratio(counted).where(F.col("copy_ratio") < limit)


def _ends(c, end: str, test=None) -> Column:
    return F.transform(F.filter(c, test) if test else c, lambda x: x[end])


def joined(current_true: DataFrame, current_pred: DataFrame, pred_true: DataFrame) -> DataFrame:
    """Three pairings of the same keys in the columns of ``states``, without ``met``."""
    return (
        current_true.select("key", F.col("n_left").alias("n_cur"), F.col("n_right").alias("n_true"), F.col("pairs").alias("current_true"))
        .join(current_pred.select("key", F.col("n_right").alias("n_pred"), F.col("pairs").alias("current_pred")), "key")
        .join(pred_true.select("key", F.col("pairs").alias("pred_true")), "key")
    )


def state_diff(current_true: DataFrame, current_pred: DataFrame, pred_true: DataFrame, strict: float = 0.9) -> DataFrame:
    """``diffed`` of three pairings of the same keys."""
    rows = joined(current_true, current_pred, pred_true)
    # a pair of changed elements on both sides: pairs whose ends are not among the unchanged, by anti-joins of long tables
    long = rows.select("key", F.explode("pred_true").alias("x")).select("key", "x.l", "x.r", "x.sim")
    kept = lambda c, name: rows.select("key", F.explode(_ends(c, "r", same())).alias(name))
    met = long.join(kept("current_true", "r"), ["key", "r"], "left_anti").join(kept("current_pred", "l"), ["key", "l"], "left_anti")
    return diffed(rows.join(met.groupBy("key").agg(F.collect_list("sim").alias("met")), "key", "left"), strict)


def diffed(found: DataFrame, strict: float = 0.9) -> DataFrame:
    """What a predicted next state got right, from the pairings of ``states``.

    Changed items are added and modified elements and deleted ones of the current state, on either side; a prediction
    without elements claims none. A predicted change hits if it is paired with a true one (loose), with texts ``strict``
    alike (strict); shared deletions hit both. Precision, recall and F1 are null where neither side changes. ``floor`` is the
    F1 of a prediction that keeps nothing. Recalls of the layers are null where a layer is empty. Four decimals.
    """
    met = F.coalesce("met", F.array().cast("array<double>"))
    rows = found.select(
        *("key", "n_cur", "n_true", "n_pred"),
        *(_ends(c, end, test).alias(n) for n, c, end, test in (("stay_true", "current_true", "l", None), ("from_cur", "current_true", "r", None), ("same_true", "current_true", "r", same()), ("stay_pred", "current_pred", "l", None), ("same_pred", "current_pred", "r", same()), ("hit_true", "pred_true", "r", None))),
        F.size("current_pred").alias("k_cp"),
        F.size(met).alias("loose_hits"),
        F.size(F.filter(met, lambda x: x >= strict)).alias("strict_hits"),
    )
    none = F.col("n_pred") == 0
    changed_true, deleted_true = F.col("n_true") - F.size("same_true"), F.col("n_cur") - F.size("stay_true")
    changed_pred, deleted_pred = F.col("n_pred") - F.size("same_pred"), F.when(none, 0).otherwise(F.col("n_cur") - F.size("stay_pred"))
    both_deleted = F.when(none, 0).otherwise(F.col("n_cur") - F.size(F.array_union("stay_true", "stay_pred")))
    n_true, n_pred = changed_true + deleted_true, changed_pred + deleted_pred
    some = (n_true > 0) | (n_pred > 0)
    four = lambda c, when=None: F.round(c if when is None else F.when(when, c), 4)
    prf = []
    for name in ("strict", "loose"):
        hit = F.col(f"{name}_hits") + both_deleted
        p, r = share(hit, n_pred), share(hit, n_true)
        prf += [four(p, some).alias(f"change_prec_{name}"), four(r, some).alias(f"change_recall_{name}"), four(f1(p, r), some).alias(f"change_f1_{name}")]
    modified = F.array_except("from_cur", "same_true")
    added = F.array_except(F.when(F.col("n_true") > 0, F.sequence(F.lit(0), F.col("n_true") - 1)).otherwise(F.array().cast("array<int>")), F.col("from_cur"))
    layer = lambda c: four(F.size(F.array_intersect("hit_true", c)) / F.size(c), F.size(c) > 0)
    copied_true, copied_pred = share(F.size("from_cur"), F.col("n_true")), share(F.col("k_cp"), F.col("n_pred"))
    near = f1(share(F.col("k_cp"), F.col("n_pred")), share(F.col("k_cp"), F.col("n_cur")))
    return rows.select(
        "key",
        "n_cur",
        "n_true",
        "n_pred",
        n_true.alias("n_change_true"),
        n_pred.alias("n_change_pred"),
        *prf,
        four(f1(share(deleted_true, F.col("n_cur")), share(deleted_true, n_true)), some).alias("change_f1_floor"),
        layer(F.col("same_true")).alias("unchanged_recall"),
        layer(modified).alias("modified_recall"),
        layer(added).alias("added_recall"),
        layer(F.array_union(modified, added)).alias("addmod_recall"),
        four(F.col("loose_hits") / changed_pred, (changed_true > 0) & (changed_pred > 0)).alias("addmod_prec"),
        four(copied_true).alias("copy_rate_true"),
        four(copied_pred).alias("copy_rate_pred"),
        (four(copied_pred) - four(copied_true)).alias("copy_excess"),
        (near >= 0.98).alias("copy_near"),
        F.when(n_true == 0, ((F.col("n_pred") > 0) & (n_pred == 0)).cast("int")).alias("no_change_right"),
        none.alias("parse_fail"),
    )
