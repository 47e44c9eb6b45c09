"""BLEU and ROUGE of pairs of texts from long tables of their word runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONGEST = 4
#: fixed values: the public mteval-v13a tokenizer, references put back and signs set apart in this order
REFERENCES = (("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))
SIGNS = ((r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 "), (r"([^0-9])([\.,])", "$1 $2 "), (r"([\.,])([^0-9])", " $1 $2"), (r"([0-9])(-)", "$1 $2 "))


def blank_tokens(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: x != "")


def tokens_13a(text: Column) -> Column:
    """Tokens of the mteval-v13a standard."""
    plain = reduce(lambda c, r: F.replace(c, F.lit(r[0]), F.lit(r[1])), REFERENCES, F.coalesce(text, F.lit("")))
    spaced = F.concat(F.lit(" "), plain, F.lit(" "))
    return blank_tokens(reduce(lambda c, r: F.regexp_replace(c, *r), SIGNS, spaced))


def runs_of(tokens: Column) -> Column:
    """(n, run) of all runs of one to LONGEST tokens."""

    def of(n: int) -> Column:
        last = F.size(tokens) - (n - 1)
        places = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda k: F.struct(F.lit(n).alias("n"), F.array_join(F.slice(tokens, k, n), " ").alias("run")))

    return F.concat(*(of(n) for n in range(1, LONGEST + 1)))


def matched(df: DataFrame, keys: list[str], hypothesis: Column, reference: Column) -> DataFrame:
    """(keys, size_h, size_r, hit1 .. hit4): tokens of either side and the runs of each length that both have, as often as both have them.

    ``hypothesis`` and ``reference`` are columns of tokens; rows of equal keys count as one text. Runs are counted by key and text
    before anything of a pair meets, so no task holds a long pair.
    """
    sized = df.select(*keys, hypothesis.alias("h"), reference.alias("r"))
    sides = F.explode(F.array(F.struct(F.lit(True).alias("mine"), F.col("h").alias("t")), F.struct(F.lit(False).alias("mine"), F.col("r").alias("t"))))
    long = sized.select(*keys, sides.alias("s")).select(*keys, "s.mine", F.explode(runs_of(F.col("s.t"))).alias("g")).select(*keys, "mine", "g.n", "g.run")
    both = long.groupBy(*keys, "n", "run").agg(F.least(F.count_if("mine"), F.count_if(~F.col("mine"))).alias("hit"))
    hits = both.groupBy(*keys).agg(*(F.sum(F.when(F.col("n") == n, F.col("hit")).otherwise(0)).alias(f"hit{n}") for n in range(1, LONGEST + 1)))
    sizes = sized.groupBy(*keys).agg(F.sum(F.size("h")).alias("size_h"), F.sum(F.size("r")).alias("size_r"))
    return sizes.join(hits, keys, "left").fillna(0)


def _total(side: str, n: int) -> Column:
    return F.greatest(F.lit(0), F.col(f"size_{side}") - (n - 1))


def _brevity() -> Column:
    return F.when(F.col("size_h") > 0, F.least(F.lit(1.0), F.exp(1 - F.col("size_r") / F.col("size_h")))).otherwise(0.0)


def bleu4() -> Column:
    """0 where any length of runs has no hit."""
    least = F.least(*(F.col(f"hit{n}") for n in range(1, LONGEST + 1)))
    logs = sum((F.log(F.col(f"hit{n}") / _total("h", n)) for n in range(1, LONGEST + 1)), F.lit(0.0))
    return F.when(least > 0, _brevity() * F.exp(logs / LONGEST)).otherwise(0.0)


def rouge(n: int) -> Column:
    total = _total("h", n) + _total("r", n)
    return F.when(F.col(f"hit{n}") > 0, 2 * F.col(f"hit{n}") / total).otherwise(0.0)


def sentence_bleu() -> Column:
    """With exponential smoothing over the lengths that the hypothesis has: the k-th length without a hit counts as 1 / 2^k hits."""
    order = F.least(F.lit(LONGEST), F.col("size_h"))
    logs, missed = F.lit(0.0), F.lit(0)
    for n in range(1, LONGEST + 1):
        has, none = F.col("size_h") >= n, F.col(f"hit{n}") == 0
        missed = missed + F.when(has & none, 1).otherwise(0)
        hits = F.when(none, 1 / F.pow(F.lit(2.0), missed)).otherwise(F.col(f"hit{n}"))
        logs = logs + F.when(has, F.log(hits / _total("h", n))).otherwise(0.0)
    return F.when((F.col("hit1") > 0) & (F.col("size_r") > 0), _brevity() * F.exp(logs / order)).otherwise(0.0)
