"""Mixing sources to target weights by hierarchical budgeting.

The tree is domain, language, source. A node's weight is its share among its siblings; a leaf can give its tokens
``max_epochs`` times. The token budget flows from the root: a node's budget is dealt to its children by weight, a child
whose capacity is smaller takes all it has, and what it leaves goes to its siblings by their weights, so a shortage
reaches the ancestors only when a whole subtree is exhausted. Each level is one window over the few rows of the tree.

A leaf takes whole epochs and then a prefix of the next one: documents ordered by md5(seed|epoch|doc_id) and then by the md5 of
their text, up to the tokens that remain; the document at the end gives a prefix of its tokens. The cut is found without ever
sorting a leaf in one task: tokens are summed by the first three digits of the key, and only the different keys of the bucket
that holds the cut are ordered. What results is one cut key per leaf, so a document's share follows from its own row and the
small leaf table. Rows of one doc_id and text are alike; where the cut falls among them, and only there, they are numbered, in
stretches as large as the partitions they lie in, and so many of them are taken as the tokens allow.

Defined cases: null texts have 0 tokens; null languages and sources form leaves of their own named 'unknown'; names
without a weight weigh 1; rows that repeat a doc_id are documents of their own, so that a leaf gives what is left of its budget
to the token, which of several equal rows are taken is left open; leaves without tokens give nothing; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparrowmill.llm.scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
LEAF = ["domain", "language", "origin"]


@dataclass(frozen=True)
class Mix:
    """Whole-number weights by name for each level, the budget as thousandths of the corpus's tokens, and the seed."""

    domains: dict[str, int] = field(default_factory=lambda: {"d0": 4, "d1": 3, "d2": 2, "d3": 1})
    languages: dict[str, int] = field(default_factory=lambda: {"en": 5, "de": 2, "fr": 2, "es": 2})
    sources: dict[str, int] = field(default_factory=lambda: {"src0": 2})
    domain_of: dict[str, str] | None = None
    budget_thousandths: int = 900
    max_epochs: int = 2
    seed: int = 7

    def domain(self) -> Column:
        """The domain of a source by the mapping ``domain_of`` ('unknown' if it has none); without one, by the number in its name modulo 4."""
        if self.domain_of is not None:
            out = F.lit("unknown")
            for name, domain in sorted(self.domain_of.items()):
                out = F.when(F.col("source") == name, domain).otherwise(out)
            return out
        number = F.regexp_extract(F.coalesce("source", F.lit("")), "([0-9]+)$", 1)
        return F.when(number == "", "unknown").otherwise(F.concat(F.lit("d"), (number.cast("bigint") % 4).cast("string")))


def weight(names: dict[str, int], column: str) -> Column:
    out = F.lit(1).cast("bigint")
    for name, w in sorted(names.items()):
        out = F.when(F.col(column) == name, F.lit(w).cast("bigint")).otherwise(out)
    return out


def leafed(docs: DataFrame, mix: Mix) -> DataFrame:
    return docs.withColumns(
        {
            "domain": mix.domain(),
            "language": F.coalesce("lang", F.lit("unknown")),
            "origin": F.coalesce("source", F.lit("unknown")),
            "n_tokens": F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("bigint"),
            "text_md5": F.md5(F.coalesce("text", F.lit(""))),
        }
    )


def poured(nodes: DataFrame, parent: list[str], child: str) -> DataFrame:
    """``nodes`` (parent.., child, cap, weight, budget of the parent) with ``share``, the child's budget."""
    family = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    before = family.orderBy(F.col("cap") / F.col("weight"), child).rowsBetween(Window.unboundedPreceding, -1)
    spent, used = F.coalesce(F.sum("cap").over(before), F.lit(0)), F.coalesce(F.sum("weight").over(before), F.lit(0))
    total = F.sum("weight").over(family)
    full = F.expr("cap * (total - used) <= weight * (budget - spent)")
    rest = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(family)
    gone = F.sum(F.when(F.col("full"), F.col("weight")).otherwise(0)).over(family)
    return (
        nodes.withColumns({"spent": spent, "used": used, "total": total})
        .withColumn("full", full)
        .withColumns({"rest": rest, "gone": gone})
        .withColumn("share", F.expr("CASE WHEN full THEN cap ELSE (weight * (budget - rest)) DIV (total - gone) END"))
        .drop("spent", "used", "total", "full", "rest", "gone")
    )


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """Leaves (domain, language, origin, tokens) with ``share``, the tokens each is to give."""
    sized = leaves.withColumn("cap", F.col("tokens") * mix.max_epochs)
    whole = sized.agg(((F.sum("tokens") * mix.budget_thousandths) / 1000).cast("bigint").alias("budget"))
    top = sized.groupBy("domain").agg(F.sum("cap").alias("cap")).crossJoin(F.broadcast(whole)).withColumn("weight", weight(mix.domains, "domain"))  # one row
    top = poured(top, [], "domain").select("domain", F.col("share").alias("budget"))
    mid = sized.groupBy("domain", "language").agg(F.sum("cap").alias("cap")).join(top, "domain").withColumn("weight", weight(mix.languages, "language"))
    mid = poured(mid, ["domain"], "language").select("domain", "language", F.col("share").alias("budget"))
    low = sized.join(mid, ["domain", "language"]).withColumn("weight", weight(mix.sources, "origin"))
    return poured(low, ["domain", "language"], "origin").select(*LEAF, "tokens", "share")


def order_key(mix: Mix) -> Column:
    """Equal for rows of one doc_id and text alone."""
    drawn = F.md5(F.concat(F.lit(f"{mix.seed}|"), F.col("epochs").cast("string"), F.lit("|"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return F.concat(drawn, "text_md5")


def plan(docs: DataFrame, mix: Mix) -> DataFrame:
    """One row per leaf: its tokens and share, whole epochs, the cut key of the next epoch, the tokens to take of the rows with that key, and how many rows these are."""
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = scratch.keep(leafed(docs, mix).select("doc_id", *LEAF, "n_tokens", "text_md5"), "tokens")
    leaves = budgets(rows.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens")), mix)
    leaves = scratch.keep(
        leaves.withColumns({"epochs": F.expr("CASE WHEN tokens > 0 THEN share DIV tokens ELSE 0 END"), "part": F.expr("CASE WHEN tokens > 0 THEN share % tokens ELSE 0 END")}),
        "leaves",
    )
    keyed = rows.join(leaves.select(*LEAF, "epochs", "part"), LEAF).where("part > 0").withColumn("key", order_key(mix)).withColumn("bucket", F.substring("key", 1, 3))
    sums = keyed.groupBy(*LEAF, "bucket", "part").agg(F.sum("n_tokens").alias("here"))
    ahead = F.sum("here").over(Window.partitionBy(*LEAF).orderBy("bucket"))
    at = sums.withColumn("ahead", ahead - F.col("here")).where("ahead < part AND part <= ahead + here").select(*LEAF, "bucket", "ahead")
    inside = keyed.join(F.broadcast(at) if at.count() <= 100_000 else at, [*LEAF, "bucket"])  # one row per leaf at most
    inside = inside.groupBy(*LEAF, "bucket", "part", "ahead", "key").agg(F.sum("n_tokens").alias("here"), F.count("*").alias("rows"))
    before = F.col("ahead") + F.sum("here").over(Window.partitionBy(*LEAF, "bucket").orderBy("key")) - F.col("here")
    cut = inside.withColumn("before", before).where("before < part AND part <= before + here")
    cut = cut.select(*LEAF, F.col("key").alias("cut"), (F.col("part") - F.col("before")).alias("cut_tokens"), F.col("rows").alias("cut_rows"))
    return scratch.keep(leaves.join(cut, LEAF, "left"), "plan")


def numbered_alike(rows: DataFrame) -> DataFrame:
    """``rows`` with ``nth``, from 0 within each leaf: counts of the partitions give where each begins, windows reach no further than a partition."""
    scratch = Scratch(rows.sparkSession, "mixing")
    held = scratch.keep(rows.withColumn("place", F.monotonically_increasing_id()), "alike").withColumn("stretch", F.shiftright("place", 33))
    counts = held.groupBy(*LEAF, "stretch").agg(F.count("*").alias("n"))
    begin = counts.select(*LEAF, "stretch", (F.sum("n").over(Window.partitionBy(*LEAF).orderBy("stretch")) - F.col("n")).alias("begin"))
    inside = F.row_number().over(Window.partitionBy(*LEAF, "stretch").orderBy("place")) - 1
    return held.withColumn("inside", inside).join(begin, [*LEAF, "stretch"]).withColumn("nth", F.col("begin") + F.col("inside")).drop("place", "stretch", "inside", "begin")


def shares(docs: DataFrame, mix: Mix, leaf_plan: DataFrame) -> DataFrame:
    """``docs`` with leaf columns, n_tokens, copies, last_tokens (of the last copy) and taken_tokens, by a join with the small leaf table alone."""
    joined = leafed(docs, mix).join(leaf_plan.select(*LEAF, "epochs", "cut", "cut_tokens", "cut_rows"), LEAF).withColumn("key", order_key(mix))
    last = F.when(F.col("key") < F.col("cut"), F.col("n_tokens")).when(F.col("key") == F.col("cut"), F.greatest(F.lit(0), F.least("n_tokens", F.col("cut_tokens") - F.col("nth") * F.col("n_tokens")))).otherwise(0)
    among = (F.col("key") == F.col("cut")) & (F.col("cut_rows") > 1)
    rows = joined.withColumn("nth", F.lit(0).cast("bigint"))
    if leaf_plan.where("cut_rows > 1").limit(1).count():
        alike = numbered_alike(joined.where(among))
        rows = rows.where(~F.coalesce(among, F.lit(False))).unionByName(alike)
    taken = (F.col("key") < F.col("cut")) | ((F.col("key") == F.col("cut")) & (F.col("last_tokens") > 0))
    return (
        rows.withColumn("last_tokens", last)
        .withColumn("copies", F.col("epochs") + F.when(taken, 1).otherwise(0))
        .withColumn("taken_tokens", F.col("epochs") * F.col("n_tokens") + F.col("last_tokens"))
    )


def mixed(docs: DataFrame, mix: Mix | None = None) -> DataFrame:
    """Per document: doc_id, its leaf, n_tokens, copies (epochs it is in) and taken_tokens (over all of them)."""
    mix = mix or Mix()
    docs = docs.select("doc_id", "text", "lang", "source")
    return shares(docs, mix, plan(docs, mix)).select("doc_id", "domain", "language", "origin", "n_tokens", "copies", "taken_tokens")


def mixed_documents(docs: DataFrame, mix: Mix | None = None) -> DataFrame:
    """The rows of ``docs``, each as often as epochs take it; the last copy of the document at a leaf's cut ends at the cut.

    Its text keeps its first tokens with the white space before them, and an integer column n_chars is set anew there.
    """
    mix = mix or Mix()
    held = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", "lang", "source")
    taken = shares(held, mix, plan(docs.select("doc_id", "text", "lang", "source"), mix)).where("copies > 0")
    copies = taken.withColumn("copy", F.explode(F.expr("sequence(1, copies)")))
    ends = (F.col("copy") == F.col("copies")) & (F.col("key") == F.col("cut")) & (F.col("last_tokens") > 0) & (F.col("last_tokens") < F.col("n_tokens"))
    cut = F.array_join(F.slice(F.regexp_extract_all("row.text", F.lit("[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+"), F.lit(0)), 1, F.col("last_tokens").cast("int")), "")
    changed = {"text": F.when(ends, cut).otherwise(F.col("row.text"))}
    if dict(docs.dtypes).get("n_chars") in ("int", "bigint"):
        changed["n_chars"] = F.when(ends, F.length(cut).cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("row.n_chars"))
    return copies.select(*(changed[c].alias(c) if c in changed else F.col("row")[c].alias(c) for c in docs.columns))


def _pour_sql(source: str, parent: str, child: str, out: str) -> str:
    by = f"PARTITION BY {parent}" if parent else ""
    return f"""
{out}_a AS (SELECT *, coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS spent,
    coalesce(sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS used, (sum(weight) OVER ({by}))::BIGINT AS total
  FROM {source} WINDOW w AS ({by} ORDER BY cap / weight, {child})),
{out}_b AS (SELECT *, cap * (total - used) <= weight * (budget - spent) AS is_full FROM {out}_a),
{out}_c AS (SELECT *, (sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ({by}))::BIGINT AS rest, (sum(CASE WHEN is_full THEN weight ELSE 0 END) OVER ({by}))::BIGINT AS gone FROM {out}_b),
{out} AS (SELECT * EXCLUDE (budget), CASE WHEN is_full THEN cap ELSE (weight * (budget - rest)) // (total - gone) END AS share FROM {out}_c)"""


def _weight_sql(names: dict[str, int], column: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{n}' THEN {w}" for n, w in sorted(names.items())) + " ELSE 1 END::BIGINT AS weight"


def oracle(mix: Mix | None = None) -> str:
    mix = mix or Mix()
    return f"""
WITH d AS (SELECT doc_id, coalesce('d' || (try_cast(nullif(regexp_extract(coalesce(source, ''), '([0-9]+)$', 1), '') AS BIGINT) % 4), 'unknown') AS domain,
    coalesce(lang, 'unknown') AS language, coalesce(source, 'unknown') AS origin,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens, md5(coalesce(text, '')) AS text_md5 FROM documents),
leaf AS (SELECT domain, language, origin, sum(n_tokens)::BIGINT AS tokens, (sum(n_tokens) * {mix.max_epochs})::BIGINT AS cap FROM d GROUP BY ALL),
root AS (SELECT floor(sum(tokens) * {mix.budget_thousandths} / 1000)::BIGINT AS budget FROM leaf),
top AS (SELECT domain, sum(cap)::BIGINT AS cap, {_weight_sql(mix.domains, "domain")}, (SELECT budget FROM root) AS budget FROM leaf GROUP BY domain),
{_pour_sql("top", "", "domain", "t1")},
mid AS (SELECT l.domain, l.language, sum(l.cap)::BIGINT AS cap, {_weight_sql(mix.languages, "l.language")}, any_value(t1.share) AS budget
  FROM leaf l JOIN t1 USING (domain) GROUP BY l.domain, l.language),
{_pour_sql("mid", "domain", "language", "t2")},
low AS (SELECT l.domain, l.language, l.origin, l.tokens, l.cap, {_weight_sql(mix.sources, "l.origin")}, t2.share AS budget FROM leaf l JOIN t2 USING (domain, language)),
{_pour_sql("low", "domain, language", "origin", "t3")},
cut AS (SELECT domain, language, origin, CASE WHEN tokens > 0 THEN share // tokens ELSE 0 END AS epochs, CASE WHEN tokens > 0 THEN share % tokens ELSE 0 END AS part FROM t3),
k AS (SELECT d.*, epochs, part, md5('{mix.seed}|' || epochs || '|' || coalesce(doc_id::VARCHAR, '')) || text_md5 AS key FROM d JOIN cut USING (domain, language, origin)),
c AS (SELECT *, (sum(n_tokens) OVER (PARTITION BY domain, language, origin ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT - n_tokens AS ahead FROM k)
SELECT doc_id, domain, language, origin, n_tokens, (epochs + CASE WHEN ahead < part THEN 1 ELSE 0 END)::BIGINT AS copies,
  (epochs * n_tokens + greatest(0, least(n_tokens, part - ahead)))::BIGINT AS taken_tokens FROM c
"""
