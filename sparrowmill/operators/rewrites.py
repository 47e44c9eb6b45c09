"""Texts of records and names of stored files brought into another form, with what can't be as data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparrowmill.functions.prompts import bare_number, bare_page, occurrences


def references(lines: DataFrame, text: str, convert: Callable[[Column], Column], keys: tuple[str, ...] = ("messages", "images")) -> DataFrame:
    """``lines`` with images, new_images, new_text and fault: JSON records whose image references are replaced in their text alone.

    Every byte but the references stays, as the text isn't written anew. A record is faulty, and has no new text, where it isn't an
    object, has other keys than ``keys``, a reference that ``convert`` gives null for, or one that doesn't occur exactly once.
    Blank lines drop out.
    """
    c = F.col(text)
    rows = lines.where(F.trim(c) != "").withColumn("images", F.coalesce(F.from_json(c, "images array<string>")["images"], F.array().cast("array<string>")))
    # the reference is a column, which can't be a pattern's literal: what goes with it tells how often it occurs
    times = lambda ref: (F.length(c) - F.length(F.replace(c, ref, F.lit("")))) / F.length(ref)
    names = F.array_sort(F.json_object_keys(c))
    fault = (
        F.when(names.isNull(), "not an object")
        .when(names != F.array(*map(F.lit, sorted(keys))), "other keys")
        .when(F.exists("images", lambda r: r.isNull() | (r == "") | convert(r).isNull()), "unknown reference")
        .when(F.exists("images", lambda r: times(r) != 1), "reference not exactly once")
    )
    changed = F.aggregate("images", c, lambda done, r: F.replace(done, r, convert(r)))
    rows = rows.withColumn("fault", fault)
    sound = F.col("fault").isNull()
    return rows.withColumns({"new_images": F.when(sound, F.transform("images", convert)), "new_text": F.when(sound, changed)})


def moved_images(folder: str, old: str, digits: int = 6) -> Callable[[Column], Column]:
    """Conversion of 'old/episode_7_step_2.jpg' to 'folder/episode_000007_step_2.jpg' and of 'old/home.jpg'; null for all else."""

    def convert(ref: Column) -> Column:
        pattern = rf"\A\Q{old}\E/episode_0*([0-9]+)_step_([0-9]+)\.jpg\z"
        number = F.regexp_extract(ref, pattern, 1)
        padded = F.when(F.length(number) >= digits, number).otherwise(F.lpad(number, digits, "0"))
        named = F.concat(F.lit(f"{folder}/episode_"), padded, F.lit("_step_"), F.regexp_extract(ref, pattern, 2), F.lit(".jpg"))
        return F.when(ref == f"{old}/home.jpg", F.lit(f"{folder}/home.jpg")).when(ref.rlike(pattern), named)

    return convert


def reference_rules(n_before: int, n_asked: int, old: str, stored: DataFrame, mark: str = "<image>") -> Callable[[DataFrame], dict[str, DataFrame]]:
    """Rules for converted lines (new_text, new_images), each with the rows that break it; ``stored`` are the paths (path) of images.

    As many lines as came in and were asked for, no trace of the old folder, as many marks as images, and a file for each image.
    """

    def rules(lines: DataFrame) -> dict[str, DataFrame]:
        n = lines.count()
        used = lines.select(F.explode("new_images").alias("path")).distinct()
        return {
            "lines lost or too many": lines.sparkSession.range(abs(n - n_before) + abs(n - n_asked)),
            "old folder": lines.where(F.col("new_text").contains(old)),
            "marks and images": lines.where(occurrences(F.col("new_text"), mark) != F.size("new_images")),
            "images without a file": used.join(stored.select("path").distinct(), "path", "left_anti"),
        }

    return rules


#: parts of a stored path: up to the pages, page, number of the observation (or none), name
OBSERVED = r"\A([^/]+/pages/)([^/]+)/(?:([^/]+)/)?([^/]+)\z"
#: fixed values: files whose JSON names their page
NAMING = ("page.json", "elements.json", "page_graph.json", "events.jsonl")


def layout_plan(listed: DataFrame) -> DataFrame:
    """(path, new_path, status) of files below a root: 'page_7/0003' becomes '7/3', anything else stays.

    ``listed`` has paths relative to the root. Folders move whole: where two of one page come to one name, the one that has it already
    or else the first in order moves, and the files of the other stay ('taken'). The plan of a tree that has moved keeps every file.
    """
    part = lambda k: F.when(F.col("path").rlike(OBSERVED), F.regexp_extract("path", OBSERVED, k))
    rows = listed.select("path", part(1).alias("head"), part(2).alias("page"), F.nullif(part(3), F.lit("")).alias("number"), part(4).alias("name"))
    bare = bare_page(F.col("page"))
    rows = rows.withColumn("to_page", F.when(bare.rlike(r"\A[0-9]+\z"), bare).otherwise(F.col("page")))
    rows = rows.withColumn("to_number", F.when(F.col("to_page").rlike(r"\A[0-9]+\z"), bare_number(F.col("number"))))
    rows = rows.withColumn("to_number", F.coalesce("to_number", "number"))

    def free(inside: list[str], name: str, to: str) -> DataFrame:
        """One folder for each place it can come to."""
        folders = rows.where(F.col(to).isNotNull()).select(*inside, name, to).distinct()
        order = Window.partitionBy(*inside, to).orderBy((F.col(name) != F.col(to)).cast("int"), name)  # folders of one name, a few
        return folders.withColumn("__first", F.row_number().over(order) == 1).select(*inside, name, F.col("__first").alias(f"{name}_free"))

    rows = rows.join(free(["head"], "page", "to_page"), ["head", "page"], "left").join(free(["head", "page"], "number", "to_number"), ["head", "page", "number"], "left")
    page = F.when(F.col("page_free"), F.col("to_page")).otherwise(F.col("page"))
    number = F.when(F.col("number_free"), F.col("to_number")).otherwise(F.col("number"))
    moved = F.concat(F.col("head"), page, F.lit("/"), F.coalesce(F.concat(number, F.lit("/")), F.lit("")), F.col("name"))
    new = F.coalesce(moved, F.col("path"))
    taken = (~F.coalesce("page_free", F.lit(True))) | (~F.coalesce("number_free", F.lit(True)))
    return rows.select("path", new.alias("new_path"), F.when(taken, "taken").when(new != F.col("path"), "moves").otherwise("stays").alias("status"))


def bare_keys(text: Column) -> Column:
    """JSON text with 'page_7' as '7' in every page_key; the rest keeps its bytes. Keys inside of texts don't count."""
    return F.regexp_replace(text, r'(?<!\\)("page_key"\s*:\s*)"page_([0-9]+)"', '$1"$2"')
