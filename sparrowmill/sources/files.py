"""Sets of files below a folder: written by tasks, screens' forms made anew, layouts moved, digests."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from fnmatch import fnmatchcase

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowmill.functions import screens
from sparrowmill.operators import rewrites
from sparrowmill.operators.ordering import held
from sparrowmill.sources.tfrecord import files as listed
from sparrowmill.sources.tfrecord import opened

#: fixed values: names of an observation's files by the column that they hold
FORMS = {"parsed": "parsed.xml", "hierarchy": "hierarchy.xml", "encoded": "encoded.xml", "pretty": "pretty.xml"}
FILES = {"screenshot": "screenshot.png", "raw": "raw.xml"} | FORMS | {"elements": "elements.json"}


def _put(system: fs.FileSystem, root: str, path: str, content: bytes) -> None:
    """A file seen whole or not at all, also where a lost task's attempt is made again."""
    final = f"{root.rstrip('/')}/{path}"
    folder, name = final.rsplit("/", 1)
    system.create_dir(folder, recursive=True)
    beside = f"{folder}/.{name}-{uuid.uuid4().hex[:8]}"
    with system.open_output_stream(beside) as out:
        out.write(content)
    system.move(beside, final)


def written(df: DataFrame, root: str, path: str = "path", content: str = "content") -> int:
    """Write a file for each row that has content, below ``root``; the number of files.

    Paths are relative; one that leaves the root, and one that two rows share, raise before anything is written. Files that are there
    are replaced. Tasks write beside and rename, so that an attempt made again gives the same files; ``root`` is a folder or a URI
    that pyarrow knows and all executors reach.
    """
    rows = held(df.where(F.col(content).isNotNull()).select(F.col(path).alias("path"), F.col(content).cast("binary").alias("content")), "files")
    outside = rows.where(F.col("path").isNull() | F.col("path").rlike(r"\A/|(\A|/)\.\.(/|\z)|\A\z|/\z"))
    if bad := outside.select("path").limit(1).collect():
        raise ValueError(f"not a path below the root: {bad[0][0]!r}")
    if bad := rows.groupBy("path").count().where("count > 1").limit(1).collect():
        raise ValueError(f"{bad[0][1]} rows for {bad[0][0]!r}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = opened(root)
        for batch in batches:
            for name, body in zip(batch.column(0), batch.column(1), strict=True):
                _put(system, at, name.as_py(), body.as_py())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return rows.mapInArrow(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _apart(df: DataFrame, keep: list[str], names: dict[str, str]) -> DataFrame:
    """A row (keep.., name, content) for each of the columns that isn't null or empty."""
    one = [F.struct(F.lit(name).alias("name"), F.col(c).cast("binary").alias("content")) for c, name in names.items()]
    rows = df.select(*keep, F.explode(F.array(*one)).alias("f")).select(*keep, "f.*")
    return rows.where(F.length("content") > 0)


def observation_files(observed: DataFrame) -> DataFrame:
    """(path, content) of observations (package, page_key, observation_num, screenshot, raw[, match]).

    Each has its dump and, where it can be read, the dump's forms; a screenshot and, where ``match`` (a struct) isn't null,
    elements.json are there if given. Readers are ``stores.files`` and ``stores.observations``.
    """
    shown = observed.select("*", screens.screen("raw").alias("s"))
    match = F.to_json(F.col("match")) if "match" in observed.columns else F.lit(None).cast("string")
    columns = shown.select("package", "page_key", "observation_num", "screenshot", "raw", *(F.col(f"s.{c}").alias(c) for c in FORMS), match.alias("elements"))
    rows = _apart(columns, ["package", "page_key", "observation_num"], FILES)
    path = F.concat_ws("/", "package", F.lit("pages"), "page_key", F.col("observation_num").cast("string"), "name")
    return rows.select(path.alias("path"), "content")


def relative(found: DataFrame, root: str) -> DataFrame:
    """``found`` with paths relative to the root, whatever scheme Spark writes ahead of them."""
    plain = lambda c: F.regexp_replace(c, r"\A[a-z0-9+.-]+:/*", "/")
    below = F.expr("substring(p, length(r) + 1)")
    at = found.withColumn("p", plain(F.col("path"))).withColumn("r", F.concat(F.rtrim(plain(F.lit(root)), F.lit("/")), F.lit("/")))
    return at.where("startswith(p, r)").withColumn("path", below).drop("p", "r")


def regenerated_forms(found: DataFrame) -> DataFrame:
    """(package, source, path, content) of the forms of all dumps among ``found`` (path relative to the root, content).

    Dumps are package/pages/page/number/raw.xml, whose forms lie beside it, and for packages without such pages
    package/xml/name.xml, whose forms are called name_form. A dump that can't be read has one row without a path.
    """
    new, old = r"\A([^/]+)/pages/[^/]+/[^/]+/raw\.xml\z", r"\A([^/]+)/xml/([^/_]+)\.xml\z"
    rows = found.withColumns({"package": F.regexp_extract("path", r"\A[^/]+", 0), "in_pages": F.col("path").rlike(r"\A[^/]+/pages/")})
    paged = rows.where("in_pages").select("package").distinct().withColumn("paged", F.lit(True))
    dumps = rows.where(F.col("path").rlike(f"{new}|{old}")).join(paged, "package", "left").where(F.col("path").rlike(new) | F.col("paged").isNull())
    stem = F.when(F.col("in_pages"), F.regexp_replace("path", r"raw\.xml\z", "")).otherwise(F.regexp_replace("path", r"\.xml\z", "_"))
    shown = dumps.select("package", F.col("path").alias("source"), stem.alias("stem"), screens.screen(F.make_valid_utf8(F.col("content").cast("string")), *FORMS).alias("s"))
    # a dump is read once: its forms and the row of one that can't be read come from the same list
    one = [F.struct(F.concat("stem", F.lit(name)).alias("path"), F.col(f"s.{c}").cast("binary").alias("content")) for c, name in FORMS.items()]
    unread = F.array(F.struct(F.lit(None).cast("string").alias("path"), F.lit(None).cast("binary").alias("content")))
    files = F.when(F.col("s.parsed") == "", unread).otherwise(F.filter(F.array(*one), lambda f: F.length(f["content"]) > 0))
    return shown.select("package", "source", F.explode(files).alias("f")).select("package", "source", "f.*")


def stored(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path relative to the root, content) of the files below a folder, but for hidden ones.

    Spark's reader passes over files without content, so these come from a listing of their names, made on the driver as Spark makes its own.
    """
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    found = read.load(root).select("path", "content").where(F.length("content") > 0)
    empty = [(path, b"") for path, size in listed(root) if size == 0 and fnmatchcase(path.rsplit("/", 1)[-1], glob)]
    both = found.unionByName(spark.createDataFrame(empty, found.schema)) if empty else found
    return relative(both, root)


def regenerated(spark: SparkSession, root: str) -> DataFrame:
    """Write the forms of all dumps below ``root`` anew, beside them; (package, regenerated, unread) counts dumps."""
    made = held(regenerated_forms(stored(spark, root, "*.xml")), "forms")
    written(made.where("path IS NOT NULL"), root)
    return made.groupBy("package").agg(F.count_distinct(F.when(F.col("path").isNotNull(), F.col("source"))).alias("regenerated"), F.count_if(F.col("path").isNull()).alias("unread"))


def migrated(spark: SparkSession, root: str, into: str | None = None) -> DataFrame:
    """(status, files, rewritten): what moving a tree to the present layout does; with ``into`` the moved tree is written there.

    The tree that is there isn't touched, so a lost job is simply run again; a tree that has moved is copied as it is. Files that name
    their page are rewritten by ``rewrites.bare_keys``.
    """
    files = stored(spark, root)
    plan = rewrites.layout_plan(files.select("path"))
    name = F.substring_index("path", "/", -1)
    text = F.col("content").cast("string")
    changed = F.when(name.isin(*rewrites.NAMING), rewrites.bare_keys(text))
    rows = files.join(plan, "path").withColumn("new", F.coalesce(changed.cast("binary"), F.col("content")))
    if into is not None:
        written(rows, into, "new_path", "new")
    return rows.groupBy("status").agg(F.count("*").alias("files"), F.count_if(F.col("new") != F.col("content")).alias("rewritten"))


def digests(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, sha256) of the files below a folder, in lower-case hex."""
    found = stored(spark, root)
    return found.select("path", F.length("content").cast("bigint").alias("length"), F.sha2("content", 256).alias("sha256"))


def is_jpeg(content: Column) -> Column:
    """Whether bytes begin as a JPEG picture does and hold three channels by their first frame header of the usual kinds."""
    text = F.hex(content)
    return text.startswith("FFD8FF") & text.rlike(r"FFC[0-2]00110[0-9A-F]{9}03")
