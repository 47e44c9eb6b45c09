"""Datasets of several tables that readers see whole or not at all."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class BuildFailed(ValueError):
    """Rules that a build breaks, with the number of rows that break each."""

    def __init__(self, broken: dict[str, int]):
        super().__init__(", ".join(f"{rule}: {n} rows" for rule, n in sorted(broken.items())))
        self.broken = broken


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions that are announced."""
    fs, at = _folder(spark, f"{path.rstrip('/')}/manifest")
    if not fs.exists(at):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(at)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())


def published(spark: SparkSession, path: str, tables: dict[str, DataFrame], rules: Callable[[dict[str, DataFrame]], dict[str, DataFrame]]) -> int:
    """Write all tables beside what is there, check them as written, and announce them; the new version's number.

    ``rules`` gives for each invariant the rows that break it. Where any has rows, or any step fails, nothing is announced and readers
    stay with the earlier version. A version is announced by one file of its own that comes by a rename and is never written again,
    so readers see either all tables of a version or none. Two builds at a time can't take one number: the rename of the later fails.
    """
    path = path.rstrip("/")
    build = uuid.uuid4().hex[:12]
    for name, df in tables.items():
        df.write.parquet(f"{path}/builds/{build}/{name}")
    written = {name: spark.read.schema(df.schema).parquet(f"{path}/builds/{build}/{name}") for name, df in tables.items()}
    broken = {rule: n for rule, rows in rules(written).items() if (n := rows.count())}
    if broken:
        raise BuildFailed(broken)
    number = max(versions(spark, path), default=0) + 1
    fs, at = _folder(spark, f"{path}/manifest/.{build}")
    out = fs.create(at)
    out.write(bytearray(f'{{"build": "{build}", "tables": {sorted(tables)}}}'.replace("'", '"'), "utf-8"))
    out.close()
    _, final = _folder(spark, f"{path}/manifest/{number:08d}.json")
    if fs.exists(final) or not fs.rename(at, final):
        raise BuildFailed({"another build took the number": 1})
    return number


def current(spark: SparkSession, path: str, version: int | None = None) -> dict[str, DataFrame]:
    """The tables of a version, by default the newest that is announced."""
    path = path.rstrip("/")
    known = versions(spark, path)
    if not known or (version is not None and version not in known):
        raise FileNotFoundError(f"no such version below {path}")
    told = spark.read.schema("build string, tables array<string>").json(f"{path}/manifest/{version or known[-1]:08d}.json").first()
    return {name: spark.read.parquet(f"{path}/builds/{told.build}/{name}") for name in told.tables}


def sample_rules(train: dict[str, tuple[str, int]], test: str, key: str, allowed: tuple[float, ...] = (0.25, 0.5, 1.0), even_share: float = 0.5) -> Callable[[dict[str, DataFrame]], dict[str, DataFrame]]:
    """Rules of a build of training samples: no key of ``test`` in training, as many rows of each table as asked, known weights alone,
    a weight for each token, and not too many states whose tokens all weigh the same.

    ``train`` gives for each table its column of kinds and its number of rows; tables have ``key``, token_weights and n_tokens where
    they are weighed. A row without a key counts for no leak.
    """

    def rules(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        spark = tables[test].sparkSession
        found = {}
        for name, (kind, rows) in train.items():
            df = tables[name]
            found[f"{name}: keys of the test"] = df.join(tables[test].select(key).where(F.col(key).isNotNull()), key, "left_semi")
            n = df.count()
            found[f"{name}: {n} of {rows} rows"] = spark.range(abs(n - rows))
            if "token_weights" in df.columns:
                known = F.array(*map(F.lit, (0.0, *allowed)))
                found[f"{name}: unknown weights"] = df.where(F.size(F.array_except("token_weights", known)) > 0)
                found[f"{name}: tokens without a weight"] = df.where(F.size("token_weights") != F.col("n_tokens"))
                states = df.where(F.col(kind) == "state")
                even = states.where(F.size(F.array_distinct("token_weights")) <= 1)
                k = even.count()
                found[f"{name}: even states"] = even if k > even_share * max(1, states.count()) else even.limit(0)
        return found

    return rules
