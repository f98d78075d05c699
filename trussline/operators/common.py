"""Shared pieces of the operators: blank-trimmed keys, lineage cuts and salted joins."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_OWN: dict[str, str] = {}


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One test table; columns are pruned and filters pushed down by the Parquet scan."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def blank_trim(c: Column | str) -> Column:
    """Value without surrounding spaces and tabs."""
    return F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(" \t"))


def key_of(c: Column | str) -> Column:
    """Comparable key: blank-trimmed, with null for an empty one."""
    return F.nullif(blank_trim(c), F.lit(""))


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a folder of our own only where none is named.

    On a cluster the executors could not read a folder of this machine, so there a missing
    setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if "dir" not in _OWN:
            _OWN["dir"] = tempfile.mkdtemp(prefix="trussline-")
            atexit.register(shutil.rmtree, _OWN["dir"], ignore_errors=True)
        named = _OWN["dir"]
    return named


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back, without its lineage.

    A written table costs one pass over the plan, where checkpoint() computes it twice. The
    files outlive executors, and are deleted when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/trussline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def sketch(df: DataFrame, columns: Sequence[str], share: float = 0.02) -> tuple[int, dict[str, list[str]]]:
    """The number of rows, and the values holding at least about ``share`` of a column's rows.

    One scan with a bounded frequent-items sketch; at most ``1/share`` values a column come
    to the driver. The values steer salting only, so their error never changes a result.
    """
    k = max(1, int(1 / share))
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.expr(f"approx_top_k(cast({c} as string), {k}, {20 * k})").alias(f"top_{i}") for i, c in enumerate(columns)],
    ).first()
    least = max(1.0, row["n"] * share)
    return row["n"], {
        c: sorted(x["item"] for x in row[f"top_{i}"] or [] if x["item"] is not None and x["count"] >= least)
        for i, c in enumerate(columns)
    }


def hot_values(df: DataFrame, columns: Sequence[str], share: float = 0.02) -> dict[str, list[str]]:
    """The values of :func:`sketch`."""
    return sketch(df, columns, share)[1]


def one_of(column: str, values: Sequence[str]) -> Column:
    """Whether the column holds one of the values; false for none."""
    return F.col(column).isin(*values) if values else F.lit(False)


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    hot: Column | None,
    spread: Column,
    how: str = "left",
    salts: int = 48,
) -> DataFrame:
    """Equi-join in which the keys for which ``hot`` holds are spread over ``salts`` tasks.

    ``hot`` is an expression over the key columns, evaluated on both sides; ``spread`` is an
    expression over the left side that tells rows of one key apart. Right rows are repeated
    for hot keys only, so the repetition is bounded by (hot keys) x ``salts``. With ``hot``
    None every right row is repeated, for right sides that are small by nature.
    """
    is_hot = F.lit(True) if hot is None else F.coalesce(hot, F.lit(False))
    lft = left.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(F.lit(0)))
    every = F.array(*[F.lit(i) for i in range(salts)])
    rgt = right.withColumn("_salt", F.explode(F.when(is_hot, every).otherwise(F.array(F.lit(0)))))
    return lft.join(rgt, [*on, "_salt"], how).drop("_salt")
