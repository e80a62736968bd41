"""Shared plumbing: the shared work folder, written stage tables, fresh column names."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that part words, as Java and Python regular expressions write them.
SPACE_CLASS = r"[\x20\x09-\x0D]"
_written: list[tuple[SparkSession, str]] = []


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on a local master one of our own where that is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = jvm_dir.get() if jvm_dir.isDefined() else None
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="lakeproof-work-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def stage_table(df: DataFrame, tag: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder, with ``by`` a folder for each of that column's values, and read it back.

    The files cut the lineage and outlive any executor. They stay until :func:`release` or the end of the process.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/stage-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=by)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def near_if_small(written: DataFrame, most_rows: int = 500_000) -> DataFrame:
    """A written table of narrow rows, to be broadcast if a count of its rows allows, else to be shuffled."""
    return F.broadcast(written) if written.count() <= most_rows else written


def join_classes(rows: DataFrame, classes: DataFrame, keys: list[str], how: str = "inner", share: float = 0.0005) -> DataFrame:
    """Written ``rows``, each with the columns of its class: a written table with a row for each class and, in ``n``, how many rows it has; ``how`` is inner or left.

    Few classes are broadcast. Of many, those with more than ``share`` of the rows are, at most 1 / share of them, and their rows stay where they
    lie; the rest are shuffled, so that a task gets no class of more than that share, and a larger part of it can be split at run time.
    """
    near = near_if_small(classes)
    if near is not classes:
        return rows.join(near, keys, how)
    many = F.col("n") > share * classes.agg(F.sum("n")).first()[0]
    heavy = F.broadcast(classes.where(many))
    return rows.join(heavy, keys).unionByName(rows.join(heavy, keys, "left_anti").join(classes.where(~many), keys, how))


def release() -> None:
    """Delete what :func:`stage_table` wrote; call it when no result that reads it is needed any more."""
    while _written:
        spark, path = _written.pop()
        with contextlib.suppress(Exception):
            jvm = spark.sparkContext._jvm
            hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
            hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)


atexit.register(release)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` doesn't have, whatever case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def col(df: DataFrame, name: str):
    """A top-level column by its exact name, dots and all."""
    return df["`" + name.replace("`", "``") + "`"]


def squeezed(text):
    """``text`` without the six white-space characters; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in " \n\t\r\x0b\x0c":
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
