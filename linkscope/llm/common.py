"""Shared folder, written intermediate tables and text conventions of these operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: space and the characters 9 to 13.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, on one machine, a folder that goes with the process."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = context._jsc.sc().getCheckpointDir()
    if named is None and current.isDefined():
        return current.get()
    if named is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="linkscope-shared-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    if not current.isDefined():
        context.setCheckpointDir(named)
    return named


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/linkscope/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage is cut and it outlives lost executors."""
    path = path or fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a written table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def first_of_groups(docs: DataFrame, id_col: str, text_col: str, groups: Callable[[DataFrame, str, str], DataFrame]) -> DataFrame:
    """One row of each group, with all its columns: that with the smallest id (rows without one come last), of rows that share it one.

    groups: from rows, id column and text column to (doc_id, component_id), the smallest id of the row's group. Rows are told apart by a number
    of their own, so that rows without an id, or with an id in common, are lost only to a copy.
    """
    row, place = free_name(docs, "kept_row"), free_name(docs, "kept_place")
    numbered = written(docs.select(F.monotonically_increasing_id().alias(place), F.struct(*[quoted(c) for c in docs.columns]).alias(row)), "numbered")
    key = F.struct(F.col(row).getField(id_col).isNull().alias("none"), F.col(row).getField(id_col).alias("id"), F.col(place).alias("place"))
    found = groups(numbered.select(key.alias("key"), F.col(row).getField(text_col).alias("text")), "key", "text")
    firsts = found.where("doc_id.place = component_id.place").select(F.col("doc_id.place").alias(place))
    return numbered.join(firsts, place, "left_semi").select(*[F.col(row).getField(c).alias(c) for c in docs.columns])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, base: str) -> str:
    """base, with underscores until no column of df has that name."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")
