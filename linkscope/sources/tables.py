"""Views of the driver's tables as posts, links, suggestions and documents, and the sink for rebuilt tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as posts. Ids that are left out stand for deleted posts; attachments inherit their parent's status."""
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    kind = F.when(k % 7 == 0, "page").when(k % 13 == 0, "product").when(k % 17 == 0, "attachment").otherwise("post")
    status = F.when(k % 11 == 3, "draft").when(k % 23 == 5, "trash").when(k % 29 == 7, "private").when(kind == "attachment", "inherit").otherwise("publish")
    return o.where(k % 101 != 13).select(
        k.alias("id"),
        status.alias("status"),
        kind.alias("type"),
        F.concat(F.lit("Post "), k.cast("string")).alias("title"),
        F.col("o_orderpriority").alias("content"),
        F.col("o_orderdate").alias("post_date"),
        F.when(status == "trash", F.concat(F.lit("post-"), k.cast("string"), F.lit("__trashed"))).otherwise(F.concat(F.lit("post-"), k.cast("string"))).alias("slug"),
        F.when((status == "trash") & (k % 2 == 0), F.concat(F.lit("post-"), k.cast("string"))).alias("desired_slug"),
        F.when((kind == "attachment") & (k % 3 == 0), k - 1).otherwise(0).cast("long").alias("parent_id"),
        (k % 37 == 1).alias("has_password"),
        F.concat(F.lit("https://example.test/post-"), k.cast("string"), F.lit("/")).alias("permalink"),
        (F.col("o_orderpriority") == "1-URGENT").alias("is_sticky"),
        F.when(k % 19 == 0, F.floor(F.col("o_totalprice") / 1000)).cast("long").alias("pageviews"),
        F.array((F.col("o_custkey") % 25).cast("long")).alias("category_ids"),
    )


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as links; parallel and self links occur."""
    target = F.col("l_partkey") * 7 + F.col("l_suppkey")
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("source_post_id"), target.alias("target_post_id"), F.col("l_linenumber").alias("pos"), F.concat(F.lit("/post-"), target.cast("string"), F.lit("/")).alias("link_url")
    )


def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as stored suggestions."""
    status = F.when(F.col("l_returnflag") == "N", "pending").when(F.col("l_returnflag") == "A", "applied").otherwise("dismissed")
    return read(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.col("l_orderkey").alias("source_post_id"),
        (F.col("l_partkey") * 7 + F.col("l_suppkey")).alias("target_post_id"),
        F.when(F.col("l_linestatus") == "O", "high").otherwise("specified").alias("keyword"),
        (F.col("l_quantity") + F.col("l_discount")).alias("relevance_score"),
        status.alias("status"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with a title (their first five words) and a date."""
    d = read(spark, sf_dir, "documents")
    words = F.slice(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " "), 1, 5)
    return d.select("doc_id", "text", F.col("source").alias("category"), F.array_join(words, " ").alias("title"), (F.col("doc_id") % 120).alias("age_days"))


def publish(df: DataFrame, folder: str, version: str) -> str:
    """A rebuilt table under a folder of its own, to which readers are pointed once it is whole.

    The pointer is an empty file in ``folder``/_current, made in one step after the rows; a job that dies before leaves readers with the
    version before.
    """
    path = f"{folder.rstrip('/')}/{version}"
    df.write.mode("overwrite").parquet(path)
    files, pointers = _files(df.sparkSession, f"{folder.rstrip('/')}/_current")
    last = max((int(n.split("=")[0]) for n in _names(files, pointers)), default=0)
    files.create(df.sparkSession._jvm.org.apache.hadoop.fs.Path(pointers, f"{last + 1:012d}={version}"), False).close()
    return path


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The version that was published last."""
    names = sorted(_names(*_files(spark, f"{folder.rstrip('/')}/_current")))
    if not names:
        raise FileNotFoundError(f"nothing was published in {folder}")
    return spark.read.parquet(f"{folder.rstrip('/')}/{names[-1].split('=', 1)[1]}")


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _names(files, where) -> list[str]:
    return [f.getPath().getName() for f in files.listStatus(where)] if files.exists(where) else []
