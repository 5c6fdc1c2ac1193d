"""Row types of the engine's tables."""

from pyspark.sql import types as T

POSTS = T.StructType([
    T.StructField("id", T.LongType(), False), T.StructField("status", T.StringType()), T.StructField("type", T.StringType()),
    T.StructField("title", T.StringType()), T.StructField("content", T.StringType()), T.StructField("post_date", T.TimestampNTZType()),
    T.StructField("slug", T.StringType()), T.StructField("desired_slug", T.StringType()), T.StructField("parent_id", T.LongType()),
    T.StructField("has_password", T.BooleanType()), T.StructField("permalink", T.StringType()), T.StructField("is_sticky", T.BooleanType()),
    T.StructField("pageviews", T.LongType()), T.StructField("category_ids", T.ArrayType(T.LongType())),
])
LINKS = T.StructType([
    T.StructField("source_post_id", T.LongType(), False), T.StructField("pos", T.IntegerType()), T.StructField("target_post_id", T.LongType()),
    T.StructField("anchor_text", T.StringType()), T.StructField("context", T.StringType()), T.StructField("link_url", T.StringType()),
])
STATS = T.StructType([
    T.StructField("post_id", T.LongType(), False), T.StructField("inbound_count", T.LongType()), T.StructField("outbound_count", T.LongType()), T.StructField("orphan_score", T.DoubleType()),
])
SUGGESTIONS = T.StructType([
    T.StructField("id", T.LongType(), False), T.StructField("source_post_id", T.LongType()), T.StructField("target_post_id", T.LongType()), T.StructField("keyword", T.StringType()),
    T.StructField("context", T.StringType()), T.StructField("relevance_score", T.DoubleType()), T.StructField("status", T.StringType()),
])
