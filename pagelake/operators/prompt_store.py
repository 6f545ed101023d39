"""Prompts by content: each different prompt is asked once, however many rows need its answer.

A prompt's key is a hash of its kind and text. Rows keep only the key; the prompts to ask are the distinct ones that no
usable reply is stored for. Replies are stored in batches under the batch's name, so a batch that is run again replaces
itself, and all attempts are merged by key: of usable replies the one of the lowest attempt counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REPLIES = "prompt_key string, attempt int, content string"


def prompt_key(kind: Column | str, content: Column | str) -> Column:
    """The lengths' separator cannot be part of a kind, so different prompts never share a text."""
    kind, content = (F.col(c) if isinstance(c, str) else c for c in (kind, content))
    return F.sha2(F.concat_ws("\n", F.length(kind).cast("string"), kind, content), 256)


def keyed(prompts: DataFrame) -> DataFrame:
    """Prompts (prompt_kind, content and the keys of what needs them) with ``prompt_key``; rows without a prompt are left out."""
    return prompts.where("prompt_kind is not null and content is not null").withColumn("prompt_key", prompt_key("prompt_kind", "content"))


def distinct_prompts(prompts: DataFrame) -> DataFrame:
    """(prompt_key, prompt_kind, content), one row per different prompt. Equal ones are combined before anything is shuffled."""
    return keyed(prompts).groupBy("prompt_key").agg(F.first("prompt_kind").alias("prompt_kind"), F.first("content").alias("content"))


def store_replies(replies: DataFrame, path: str, batch: str) -> None:
    """Write the replies (prompt_key, attempt, content) of a batch; the batch written again replaces itself."""
    replies.select("prompt_key", F.col("attempt").cast("int").alias("attempt"), "content").write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")


def stored_replies(spark: SparkSession, path: str) -> DataFrame:
    """All stored attempts; none where nothing is stored yet."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], REPLIES)
    return spark.read.schema(REPLIES).parquet(path)


def usable(content: Column) -> Column:
    return content.isNotNull() & (F.trim(content) != "")


def answers(replies: DataFrame) -> DataFrame:
    """(prompt_key, content): the usable reply of the lowest attempt; of equal attempts the smaller text, so that reruns agree."""
    return replies.where(usable(F.col("content"))).groupBy("prompt_key").agg(F.min(F.struct("attempt", "content")).content.alias("content"))


def to_ask(prompts: DataFrame, replies: DataFrame) -> DataFrame:
    """Distinct prompts without a usable reply, with the number of the attempt to make."""
    tried = replies.groupBy("prompt_key").agg(F.max("attempt").alias("last"), F.max(usable(F.col("content"))).alias("done"))
    open_ones = distinct_prompts(prompts).join(tried, "prompt_key", "left").where("done is null or not done")
    return open_ones.select("prompt_key", "prompt_kind", "content", (F.coalesce("last", F.lit(0)) + 1).alias("attempt"))


def answered(prompts: DataFrame, replies: DataFrame, out: str = "reply") -> DataFrame:
    """The rows that need answers with theirs, NULL where there is none yet. Prompt texts are not carried along."""
    return keyed(prompts).drop("content").join(answers(replies).withColumnRenamed("content", out), "prompt_key", "left")
