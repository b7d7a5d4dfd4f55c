"""Prompts to answers through functions given by the caller, with fallback."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.functions import fixed
from lexspark.session import use_checkpoints

Model = Callable[[Sequence[str]], Sequence[str]]


def score(df: DataFrame, prompt: str, models: Sequence[tuple[str, Model]], fallback: Column,
          batch_size: int = fixed.EMBED_BATCH, answer: str = "answer", model_used: str = "model_used",
          replies: str | None = None) -> DataFrame:
    """Add the answer and the name of the model that gave it.

    The models are tried in order for each batch of distinct prompts; the first that returns wins.
    Prompts that no model answers, and all prompts when there is no model, take ``fallback``. Replies
    are written once, since a model asked again may reply otherwise; rows find theirs by a digest of the
    prompt, and rows without a prompt take no part in the join.

    ``replies`` names a reply table (a folder in shared storage) kept across runs: replies are addressed by the
    names of the models in order and the digest of the prompt. Prompts found there are not asked again; new
    replies are appended. Prompts that no model answered are not kept, so they are asked again next time.
    """
    if not models:
        return df.withColumn(answer, fallback).withColumn(model_used, F.lit(fixed.NO_MODEL))

    def ask(texts: list[str]) -> tuple[list, str | None]:
        for name, model in models:
            try:
                replies = list(model(texts))
            except Exception:  # the next model in the list is the remedy
                continue
            if len(replies) == len(texts):
                return replies, name
        return [None] * len(texts), None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            texts = frame["_prompt"].tolist()
            replies, used = [], []
            for low in range(0, len(texts), batch_size):
                part = texts[low:low + batch_size]
                got, name = ask(part)
                replies += got
                used += [name] * len(part)
            yield pd.DataFrame({"_ask": frame["_ask"], "_reply": replies, "_model": used})

    keyed = df.withColumn("_ask", F.md5(prompt))
    distinct = keyed.where(F.col("_ask").isNotNull()).groupBy("_ask").agg(F.first(prompt).alias("_prompt"))
    use_checkpoints(df.sparkSession)
    key = "|".join(name for name, _ in models)
    known = _known(df.sparkSession, replies, key) if replies else None
    todo = distinct if known is None else distinct.join(known.select("_ask"), "_ask", "left_anti")
    answered = todo.mapInPandas(run, "_ask string, _reply string, _model string").checkpoint()
    if replies:
        answered.where(F.col("_model").isNotNull()).withColumn("_models", F.lit(key)).write.mode("append").parquet(replies)
    if known is not None:
        answered = answered.unionByName(known)
    nothing = F.lit(None).cast("string")
    joined = keyed.where(F.col("_ask").isNotNull()).join(answered, "_ask", "left").unionByName(
        keyed.where(F.col("_ask").isNull()).withColumn("_reply", nothing).withColumn("_model", nothing))
    return (
        joined.withColumn(answer, F.when(F.col("_model").isNotNull(), F.col("_reply")).otherwise(fallback))
        .withColumn(model_used, F.coalesce("_model", F.lit(fixed.NO_MODEL)))
        .drop("_ask", "_reply", "_model")
    )


def _known(spark, replies: str, key: str) -> DataFrame | None:
    """Stored replies of this list of models, one per digest; None if there are none yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(replies)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    stored = spark.read.parquet(replies).where(F.col("_models") == key)
    return stored.groupBy("_ask").agg(F.min(F.struct("_model", "_reply")).alias("_r")).select("_ask", "_r._reply", "_r._model")
