"""Which texts contain which patterns, as equi-joins instead of a nested loop.

Patterns, words and texts all grow with the tables, and the size of compressed files says little about them, so the
joins carry a merge hint: none of their sides is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.functions.text import SPACE, squeeze
from lexspark.operators.windows import top_k
from lexspark.session import use_checkpoints

_GRAM = 4


def _tokens(text: str) -> Column:
    return F.filter(F.array_distinct(F.split(squeeze(F.col(text)), " ")), lambda t: t != "")


def _grams(token: str, sizes: list[int]) -> Column:
    """Distinct substrings of the given sizes."""

    def of_size(size: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(token) - (size - 1))
        pieces = F.transform(starts, lambda start: F.col(token).substr(start, F.lit(size)))
        return F.when(F.length(token) >= size, pieces).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.flatten(F.array(*[of_size(size) for size in sizes])))


def _holding(words: DataFrame, vocabulary: DataFrame) -> DataFrame | None:
    """Rows of ``vocabulary`` (with ``_token``) and each of ``words`` (``_word``) inside the token, through short grams.

    None if there is no word at all.
    """
    distinct_words = words.select("_word").distinct().withColumn("_gram", F.substring("_word", 1, _GRAM))
    # At most _GRAM rows: the gram lengths that short words make necessary.
    sizes = sorted(row[0] for row in distinct_words.select(F.length("_gram")).distinct().limit(_GRAM).collect())
    if not sizes:
        return None
    return (
        vocabulary.withColumn("_gram", F.explode(_grams("_token", sizes)))
        .join(distinct_words.hint("merge"), "_gram")
        .where(F.contains("_token", "_word"))
        .drop("_gram")
    )


def least_holding(words: DataFrame, word: str, texts: DataFrame, text_id: str, text: str, group: str, k: int) -> DataFrame:
    """(word, group, text_id): per group the ``k`` least text ids that hold each one-word pattern.

    Every token keeps its k least texts of a group before it meets a word, so a word that stands
    nearly everywhere costs no more than a rare one.
    """
    asked = words.select(F.col(word).alias("_word")).where(F.col(word) != "").distinct()
    tokens = texts.select(text_id, group, F.explode(_tokens(text)).alias("_token"))
    first = top_k(tokens, ["_token", group], [text_id], k).drop("rank")
    held = _holding(asked, first.select("_token").distinct())
    if held is None:
        return first.select(F.col("_token").alias(word), group, text_id).where(F.lit(False))
    hits = first.join(held.hint("merge"), "_token").select(F.col("_word").alias(word), group, text_id).distinct()
    return top_k(hits, [word, group], [text_id], k).drop("rank")


def _leads(patterns: DataFrame, pattern: str, texts: DataFrame, text_id: str, text: str):
    """(wanted patterns, postings (text_id, _token), leads (_pattern, _token)): the tokens that hold each pattern's rarest word.

    leads is None if no pattern has a word.
    """
    wanted = patterns.select(F.col(pattern).alias("_pattern")).where(squeeze(F.col(pattern)) != "").distinct()
    words = wanted.select("_pattern", F.explode(_tokens("_pattern")).alias("_word"))
    tokens = texts.select(text_id, F.explode(_tokens(text)).alias("_token"))
    vocabulary = tokens.groupBy("_token").agg(F.count("*").alias("_texts"))
    matched = _holding(words, vocabulary)
    if matched is None:
        return wanted, tokens, None
    reach = matched.groupBy("_word").agg(F.sum("_texts").alias("_reach"))
    anchors = (
        words.join(reach.hint("merge"), "_word", "left")
        .groupBy("_pattern")
        .agg(F.count("*").alias("_words"), F.count("_reach").alias("_found"),
             F.min(F.struct("_reach", "_word")).alias("_rarest"))
        .where(F.col("_words") == F.col("_found"))
        .select("_pattern", F.col("_rarest._word").alias("_word"))
    )
    leads = anchors.join(matched.hint("merge"), "_word").select("_pattern", "_token")
    return wanted, tokens, leads


def first_containing(patterns: DataFrame, pattern: str, texts: DataFrame, text_id: str, text: str, k: int,
                     blocks: int = 64, first: int = 4, growth: int = 4) -> DataFrame:
    """(pattern, text_id, rank): per pattern the ``k`` least text ids whose text holds it literally (top-k containment).

    Postings of a pattern's anchor token are visited in text-id order: the texts are range-partitioned by id into
    ``blocks`` ordered blocks, visited in rounds of ``first`` blocks, then ``growth`` times as many each round. Each round verifies the candidates of the
    patterns still open, keeps at most ``k`` hits of each, and closes the patterns that have ``k``; so a pattern
    that stands in every text ends after the first block, and no round hands on more than ``k`` rows a pattern.
    Text ids are unique; patterns may repeat; blank patterns match nothing.
    """
    from lexspark.operators.windows import top_k
    from lexspark.session import scratch_path

    spark = patterns.sparkSession
    wanted, _, leads = _leads(patterns, pattern, texts, text_id, text)
    empty = wanted.select(F.col("_pattern").alias(pattern), F.lit(None).cast(texts.schema[text_id].dataType).alias(text_id),
                          F.lit(1).alias("rank")).where(F.lit(False))
    if leads is None:
        return empty
    path = scratch_path(spark, "ordered-texts")
    texts.select(text_id, text).repartitionByRange(blocks, text_id).withColumn("_block", F.spark_partition_id()) \
        .write.parquet(path)
    _write_done(spark, path)
    ordered = spark.read.parquet(path)
    postings = ordered.select(text_id, "_block", F.explode(_tokens(text)).alias("_token"))
    cuts = sorted(r[0] for r in ordered.select("_block").distinct().collect())  # at most ``blocks`` numbers
    open_leads, found, start, width = leads, None, 0, first
    while start < len(cuts) and open_leads is not None:
        visit = cuts[start:start + width]
        here = postings.where(F.col("_block").isin(visit)).join(open_leads.hint("merge"), "_token").select("_pattern", text_id).distinct()
        proven = ~F.col("_pattern").rlike(SPACE)
        texts_here = ordered.where(F.col("_block").isin(visit)).select(text_id, F.col(text).alias("_text"))
        hits = here.where(proven).unionByName(
            here.where(~proven).join(texts_here.hint("merge"), text_id).where(F.contains("_text", "_pattern")).select("_pattern", text_id))
        kept = top_k(hits, ["_pattern"], [text_id], k).drop("rank")
        found = kept if found is None else found.unionByName(kept)
        found = spark.read.parquet(_write(found, scratch_path(spark, "first-hits")))
        full = top_k(found, ["_pattern"], [text_id], k).groupBy("_pattern").count().where(F.col("count") >= k).select("_pattern")
        open_leads = open_leads.join(full.hint("merge"), "_pattern", "left_anti")
        open_leads = spark.read.parquet(_write(open_leads, scratch_path(spark, "open-leads")))
        if open_leads.isEmpty():
            open_leads = None
        start, width = start + width, width * growth
    if found is None:
        return empty
    ranked = top_k(found, ["_pattern"], [text_id], k)
    return wanted.join(ranked.hint("merge"), "_pattern").select(F.col("_pattern").alias(pattern), text_id, "rank")


def _write_done(spark, path: str) -> None:
    from lexspark.session import remove_at_exit

    remove_at_exit(spark, path)


def _write(df: DataFrame, path: str) -> str:
    from lexspark.session import remove_at_exit

    df.write.parquet(path)
    remove_at_exit(df.sparkSession, path)
    return path


def contains_pairs(patterns: DataFrame, pattern: str, texts: DataFrame, text_id: str, text: str) -> DataFrame:
    """Distinct (pattern, text_id) with the pattern literally inside the text; blank patterns match nothing.

    Text ids are unique; patterns may repeat.

    A text can contain a pattern only if, for each word of the pattern, one of its own
    whitespace-separated tokens contains that word. So words are matched against the *vocabulary*
    of the texts on short character grams, the pattern word found in the fewest texts becomes its
    anchor, and only texts holding a token of the anchor are compared with the pattern. A pattern of one
    word needs no comparison: a token that holds the word proves the text does.
    """
    wanted, tokens, leads = _leads(patterns, pattern, texts, text_id, text)
    if leads is None:
        return wanted.select("_pattern", F.lit(None).cast(texts.schema[text_id].dataType).alias(text_id)).where(F.lit(False)) \
            .withColumnRenamed("_pattern", pattern)
    # Pairs of small ids, needed twice.
    use_checkpoints(patterns.sparkSession)
    candidates = tokens.join(leads.hint("merge"), "_token").select("_pattern", text_id).distinct().checkpoint()
    proven = ~F.col("_pattern").rlike(SPACE)
    compared = (
        candidates.where(~proven).join(texts.select(text_id, F.col(text).alias("_text")).hint("merge"), text_id)
        .where(F.contains("_text", "_pattern")).select("_pattern", text_id)
    )
    return candidates.where(proven).unionByName(compared).withColumnRenamed("_pattern", pattern)
