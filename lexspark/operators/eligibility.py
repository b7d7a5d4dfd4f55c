"""Profiles against schemes: the first matching schemes by name for every profile."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions import fixed
from lexspark.functions.text import cut, or_default
from lexspark.operators.containment import contains_pairs
from lexspark.operators.windows import top_k
from lexspark.session import use_checkpoints

_ANY = "*"
_CLASS = ["_state", "_who"]
_ORDER = ["scheme_name", "source_file"]


def _keep_reachable(limit: int):
    """Drop schemes that no income can bring among the first ``limit`` of their class.

    Rows come sorted by class and name. A scheme is out of reach when ``limit`` earlier ones of
    its class already admit every income that it admits.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, highest = None, []
        for batch in batches:
            keep = []
            ceilings = batch["income_limit_inr"].astype("float64").fillna(float("inf"))
            for state, who, ceiling in zip(batch["_state"], batch["_who"], ceilings):
                if (state, who) != current:
                    current, highest = (state, who), []
                reachable = len(highest) < limit or ceiling > highest[0]
                keep.append(reachable)
                if reachable:
                    bisect.insort(highest, ceiling)
                    del highest[:-limit]
            yield batch[keep]

    return run


def reachable_schemes(schemes: DataFrame, limit: int) -> DataFrame:
    """Per class the few schemes that some income can see; cut inside tasks, then once per class."""
    prune = _keep_reachable(limit)
    sort = [*_CLASS, *_ORDER]
    local = schemes.sortWithinPartitions(*sort).mapInPandas(prune, schemes.schema)
    return local.repartition(*_CLASS).sortWithinPartitions(*sort).mapInPandas(prune, schemes.schema)


def next_limits(incomes: DataFrame, limits: DataFrame) -> DataFrame:
    """(income, bracket): the least limit that still admits the income, NULL if there is none.

    Both tables have one column of distinct numbers. Values are sorted within narrow ranges (eighths of a power of
    two); where the rest of a range holds no limit, the first limit of the next range that has one is taken. There are
    at most 512 ranges, whatever the tables hold, so the table of their first limits is broadcast.
    """
    def placed(df: DataFrame, is_limit: bool) -> DataFrame:
        value = F.col(df.columns[0])
        spot = F.floor(F.log2(F.greatest(value, F.lit(0)).cast("double") + 1) * 8).cast("int")
        return df.where(value.isNotNull()).select(value.alias("_value"), F.lit(is_limit).alias("_is_limit"), spot.alias("_range"))

    both = placed(incomes, False).unionByName(placed(limits, True))
    onward = Window.partitionBy("_range").orderBy("_value", "_is_limit").rowsBetween(0, Window.unboundedFollowing)
    inside = both.withColumn("_inside", F.first(F.when(F.col("_is_limit"), F.col("_value")), ignorenulls=True).over(onward))
    ranges = both.groupBy("_range").agg(F.min(F.when(F.col("_is_limit"), F.col("_value"))).alias("_first"))
    after = Window.orderBy("_range").rowsBetween(1, Window.unboundedFollowing)
    later = ranges.select("_range", F.first("_first", ignorenulls=True).over(after).alias("_later"))
    return inside.where(~F.col("_is_limit")).join(F.broadcast(later), "_range").select(
        F.col("_value").alias("income"), F.coalesce("_inside", "_later").alias("_bracket"))


def _keys(profiles: DataFrame, wish: str, classes: DataFrame, label: str) -> DataFrame:
    """(wish, class) pairs: class values that contain the wish, and the class open to anybody."""
    wishes = profiles.select(wish).distinct()
    values = classes.select(F.col(label).alias("_value")).where(F.col(label) != _ANY).distinct()
    inside = contains_pairs(wishes, wish, values.withColumn("_text", F.col("_value")), "_value", "_text")
    blank = values.select(F.lit("").alias(wish), "_value")
    everyone = wishes.select(wish, F.lit(_ANY).alias("_value"))
    return inside.unionByName(blank).unionByName(everyone).withColumnRenamed("_value", label)


def eligible(profiles: DataFrame, schemes: DataFrame, limit: int = fixed.ELIGIBLE_ROWS,
             preview_chars: int | None = None) -> DataFrame:
    """First ``limit`` schemes by name for each profile.

    State and occupation match as substrings without regard to case, a scheme without state,
    beneficiary or income limit is open in that respect, as is a state holding ``all`` or a
    beneficiary holding ``general``. ``category`` plays no part.
    """
    state, who = F.lower("state"), F.lower("beneficiary_type")
    classed = schemes.select(
        F.when(state.isNull() | F.contains(state, F.lit("all")), F.lit(_ANY)).otherwise(state).alias("_state"),
        F.when(who.isNull() | F.contains(who, F.lit("general")), F.lit(_ANY)).otherwise(who).alias("_who"),
        "income_limit_inr", "scheme_name", "source_file", "ministry", "beneficiary_type",
        F.col("state").alias("scheme_state"), cut(F.col("full_text"), preview_chars).alias("preview"),
    )
    # A few rows per class, used several times below: the schemes themselves are read once.
    use_checkpoints(schemes.sparkSession)
    reachable = reachable_schemes(classed, limit).checkpoint()
    wishes = profiles.withColumn("_wish_state", F.coalesce(F.lower("state"), F.lit(_ANY))) \
        .withColumn("_wish_who", F.coalesce(F.lower("occupation"), F.lit(_ANY)))
    classes = reachable.select(*_CLASS).distinct()
    by_state = _keys(wishes, "_wish_state", classes, "_state")
    by_who = _keys(wishes, "_wish_who", classes, "_who")
    # Whoever wishes the same and has incomes between the same limits sees the same schemes: match each case once.
    # There are no more cases of one wish than there are limits, however many incomes.
    brackets = next_limits(wishes.select("income").distinct(), reachable.select("income_limit_inr").distinct())
    wishes = wishes.where(F.col("income").isNotNull()).join(brackets, "income").unionByName(
        wishes.where(F.col("income").isNull()), allowMissingColumns=True)
    case = ["_wish_state", "_wish_who", "_bracket"]
    admitted = F.col("income_limit_inr").isNull() | (F.col("income_limit_inr") >= F.col("_bracket"))
    matches = (
        wishes.select(*case).distinct()
        .join(by_state, "_wish_state").join(by_who, "_wish_who")
        .join(reachable, _CLASS)
        .where(admitted)
    )
    ranked = top_k(matches, case, _ORDER, limit)
    found = ranked.select(*[F.col(c).alias(f"_f{c}") for c in case], "rank",
                          "source_file", "scheme_name", "ministry", "beneficiary_type", "scheme_state",
                          "income_limit_inr", "preview")
    same = (F.col("_wish_state") == F.col("_f_wish_state")) & (F.col("_wish_who") == F.col("_f_wish_who")) \
        & F.col("_bracket").eqNullSafe(F.col("_f_bracket"))
    return wishes.select("profile_id", *case).join(found, same).select(
        "profile_id", "rank", "source_file", "scheme_name", "ministry", "beneficiary_type", "scheme_state",
        "income_limit_inr", "preview")


def eligible_by_state(profiles: DataFrame, schemes: DataFrame, limit: int = fixed.ELIGIBLE_ROWS,
                      everywhere: str = "All India") -> DataFrame:
    """First ``limit`` schemes by name of the profile's state or of the whole country.

    A profile for the whole country sees every scheme. Each scheme is filed under its state (or
    'everywhere') and under 'any'; only the first ``limit`` of a file can be shown.
    """
    open_to_all = F.col("state").isNull() | (F.col("state") == everywhere)
    filed = schemes.where(F.col("scheme_name").isNotNull()).select(
        F.explode(F.array(F.when(open_to_all, F.lit("everywhere")).otherwise(F.concat(F.lit("state:"), "state")),
                          F.lit("any"))).alias("_file"),
        "scheme_name", "source_file",
        or_default(F.col("ministry"), "Unknown").alias("ministry"),
        or_default(F.col("beneficiary_type"), "General").alias("beneficiary_type"),
    )
    first = top_k(filed, ["_file"], _ORDER, limit, "_file_rank")
    files = F.when(F.col("state") == everywhere, F.array(F.lit("any"))).otherwise(
        F.array_compact(F.array(F.lit("everywhere"), F.concat(F.lit("state:"), "state"))))
    # Each state is answered once, whatever the number of its profiles.
    wanted = profiles.select("state").distinct().select(F.col("state").alias("_state"), F.explode(files).alias("_file"))
    ranked = top_k(wanted.join(first, "_file"), ["_state"], _ORDER, limit)
    return profiles.join(ranked, F.col("state").eqNullSafe(F.col("_state"))).select(
        "profile_id", "rank", "source_file", "scheme_name", "ministry", "beneficiary_type")
