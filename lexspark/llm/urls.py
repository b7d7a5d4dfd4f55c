"""URL filters: fixed rules, and a path-template tree per host. Columns, joins and aggregations only.

Paths are first written with lexical classes (numbers, hashes). In the tree of a host a position whose
branches are too many becomes a wildcard. Sibling templates, equal but for their first literal segment, are merged where
their labelled shares do not differ statistically from the siblings' common share. A template is
rejected if its share of blocked pages among the labelled ones, smoothed, is high enough. Labels come from the rules.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.functions.text import once

# Fixed values: (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
BRANCHES, EVIDENCE = 16, 5
PURITY_TENTHS = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def located(pages: DataFrame, url: str = "url") -> DataFrame:
    """All columns with ``host`` and ``path`` of the url; both are empty without ``://`` and for null."""
    rest = F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return pages.withColumn("host", F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER)).withColumn(
        "path", F.regexp_extract(F.regexp_replace(rest, "^[^/?#]*", ""), "^[^?#]*", 0))


def ruled(rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """Struct of ``rule`` (host and path) and ``verdict`` of the longest rule that fits host and path, else null."""
    found = None
    for verdict, host, path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))
        hit = F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, hit) if found is None else found.when(fits, hit)
    return found


def lexical(segment: Column) -> Column:
    """Class of a segment that is a number, with or without an extension, or a long hash; else the segment."""
    ending = F.regexp_extract(segment, r"(\.[A-Za-z]+)?$", 1)
    return (F.when(segment.rlike(r"^[0-9]+(\.[A-Za-z]+)?$"), F.concat(F.lit("{n}"), ending))
            .when(segment.rlike(r"^(?=.*[0-9])[0-9a-f-]{8,}(\.[A-Za-z]+)?$"), F.concat(F.lit("{h}"), ending)).otherwise(segment))


def templates(judged: DataFrame, branches: int = BRANCHES, evidence: int = EVIDENCE) -> DataFrame:
    """Per host and lexical path its ``template``, ``n_labelled``, ``n_blocked`` (after merging) and ``rejected``.

    ``judged`` has host, lexical (the path's classes) and label (allow, block or null).
    """
    is_ = lambda v: F.sum(F.when(F.col("label") == v, 1).otherwise(0))
    shapes = judged.groupBy("host", "lexical").agg(is_("block").alias("b"), F.count("label").alias("m"))
    parts = shapes.withColumn("parts", F.split("lexical", "/"))
    nodes = parts.select("host", "lexical", F.size("parts").alias("length"), F.posexplode("parts").alias("depth", "part"))
    wide = (nodes.select("host", "length", "depth", "part").distinct().groupBy("host", "length", "depth").agg(F.count("*").alias("n"))
            .filter(F.col("n") > branches).groupBy("host", "length").agg(F.collect_list("depth").alias("wide")))  # at most one entry a level
    named = parts.withColumn("length", F.size("parts")).join(wide, ["host", "length"], "left").select(
        "host", "lexical", "b", "m", F.transform("parts", lambda p, i: F.when(F.array_contains("wide", i), F.lit("*")).otherwise(p)).alias("parts"))
    free = lambda p: (p != "") & (p != "*") & ~p.startswith("{n}") & ~p.startswith("{h}")
    first = F.array_position(F.transform("parts", free), F.lit(True))
    named = once(named, "host", "lexical", "b", "m", template=F.array_join("parts", "/"),
                 family=F.array_join(F.transform("parts", lambda p, i: F.when(i + 1 == first, F.lit("*")).otherwise(p)), "/"))
    stats = named.groupBy("host", "family", "template").agg(F.sum("b").alias("b"), F.sum("m").alias("m"))
    weighed = stats.filter(F.col("m") >= evidence)
    common = weighed.groupBy("host", "family").agg(F.sum("b").alias("all_b"), F.sum("m").alias("all_m"))
    b, m, big_b, big_m = (F.col(c).cast("double") for c in ("b", "m", "all_b", "all_m"))
    apart = b * big_m - m * big_b
    alike = weighed.join(common, ["host", "family"]).filter(
        apart * apart <= 4 * m * big_b * (big_m - big_b)).select("host", "family", "template", "b", "m")
    merged = alike.groupBy("host", "family").agg(F.sum("b").alias("mb"), F.sum("m").alias("mm"))
    pooled = alike.join(merged, ["host", "family"]).select("host", "template", "mb", "mm")
    final = stats.join(pooled, ["host", "template"], "left").select(
        "host", "template", F.coalesce("mb", "b").alias("n_blocked"), F.coalesce("mm", "m").alias("n_labelled"))
    final = final.withColumn("rejected", (F.col("n_blocked") + 1) * 10 >= (F.col("n_labelled") + 2) * PURITY_TENTHS)
    return named.select("host", "lexical", "template").join(final, ["host", "template"])


def judged_pages(pages: DataFrame, branches: int = BRANCHES, evidence: int = EVIDENCE) -> DataFrame:
    """page_id, host, path, rule, verdict, template, n_labelled, n_blocked of every row.

    ``pages`` needs page_id and url; other columns are ignored. The longest fitting rule decides; without one the
    page is blocked if its template is rejected. Null urls and such without ``://`` have empty host and path and are
    judged by that template, which has no labels. Repeated rows count as often as they stand.
    """
    rows = located(pages.select("page_id", "url")).withColumn("ruled", ruled())
    rows = rows.select("page_id", "host", "path", F.col("ruled.rule").alias("rule"), F.col("ruled.verdict").alias("label"),
                       F.array_join(F.transform(F.split("path", "/"), lexical), "/").alias("lexical"))
    tree = templates(rows, branches, evidence)
    return rows.join(tree, ["host", "lexical"]).select(
        "page_id", "host", "path", "rule",
        F.coalesce("label", F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        "template", "n_labelled", "n_blocked")
