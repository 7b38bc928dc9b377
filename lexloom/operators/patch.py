"""Patch operators as column expressions, for many units at once.

Each returns a status (APPLIED, or the reason of failure) and the resulting text; a failed
operation leaves the text as it was.  What depends on earlier commands of a law runs in the fold
(``lexloom.plans.apply``) instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.columns import bounded, count_words

APPLIED, MISSING, AMBIGUOUS = "APPLIED", "TARGET_MISSING", "AMBIGUOUS"


def _quoted(text: str) -> str:
    return text.replace("\\", "\\\\").replace("$", "\\$")


def word_status(text: Column, old: str, each: bool = False) -> Column:
    """How a word operation on ``old`` fares: it must occur, and once only unless each occurrence is meant."""
    n = count_words(text, old)
    return F.when(n == 0, MISSING).when((n > 1) & F.lit(not each), AMBIGUOUS).otherwise(APPLIED)


def replace_words(text: Column, old: str, new: str, each: bool = False) -> tuple[Column, Column]:
    status = word_status(text, old, each)
    return status, F.when(status == APPLIED, F.regexp_replace(text, bounded(old), _quoted(new))).otherwise(text)


def replace_at_end(text: Column, old: str, new: str) -> tuple[Column, Column]:
    bare = F.rtrim(text)
    status = F.when(bare.endswith(old), APPLIED).otherwise(MISSING)
    return status, F.when(status == APPLIED, F.concat(F.substring(bare, F.lit(1), F.length(bare) - len(old)), F.lit(new))).otherwise(text)


def strike_words(text: Column, old: str) -> tuple[Column, Column]:
    """Removes one occurrence and heals the seam: one space stays, none before punctuation or at an edge."""
    status = word_status(text, old)
    healed = F.regexp_replace(text, " ?" + bounded(old) + r"(?= ?([,.;:!?)]|$))|^" + bounded(old) + " ?|" + bounded(old) + " ?", "")
    return status, F.when(status == APPLIED, healed).otherwise(text)


def insert_words(text: Column, anchor: str, words: str, before: bool = False) -> tuple[Column, Column]:
    status = word_status(text, anchor)
    join = "" if not before and words[:1] in ",.;:" else " "
    new = f"{words} {anchor}" if before else f"{anchor}{join}{words}"
    return status, F.when(status == APPLIED, F.regexp_replace(text, bounded(anchor), _quoted(new))).otherwise(text)


def insert_at_end(text: Column, words: str) -> Column:
    """Words at the end, before a final full stop, comma or semicolon."""
    bare = F.rtrim(text)
    end = F.regexp_extract(bare, "([.,;])$", 1)
    stem = F.substring(bare, F.lit(1), F.length(bare) - F.length(end))
    return F.concat(stem, F.lit("" if words[:1] in ",.;:" else " "), F.lit(words), end)


def exactly_one(units: DataFrame, key: str, ok: Column) -> DataFrame:
    """(key, hits, status): an operation on a whole norm must succeed in exactly one of its paragraphs."""
    hits = F.sum(ok.cast("int"))
    status = F.when(F.col("hits") == 0, MISSING).when(F.col("hits") > 1, AMBIGUOUS).otherwise(APPLIED)
    return units.groupBy(key).agg(hits.alias("hits")).withColumn("status", status)


def append_unit(units: DataFrame, key: str, ordinal: str, **values: Column) -> DataFrame:
    """units with one more at the end of each norm, numbered after the last."""
    last = units.groupBy(key).agg((F.max(ordinal) + 1).cast(units.schema[ordinal].dataType).alias(ordinal))
    columns = [values[c].alias(c) if c in values else F.col(c) if c in (key, ordinal) else F.lit(None).cast(units.schema[c].dataType).alias(c) for c in units.columns]
    return units.unionByName(last.select(*columns))


def repeal_units(units: DataFrame, key: str, order: list[str], live: Column) -> DataFrame:
    """units with ``outcome``: a unit that is not live stays as a placeholder if a live one follows, else it is removed."""
    following = Window.partitionBy(key).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    later = F.coalesce(F.max(live.cast("int")).over(following), F.lit(0))
    return units.withColumn("outcome", F.when(live, "KEPT").when(later == 1, "PLACEHOLDER").otherwise("REMOVED"))


def renumber_upwards(units: DataFrame, ordinal: str, start: int, by: int = 1) -> DataFrame:
    """What a cascade of renumberings from the last label to ``start`` comes to: all at once."""
    return units.withColumn(ordinal, F.when(F.col(ordinal) >= start, F.col(ordinal) + by).otherwise(F.col(ordinal)))


def renumber_range(units: DataFrame, key: str, label: str, low: int, high: int, new_low: int, live: Column) -> DataFrame:
    """(key, label, new_label): the k-th live unit in the range gets the k-th new label."""
    held = units.where(live & F.col(label).between(low, high))
    by = Window.partitionBy(key).orderBy(label)
    return held.withColumn("new_label", (F.row_number().over(by) + new_low - 1).cast("long"))


def compound_status(parts: DataFrame, key: str, order: list[str], ok: Column, reason: Column) -> DataFrame:
    """(key, parts, status, reason): a compound is applied if each part is; else the first failed part's reason counts."""
    first = F.min(F.when(~ok, F.struct(*order, reason.alias("reason"))))
    whole = parts.groupBy(key).agg(F.count("*").alias("parts"), F.min(ok.cast("int")).alias("ok"), first.alias("f"))
    return whole.select(key, "parts", F.when(F.col("ok") == 1, APPLIED).otherwise("MANUAL").alias("status"), F.col("f.reason").alias("reason"))
