"""Joins between documents, laws, rules and versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def most_specific(rows: DataFrame, path: str, key: list[str], rules: DataFrame, prefix: str = "prefix") -> DataFrame:
    """rows with the rule whose prefix of the path is longest; the rule with an empty prefix is the general one.

    A path is joined by its beginnings, of the lengths that rules have: there are no more than a path is long.
    """
    lengths = sorted(r[0] for r in rules.select(F.length(prefix)).distinct().collect() if r[0] is not None)
    begins = F.array_compact(F.array(*[F.when(F.length(path) >= n, F.substring(F.col(path), 1, n)) for n in lengths])) if lengths else F.array().cast("array<string>")
    hits = rows.withColumn("__begin", F.explode_outer(begins)).join(rules, F.col("__begin") == F.col(prefix), "left").drop("__begin")
    by = Window.partitionBy(*key).orderBy(F.length(prefix).desc_nulls_last())
    return hits.withColumn("__n", F.row_number().over(by)).where("__n = 1").drop("__n")


def as_of_status(date: Column, as_of: Column) -> Column:
    """NOT_IN_FORCE after the date asked for; an undated rule is applied, with a warning."""
    return F.when(date.isNull(), "APPLIED_UNDATED").when(date > as_of, "NOT_IN_FORCE").otherwise("APPLIED")


def last_before(rows: DataFrame, key: str, order: list[str], is_draft: Column, draft: Column) -> DataFrame:
    """rows with ``found``: the last draft before the row."""
    by = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("found", F.last(F.when(is_draft, draft), ignorenulls=True).over(by))


def chain_order(docs: DataFrame, key: str, ordinal: str, issued: Column) -> DataFrame:
    """docs with ``place`` and ``moved``: by date of issue if every document of the chain has one, else as given."""
    whole = Window.partitionBy(key)
    dated = docs.withColumn("__issued", issued)
    dated = dated.withColumn("__all", F.min(F.col("__issued").isNotNull()).over(whole))
    by = Window.partitionBy(key).orderBy(F.when(F.col("__all"), F.col("__issued")), ordinal)
    given = Window.partitionBy(key).orderBy(ordinal)
    placed = dated.withColumn("place", F.row_number().over(by))
    return placed.withColumn("moved", F.col("place") != F.row_number().over(given)).drop("__issued", "__all")


def locate(wanted: DataFrame, units: DataFrame, key: list[str]) -> DataFrame:
    """wanted with ``matches`` and ``status``: a locator must name exactly one unit."""
    counts = units.groupBy(*key).agg(F.count("*").alias("matches"))
    found = wanted.join(counts, key, "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    return found.withColumn("status", F.when(F.col("matches") == 0, "MISSING").when(F.col("matches") == 1, "UNIQUE").otherwise("AMBIGUOUS"))


def reconcile(computed: DataFrame, official: DataFrame, key: str, wording: str) -> DataFrame:
    """(key, outcome) for each norm: EQUAL, DEVIATING, MISSING (official only) or EXTRA (computed only)."""
    c, o = computed.select(key, F.col(wording).alias("__c"), F.lit(1).alias("__in")), official.select(key, F.col(wording).alias("__o"), F.lit(1).alias("__of"))
    outcome = F.when(F.col("__in").isNull(), "MISSING").when(F.col("__of").isNull(), "EXTRA").when(F.col("__c").eqNullSafe(F.col("__o")), "EQUAL").otherwise("DEVIATING")
    return c.join(o, key, "full_outer").select(key, outcome.alias("outcome"))


def synopsis_kind(old: DataFrame, new: DataFrame, key: str, wording: str) -> DataFrame:
    """(key, kind) for each norm of either version: NEW, REPEALED, CHANGED, UNCHANGED; one without a new version is REMOVED."""
    o, n = old.select(key, F.col(wording).alias("__o"), F.lit(1).alias("__was")), new.select(key, F.col(wording).alias("__n"), F.lit(1).alias("__is"))
    kind = (
        F.when(F.col("__is").isNull(), "REMOVED")
        .when(F.col("__was").isNull(), "NEW")
        .when(F.col("__n").eqNullSafe(F.col("__o")), "UNCHANGED")
        .when(F.col("__n") == "(weggefallen)", "REPEALED")
        .otherwise("CHANGED")
    )
    return o.join(n, key, "full_outer").select(key, kind.alias("kind"))


def toc_problems(toc: DataFrame, norms: DataFrame, key: str, title: str) -> DataFrame:
    """(key, problem): norms without an entry, entries without a norm, entries whose title differs."""
    t, n = toc.select(key, F.col(title).alias("__t"), F.lit(1).alias("__in")), norms.select(key, F.col(title).alias("__n"), F.lit(1).alias("__is"))
    problem = F.when(F.col("__in").isNull(), "NO_ENTRY").when(F.col("__is").isNull(), "STALE_ENTRY").when(~F.col("__t").eqNullSafe(F.col("__n")), "TITLE_DIFFERS")
    return t.join(n, key, "full_outer").select(key, problem.alias("problem")).where("problem is not null")


def regressions(base: DataFrame, run: DataFrame, key: str, worse_if_less: list[str], worse_if_more: list[str]) -> DataFrame:
    """(key, metric, before, now): figures that got worse, and jobs that the run lacks; gains and new jobs are no complaint."""
    metrics = worse_if_less + worse_if_more
    pair = base.select(key, *[F.col(m).cast("long").alias(f"b_{m}") for m in metrics]).join(
        run.select(key, F.lit(1).alias("__ran"), *[F.col(m).cast("long").alias(f"r_{m}") for m in metrics]), key, "left"
    )
    rows = [F.struct(F.lit(m).alias("metric"), F.col(f"b_{m}").alias("before"), F.col(f"r_{m}").alias("now")) for m in metrics]
    lost = F.struct(F.lit("job").alias("metric"), F.lit(1).cast("long").alias("before"), F.col("__ran").cast("long").alias("now"))
    each = pair.select(key, F.explode(F.when(F.col("__ran").isNull(), F.array(lost)).otherwise(F.array(*rows))).alias("m")).select(key, "m.*")
    less = F.col("metric").isin(worse_if_less) & (F.col("now") < F.col("before"))
    more = F.col("metric").isin(worse_if_more) & (F.col("now") > F.col("before"))
    return each.where(less | more | (F.col("metric") == "job"))


def classify_heads(lines: DataFrame, key: str, rules: list[tuple[str, str]], head: int = 120) -> DataFrame:
    """(key, kind): the first rule whose pattern the head of a document has; its head is its first filled lines."""
    by = Window.partitionBy(key).orderBy("line_no")
    first = lines.where(F.trim("line") != "").withColumn("__k", F.row_number().over(by)).where(F.col("__k") <= head)
    heads = first.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(F.struct("line_no", "line"))).getField("line"), "\n").alias("__head"))
    kind = F.lit("UNKNOWN")
    for name, pattern in reversed(rules):
        kind = F.when(F.col("__head").rlike(pattern), name).otherwise(kind)
    return heads.select(key, kind.alias("kind"))


#: Lengths of the character grams by which names and preambles meet.
_GRAMS = (8, 4, 2, 1)


def _grams(text: Column, size: int) -> Column:
    starts = F.sequence(F.lit(1), F.length(text) - size + 1)
    return F.when(F.length(text) >= size, F.transform(starts, lambda k: F.substring(text, k, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def route(articles: DataFrame, preamble: str, laws: DataFrame, name: str) -> DataFrame:
    """articles with each law whose name their preamble contains, in whatever case and within longer words too.

    A character gram of the name, the one with the least hash, finds the preambles that may contain it, so that
    neither side need be held by every task; the whole name is then looked for.  Names shorter than the longest grams
    are found by shorter ones; an empty name is contained in every preamble.
    """
    whole, named = F.lower(preamble), F.lower(name)
    grams = F.array_distinct(F.concat(F.array(F.lit("")), *[_grams(whole, n) for n in _GRAMS]))
    key = F.lit("")
    for n in reversed(_GRAMS):
        least = F.array_min(F.transform(_grams(named, n), lambda g: F.struct(F.xxhash64(g).alias("h"), g.alias("g"))))["g"]
        key = F.when(F.length(named) >= n, least).otherwise(key)
    keys = articles.withColumn("__gram", F.explode(F.when(whole.isNotNull(), grams)))
    found = keys.join(laws.where(F.col(name).isNotNull()).withColumn("__gram", key), "__gram")
    return found.where(whole.contains(named)).drop("__gram")
