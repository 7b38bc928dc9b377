"""Repeated lines and runs of lines, by winnowing over line hashes.

Over every ``RUN`` consecutive lines of a document, the line with the least hash is
selected.  A run of RUN lines that stands in two places selects the same line in both,
so selected lines are guaranteed fingerprints: places are joined on them, and only
around fingerprints that occur twice are matches extended, RUN - 1 lines both ways.
A line of ``LONG`` words or more is a window of its own, and a fingerprint by itself.
Each extension is looked up by its line hashes, and its first place (by
doc_id, then line) is aggregated, never a pair of places.  Extensions whose first places follow one another like themselves are
one run: it goes on both ways as far as its lines and those of its first place are the same.  Everything is SQL functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.llm.common import Workspace

#: Lines of the shortest run that is deleted; also the winnowing window.
RUN = 3
#: Words of a line that is deleted without repeated neighbours.
LONG = 8


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, no, h, words): numbers, hashes and numbers of words of each document's filled lines."""
    lines = F.transform(F.split(F.coalesce(F.col("text"), F.lit("")), "\n"), lambda x, k: F.struct(k.alias("no"), F.trim(F.regexp_replace(x, r"[ \t\r]+", " ")).alias("t")))
    words = lambda t: F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1
    kept = F.transform(F.filter(lines, lambda x: x["t"] != ""), lambda x: F.struct(x["no"].alias("no"), F.xxhash64(x["t"]).alias("h"), words(x["t"]).alias("words")))
    return docs.select("doc_id", kept.alias("kept")).select("doc_id", F.col("kept.no").alias("no"), F.col("kept.h").alias("h"), F.col("kept.words").alias("words"))


def _selected(lines: DataFrame, run: int, long: int) -> DataFrame:
    """(doc_id, fp, at, alone, first, hashes, lines): each selected line with its neighbours, run - 1 on either side, and each long line alone.

    hashes and lines belong to the filled lines from the at-th on that first counts; alone are long lines, by themselves.
    """
    n = F.size("h")
    rows = lines.select("doc_id", "no", "h", "words", F.explode(F.sequence(F.lit(0), n - 1)).alias("at"))
    own, least = F.get("h", F.col("at")), F.lit(False)
    for k in range(run):  # the windows that hold the line, where they exist
        start = F.col("at") - k
        least = least | (start >= 0) & (start + run <= n) & (F.array_min(F.slice("h", F.greatest(start, F.lit(0)) + 1, F.lit(run))) == own)
    kinds = F.explode(F.array_compact(F.array(F.when(least, F.lit(False)), F.when(F.get("words", F.col("at")) >= long, F.lit(True)))))
    rows = rows.select("doc_id", "no", "h", "at", own.alias("fp"), n.alias("n"), kinds.alias("alone"))
    first = F.when(F.col("alone"), F.col("at")).otherwise(F.greatest(F.col("at") - (run - 1), F.lit(0)))
    span = F.when(F.col("alone"), F.lit(1)).otherwise(F.least(F.col("at") + run, F.col("n")) - first)
    return rows.select("doc_id", "fp", "at", "alone", first.alias("first"), F.slice("h", first + 1, span).alias("hashes"), F.slice("no", first + 1, span).alias("lines"))


def repeated_runs(spark: SparkSession, docs: DataFrame, run: int = RUN, long: int = LONG, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, first_line, last_line, n_lines, from_doc_id, from_line): runs to delete, and where their first line stands first.

    Lines are compared with white space trimmed and folded; blank ones are passed over,
    and belong to a run that goes on past them.  A run of at least ``run`` lines, or a line of at least ``long`` words, stays where it first occurs, by doc_id
    and line, and is deleted wherever it occurs later, in the same document
    too (but lines of its first place stay).  A run's lines all stand in its source, one after the other; where the first place changes, another
    run begins, and a line that several cover belongs to the one that begins first, and to a line alone last.  Lines are numbered from 0, and n_lines counts
    those that are not blank.  Null and empty texts have no lines; rows that share a
    doc_id are compared in one order, as if either came first; rows with a null
    doc_id are left out.  Other columns are left out; an empty table gives no rows.
    """
    work = Workspace(spark, "lines")
    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    selected = work.table(_selected(_lines(rows).where(F.size("h") > 0), run, long), "selected")
    # Written, so that the join has plain shuffles on both sides, of which adaptive execution splits a hot one.
    twice = work.table(selected.groupBy("fp", "alone").agg(F.count("*").alias("n")).where("n > 1").select("fp", "alone"), "twice")
    seeds = selected.join(twice, ["fp", "alone"])
    # Both ways: every run of lines that holds the selected one.
    size = F.when(F.col("alone"), F.lit(1)).otherwise(F.lit(run))
    starts = F.explode(F.sequence(F.lit(0), F.size("hashes") - size)).alias("k")
    part = lambda c: F.slice(c, F.col("k") + 1, size)
    grams = seeds.select("doc_id", "alone", "first", "hashes", "lines", starts).select(
        "doc_id", "alone", (F.col("first") + F.col("k")).alias("at"), part("hashes").alias("gram"), part("lines").alias("lines")
    )
    grams = work.table(grams, "grams")
    place = F.struct("doc_id", "at", "lines")
    firsts = work.table(grams.groupBy("gram", "alone").agg(F.min(place).alias("f"), F.max(place).alias("l")).where("f != l").select("gram", "alone", "f"), "firsts")
    later = grams.join(firsts, ["gram", "alone"]).where((F.col("doc_id") != F.col("f.doc_id")) | (F.col("at") != F.col("f.at")))
    each = later.select("doc_id", "alone", "at", "f", F.posexplode("lines").alias("k", "line"))
    # Where a run overlaps its own first place, that place's lines stay.
    each = each.where((F.col("doc_id") != F.col("f.doc_id")) | (F.col("at") + F.col("k") >= F.col("f.at") + F.size("f.lines")))
    source = F.struct("alone", "at", F.col("f.doc_id").alias("from_doc_id"), F.get("f.lines", F.col("k")).alias("from_line"), (F.col("f.at") + F.col("k")).alias("from_at"), "line")
    gone = each.select("doc_id", (F.col("at") + F.col("k")).alias("pos"), source.alias("s")).groupBy("doc_id", "pos").agg(F.min("s").alias("s")).select("doc_id", "pos", "s.*")
    by = Window.partitionBy("doc_id").orderBy("pos")
    goes_on = (F.lag("pos").over(by) == F.col("pos") - 1) & (F.lag("from_doc_id").over(by) == F.col("from_doc_id")) & (F.lag("from_at").over(by) == F.col("from_at") - 1)
    marked = gone.withColumn("new", F.when(goes_on, 0).otherwise(1)).withColumn("no", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return (
        marked.groupBy("doc_id", "no")
        .agg(F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.count("*").alias("n_lines"), F.min("from_doc_id").alias("from_doc_id"), F.min("from_line").alias("from_line"))
        .select("doc_id", "first_line", "last_line", "n_lines", "from_doc_id", "from_line")
    )


def without_runs(docs: DataFrame, runs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the lines of those runs deleted from the text; documents without runs, null texts and null ids are untouched.

    Rows that share a doc_id lose the same line numbers each; an empty table of either gives all rows as they are.
    """
    cut = runs.groupBy(F.col("doc_id").alias("__of")).agg(F.collect_list(F.struct("first_line", "last_line")).alias("__cut"))
    gone = lambda k: F.exists(F.col("__cut"), lambda c: (k >= c["first_line"]) & (k <= c["last_line"]))
    lines = F.transform(F.split(F.col(text), "\n"), lambda x, k: F.struct(gone(k).alias("gone"), x.alias("x")))
    left = F.array_join(F.transform(F.filter(lines, lambda x: ~x["gone"]), lambda x: x["x"]), "\n")
    joined = docs.join(cut, docs[doc_id] == cut["__of"], "left")
    return joined.withColumn(text, F.when(F.col("__cut").isNull(), F.col(text)).otherwise(left)).select(*docs.columns)
