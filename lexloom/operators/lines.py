"""Operators on the lines of documents: splitting, furniture, break classes, layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORDS = r"[^\p{L}\p{N}.-]+"


def lines_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no from 0, line)."""
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Lines as numbered paragraphs: a leading "(n)" becomes the number."""
    found = lines_of(docs, key, text)
    head = r"^\(([0-9]+[a-z]?)\)[ \t]+"
    number = F.regexp_extract("line", head, 1)
    return found.select(key, F.col("line_no").alias("para_ord"), F.when(number != "", number).alias("number"), F.regexp_replace("line", head, "").alias("body"))


def is_furniture(line: Column) -> Column:
    """Page numbers and page heads that stand alone on a line."""
    return line.rlike(r"^[ \t]*(-? ?[0-9]{1,4} ?-?|Seite [0-9]+( von [0-9]+)?|\| ?[0-9]+|Drucksache [0-9]+/[0-9]+)[ \t]*$")


def vocabulary(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n_docs): each word once for each document."""
    words = F.array_distinct(F.split(text, WORDS))
    return docs.select(F.explode(words).alias("word")).where("word != ''").groupBy("word").agg(F.count("*").alias("n_docs"))


def break_seams(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, tail, head, is_gap): at each line break, whether words stay apart.

    They do if the tail (of at least four letters) also occurs within a line of the
    document, and tail and head joined occur nowhere in it.  A document's words are all in its own row, so
    nothing is shuffled; set operations on its arrays find what occurs.
    """
    filled = F.filter(
        F.transform(F.split(text, "\n"), lambda x, k: F.struct(k.alias("no"), F.filter(F.split(x, WORDS), lambda w: w != "").alias("w"))),
        lambda x: F.size(x["w"]) > 0,
    )
    rows = docs.select(key, filled.alias("l")).withColumn("n", F.greatest(F.size("l") - 1, F.lit(0)))
    tails = F.transform(F.slice("l", F.lit(1), F.col("n")), lambda x: F.element_at(x["w"], -1))
    heads = F.transform(F.slice("l", F.lit(2), F.col("n")), lambda x: F.element_at(x["w"], 1))
    inner = F.flatten(F.transform("l", lambda x: F.slice(x["w"], F.lit(2), F.greatest(F.size(x["w"]) - 2, F.lit(0)))))
    rows = rows.select(key, "l", tails.alias("tails"), heads.alias("heads"), inner.alias("inner"), F.flatten(F.transform("l", lambda x: x["w"])).alias("known"))
    rows = rows.withColumn("joined", F.zip_with("tails", "heads", lambda a, b: F.concat(a, b)))
    rows = rows.select(
        key, "l", "tails", "heads", "joined", F.array_intersect("tails", "inner").alias("within"), F.array_intersect("joined", "known").alias("whole")
    )
    seams = rows.select(key, "within", "whole", F.explode(F.arrays_zip(F.col("l.no").alias("no"), "tails", "heads", "joined")).alias("s"))
    is_gap = (F.length("s.tails") >= 4) & F.array_contains("within", F.col("s.tails")) & ~F.array_contains("whole", F.col("s.joined"))
    return seams.where("s.tails is not null").select(key, F.col("s.no").alias("line_no"), F.col("s.tails").alias("tail"), F.col("s.heads").alias("head"), is_gap.alias("is_gap"))


def _around(key: str, reach: int = 20):
    return Window.partitionBy(key).orderBy("line_no").rowsBetween(-reach, reach)


def typical_length(lines: DataFrame, key: str = "doc_id", reach: int = 20) -> DataFrame:
    """The 90th percentile of the filled lines' lengths among the ``reach`` before and after."""
    filled = lines.where(F.trim("line") != "").withColumn("len", F.length("line"))
    near = F.sort_array(F.collect_list("len").over(_around(key, reach)))
    at = F.least(F.floor(F.size("near") * 0.9), F.size("near") - 1).cast("int")
    return filled.withColumn("near", near).select(key, "line_no", F.get("near", at).alias("typical"))


def line_ends(lines: DataFrame, key: str = "doc_id", end: str = "x1", reach: int = 20, within: float = 4, cluster: int = 5, indent: float = 10) -> DataFrame:
    """SOFT where a cluster of near lines ends at the same place, HARD where one ends clearly further right, else UNKNOWN."""
    near = lines.withColumn("near", F.collect_list(end).over(_around(key, reach)))
    members = lambda x: F.size(F.filter("near", lambda y: F.abs(y - x) <= within))
    soft = members(F.col(end)) >= cluster
    hard = F.exists("near", lambda x: (x >= F.col(end) + indent) & (members(x) >= cluster))
    return near.select(key, "line_no", F.when(soft, "SOFT").when(hard, "HARD").otherwise("UNKNOWN").alias("line_end"))


def widest_gutter(
    lines: DataFrame, page: str, x0: str, x1: str, few: tuple[float, float] = (4.0, 0.1), many: tuple[float, float] = (3.0, 0.2),
    least: float = 12.0, off_middle: float = 0.1, column: float = 0.3,
) -> DataFrame:
    """(page, gutter, width, crossing): the widest gap to the right of some line's end with few lines across it and many on each side (at least so many, or such a share).

    It is at least ``least`` points wide, no farther from the middle of what is printed than such a share of its width, and the columns beside it are
    no narrower than such a share: the gaps of tables are.

    One pass over the sorted ends and starts of a page's lines, by running counts.
    """
    ends = lines.select(page, F.col(x1).alias("x"), F.lit(1).alias("ends"), F.lit(0).alias("starts"))
    starts = lines.select(page, F.col(x0).alias("x"), F.lit(0).alias("ends"), F.lit(1).alias("starts"))
    points = ends.unionByName(starts).groupBy(page, "x").agg(F.sum("ends").alias("ends"), F.sum("starts").alias("starts"))
    whole = Window.partitionBy(page)
    low, high = F.min(F.when(F.col("starts") > 0, F.col("x"))).over(whole), F.max(F.when(F.col("ends") > 0, F.col("x"))).over(whole)
    points = points.withColumn("low", low).withColumn("high", high)
    by = Window.partitionBy(page).orderBy("x")
    total = F.sum("ends").over(Window.partitionBy(page))
    left = F.sum("ends").over(by)
    before = F.coalesce(F.sum("starts").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    following = F.first(F.when(F.col("starts") > 0, F.col("x")), ignorenulls=True).over(by.rowsBetween(0, Window.unboundedFollowing))
    found = points.select(page, F.col("x").alias("gutter"), "ends", "low", "high", total.alias("n"), left.alias("left"), (total - before).alias("right"), (following - F.col("x")).alias("width"))
    crossing = F.col("n") - F.col("left") - F.col("right")
    enough = F.greatest(F.lit(many[0]), F.col("n") * many[1])
    printed = F.col("high") - F.col("low")
    middle = F.abs(F.col("gutter") - (F.col("low") + F.col("high")) / 2) <= off_middle * printed
    columns = (F.col("gutter") - F.col("low") >= column * printed) & (F.col("high") - F.col("gutter") - F.col("width") >= column * printed)
    fits = middle & columns & (F.col("width") >= least) & (F.col("ends") > 0) & (crossing <= F.greatest(F.lit(few[0]), F.col("n") * few[1])) & (F.col("left") >= enough) & (F.col("right") >= enough)
    found = found.withColumn("crossing", crossing).where(fits)
    # Aliases, since an aggregate's struct field must not shadow a column.
    best = F.max(F.struct("width", (-F.col("gutter")).alias("minus"), "crossing"))
    return found.groupBy(page).agg(best.alias("b")).select(page, (-F.col("b.minus")).alias("gutter"), F.col("b.width").alias("width"), F.col("b.crossing").cast("long").alias("crossing"))


def reading_order(lines: DataFrame, page: str = "page", seq: str = "seq", baseline: str = "baseline", x0: str = "x0", x1: str = "x1") -> DataFrame:
    """lines with their place in reading order.

    Lines that cross the page's gutter part bands; in a band the left column comes before the right one, each
    by baseline.  Without a gutter the order of the stream stays.
    """
    gutters = widest_gutter(lines, page, x0, x1).select(page, "gutter")
    side = F.when(F.col(x1) <= F.col("gutter"), 0).when(F.col(x0) >= F.col("gutter"), 1).otherwise(2)
    placed = lines.join(gutters, page, "left").withColumn("side", F.when(F.col("gutter").isNull(), 0).otherwise(side))
    down = Window.partitionBy(page).orderBy(F.when(F.col("gutter").isNotNull(), F.col(baseline)), seq)
    placed = placed.withColumn("band", F.sum(F.when(F.col("side") == 2, 1).otherwise(0)).over(down))
    column = F.when(F.col("side") == 2, -1).otherwise(F.col("side"))
    order = Window.partitionBy(page).orderBy("band", column, F.when(F.col("gutter").isNotNull(), F.col(baseline)), seq)
    return placed.withColumn("place", F.row_number().over(order)).drop("gutter", "side", "band")


def body_size(glyphs: DataFrame, page: str = "page", size: str = "size", n: str = "n", most: float = 0.6, least: float = 0.25) -> DataFrame:
    """(page, body): the size of at least 60 % of a page's characters, else the largest with at least 25 %, else the document's."""

    def pick(counts: DataFrame, totals: DataFrame, by: list[str]) -> DataFrame:
        share = F.col("k") / F.col("all")
        largest = [F.max(F.when(share >= s, F.col(size))) for s in (most, least)]
        joined = counts.join(totals, by) if by else counts.crossJoin(totals)  # one row
        return joined.groupBy(*by).agg(F.coalesce(*largest).alias("body"))

    per = glyphs.groupBy(page, size).agg(F.sum(n).alias("k"))
    sizes = per.groupBy(size).agg(F.sum("k").alias("k"))
    whole = pick(sizes, sizes.agg(F.sum("k").alias("all")), []).select(F.col("body").alias("whole"))
    return pick(per, per.groupBy(page).agg(F.sum("k").alias("all")), [page]).crossJoin(whole).select(page, F.coalesce("body", "whole").alias("body"))


def quote_depth(lines: DataFrame, key: str = "doc_id", opening: str = "(", closing: str = ")") -> DataFrame:
    """(key, line_no, depth): quotes open at the end of each line."""
    count = lambda mark: F.length("line") - F.length(F.replace(F.col("line"), F.lit(mark), F.lit("")))
    by = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("d", count(opening) - count(closing)).select(key, "line_no", F.sum("d").over(by).alias("depth"))


def last_valid(rows: DataFrame, key: str, order: list[str], flag: Column) -> DataFrame:
    """rows with ``valid``: the last known flag, carried forward over rows that do not say."""
    by = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("valid", F.last(flag, ignorenulls=True).over(by))


def bands(rows: DataFrame, key: str, order: list[str], separator: Column) -> DataFrame:
    """rows with ``band``: how many separators have been seen."""
    by = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("band", F.sum(separator.cast("int")).over(by))


def without_small_print(runs: DataFrame, sizes: DataFrame, page: str = "page", size: str = "size", baseline: str = "baseline", much: float = 3.0) -> DataFrame:
    """runs without footnotes: smaller than the page's body and below its last body line, or smaller by more than ``much`` points."""
    placed = runs.join(sizes.select(page, "body"), page, "left")
    last = F.max(F.when(F.col(size) >= F.col("body"), F.col(baseline))).over(Window.partitionBy(page))
    small = F.col(size) < F.col("body")
    drop = small & ((F.col("__last").isNotNull() & (F.col(baseline) > F.col("__last"))) | (F.col("body") - F.col(size) > much))
    return placed.withColumn("__last", last).where(~F.coalesce(drop, F.lit(False))).drop("__last", "body")


def raised_digits(runs: DataFrame, page: str = "page", seq: str = "seq", size: str = "size", baseline: str = "baseline", text: str = "text") -> DataFrame:
    """runs with smaller digits that stand 2 to 6 points above the text before them as superscripts."""
    from lexloom.functions.columns import to_superscript

    by = Window.partitionBy(page).orderBy(seq)
    rise = F.lag(baseline).over(by) - F.col(baseline)
    raised = F.col(text).rlike("^[0-9]+$") & (F.col(size) < F.lag(size).over(by)) & rise.between(2, 6)
    return runs.withColumn(text, F.when(raised, to_superscript(text)).otherwise(F.col(text)))


def paired_columns(lines: DataFrame, page: str = "page", baseline: str = "baseline", x0: str = "x0", text: str = "text", middle: float = 0.0, within: float = 1.0) -> DataFrame:
    """(page, row, left_text, right_text): lines of two columns whose baselines differ by at most ``within`` are one row."""
    by = Window.partitionBy(page).orderBy(baseline, x0)
    starts = F.coalesce(F.col(baseline) - F.lag(baseline).over(by) > within, F.lit(True))
    rows = lines.withColumn("__new", starts.cast("int")).withColumn("row", F.sum("__new").over(by))
    side = lambda k: F.array_join(F.array_sort(F.collect_list(F.when((F.col(x0) >= middle) == bool(k), F.struct(x0, text)))).getField(text), " ")
    return rows.groupBy(page, "row").agg(side(0).alias("left_text"), side(1).alias("right_text"))


def resolved_rows(rows: DataFrame, key: str, order: list[str], left: str = "left_text", right: str = "right_text") -> DataFrame:
    """rows of (draft, resolution) with ``resolved``: "unverändert" takes the left, "entfällt" nothing, other text the right;
    an empty right keeps the left while the last word on it was that it stays."""
    r = F.trim(right)
    unchanged, dropped = r.rlike("unverändert[.]?$"), r.rlike("entfällt[.]?$")
    flag = F.when(r == "", None).when(unchanged, True).otherwise(False)
    valid = F.coalesce(F.last(flag, ignorenulls=True).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)), F.lit(True))
    bare = F.regexp_replace(F.trim(left), r"^([0-9]+[a-z]?\.|[a-z]+\)|\([0-9]+\))[ ]*", "")
    mark = F.regexp_extract(r, r"^([0-9]+[a-z]?\.|[a-z]+\)|\([0-9]+\))", 1)
    kept = F.when(mark == "", F.trim(left)).otherwise(F.concat_ws(" ", mark, bare))
    text = F.when((r == "") & F.col("__v"), F.trim(left)).when(r == "", "").when(unchanged, kept).when(dropped, "").otherwise(r)
    return rows.withColumn("__v", valid).withColumn("resolved", text).drop("__v")
