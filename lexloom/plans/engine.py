"""Jobs as a table, amended in parallel, with results as tables.

A job is one row, and one task runs it from text to protocol: its commands depend on one another, jobs do
not.  Everything after is DataFrame work on the result rows.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from html import escape

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.plans import synopsis as S
from lexloom.plans.job import run_job
from lexloom.plans.model import APPLIED, DEFERRED, MANUAL, REASONS
from lexloom.sources.canonical import write_law

JOB = "job string, base string, docs array<string>, article string, as_of date, official string"
#: One schema for all that a job yields; ``part`` tells the rows apart.
RESULT = (
    "job string, part string, doc int, ord int, label string, kind string, status string, reason string, article string, path string, page int, "
    "wording string, prose string, affected array<string>, old_text string, new_text string"
)
_COLUMNS = [x.split()[0] for x in RESULT.split(", ")]


def _rows(base: str, docs, article: str | None, as_of, official: str | None, html: bool) -> Iterator[dict]:
    if isinstance(as_of, str):
        as_of = dt.date.fromisoformat(as_of)
    result = run_job(base, list(docs) if docs is not None else [], article or None, as_of or None, official)
    for k, (doc, e) in enumerate(zip(result.ordinals, result.entries, strict=True)):
        origin = e.command.origin
        yield {
            "part": "protocol", "doc": doc, "ord": k, "label": str(e.command), "kind": e.command.kind, "status": e.status, "reason": e.reason, "article": origin.article,
            "path": origin.path, "page": origin.page, "wording": origin.wording, "prose": e.prose, "affected": list(e.affected),
        }
    for k, r in enumerate(S.rows(result.old, result.new, result.entries, full=True)):
        yield {"part": "synopsis", "ord": k, "label": r.label, "kind": r.kind, "old_text": r.old_text, "new_text": r.new_text, "affected": list(r.causes), "prose": r.new_title}
    for k, w in enumerate(result.warnings):
        yield {"part": "warning", "ord": k, "prose": w}
    for k, (label, problem) in enumerate(result.toc_problems):
        yield {"part": "toc", "ord": k, "label": label, "kind": problem}
    for k, d in enumerate(result.documents):
        yield {"part": "document", "ord": k, "label": d.name, "kind": d.kind, "prose": d.title, "affected": list(d.refers_to)}
    if r := result.reconciliation:
        for kind, labels in (("MISSING", r.missing), ("EXTRA", r.extra), ("DEVIATING", r.deviating)):
            yield from ({"part": "reconciliation", "label": x, "kind": kind} for x in labels)
        yield {"part": "reconciliation", "kind": "EQUAL", "ord": r.equal, "doc": r.checked}
    yield {"part": "law", "new_text": write_law(result.new), "old_text": write_law(result.old)}
    if html:
        page = S.render(result.old, result.new, result.entries, result.warnings, result.draft, result.reconciliation, [d.name for d in result.documents], official=result.official)
        yield {"part": "html", "new_text": page}


def _runner(html: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for job in batch.itertuples(index=False):
                try:
                    if isinstance(job.problem, str):
                        raise ValueError(job.problem)
                    rows = list(_rows(job.base or "", job.docs, job.article, None if pd.isna(job.as_of) else job.as_of, job.official, html))
                except Exception as x:  # a failing job becomes a row, the others go on
                    rows = [{"part": "error", "prose": f"{type(x).__name__}: {x}"}]
                found += [dict.fromkeys(_COLUMNS) | r | {"job": job.job} for r in rows]
                if len(found) > 1000:
                    yield _frame(found)
                    found = []
            yield _frame(found)

    return run


def _frame(rows: list[dict]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=_COLUMNS)
    return frame.astype({"doc": "Int32", "ord": "Int32", "page": "Int32"})


def amend(jobs: DataFrame, html: bool = False) -> DataFrame:
    """All result rows of all jobs (schema RESULT).  jobs has the columns of JOB, and ``problem`` where texts could not be read: such a job fails.

    Jobs are dealt out evenly, since a job costs far more than moving it.  Select from a written or
    cached copy: each selection would run the jobs again.
    """
    problem = F.col("problem") if "problem" in jobs.columns else F.lit(None).cast("string")
    rows = jobs.select("job", "base", "docs", "article", F.col("as_of").cast("string").alias("as_of"), "official", problem.alias("problem"))
    parts = int(jobs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "job").mapInPandas(_runner(html), RESULT)


def protocol(results: DataFrame) -> DataFrame:
    return results.where("part = 'protocol'").select("job", "doc", "ord", "article", "path", "kind", F.col("label").alias("command"), "status", "reason", "prose", "affected", "wording")


def synopsis(results: DataFrame, full: bool = False) -> DataFrame:
    found = results.where("part = 'synopsis'").select("job", "ord", "label", "kind", "old_text", "new_text", F.col("affected").alias("causes"))
    return found if full else found.where("kind != 'UNCHANGED'")


def laws(results: DataFrame) -> DataFrame:
    return results.where("part = 'law'").select("job", F.col("new_text").alias("text"))


def pages(results: DataFrame) -> DataFrame:
    return results.where("part = 'html'").select("job", F.col("new_text").alias("html"))


def reasons(results: DataFrame) -> DataFrame:
    """(job, reason, n) of what is left for manual review."""
    return results.where("part = 'protocol' and status = 'MANUAL'").groupBy("job", "reason").agg(F.count("*").alias("n"))


def report(results: DataFrame) -> DataFrame:
    """One row per job: commands, applied, manual, deferred, and how it stands to the official version; a failed job has an error."""
    is_ = lambda part: F.col("part") == part
    of = lambda kind: F.count_if(is_("reconciliation") & (F.col("kind") == kind))
    counts = results.groupBy("job").agg(
        F.count_if(is_("protocol")).alias("commands"),
        F.count_if(is_("protocol") & (F.col("status") == APPLIED)).alias("applied"),
        F.count_if(is_("protocol") & (F.col("status") == MANUAL)).alias("manual"),
        F.count_if(is_("protocol") & (F.col("status") == DEFERRED)).alias("deferred"),
        F.max(F.when(is_("reconciliation") & (F.col("kind") == "EQUAL"), F.col("ord"))).alias("equal"),
        F.max(F.when(is_("reconciliation") & (F.col("kind") == "EQUAL"), F.col("doc"))).alias("checked"),
        *[of(k.upper()).alias(k) for k in ("missing", "extra", "deviating")],
        F.max(F.when(is_("error"), F.col("prose"))).alias("error"),
        *[F.count_if(is_("protocol") & (F.col("status") == MANUAL) & (F.col("reason") == k)).alias(f"n_{k}") for k in REASONS],
    )
    # One pass over the results, which may not be written: reading them twice would run every job twice.
    told = [F.when(F.col(f"n_{k}") > 0, F.concat(F.lit(f"{name}:"), F.col(f"n_{k}").cast("string"))) for k, name in REASONS.items()]
    listed = F.array_compact(F.array(*told))
    return counts.withColumn("reasons", F.when(F.size(listed) > 0, F.array_join(listed, "; "))).drop(*[f"n_{k}" for k in REASONS])


def report_page(reports: DataFrame) -> str:
    """A report as a page: a row for each job, and the sums.  It is as long as the list of jobs, which a reader is to look through."""
    columns = ["job", "commands", "applied", "manual", "deferred", "equal", "checked", "missing", "extra", "deviating", "reasons", "error"]
    shown = lambda x: "–" if x is None else escape(str(x))
    row = lambda cells, tag="td": "<tr>" + "".join(f"<{tag}>{c}</{tag}>" for c in cells) + "</tr>"
    rows = [row([shown(r[c]) for c in columns]) for r in reports.orderBy("job").toLocalIterator()]
    t = totals(reports).first().asDict()
    foot = row([f"{t['jobs']} Aufträge", *(shown(t.get(c)) for c in columns[1:-2]), "", f"{t['failed']} gescheitert"], "th")
    head = row(["Auftrag", "Befehle", "angewandt", "von Hand", "noch nicht in Kraft", "gleich", "verglichen", "fehlend", "zusätzlich", "abweichend", "Gründe", "Fehler"], "th")
    return f"<!DOCTYPE html>\n<html lang=\"de\"><head><meta charset=\"utf-8\"><title>Bericht</title></head><body><table>\n{head}\n" + "\n".join(rows) + f"\n{foot}\n</table></body></html>\n"


def totals(reports: DataFrame) -> DataFrame:
    """Sums over the jobs; equal and checked pass over jobs without an official version."""
    sums = [F.sum(c).alias(c) for c in ("commands", "applied", "manual", "deferred", "equal", "checked", "missing", "extra", "deviating")]
    return reports.agg(F.count("*").alias("jobs"), *sums, F.count_if(F.col("error").isNotNull()).alias("failed"))


def latest_laws(results: DataFrame, chains: DataFrame) -> DataFrame:
    """The last version of each law in a chain of jobs: chains has (law, job, place)."""
    by = Window.partitionBy("law").orderBy(F.desc("place"))
    return laws(results).join(chains, "job").withColumn("n", F.row_number().over(by)).where("n = 1").drop("n")
