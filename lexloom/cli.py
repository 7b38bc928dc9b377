"""Command line: one law, or a list of jobs.

    python -m lexloom.cli base.txt act.txt --synopsis out.html --law new.txt --official official.txt
    python -m lexloom.cli --jobs jobs.tsv --root texts/ --report report --baseline baseline.tsv

Exit code: 0 all well, 1 wrong usage, 2 commands were found and none applied, 3 a reconciliation or a baseline failed.
"""

from __future__ import annotations

import argparse
import datetime as dt
import sys
from pathlib import Path

from lexloom.functions.locator import show


def _one(a: argparse.Namespace) -> int:
    from lexloom.operators.clean import clean_text
    from lexloom.plans import synopsis as S
    from lexloom.plans.job import run_job
    from lexloom.sources.canonical import write_law
    from lexloom.sources.inputs import read_law_file, read_text_file
    from lexloom.sources.locate import fetch

    texts = [read_text_file(fetch(x)) for x in a.files[1:]]
    if a.extract_only:
        for x in texts:
            print(x if a.raw else clean_text(x)[0])
        return 0
    base = write_law(read_law_file(fetch(a.files[0])))
    if a.dump_law:
        print(base, end="")
    official = write_law(read_law_file(fetch(a.official))) if a.official else None
    result = run_job(base, texts, a.article, dt.date.fromisoformat(a.as_of) if a.as_of else None, official)
    if a.dump_documents:
        for d in result.documents:
            print(f"{d.kind}\t{d.name}\t{d.title or '-'}")
    if a.dump_commands:
        for e in result.entries:
            print(f"{e.status}\t{e.reason or '-'}\t{e.command.origin}\t{e.command.kind}\t{show(e.command.at)}\t{e.prose}")
    for w in result.warnings:
        print(w, file=sys.stderr)
    if a.synopsis:
        page = S.render(result.old, result.new, result.entries, result.warnings, result.draft, result.reconciliation, [d.name for d in result.documents], a.full, result.official)
        Path(a.synopsis).write_text(page, encoding="utf-8")
    if a.law:
        Path(a.law).write_text(write_law(result.new), encoding="utf-8")
    applied = sum(e.status == "APPLIED" for e in result.entries)
    print(f"{applied} von {len(result.entries)} Befehlen angewandt" + (f"; {result.reconciliation}" if result.reconciliation else ""))
    if result.reconciliation and not result.reconciliation.holds:
        return 3
    return 2 if result.entries and not applied else 0


def _many(a: argparse.Namespace) -> int:
    from pyspark.sql import SparkSession

    from lexloom.operators.relate import regressions
    from lexloom.plans import engine
    from lexloom.sources import inputs

    spark = SparkSession.builder.appName("lexloom").getOrCreate()
    jobs = inputs.with_texts(spark, inputs.read_job_list(spark, a.jobs), a.root)
    results = engine.amend(jobs, html=bool(a.synopses)).persist()
    report = engine.report(results)
    if a.report:
        inputs.write_report(report, a.report)
    if a.report_page:
        Path(a.report_page).write_text(engine.report_page(report), encoding="utf-8")
    if a.synopses:
        engine.pages(results).write.partitionBy("job").text(a.synopses)
    engine.totals(report).show(truncate=False)
    if a.baseline:
        worse = regressions(inputs.read_baseline(spark, a.baseline), report.where("error is null"), "job", ["commands", "applied", "equal"], ["manual", "missing", "extra", "deviating"])
        if not worse.isEmpty():
            worse.show(truncate=False)
            return 3
    return 0


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lexloom", description="Applies amendment texts to laws.")
    p.add_argument("files", nargs="*", help="the base law, then amendment documents: paths, addresses, or gii:abbreviation")
    for name, text in (
        ("article", "only this article"), ("as-of", "apply what is in force on this date"), ("official", "official version to compare with"), ("synopsis", "file for the synopsis page"),
        ("law", "file for the amended law"), ("jobs", "list of jobs"), ("root", "folder of the jobs' files"), ("report", "folder for the report"), ("report-page", "file for the report as a page"), ("synopses", "folder for the synopses"), ("baseline", "earlier report"),
    ):
        p.add_argument(f"--{name}", help=text)
    for name in ("full", "extract-only", "raw", "dump-law", "dump-documents", "dump-commands"):
        p.add_argument(f"--{name}", action="store_true")
    try:
        a = p.parse_args(argv)
    except SystemExit as x:
        return 1 if x.code else 0
    if a.jobs and a.root:
        return _many(a)
    if len(a.files) < 2:
        p.print_usage(sys.stderr)
        return 1
    return _one(a)


if __name__ == "__main__":
    sys.exit(main())
