"""Inputs and reports as files: job lists, baselines, archives, federal XML, and results as tables."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import columns as C
from lexloom.plans.model import Division, Law, Norm, Paragraph
from lexloom.sources.canonical import TOC_LABEL

JOB_LIST = "job string, base string, docs string, article string, official string, as_of string"
BASELINE = "job string, commands long, applied long, manual long, deferred long, equal long, checked long, missing long, extra long, deviating long, reasons string, error string"


def read_job_list(spark: SparkSession, path: str) -> DataFrame:
    """(job, base, docs, article, official, as_of) from tab-separated lines; "-" is null and "#" starts a comment."""
    found = spark.read.csv(path, schema=JOB_LIST, sep="\t", comment="#", nullValue="-", quote="", mode="PERMISSIVE")
    return found.where("job is not null and base is not null").select("job", "base", F.split("docs", ",").alias("docs"), "article", "official", F.to_date("as_of").alias("as_of"))


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    found = spark.read.csv(path, schema=BASELINE, sep="\t", comment="#", nullValue="-", quote="", mode="PERMISSIVE")
    return found.where("commands is not null")


def with_texts(spark: SparkSession, jobs: DataFrame, root: str) -> DataFrame:
    """A job list with the texts of its files, read by Spark from the folder ``root``: the input of ``engine.amend``.

    Laws as federal XML, also in an archive, become laws as text.  ``problem`` tells what a job's files cannot be read for: a kind without a
    reader, damage, or that they are not there; such a job fails as a row.
    """
    named = jobs.select(F.explode(F.concat(F.array("base", "official"), F.coalesce("docs", F.array()))).alias("name")).where("name is not null")
    named = named.select(F.regexp_replace("name", "^.*/", "").alias("name")).distinct()
    content = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    content = content.join(named, F.regexp_extract("path", "([^/]*)$", 1) == F.col("name"), "left_semi")  # files that no job names are not read
    files = content.select("path", "content").mapInPandas(_texts, "path string, text string, trouble string")
    name = lambda c: F.regexp_replace(c, "^\\./", "")
    base = F.regexp_replace(F.lit(root), "/+$", "")
    files = files.withColumn("file", F.regexp_replace(F.element_at(F.split("path", F.concat(F.lit("\\Q"), F.regexp_replace(base, "^file:/*", "/"), F.lit("\\E"))), -1), "^/+", ""))
    each = jobs.select("*", F.posexplode_outer("docs").alias("k", "doc"))
    trouble = lambda name, text, told: F.when(name.isNotNull() & text.isNull(), F.concat(name, F.lit(": "), F.coalesce(told, F.lit("no such file"))))
    read = lambda n: files.select(F.col("file").alias(n), F.col("text").alias(f"{n}_text"), F.col("trouble").alias(f"{n}_trouble"))
    own = each.withColumn("doc", name(F.col("doc"))).join(read("doc"), "doc", "left").withColumn("t", trouble(F.col("doc"), F.col("doc_text"), F.col("doc_trouble")))
    # A text that is not there stays null, so that the others keep their places.
    docs = F.array_sort(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "doc_text")))).getField("doc_text")
    whole = own.groupBy("job", "base", "article", "official", "as_of").agg(docs.alias("docs"), F.array_sort(F.collect_list("t")).alias("t"))
    bases, officials = read("b"), read("o")
    joined = whole.join(bases, name(F.col("base")) == F.col("b"), "left").join(officials, name(F.col("official")) == F.col("o"), "left")
    of = F.array_compact(F.array(trouble(F.col("base"), F.col("b_text"), F.col("b_trouble")), trouble(F.col("official"), F.col("o_text"), F.col("o_trouble"))))
    told = F.concat(of, "t")
    problem = F.when(F.size(told) > 0, F.array_join(told, "; "))
    return joined.select("job", F.col("b_text").alias("base"), "docs", "article", "as_of", F.col("o_text").alias("official"), problem.alias("problem"))


def _texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Files as text; a law of another kind as canonical text; null and the trouble for what cannot be read."""
    from lexloom.sources.canonical import write_law

    for batch in batches:
        out = []
        for path, content in zip(batch["path"], batch["content"], strict=True):
            try:
                kind = sniff(content)
                out.append((path, write_law(read_law_file(content)) if kind in ("zip", "xml") else read_text_file(content), None))
            except Exception as x:  # one file's damage is told with its job
                out.append((path, None, f"{type(x).__name__}: {x}"))
        yield pd.DataFrame(out, columns=["path", "text", "trouble"])


def write_report(report: DataFrame, path: str) -> None:
    """A report as tab-separated lines that read_baseline reads."""
    columns = [x.split()[0] for x in BASELINE.split(", ")]
    report.select(*[F.col(c).cast("string") for c in columns]).orderBy("job").write.csv(path, sep="\t", nullValue="-", emptyValue="-", quote="", header=False)


def sniff(content: bytes) -> str:
    """zip, pdf, xml or text, by the bytes alone."""
    if content.startswith(b"PK\x03\x04"):
        return "zip"
    if b"%PDF-" in content[:1024]:
        return "pdf"
    return "xml" if re.match(rb"(?:\xef\xbb\xbf)?\s*<", content) else "text"


def unpack(content: bytes) -> bytes:
    """The one XML file of an archive; checksums are verified, encrypted archives refused."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        found = [x for x in archive.infolist() if x.filename.endswith(".xml") and not x.filename.startswith("__MACOSX/")]
        if len(found) != 1:
            raise ValueError(f"the archive has {len(found)} XML files: {', '.join(x.filename for x in found)}")
        if found[0].flag_bits & 1:
            raise ValueError("the archive is encrypted")
        return archive.read(found[0])


def _flat(node: ET.Element, depth: int = 0) -> str:
    """Mixed content as lines: definition lists indented by level, table rows with bars, breaks as line ends."""
    out = [node.text or ""]
    for child in node:
        tag = child.tag.upper()
        if tag == "DL":
            items, label = [], ""
            for x in child:
                if x.tag.upper() == "DT":
                    label = re.sub(r"\s+", " ", _flat(x)).strip()
                elif x.tag.upper() == "DD":
                    body = _flat(x, depth + 1).strip("\n")
                    first, _, rest = body.partition("\n")
                    items.append("  " * (depth + 1) + f"{label} {re.sub(r'[ \t]+', ' ', first).strip()}".strip() + (f"\n{rest}" if rest else ""))
            out.append("\n" + "\n".join(items) + "\n")
        elif tag == "LA":
            inner = re.sub(r"(?<=\S)[ \t]+", " ", _flat(child, depth)).strip()
            out.append(f"\n{'  ' * (depth + 1)}{inner}" if "".join(out).strip() else inner)
        elif tag == "BR":
            out.append("\n")
        elif tag in ("TABLE", "TGROUP", "TBODY", "THEAD"):
            out.append("\n" + _flat(child, depth).strip() + "\n")
        elif tag == "ROW":
            out.append(" | ".join(re.sub(r"\s+", " ", _flat(x)).strip() for x in child) + "\n")
        elif tag in ("COLSPEC", "NOINDEX"):
            pass
        else:
            out.append(_flat(child, depth))
        out.append(child.tail or "")
    return "".join(out)


def _tidy_lines(text: str) -> str:
    lines = [re.sub(r"(?<=\S)[ \t]+", " ", x).rstrip() for x in text.split("\n")]
    return "\n".join(x for x in lines if x.strip()).strip()


def read_federal_xml(content: bytes) -> Law:
    """A law from the federal XML; entities and external definitions are not resolved."""
    if re.search(rb"<!ENTITY", content):
        raise ValueError("entity definitions are refused")
    root = ET.fromstring(content)
    law, division = None, None
    stands: list[str] = []
    for node in root.iter("norm"):
        meta = node.find("metadaten")
        if meta is None:
            continue
        get = lambda path: (re.sub(r"\s+", " ", "".join(x.itertext())).strip() or None) if (x := meta.find(path)) is not None else None  # noqa: B023, E731
        if law is None:
            law = Law(get("kurzue") or get("jurabk") or "", get("langue") or get("jurabk") or "", get("jurabk"))
        for s in meta.findall("standangabe"):
            if (s.findtext("standtyp") or "").strip() == "Stand" and s.findtext("standkommentar"):
                stands.append(re.sub(r"\s+", " ", s.findtext("standkommentar")).strip())
        unit = meta.find("gliederungseinheit")
        if unit is not None:
            text = lambda x: re.sub(r"\s+", " ", unit.findtext(x) or "").strip() or None  # noqa: B023, E731
            law.divisions.append(Division(text("gliederungsbez") or "", text("gliederungstitel"), text("gliederungskennzahl") or ""))
            division = len(law.divisions) - 1
        label = get("enbez")
        if not label:
            continue
        title = get("titel")
        paragraphs = []
        for body in node.findall("textdaten/text/Content"):
            for x in body:
                if x.tag == "P":
                    text_ = _tidy_lines(_flat(x))
                    m = re.match(r"\((\d+[a-z]?)\)\s+", text_)
                    if text_:
                        paragraphs.append(Paragraph(m[1] if m else None, text_[m.end() :] if m else text_))
                elif x.tag == "TOC":
                    lines = []
                    for entry in x.iter():
                        if entry.tag == "Ident":
                            lines.append(re.sub(r"\s+", " ", "".join(entry.itertext())).strip())
                        elif entry.tag == "Title" and lines:
                            lines[-1] += " | " + re.sub(r"\s+", " ", "".join(entry.itertext())).strip()
                    paragraphs.append(Paragraph(None, "\n".join(lines) or "\n".join(y.strip() for y in _tidy_lines(_flat(x)).split("\n"))))
        gone = title == "(weggefallen)" or [p.text for p in paragraphs] in (["(weggefallen)"], ["-"])
        law.norms.append(Norm(TOC_LABEL if label.startswith("Inhalts") else label, None if title == "(weggefallen)" else title, paragraphs, division, gone))
    if law is None:
        raise ValueError("no norm found")
    law.stand = "; ".join(stands) or None
    return law


def read_law_file(content: bytes, short: str | None = None) -> Law:
    """A law from a file of any known kind."""
    from lexloom.sources.canonical import read_law

    kind = sniff(content)
    if kind == "zip":
        return read_law_file(unpack(content), short)
    if kind == "xml":
        return read_federal_xml(content)
    if kind == "pdf":
        raise ValueError("no PDF reader is available")
    return read_law(content.decode("utf-8-sig"), short)


def read_text_file(content: bytes) -> str:
    """An amendment document's text; kinds other than plain text are refused."""
    kind = sniff(content)
    if kind != "text":
        raise ValueError("no PDF reader is available" if kind == "pdf" else f"an amendment document cannot be {kind}")
    return content.decode("utf-8-sig")


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, length) of the files of a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    head = F.decode(F.substring("content", 1, 1024), "ISO-8859-1")  # what tells a kind stands there
    return files.select("path", C.sniff_type(head).alias("kind"), "length")
