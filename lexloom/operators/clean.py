"""Cleaning of extracted text: characters, quotation marks, page furniture, line breaks.

``clean_text`` works on one document; ``clean`` applies it to a table.  Furniture is a rule table, so a gazette
that is not known yet needs a row and no code.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from lexloom.functions.columns import SUPERSCRIPTS
from lexloom.plans.outline import mark_of, normal_quotes

#: A date in words, and a letter-spaced text that line ends may run through.
_DATE = r"\d{1,2}\. \w+ \d{4}"


def _spaced(text: str) -> str:
    return r"[\s\ue000\ue001]*".join("[-–]" if c == "-" else re.escape(c) for c in text if c != " ")


#: (name, "line" or "inline", pattern): whole lines that are dropped, and parts that are cut out of lines.
FURNITURE = [
    ("page number", "line", r"[-–|]? ?\d{1,4} ?[-–|]?"),
    ("page of", "line", r"Seite \d+(?: von \d+)?"),
    ("federal gazette head", "line", r"(?:Seite \d+ von \d+\s+)?(?:\d+\s+)?Bundesgesetzblatt (?:Jahrgang )?\d{4},? Teil I+,? Nr\. \d+.*|Bundesgesetzblatt.*ausgegeben zu Bonn.*"),
    ("federal gazette foot", "line", r"Das Bundesgesetzblatt im Internet:.*|Ein Service des Bundesanzeiger Verlag.*|(?:www\.)?bundesanzeiger-verlag\.de.*"),
    ("draft mark", "line", r"[-–] ?\d+ ?[-–]\s+Bearbeitungsstand:.*|Bearbeitungsstand: .*"),
    ("upper house head", "line", r"Bundesrat\s+[-–] ?\d+ ?[-–]\s+Drucksache \d+/\d+.*"),
    ("lower house head", "line", r"Deutscher Bundestag\s+[-–] ?\d+\.? Wahlperiode.*"),
    ("paper number", "line", r"Drucksache\s+\d+/\d+(?:\s+[-–] ?\d+ ?[-–].*)?|[-–] ?\d+ ?[-–]\s+Drucksache \d+/\d+.*"),
    ("column heads", "line", r"Entwurf\s+Beschlüsse des \d+\. Ausschusses"),
    ("state gazette head", "line", r"(?:Bayerisches |Hessisches |Niedersächsisches |Thüringer |Sächsisches )?Gesetz- ?und Verordnungsblatt(?: für \S+|.*\d{4}.*)|\d{4}/\d+ vom \d+\. \w+|für das Land Hessen|\d{4} Wiesbaden,\s+den .*Nr\. \d+|(?:Nds\.|Hess\.)? ?GVBl\.? (?:Nr\. ?\d+/|Nr\. )?\d+.*ausgegeben am.*"),
    ("state parliament head", "line", r"(?:(?:Bayerischer|Hessischer|Sächsischer|Thüringer|Niedersächsischer) )?Landtag(?:\s+\d+\. Wahlperiode.*)?|\d+\. Wahlperiode(?:\s+[\d.]+)?\s+Drucksache \d+/\d+|Drucksache \d+/\d+\s+.*Landtag\s+\d+\. Wahlperiode.*"),
    ("publisher", "line", r"Herausgegeben von der .*(?:Staatskanzlei|Landesregierung).*"),
    ("portal foot", "line", r"https?://\S+\s+(?:Seite \d+ von \d+|Stand vom \d+\.\d+\.\d{4}.*)"),
    ("preliminary mark", "inline", rf"{_spaced('Vorabfassung - wird durch die lektorierte')}[\s\ue000\ue001]*(?:{_spaced('Fassung')}|{_spaced('Version')})[\s\ue000\ue001]*{_spaced('ersetzt.')}"),
    ("preliminary", "inline", r"V ?o ?r ?a ?b ?f ?a ?s ?s ?u ?n ?g(?: ?[-–] ?w ?i ?r ?d ?d ?u ?r ?c ?h.*?e ?r ?s ?e ?t ?z ?t ?\.?)?"),
    ("Berlin head", "inline", r"\d*\s*Gesetz- und Verordnungsblatt für Berlin\s+\d+\. Jahrgang\s+Nr\. \d+\s+\d+\. \w+ \d{4}(?:\s+\d+$)?[ \t]*"),
    ("Thuringia head", "inline", rf"[ \t]*Nr\. \d+ [-–] Tag der Ausgabe: \w+, den {_DATE}(?:[ \t]+\d{{1,4}})?[ \t]*"),
    ("Thuringia foot", "inline", r"[ \t]*(?:\d{1,4}[ \t]+)?Gesetz- und Verordnungsblatt für den Freistaat Thüringen[ \t]*"),
    ("Hamburg head", "inline", rf"[ \t]*(?:HmbGVBl\. Nr\. \d+[ \t]+\w+tag, den {_DATE}(?:[ \t]+\d{{1,4}})?|\w+tag, den {_DATE}[ \t]*\d{{0,4}}[ \t]*HmbGVBl\. Nr\. \d+)[ \t]*"),
    ("Baden-Württemberg foot", "inline", rf"[ \t]*Gesetzblatt für Baden-Württemberg,\s+Jahrgang \d{{4}},\s+Nr\. ?\d+ vom {_DATE}(?:\s+Seite \d+ von \d+)?[ \t]*"),
    ("Bremen head", "inline", rf"[ \t]*Nr\. \d+ Gesetzblatt der Freien Hansestadt Bremen vom {_DATE}(?:[ \t]+\d{{1,4}})?[ \t]*"),
    ("Mecklenburg-Vorpommern head", "inline", rf"[ \t]*(?:Nr\. \d+[ \t]+)?Tag der Ausgabe: \w+, den {_DATE}(?:[ \t]+\d{{1,4}})?(?:[ \t]*Nr\. \d+)?[ \t]*"),
    ("Mecklenburg-Vorpommern foot", "inline", r"[ \t]*(?:\d{1,4}[ \t]+)?Gesetz- und Verordnungsblatt für Mecklenburg-Vorpommern \d{4}[ \t]+Nr\. \d+[ \t]*"),
    ("Saarland head", "inline", rf"[ \t]*(?:\d{{1,4}}[ \t]*)?Amtsblatt des Saarlandes Teil I+ vom {_DATE}[ \t]*\d{{0,4}}[ \t]*"),
    ("spaced word", "inline", r"(?<!\w)u n v e r ä n d e r t(?!\w)"),
]
_LINE = re.compile(r"\s*(?:" + "|".join(f"(?:{p})" for _, mode, p in FURNITURE if mode == "line") + r")\s*")
_INLINE = re.compile("|".join(f"(?:{p})" for name, mode, p in FURNITURE if mode == "inline" and name != "spaced word"))
_BLANKS = re.compile("[  -   　]")
_CONTROLS = re.compile("[\u0000-\u0008\u000b\u000c\u000e-\u001f\u007f­​﻿]")
#: Words that are printed as one or parted by mistake, and what they stand for; parted ones are no words of prose by themselves.
_GLUED = [
    ("durchdie", "durch die"), ("durchden", "durch den"), ("durchdas", "durch das"), ("ein gefügt", "eingefügt"), ("an gefügt", "angefügt"), ("ge strichen", "gestrichen"), ("auf gehoben", "aufgehoben"),
    ("undwerden", "und werden"), ("undwird", "und wird"), ("Kommaeingefügt", "Komma eingefügt"), ("Kommaersetzt", "Komma ersetzt"),
]
#: Private characters by which a layout reader marks line ends.
HARD, SOFT = "\ue000", "\ue001"
_TOKEN = re.compile(r"[^\W_]+(?:-[^\W_]+)*")
_CONJUNCTION = re.compile(r"(?:und|oder|sowie|bis|bzw\.|als)\b")


def is_furniture(line: str) -> bool:
    return bool(line.strip()) and _LINE.fullmatch(line) is not None


def typical_length(lengths: list[int], at: int, reach: int = 20) -> int:
    """The 90th percentile of the filled lines' lengths around one."""
    near = sorted(x for x in lengths[max(0, at - reach) : at + reach + 1] if x)
    return near[min(int(len(near) * 0.9), len(near) - 1)] if near else 0


def join_breaks(lines: list[str], ends: list[str] | None = None) -> list[tuple[str, str]]:
    """(line, end) with words joined that a line break has divided; the document's own vocabulary decides.

    "Be-" and "hörde" are one word.  A hyphen before a capital divides a word only if the joined form
    occurs elsewhere, and stays before a conjunction ("Vor- und").  Where lines end in a space by custom, a long line
    that does not is divided without a hyphen - unless its last word occurs within a line elsewhere and the joined one
    nowhere.  A line end that is known to be hard divides no word, but for a hyphen right at it.
    """
    ends = ends or ["UNKNOWN"] * len(lines)
    text = "\n".join(lines)
    words = set(_TOKEN.findall(text))
    inner = {w for x in lines for w in _TOKEN.findall(x)[1:-1]}
    filled = [x for x in lines if x.strip()]
    trailing = bool(filled) and sum(x.endswith((" ", "\t")) for x in filled) * 4 >= len(filled)
    lengths = [len(x.rstrip()) for x in lines]
    out: list[tuple[str, str]] = []
    k = 0
    while k < len(lines):
        line = lines[k]
        while (nxt := next((j for j in range(k + 1, min(k + 4, len(lines))) if lines[j].strip()), None)) is not None:
            following = lines[nxt].lstrip()
            head = _TOKEN.match(following)
            hyphen = re.search(r"([^\W\d_]+)-(\s*)$", line)
            if hyphen and head and not _CONJUNCTION.match(following) and not (hyphen[2] and ends[k] == "HARD"):
                joined = hyphen[1] + head[0]
                keep = "" if following[0].islower() or joined in words or hyphen[1] + head[0].lower() in words else "-"
                line = line[: hyphen.start(2) - 1] + keep + following
                k = nxt
                continue
            tail = re.search(r"([^\W\d_]+)$", line)
            fits = tail and head and following[0].islower() and mark_of(following) is None and not _CONJUNCTION.match(following)
            if trailing and nxt == k + 1 and fits and ends[k] != "HARD" and lengths[k] >= 0.8 * typical_length(lengths, k):
                gap = len(tail[1]) >= 4 and tail[1] in inner and tail[1] + head[0] not in words
                line = line + (" " if gap else "") + following
                k = nxt
                continue
            break
        out.append((line, ends[k]))
        k += 1
    return out


def _structural(line: str) -> bool:
    return mark_of(line) is not None or re.match(r"\s*(?:§ \d|Artikel \d|Art\. \d|\(\d+[a-z]?\) |„|Abschnitt |Kapitel |Teil |Anlage)", line) is not None


def reflow(lines: list[str], ends: list[str] | None = None) -> list[str]:
    """Soft line ends become spaces unless the next line opens a structure; unknown ends stay."""
    if not ends:
        return lines
    out: list[str] = []
    for k, line in enumerate(lines):
        if out and k and ends[k - 1] == "SOFT" and line.strip() and not _structural(line) and not re.fullmatch(r"\s*(?:Artikel|Art\.|§) \d+[a-z]?\s*", out[-1]):
            out[-1] = out[-1].rstrip() + " " + line.lstrip()
        elif not (not line.strip() and k and ends[k - 1] == "SOFT"):
            out.append(line)
    return out


#: Quotes whose opening mark was drawn behind the label that it stands before: "(1) „ x", "§ 19„ x", "3. „ x".
_INVERTED = [
    (re.compile(r"^([ \t]*)(\(\d+[a-z]?\)) „[ \t]+", re.M), r"\1„\2 "),
    (re.compile(r"^([ \t]*)(§ ?\d+[a-z]?)„[ \t]*(?=\S)", re.M), r"\1„\2 "),
    (re.compile(r"^([ \t]*)(§ ?\d+[a-z]?)„[ \t]*$", re.M), r"\1„\2"),
    (re.compile(r"^([ \t]*)(\d+[a-z]?\.|[a-z]{1,3}\))[ \t]+„[ \t]+", re.M), r"\1„\2 "),
]


def _without_inline(text: str) -> str:
    """Furniture cut out of lines; what stood around it on the line stays apart, unless a hyphen divides a word there."""

    def seam(m: re.Match) -> str:
        left, right = text[max(0, m.start() - 1) : m.start()], text[m.end() : m.end() + 1]
        return " " if left.strip() and right.strip() and left != "-" else ""

    return _INLINE.sub(seam, text)


def clean_text(text: str | None) -> tuple[str, list[str]]:
    """The cleaned text and warnings.  Composed characters stay what they are; superscripts are kept."""
    text = unicodedata.normalize("NFC", text or "")
    text = _CONTROLS.sub("", _BLANKS.sub(" ", re.sub(r"\r\n?|\f", "\n", text)))
    for pattern, right in _INVERTED:
        text = pattern.sub(right, text)
    text, warnings = normal_quotes(text)
    text = re.sub(r"(?<=[\w.,;:])„(?=\w)", " „", re.sub(r"“(?=[\w„])", "“ ", text))
    text = re.sub(r"(?<!\w)u n v e r ä n d e r t(?!\w)", "unverändert", _without_inline(text))
    lines, ends = [], []
    for line in text.split("\n"):
        ends.append("SOFT" if SOFT in line else "HARD" if HARD in line else "UNKNOWN")
        lines.append(line.replace(SOFT, "").replace(HARD, ""))
    kept = []
    for k, line in enumerate(lines):
        following = next((x for x in lines[k + 1 :] if x.strip()), "")
        if not (is_furniture(line) or re.fullmatch(r"\s*Anlage \d+\s*", line) and is_furniture(following)):
            kept.append(k)
    joined = join_breaks([lines[k] for k in kept], [ends[k] for k in kept])
    text = "\n".join(x.rstrip() for x in reflow([x for x, _ in joined], [e for _, e in joined]))
    for wrong, right in _GLUED:
        text = re.sub(rf"(?<!\w){wrong}(?!\w)", right, text)
    text = re.sub(r"(wie folgt geändert:?)[ \t]*(?=(?:[a-z]{1,3}\)|\d+[a-z]?\.)\s)", r"\1\n", text)  # a point printed right behind its frame
    text = re.sub(r"(§§?|Art\.) (\d+) ([a-z])(?![\w)])", r"\1 \2\3", text)
    # A footnote mark at an article's heading; what follows it on the line is a line of its own.
    text = re.sub(rf"^(Artikel \d+[a-z]?) ?[{SUPERSCRIPTS}]+\)[ \t]*(\S?)", lambda m: m[1] + ("\n" + m[2] if m[2] else ""), text, flags=re.M)
    return re.sub(r"\n{3,}", "\n\n", text), warnings


def clean(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the text cleaned, and ``warnings``."""
    fields = [f for f in docs.schema.fields if f.name != "warnings"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", warnings array<string>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = [clean_text(x) for x in batch[text]]
            yield batch.assign(**{text: [x for x, _ in done], "warnings": [w for _, w in done]})

    return docs.select([f.name for f in fields]).mapInPandas(run, schema)
