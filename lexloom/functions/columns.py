"""Scalar functions as Column expressions: names, dates, numbers, markup and words of legal texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: German month names in order.
MONTHS = ["Januar", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember"]
#: Digits and their superscripts in order.
DIGITS, SUPERSCRIPTS = "0123456789", "⁰¹²³⁴⁵⁶⁷⁸⁹"
#: A letter or digit in the sense of word boundaries; superscripts are none.
LETTER = r"[\p{L}\p{Nd}]"
#: White space that patterns of the texts mean.
SPACE = r"[ \t\n\x0B\f\r]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def portal_id(name: Column | str) -> Column:
    """The name under which a portal lists an abbreviation: lower case, other characters as underscores."""
    return F.regexp_replace(F.lower(F.trim(_col(name))), "[^a-z0-9-]", "_")


def cache_key(url: Column | str) -> Column:
    """The first 8 bytes of a URL's SHA-256, in hexadecimal."""
    return F.substring(F.sha2(_col(url), 256), 1, 16)


def url_basename(url: Column | str) -> Column:
    """The last path segment, without query and fragment."""
    return F.regexp_extract(F.regexp_replace(_col(url), "[?#].*$", ""), "([^/]*)$", 1)


def sniff_type(content: Column | str) -> Column:
    """zip, pdf, xml or text, by content alone; content is text or bytes that decode one to one."""
    c = _col(content)
    return (
        F.when(c.startswith("PK\x03\x04"), "zip")
        .when(F.instr(F.substring(c, 1, 1024), "%PDF-") > 0, "pdf")
        .when(c.rlike(r"^﻿?[ \t\n\x0B\f\r]*<"), "xml")
        .otherwise("text")
    )


def escape_html(text: Column | str) -> Column:
    out = _col(text)
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(entity))
    return out


def flatten_html(html: Column | str) -> Column:
    """Markup to lines: blocks and breaks end lines, list items are indented, cells are parted by bars."""
    out = F.regexp_replace(_col(html), "(?s)<!--.*?-->|<(script|style)[^>]*>.*?</(script|style)>", "")
    out = F.regexp_replace(out, SPACE, " ")
    out = F.regexp_replace(out, "(?i)<li[^>]*>|<dt[^>]*>", "\n  ")
    out = F.regexp_replace(out, "(?i)</t[dh]> ?<t[dh][^>]*>", " | ")
    out = F.regexp_replace(out, "(?i)<br ?/?>|</?(p|div|h[1-6]|ul|ol|tr|table|article|nav|body|head|title|dl|dd|la)( [^>]*)?>", "\n")
    out = F.regexp_replace(out, "<[^>]*>", "")
    for entity, raw in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(raw))
    return F.trim(F.regexp_replace(out, " *\n[ \n]*\n( *)|\n$", "\n$1"))


def fold_space(text: Column | str) -> Column:
    """White space folded to single spaces; how wordings are compared."""
    return F.trim(F.regexp_replace(_col(text), SPACE, " "))


def to_superscript(text: Column | str) -> Column:
    return F.translate(_col(text), DIGITS, SUPERSCRIPTS)


def from_superscript(text: Column | str) -> Column:
    return F.translate(_col(text), SUPERSCRIPTS, DIGITS)


def german_date(date: Column | str) -> Column:
    """19. Juni 2020"""
    d = _col(date)
    return F.concat(F.dayofmonth(d).cast("string"), F.lit(". "), F.element_at(F.array(*map(F.lit, MONTHS)), F.month(d)), F.lit(" "), F.year(d).cast("string"))


def parse_german_date(text: Column | str) -> Column:
    """The date of "19. Juni 2020" anywhere in the text; an unknown month or impossible day is null."""
    part = lambda k: F.regexp_extract(_col(text), r"([0-9]{1,2})\. ?(\p{L}+) ([0-9]{4})", k)
    month = F.array_position(F.array(*map(F.lit, MONTHS)), part(2))
    iso = F.concat_ws("-", part(3), F.lpad(month.cast("string"), 2, "0"), F.lpad(part(1), 2, "0"))
    return F.when(month > 0, F.try_to_date(iso, "yyyy-MM-dd"))


def latest_date(text: Column | str) -> Column:
    """The latest date of the form d.m.yyyy; impossible ones are passed over."""
    found = F.regexp_extract_all(_col(text), F.lit(r"([0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})"), F.lit(1))
    return F.array_max(F.transform(found, lambda x: F.try_to_date(x, "d.M.yyyy")))


def stem_form(text: Column | str) -> Column:
    """Words without an inflection at the end, where four letters are left."""
    words = F.split(fold_space(text), " ")
    return F.array_join(F.transform(words, lambda w: F.regexp_replace(w, r"^(.{4,}?)(es|er|en|em|e|s|n)$", "$1")), " ")


def file_name(text: Column | str) -> Column:
    """A report's file name: runs of anything but letters and digits become hyphens."""
    return F.regexp_replace(_col(text), r"[^\p{L}\p{N}]+", "-")


def label_order(label: Column | str) -> Column:
    """A struct by which labels like 9, 10, 10a and 28b sort naturally."""
    c = _col(label)
    return F.struct(F.regexp_extract(c, "^([0-9]*)", 1).try_cast("int").alias("number"), F.regexp_extract(c, "^[0-9]*(.*)$", 1).alias("suffix"))


def bounded(needle: str) -> str:
    """A pattern for needle as a word: a boundary is asked for where needle begins or ends with a letter or digit."""
    import re

    quoted = "\\Q" + needle.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    word = re.compile(r"[^\W_]")
    return (rf"(?<!{LETTER})" if word.match(needle[:1]) else "") + quoted + (rf"(?!{LETTER})" if word.match(needle[-1:]) else "")


def count_words(text: Column | str, needle: str) -> Column:
    return F.regexp_count(_col(text), F.lit(bounded(needle)))


def sentence_count(text: Column | str) -> Column:
    """Sentences by the simple rule: an end mark, closing quotes, space, and a capital, quote or section sign."""
    return F.regexp_count(_col(text), F.lit(r"\.[“)]*\s+[A-ZÄÖÜ„(§]")) + 1
