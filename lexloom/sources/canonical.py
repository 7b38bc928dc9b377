"""Laws as plain text: the form in which they are read, written, and read again.

Header: title, "(short – abbreviation)", "Stand: …", "Fortgeschrieben durch: …"; then headings of
divisions, heads of norms ("§ 1  Title"), paragraphs "(1) …" and indented items; annexes last.
"""

from __future__ import annotations

import re
import unicodedata

from lexloom.functions.columns import DIGITS, SUPERSCRIPTS
from lexloom.functions.labels import expand, natural
from lexloom.functions.locator import ORDINALS
from lexloom.plans.model import REPEALED, Division, Law, Mark, Norm, Paragraph, item_mark, mark_depth

TOC_LABEL = "Inhaltsübersicht"
_UNIT = r"(?:Teil|Buch|Kapitel|Abschnitt|Unterabschnitt|Titel)"
_DIVISIONS = [
    re.compile(rf"^((?:\d+[a-z]?|[IVX]+)\. {_UNIT})(?:(?:  +| ?[:–-] ?| (?=[A-ZÄÖÜ]))(.+))?$"),
    re.compile(rf"^({_UNIT} (?:\d+[a-z]?|[IVX]+))(?:(?:  +| ?[:–-] ?| )(.+))?$"),
    re.compile(rf"^((?:{'|'.join(x.capitalize() for x in ORDINALS)})e[rs] {_UNIT})(?:(?:  +| ?[:–-] ?| )(.+))?$"),
]
#: Headings that nothing but their place tells from items: a norm or division must follow at once.
_BARE = re.compile(r"^([IVX]+\.|\d+\.) +([A-ZÄÖÜ].*[^.,;:\s])$")
_NORM = re.compile(r"^(§|Art\.|Artikel) (\d+[a-z]{0,2})(?:(?:  +|\t| )(\S.*))?$")
_GONE = re.compile(r"^§§ (\d+[a-z]?) (?:u\.|und|bis|-|–) (\d+[a-z]?)\s+\(weggefallen\)$")
_GONE_TITLES = (REPEALED, "(aufgehoben)")
_FOOTNOTE = re.compile(r"^(\d+)\) (?=\[)")
#: Named units of annexes are norms of their own.
_NAMED_UNIT = re.compile(r"^((?!Unterabschnitt)[A-ZÄÖÜ][a-zäöüß]+abschnitt \d+[a-z]?)(?:  +(.*))?$")
_ANNEX = re.compile(r"^((?:Anlage|Anhang)(?: (?:\d+[a-z]?|[IVX]+))?(?: Nummer \d+[a-z]?)?)(?:  +(.*)| ?(\((?:zu|Zu) .*))?$")
_PARA = re.compile(r"^\((\d+[a-z]{0,2})\) +")


def _is_head(m: re.Match, last: str | None) -> bool:
    """A head's title starts with a capital or bracket and ends without a full stop, and its number is larger than the last."""
    title = m[3]
    if title and (not re.match(r"[A-ZÄÖÜ(„0-9]", title) or title.rstrip().endswith((".", ",", ";")) and title.strip() != REPEALED):
        return False
    if title and re.match(r"(?:Abs(?:atz|\.)|Satz|Nummer|Nr\.|Buchstabe|Halbsatz|und |bis )", title):
        return False
    return last is None or natural(m[2]) > natural(last)


def _bare_heading(lines: list[str], k: int) -> tuple[str, str] | None:
    """A heading without a word for its unit: "I. Aufgaben" or "1. Der Rat", right before a norm or another heading."""
    m = _BARE.match(lines[k])
    return (m[1], m[2]) if m and _head_follows(lines, k + 1) else None


def divisions_heading(line: str) -> tuple[str, str | None] | None:
    for pattern in _DIVISIONS:
        if m := pattern.match(line):
            return m[1], m[2]
    return None


def tidy(lines: list[str]) -> str:
    """Lines of a paragraph with items indented by two blanks for each level of mark."""
    out, stack = [], []
    for line in lines:
        bare = line.strip()
        if not bare:
            continue
        mark = item_mark(bare)
        if mark is None:
            own = (len(line) - len(line.lstrip())) // 2
            out.append("  " * min(own, len(stack) + 1) + bare if out else bare)
            continue
        kind = "n" if mark[0].isdigit() else "–" if mark in "–-" else "l" * len(mark.rstrip(")."))
        if kind in stack:
            stack = stack[: stack.index(kind) + 1]
        else:
            stack = [k for k in stack if mark_depth_of(k) < mark_depth(mark)] + [kind]
        out.append("  " * len(stack) + bare)
    return "\n".join(out)


def mark_depth_of(kind: str) -> int:
    return 1 if kind in "n–" else 1 + len(kind)


def paragraphs_of(lines: list[str]) -> list[Paragraph]:
    """A new paragraph starts at each "(n) "; lines before the first belong to one without a number."""
    groups: list[tuple[str | None, list[str]]] = []
    for line in lines:
        if not line.strip():
            continue
        line = _FOOTNOTE.sub(lambda m: m[1].translate(str.maketrans(DIGITS, SUPERSCRIPTS)) + ") ", line)
        m = _PARA.match(line)
        if m:
            groups.append((m[1], [line[m.end() :]]))
        elif groups:
            groups[-1][1].append(line)
        else:
            groups.append((None, [line]))
    return [Paragraph(number, tidy(body)) for number, body in groups]


def read_law(text: str, short: str | None = None) -> Law:
    """A law from its text, however its norms are labelled; nothing is lost that is not a blank line."""
    lines = [x.rstrip() for x in re.split(r"\r\n|\r|\n", unicodedata.normalize("NFC", text).lstrip("﻿"))]
    at = 0
    head: list[str] = []
    while at < len(lines) and not divisions_heading(lines[at]) and not _bare_heading(lines, at) and not ((m := _NORM.match(lines[at])) and _is_head(m, None)) and not _ANNEX.match(lines[at]) and not _GONE.match(lines[at]) and lines[at].strip() != TOC_LABEL:
        if lines[at].strip():
            head.append(lines[at].strip())
        at += 1
    if head and (m := re.match(r"(\S+): (.+?) \(\1\) Vom ", head[0])):  # a portal's line before the title
        k = next((j for j, x in enumerate(head) if x == m[2]), 0)
        head = head[k:]
    law = Law(short or "", head[0] if head else "")
    rest = []
    for line in head[1:]:
        if (m := re.fullmatch(r"\((.+?) [–-] ?([^()]+?)(?: ?[–-])?\)", line)) and law.abbreviation is None:
            law.short, law.abbreviation = m[1], m[2].strip()
        elif (m := re.fullmatch(r"\(([^()]{1,40})\)", line)) and law.abbreviation is None and not rest:
            law.abbreviation = m[1]
        elif m := re.fullmatch(r"Stand: (.*)", line):
            law.stand = m[1]
        elif m := re.fullmatch(r"Fortgeschrieben durch: (.*)", line):
            d = re.search(r"vom (\d{1,2}\. \w+ \d{4})", m[1])
            law.marks.append(Mark(m[1], d[1] if d else None))
        else:
            rest.append(line)
    law.stand = law.stand or ("; ".join(rest) or None)
    law.short = law.short or short or law.title

    label, title, body, division, last, annexes, counter = None, None, [], None, None, False, 0

    def close() -> None:
        nonlocal label, title, body
        if label is not None:
            paragraphs = [Paragraph(None, "\n".join(x.strip() for x in body if x.strip()))] if label == TOC_LABEL else paragraphs_of(body)
            gone = title in _GONE_TITLES or [p.text for p in paragraphs] in ([x] for x in _GONE_TITLES)
            if title in _GONE_TITLES:
                title, paragraphs = None, paragraphs or [Paragraph(None, title)]
            law.norms.append(Norm(label, title, paragraphs, division, gone))
        label, title, body = None, None, []

    for k in range(at, len(lines)):
        line = lines[k]
        if not line.strip():
            continue
        norm = _NORM.match(line)
        in_toc = label == TOC_LABEL
        if line.strip() == TOC_LABEL and not law.norms:
            close()
            label = TOC_LABEL
        elif in_toc and " | " in line:
            body.append(line)
        elif not annexes and norm and not (in_toc and norm[3] is None) and _is_head(norm, last):
            close()
            label, title, last = f"{'§' if norm[1] == '§' else 'Art.'} {norm[2]}", norm[3], norm[2]
        elif not annexes and (m := _GONE.match(line)):
            close()
            for x in expand(m[1], m[2]) or [m[1], m[2]]:
                label, body = f"§ {x}", [REPEALED]
                close()
            last = m[2]
        elif m := _ANNEX.match(line):
            close()
            annexes, label, title = True, m[1], m[2] or m[3]
        elif annexes and (m := _NAMED_UNIT.match(line)):
            close()
            label, title = m[1], m[2]
        elif annexes and label and (m := re.fullmatch(r"Nummer (\d+[a-z]?)", line.strip())):
            annex = re.sub(r" Nummer \w+$", "", label)  # an annex's numbers with paragraphs of their own are norms
            close()
            label = f"{annex} Nummer {m[1]}"
        elif not annexes and ((found := divisions_heading(line)) and not (in_toc and not _head_follows(lines, k + 1)) or (found := None if in_toc else _bare_heading(lines, k))):
            close()
            if found[0][0].isdigit() and found[0].endswith(".") and law.divisions:
                parent = law.divisions[division].code.split(".")[0] if division is not None else "000"
                code = f"{parent}.{sum(d.code.startswith(parent + '.') for d in law.divisions) + 1}"
            else:
                counter += 1
                code = f"{counter:03d}"
            law.divisions.append(Division(found[0], found[1], code))
            division = len(law.divisions) - 1
        else:
            if label is None and division is not None:
                own = law.divisions[division]  # a heading's title may go on on the next line
                own.title = f"{own.title} {line.strip()}" if own.title else line.strip()
                continue
            if label is None:
                label, title = "", None
            body.append(line)
    close()
    return law


def _head_follows(lines: list[str], at: int) -> bool:
    for line in lines[at:]:
        if line.strip():
            return " | " not in line and (bool(_NORM.match(line)) or divisions_heading(line) is not None or bool(_BARE.match(line)))
    return False


def write_law(law: Law) -> str:
    """The text that read_law reads back as the same law."""
    out = [law.title]
    if law.abbreviation:
        out.append(f"({law.short} – {law.abbreviation})" if law.short not in ("", law.title) else f"({law.abbreviation})")
    if law.stand:
        out.append(f"Stand: {law.stand}")
    out += [f"Fortgeschrieben durch: {m.label}" for m in law.marks]
    annex = [n for n in law.norms if n.label.startswith(("Anlage", "Anhang")) or _NAMED_UNIT.match(n.label)]
    written: set[int] = set()
    for norm in [n for n in law.norms if n not in annex] + annex:
        if norm.division is not None and norm.label != TOC_LABEL:
            for k in range(norm.division + 1):
                if k not in written:
                    d = law.divisions[k]
                    out.append(f"{d.label}  {d.title}" if d.title else d.label)
                    written.add(k)
        if norm.label:
            out.append(f"{norm.label}  {norm.title}" if norm.title else norm.label)
        for p in norm.paragraphs:
            out.append(p.whole())
    out += [f"{d.label}  {d.title}" if d.title else d.label for k, d in enumerate(law.divisions) if k not in written]
    return "\n".join(out) + "\n"
