"""Quotes and outlines of amendment documents.

Quotes are masked before the outline is read, so that a quoted "1." opens no point.  A line-initial mark
counts as a point only if it opens a level (1, a, aa) right under the last point, or follows the
last one of its level; that keeps dates and quantities from becoming points.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass, field

from lexloom.functions.labels import is_successor

_ARTICLE = re.compile(r"^\s*(?:Artikel|Art\.) \d+[a-z]?\b(?!.*[.;,]$)")
_VERBS = re.compile(r"(?:geändert|gefasst|ersetzt|eingefügt|angefügt|vorangestellt|Fassung):?\s*$")
_MARK = re.compile(r"^\s*(?:(\d+(?:\.\d+)+)\.?|(\d+[a-z]?)\.|([a-z]\d?)\)|([a-z])\1?\)|([a-z]{2,4})\)|([ivx]+)\.)\s+")


def normal_quotes(text: str) -> tuple[str, list[str]]:
    """Quotation marks of other styles as „ and “, and warnings."""
    text = text.translate(str.maketrans({"«": "„", "»": "“", "”": "“", "‟": "„"}))
    warnings = []
    if '"' in text:
        n = text.count('"')
        if "„" not in text and n % 2 == 0:
            turn = iter(range(n))
            text = re.sub('"', lambda _: "„" if next(turn) % 2 == 0 else "“", text)
        else:
            warnings.append(f"{n} gerade Anführungszeichen sind als schließende gelesen.")
            text = text.replace('"', "“")
    # An opening mark at a word's end, or a closing one at its start, is upside down.
    text = re.sub(r"(?<=\w)„(?=[\s.,;:)]|$)", "“", text)
    text = re.sub(r"(^|[\s(])“(?=\w[^„“]*“)", r"\1„", text)
    return text, warnings


def mark_of(line: str) -> tuple[int, str, int] | None:
    """(level, label, length of the mark) of a line-initial mark; doubled letters are a level deeper."""
    m = re.match(r"^\s*(\d+(?:\.\d+)+)\.?\s+", line)
    if m:
        return 1 + m[1].count("."), m[1], m.end()
    m = re.match(r"^\s*(\d+[a-z]?)\.\s+", line)
    if m:
        return 1, m[1], m.end()
    m = re.match(r"^\s*([a-z]+\d?)\)\s+", line)
    if m:
        label = m[1]
        if len(label) > 1 and label.isalpha() and len(set(label)) == 1 and len(label) <= 4:
            return 1 + len(label), label, m.end()
        if re.fullmatch(r"[a-z]\d?", label):
            return 2, label, m.end()
    m = re.match(r"^\s*([a-z])\.\s+", line)
    if m and m[1] not in "ivx":
        return 2, m[1], m.end()
    m = re.match(r"^\s*([ivx]+)\.\s+", line)
    if m:
        return 3, m[1], m.end()
    return None


@dataclass
class Quoted:
    text: str
    quotes: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


def extract_quotes(text: str) -> Quoted:
    """The text with its outermost quotes as «i».  A quote that is never closed ends at the next article,
    or, in a section whose marks do not balance, where the next point of the same or a higher level
    begins with command language before it."""
    out: list[str] = []
    quoted = Quoted("")
    depth, start, at, k = 0, 0, 0, 0
    opened_level = 1
    # Where marks, lines and articles stand, so that no line of a long quote looks through what follows it.
    opening, closing = ([m.start() for m in re.finditer(x, text)] for x in "„“")
    ends = [*(m.start() for m in re.finditer("\n", text)), len(text)]
    articles = [m.start() for m in re.finditer(r"^[^\S\n]*(?:Artikel|Art\.) \d+", text, re.M)]

    def close(end: int, resume: int) -> None:
        nonlocal at, depth
        out.append(f"«{len(quoted.quotes)}»")
        quoted.quotes.append(text[start:end].strip("\n"))
        at, depth = resume, 0

    while k < len(text):
        ch = text[k]
        if ch == "„":
            if depth == 0:
                out.append(text[at:k])
                start = k + 1
                line = text[text.rfind("\n", 0, k) + 1 : k]
                found = mark_of(line)
                opened_level = found[0] if found else opened_level
            depth += 1
        elif ch == "“":
            if depth:
                depth -= 1
                if depth == 0:
                    close(k, k + 1)
            else:
                quoted.warnings.append("Ein schließendes Anführungszeichen hat kein öffnendes.")
        elif ch == "\n" and depth:
            line = text[k + 1 : ends[bisect_left(ends, k + 1)]]
            left = lambda marks, low, high=len(text): bisect_left(marks, high) - bisect_left(marks, low)
            if _ARTICLE.match(line) and left(closing, k + 1) <= left(opening, k + 1):
                quoted.warnings.append("Ein Zitat ist nicht geschlossen; es endet vor dem nächsten Artikel.")
                close(k, k)
            else:
                at_article = bisect_left(articles, k + 1)
                stop = articles[at_article] if at_article < len(articles) else len(text)
                found = mark_of(line)
                if (
                    left(opening, start - 1, stop) > left(closing, start - 1, stop)
                    and found
                    and found[0] <= opened_level
                    and re.search(r"(?:geändert|aufgehoben|ersetzt|eingefügt|angefügt|gefasst|gestrichen)[:.]?|(?:wird|werden)\b", line)
                    and "“" not in line.split("„")[0]
                ):
                    quoted.warnings.append("Ein Zitat ist nicht geschlossen; es endet vor dem nächsten Gliederungspunkt.")
                    close(k, k)
        k += 1
    if depth:
        quoted.warnings.append("Am Textende ist ein Zitat offen.")
        close(len(text), len(text))
    out.append(text[at:])
    quoted.text = "".join(out)
    return quoted


def restore_quotes(text: str, quotes: list[str]) -> str:
    return re.sub(r"«(\d+)»", lambda m: f"„{quotes[int(m[1])]}“", text)


@dataclass
class Point:
    """A point of the outline: its marks from the top, its own text, and the points under it."""

    path: tuple[str, ...]
    text: str
    children: list[Point] = field(default_factory=list)
    wording: str = ""  # as printed, where the text has been completed


def _shown(level: int, label: str) -> str:
    return f"{label}." if label[0].isdigit() or level == 3 and re.fullmatch("[ivx]+", label) else f"{label})"


def scan_outline(text: str) -> tuple[str, list[Point]]:
    """The text before the first point, and the points as a tree."""
    head: list[str] = []
    root: list[Point] = []
    stack: list[tuple[int, str, Point]] = []
    for line in text.split("\n"):
        rest, accepted = line, False
        while found := mark_of(rest):  # "1. a) aa)" may open several levels on one line
            level, label, length = found
            depth = next((k for k, (lv, lb, _) in reversed(list(enumerate(stack))) if lv == level and is_successor(lb, label)), None)
            if "." in label and stack:
                parent = label.rsplit(".", 1)[0]
                opens = label.rsplit(".", 1)[1] == "1" and any(lb == parent for _, lb, _ in stack)
            else:
                opens = (level == 1 and not stack and label == "1") or (bool(stack) and level == stack[-1][0] + 1 and label in ("a", "aa", "aaa", "aaaa", "i"))
            if depth is None and not opens:
                break
            if depth is not None:
                del stack[depth:]
            elif "." in label and stack:
                k = next(k for k, (_, lb, _) in enumerate(stack) if lb == label.rsplit(".", 1)[0])
                del stack[k + 1 :]
            point = Point((*(stack[-1][2].path if stack else ()), _shown(level, label)), "")
            (stack[-1][2].children if stack else root).append(point)
            stack.append((level, label, point))
            rest, accepted = rest[length:], True
        target = stack[-1][2] if stack else None
        if target is None:
            head.append(rest)
        elif accepted:
            target.text = rest
        else:
            target.text += "\n" + rest
    return "\n".join(head), root
