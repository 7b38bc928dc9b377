"""When an act's points come into force."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass

from lexloom.functions.columns import MONTHS
from lexloom.functions.locator import point_path


def german_date(text: str) -> dt.date | None:
    m = re.search(r"(\d{1,2})\. ?(\w+) (\d{4})", text)
    if not m or m[2] not in MONTHS:
        return None
    try:
        return dt.date(int(m[3]), MONTHS.index(m[2]) + 1, int(m[1]))
    except ValueError:
        return None


def write_date(date: dt.date) -> str:
    return f"{date.day}. {MONTHS[date.month - 1]} {date.year}"


@dataclass(frozen=True)
class Rule:
    """A date (None if it is not told) for points by article and path prefix; without points for everything else."""

    date: dt.date | None
    wording: str
    points: tuple[tuple[str, str], ...] = ()


def read_rules(text: str) -> list[Rule]:
    """The rules of the closing article.  What goes out of force is none of them."""
    out = []
    for part in re.split(r"(?:^|\n)\s*\((?:\d+)\)\s+|(?<=\.)\s+(?=Abweichend|Artikel \d+.*tritt)", text):
        for sentence in re.split(r"(?<=Kraft\.)\s+", part):
            m = re.search(r"(.*?\bin Kraft\b)", re.sub(r"\s+", " ", sentence))
            if not m or re.search(r"außer Kraft", m[1]):
                continue
            wording = m[1].strip()
            points = []
            for a in re.finditer(r"(?:Artikel|Art\.) (\d+[a-z]?)((?:(?!Artikel|Art\. ).)*)", wording):
                article, rest = f"Artikel {a[1]}", a[2]
                paths = [p for x in re.split(r",| und | sowie ", rest) if (p := point_path(x))]
                plural = re.search(r"Nummern ([\d, und]+)", rest)
                if plural:
                    paths = [f"{n}." for n in re.findall(r"\d+", plural[1])]
                points += [(article, p) for p in paths] or [(article, "")]
            general = re.match(r"(?:Dieses Gesetz|Diese Verordnung|Das Gesetz|Die Verordnung|Im Übrigen)", wording)
            if general and "Absatz" not in wording and not re.search(r"mit Ausnahme", wording):
                points = [] if re.match(r"(?:Im Übrigen|Dieses|Diese|Das|Die)", wording) else points
            out.append(Rule(german_date(wording.replace("1. des", "")), wording, tuple(points)))
    return out


def rule_for(rules: list[Rule], article: str, path: str) -> Rule | None:
    """The most specific rule: the longest prefix of the path, else the article's, else the general one."""
    best, length = None, -1
    for r in rules:
        for a, prefix in r.points:
            if a == article and (path == prefix or path.startswith(prefix + " ") or not prefix) and len(prefix) > length:
                best, length = r, len(prefix)
    return best or next((r for r in rules if not r.points), None)


def staggered(rules: list[Rule]) -> bool:
    return any(r.points for r in rules)
