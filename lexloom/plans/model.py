"""A law in memory while its commands are applied, and the commands themselves.

A law is a small tree and commands see the results of earlier ones, so one law is amended in one task;
laws run in parallel.  Items of a paragraph are indented lines of its text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from lexloom.functions.locator import EMPTY, Locator, show

REPEALED = "(weggefallen)"

#: Reasons in the order in which they are shown.
REASONS = {
    "NOT_RECOGNISED": "Befehl nicht erkannt",
    "PLACE_NOT_FOUND": "Stelle nicht auffindbar",
    "TARGET_MISSING": "Zieltext nicht vorhanden",
    "AMBIGUOUS": "Fundstelle mehrdeutig",
    "BAD_RANGE": "Bereich unbrauchbar",
    "BAD_QUOTE": "Zitat unbrauchbar",
    "STATE_CONFLICT": "Bestand widerspricht dem Befehl",
    "UNSUPPORTED": "Nicht unterstützt",
    "FAILED": "Anwendung fehlgeschlagen",
    "NOT_IN_FORCE": "Noch nicht in Kraft",
}
APPLIED, MANUAL, DEFERRED = "APPLIED", "MANUAL", "NOT_IN_FORCE"


class Failure(Exception):
    """Why a command cannot be applied: a reason and prose."""

    def __init__(self, reason: str, prose: str):
        super().__init__(prose)
        self.reason, self.prose = reason, prose


@dataclass
class Paragraph:
    number: str | None
    text: str

    def whole(self) -> str:
        """With its number; an item that opens a numbered paragraph stands right behind it, without its indentation."""
        return f"({self.number}) {self.text.lstrip(' ')}" if self.number else self.text


@dataclass
class Norm:
    label: str
    title: str | None = None
    paragraphs: list[Paragraph] = field(default_factory=list)
    division: int | None = None
    repealed: bool = False

    def wording(self) -> str:
        """Title and text with white space folded; what a reconciliation compares."""
        return re.sub(r"\s+", " ", " ".join([self.title or "", *(p.whole() for p in self.paragraphs)])).strip()

    def text(self) -> str:
        return "\n\n".join(p.whole() for p in self.paragraphs)


@dataclass
class Division:
    label: str
    title: str | None = None
    code: str = ""


@dataclass
class Mark:
    """An amendment that has been applied before."""

    label: str
    date: str | None = None


@dataclass
class Law:
    short: str
    title: str
    abbreviation: str | None = None
    stand: str | None = None
    norms: list[Norm] = field(default_factory=list)
    divisions: list[Division] = field(default_factory=list)
    marks: list[Mark] = field(default_factory=list)

    def norm(self, label: str) -> Norm | None:
        return next((n for n in self.norms if n.label == label), None)

    def copy(self) -> Law:
        norms = [replace(n, paragraphs=[replace(p) for p in n.paragraphs]) for n in self.norms]
        return replace(self, norms=norms, divisions=[replace(d) for d in self.divisions], marks=[replace(m) for m in self.marks])

    def numbers_sentences(self) -> bool:
        """Whether any paragraph carries official sentence numbers."""
        from lexloom.functions.sentences import official_numbers

        return any(any(n == "2" for _, n in official_numbers(p.text)) for x in self.norms for p in x.paragraphs)


@dataclass(frozen=True)
class Origin:
    """Where a command stands: article, outline path, wording, page."""

    article: str = ""
    path: str = ""
    wording: str = ""
    page: int | None = None

    def __str__(self) -> str:
        return " ".join(filter(None, [self.article, self.path])) + (f" (S. {self.page})" if self.page else "")


@dataclass(frozen=True)
class Command:
    """One kind of change with the fields that it needs.

    kind is one of: replace, redraft, replace_units, insert_words, insert_unit, append, repeal, strike, renumber,
    renumber_range, text_to_para, text_to_sentence, prepend, repeal_footnote, strike_sentence_number,
    division_headings, compound, unknown, refer.
    """

    kind: str
    at: Locator = EMPTY
    old: str = ""
    new: str = ""
    each: bool = False
    at_end: bool = False
    to: Locator = EMPTY
    level: str = ""
    label: str | None = None
    before: bool = False
    anchor: tuple[str, str] | None = None  # ("after" | "before" | "end" | "before_comma", words)
    text: str = ""
    labels: tuple[str, ...] = ()
    new_labels: tuple[str, ...] = ()
    parts: tuple[Command, ...] = ()
    origin: Origin = Origin()

    def __str__(self) -> str:
        return f"{self.kind} {show(self.at)}".strip()

    def with_origin(self, origin: Origin) -> Command:
        return replace(self, origin=origin, parts=tuple(p.with_origin(origin) for p in self.parts))


@dataclass
class Entry:
    """One protocol row."""

    command: Command
    status: str
    prose: str = ""
    affected: tuple[str, ...] = ()
    reason: str | None = None


_ITEM = re.compile(r"^(\s*)(\d+[a-z]?(?:\.\d+)*\.|\d+(?:\.\d+)+|[a-z]{1,3}\)|[ivx]+\.|[–-]) +")


def item_mark(line: str) -> str | None:
    """The mark that opens a line, as "1." or "a)"; a number with points counts with its last one."""
    m = _ITEM.match(line)
    return m[2] if m else None


def mark_for(kind: str, label: str) -> str:
    return f"{label}." if kind == "number" else f"{label})"


def mark_depth(mark: str) -> int:
    """1 for numbers, 2 for letters, 3 and 4 for doubled and tripled ones."""
    if mark[0].isdigit() or mark in "–-":
        return 1 + mark.rstrip(".").count(".")
    return 1 + len(mark.rstrip(").")) if len(set(mark.rstrip(")."))) == 1 and mark.endswith(")") else 3 if mark.endswith(".") else 2
