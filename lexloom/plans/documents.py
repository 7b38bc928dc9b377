"""What an amendment document is: its kind, paper numbers, title and date, by content alone."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass

from lexloom.plans.commencement import german_date

ACT, DRAFT, MOTION, RECOMMENDATION, NO_COMMANDS, UNKNOWN = "ACT", "DRAFT", "MOTION", "RECOMMENDATION", "NO_COMMANDS", "UNKNOWN"
#: Filled lines that count as the head, and those in which a document names its own number.
HEAD, OWN = 120, 10


@dataclass(frozen=True)
class Document:
    kind: str
    own_number: str | None
    refers_to: tuple[str, ...]
    title: str | None
    issued: dt.date | None

    @property
    def name(self) -> str:
        """By what an applied amendment is known: kind with paper number, or date; an undated one says so."""
        label = {ACT: "Änderungsgesetz", DRAFT: "Gesetzentwurf", MOTION: "Änderungsantrag", RECOMMENDATION: "Beschlussempfehlung"}.get(self.kind, "Dokument")
        if self.own_number:
            return f"{label} Drs. {self.own_number}"
        if self.issued:
            from lexloom.plans.commencement import write_date

            return f"{label} vom {write_date(self.issued)}"
        return f"{label} (ohne Kennzeichnung)"

    @property
    def is_draft(self) -> bool:
        return self.kind in (DRAFT, RECOMMENDATION)


def _kind(head: str, text: str) -> str:
    has = lambda pattern: re.search(pattern, head, re.M) is not None
    if has(r"^\s*(?:Plenarprotokoll|Stenografischer Bericht)"):
        return NO_COMMANDS
    if has(r"^\s*(?:\w+ )?Änderungsantr(?:ag|äge)") and re.search(r"wolle? (?:\w+ ){0,3}beschließen|wird wie folgt geändert", text):
        return MOTION
    if has(r"^\s*(?:Entschließungsantrag|Entschließung|Beschluss des|Antrag auf Entschließung)"):
        return NO_COMMANDS
    if has(r"^\s*(?:Beschlussempfehlung|Beschlußempfehlung)"):
        return RECOMMENDATION if re.search(r"Zusammenstellung|Beschlüsse des", text) else NO_COMMANDS
    if has(r"^\s*(?:Gesetzentwurf|Entwurf eines|Regierungsentwurf|Referentenentwurf|Gesetzesantrag)"):
        return DRAFT
    if has(r"^\s*Änderungsantr(?:ag|äge)"):
        return MOTION
    if has(r"^\s*(?:\w+ ){0,3}(?:Gesetz|Verordnung|\w*gesetz|\w*verordnung)\b") and re.search(r"wird wie folgt geändert|werden wie folgt geändert", text):
        return ACT
    return UNKNOWN


def recognise_document(text: str) -> Document:
    lines = [x.strip() for x in text.split("\n") if x.strip()][:HEAD]
    head = "\n".join(lines)
    own = re.findall(r"Drucksache\s+(\d+/\d+)|Drs\.\s*(\d+/\d+)", "\n".join(lines[:OWN]))
    own_number = next((a or b for a, b in own), None)
    numbers = [a or b for a, b in re.findall(r"Drucksache\s+(\d+/\d+)|Drs\.\s*(\d+/\d+)", head)]
    refers = tuple(dict.fromkeys(x for x in numbers if x != own_number))
    dates = [d for x in lines if (m := re.fullmatch(r"Vom (\d{1,2}\. \w+ \d{4})", x)) and (d := german_date(m[1]))]
    title = None
    for k, line in enumerate(lines):
        if m := re.match(r"hier: ?(.+)", line):
            title = m[1]
            break
        if re.match(r"Entwurf eines ", line) or re.match(r"(?:\w+ )*(?:Gesetz|Verordnung)\b", line) and "ndert" not in line:
            parts = [line]
            for more in lines[k + 1 : k + 6]:
                if re.match(r"(?:Vom |Artikel |A\. |Der |Das |§ |\d)", more):
                    break
                parts.append(more)
            title = " ".join(parts)
            break
    return Document(_kind(head, text), own_number, refers, title, dates[0] if len(dates) == 1 else None)


def official_columns(lines: list[tuple[str, str]]) -> list[str]:
    """A committee's table of (draft, resolution) lines as the resolved text.

    An empty right side keeps the left one while the left is valid; "unverändert" takes the left text with the right's
    mark, "entfällt" drops it, anything else replaces it.
    """
    out, valid = [], True
    for left, right in lines:
        r = right.strip()
        if not r:
            if valid and left.strip():
                out.append(left.strip())
            continue
        mark = re.match(r"((?:\d+[a-z]?\.|[a-z]+\)|\(\d+\))\s*)?(unverändert|entfällt)\.?$", r)
        if mark and mark[2] == "unverändert":
            own = re.sub(r"^(?:\d+[a-z]?\.|[a-z]+\)|\(\d+\))\s*", "", left.strip())
            out.append(f"{(mark[1] or '').strip()} {own}".strip() if mark[1] else left.strip())
            valid = True
        elif mark:
            valid = False
        else:
            out.append(r)
            valid = False
    return out


def committee_text(lines: list[tuple[str, str]]) -> tuple[list[str] | None, list[str]]:
    """The resolved text of a recommendation's comparison, which begins under its heading and ends where the report begins; and warnings."""
    opens = [k for k, pair in enumerate(lines) if any(re.match(r"\s*Zusammenstellung\b", x) for x in pair)]
    if not opens:
        return None, ["Die Beschlussempfehlung enthält keine Zusammenstellung."]
    first = opens[0] + 1
    last = next((k for k in range(first, len(lines)) if any(re.match(r"\s*Bericht (?:der|des)\b|\s*Bericht\s*$", x) for x in lines[k])), len(lines))
    heads = re.compile(r"\s*(?:Entwurf|Beschlüsse des \d+\. Ausschusses)\s*")
    return official_columns([(a, b) for a, b in lines[first:last] if not all(heads.fullmatch(x) or not x.strip() for x in (a, b)) or not (a + b).strip()]), []


class Concordance:
    """Finds the page on which a wording stands, by its letters and digits alone, forward from the last find."""

    def __init__(self, pages: list[tuple[int, str]]):
        self.text, self.page, self.cursor = "", [], 0
        for page, text in pages:
            bare = self._bare(text)
            self.text += bare
            self.page += [page] * len(bare)

    @staticmethod
    def _bare(text: str) -> str:
        return "".join(c for c in text.lower() if c.isalnum())

    def find(self, wording: str) -> int | None:
        bare = self._bare(wording)
        if len(bare) < 8:
            return None
        for length in (60, 24):
            probe = bare[:length]
            for start in (self.cursor, 0):
                at = self.text.find(probe, start)
                if at >= 0:
                    self.cursor = at if start else max(self.cursor, at)
                    return self.page[at]
        return None
