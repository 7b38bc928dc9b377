"""Locators: phrases that name a unit of a law, as lists of components.

``§ 3 Absatz 1 Satz 2 und Absatz 4`` names two units that share ``§ 3``.  A phrase with a word that is
not understood names nothing: a locator is never guessed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from lexloom.functions.labels import expand

NORM, TOC, DIVISION, ANNEX, PARA, SENTENCE, HALF, NUMBER, LETTER, HEADING, LABEL = (
    "norm", "toc", "division", "annex", "para", "sentence", "half", "number", "letter", "heading", "label",
)
#: How deep a component lies; a coordinated component shares what lies above it.
RANK = {TOC: 0, DIVISION: 1, ANNEX: 1, NORM: 2, PARA: 3, SENTENCE: 4, HALF: 5, NUMBER: 5, LETTER: 6, HEADING: 7, LABEL: 7}
_NAMES = {PARA: "Absatz", SENTENCE: "Satz", HALF: "Halbsatz", NUMBER: "Nummer", LETTER: "Buchstabe"}
#: Ordinal words in order.
ORDINALS = ["erst", "zweit", "dritt", "viert", "fünft", "sechst", "siebt", "acht", "neunt", "zehnt", "elft", "zwölft"]


@dataclass(frozen=True)
class Part:
    """One component; ``sign`` is the printed kind of a norm (§ or Art.) or of a division."""

    kind: str
    value: str = ""
    sign: str = ""

    def __str__(self) -> str:
        if self.kind == NORM:
            return f"{self.sign or '§'} {self.value}"
        if self.kind in (DIVISION, ANNEX):
            return f"{self.sign} {self.value}".strip()
        return {HEADING: "Überschrift", TOC: "Inhaltsübersicht", LABEL: "Absatzbezeichnung"}.get(self.kind) or f"{_NAMES[self.kind]} {self.value}"


Locator = tuple[Part, ...]
EMPTY: Locator = ()


def show(locator: Locator) -> str:
    """The printed form; also the name by which steps are ordered."""
    return " ".join(map(str, locator))


def has(locator: Locator, kind: str) -> bool:
    return any(p.kind == kind for p in locator)


def get(locator: Locator, kind: str) -> Part | None:
    return next((p for p in locator if p.kind == kind), None)


def without(locator: Locator, kind: str) -> Locator:
    return tuple(p for p in locator if p.kind != kind)


def within(context: Locator, found: Locator) -> Locator:
    """found, completed from the context by what lies above its first component."""
    if not found:
        return context
    if found[0].kind in (TOC, NORM, ANNEX) and not (has(context, TOC) and found[0].kind != TOC):
        return found
    first = found[0]
    if first.kind == DIVISION:
        return (tuple(p for p in context if p.kind in (TOC, DIVISION)) if not has(context, NORM) else ()) + found
    upper = []
    for p in context:
        # A number can hold sentences and a sentence numbers; only the same kind, or what is finer than it, is left.
        if p.kind == first.kind or RANK[p.kind] >= RANK[first.kind] and not (p.kind == NUMBER and first.kind in (SENTENCE, HALF)):
            break
        upper.append(p)
    return (*upper, *found)


_VALUE = r"\d+(?:\.\d+)*[a-z]{0,2}|[a-z]{1,3}"
_KINDS = [
    (NORM, r"§§?|Art(?:ikel[sn]?|t?\.)"),
    (PARA, r"Abs(?:atz(?:es)?|ätzen?|\.)"),
    (HALF, r"Halbs(?:atz(?:es)?|ätzen?|\.)"),
    (SENTENCE, r"S(?:atz(?:es)?|ätzen?)(?![a-zäöü])"),
    (NUMBER, r"N(?:ummern?|rn?\.)"),
    (LETTER, r"(?:Doppel|Dreifach)?[Bb]uchst(?:abe(?:ns?)?|\.)"),
]
_DIVISIONS = r"Teil(?:s|es)?|Buch(?:s|es)?|Kapitels?|(?:Unter)?[Aa]bschnitt(?:s|es)?|Titels?"
_SKIP = re.compile(
    r"(?:der|die|das|des|dem|den|in|im|an|am|von|vom|zu|zur|zum|bisherige[nrsm]?|neue[nrsm]?|jeweilige[nrsm]?|folgende[nrsm]?|dort|wird|"
    r"dieses Gesetzes|dieser Verordnung|des Gesetzes|der Verordnung|des Rahmens|Angaben? zu[rm]?|Wortlaut(?:s|es)?|In|Im|An|Am|Der|Die|Das|Dem|Den|Des|Zu|Nach|nach|vor|Vor)(?![\wäöüß])"
)
_CHAPEAU = re.compile(
    r"(?:,? ?(?:im |in dem |dem |der |den |die )?(?:Satzteil|Einleitungssatz|Eingangssatz|Einleitung(?!s)|einleitende[nr]? Satzteil|Teilsatz|Wortlaut|Angabe) ?(?:(?:vor|nach) (?:der )?(?:Nummer|Nr\.|Buchstabe) ?(?:\w+)?)?)"
)
_TOKEN = re.compile(r"\s+")


def _tokens(phrase: str) -> list[tuple[str, object]] | None:
    """('part', Part), ('value', str), ('and', None) and ('to', None); None if a word is not understood."""
    out: list[tuple[str, object]] = []
    at, text = 0, phrase.strip().rstrip(":.").strip()
    while at < len(text):
        rest = text[at:]
        if m := _TOKEN.match(rest):
            at += m.end()
        elif m := re.match(r"(?:, ?(?:und|sowie|oder)?|und|sowie|oder)(?![\wäöüß])", rest):
            if out and out[-1][0] != "and":
                out.append(("and", None))
            at += m.end()
        elif m := re.match(r"bis(?: zu[rm]?)?(?![\wäöüß])", rest):
            out.append(("to", None))
            at += m.end()
        elif m := re.match(r"(?:der |die )?Inhaltsübersicht|Inhaltsverzeichnis(?:ses)?", rest):
            out.append(("part", Part(TOC)))
            at += m.end()
        elif m := re.match(r"Überschrift(?:en)?(?![\wäöüß])|(?:der )?Name der Verordnung", rest):
            out.append(("part", Part(HEADING)))
            at += m.end()
        elif m := re.match(r"Absatzbezeichnung(?: «\d+»| „\(?\w+\)?“)?", rest):
            out.append(("part", Part(LABEL)))
            at += m.end()
        elif (m := _CHAPEAU.match(rest)) and m.end():
            at += m.end()
        elif m := re.match(rf"({'|'.join(ORDINALS)})e[nrsm]? ({_DIVISIONS})", rest, re.I):
            out.append(("part", Part(DIVISION, str(ORDINALS.index(m[1].lower()) + 1), _singular(m[2]))))
            at += m.end()
        elif m := re.match(r"(?!Unterabschnitt)([A-ZÄÖÜ][a-zäöüß]+abschnitt)(?:s|es)? (\d+[a-z]?)(?![\wäöüß])", rest):
            out.append(("part", Part(ANNEX, m[2], m[1])))  # a named unit of an annex, which is a norm
            at += m.end()
        elif m := re.match(rf"(\d+|[IVX]+)\. ({_DIVISIONS})(?![\wäöüß])", rest):
            out.append(("part", Part(DIVISION, m[1], _singular(m[2]))))
            at += m.end()
        elif m := re.match(rf"({_DIVISIONS}) (\d+[a-z]?|[IVX]+)(?![\wäöüß])", rest):
            out.append(("part", Part(DIVISION, m[2], _singular(m[1]))))
            at += m.end()
        elif m := re.match(r"(Anlagen?|Anhang(?:s|es)?)(?: \(?zu (?:§§?|Art\.) ?\d+[a-z]?(?: (?:Abs(?:atz|\.)|Satz|Nummer|Nr\.) \d+[a-z]?)*\)?)?(?: (\d+[a-z]?|[IVX]+)(?![\wäöüß]))?(?: zu §§? ?\d+[a-z]?)?", rest):
            out.append(("part", Part(ANNEX, m[2] or "", "Anlage" if m[1].startswith("Anlage") else "Anhang")))
            at += m.end()
        elif m := re.match(r"letzte[nrsm]? Satz(?:es)?", rest):
            out.append(("part", Part(SENTENCE, "letzter")))
            at += m.end()
        elif m := re.match(rf"({'|'.join(ORDINALS)})e[nrsm]? (Halbsatz(?:es)?|Satz(?:es)?)", rest, re.I):
            out.append(("part", Part(HALF if m[2].startswith("Halb") else SENTENCE, str(ORDINALS.index(m[1].lower()) + 1))))
            at += m.end()
        elif found := next(((k, m) for k, p in _KINDS if (m := re.match(rf"(?:{p}) ?({_VALUE})\.?(?![\wäöüß])", rest))), None):
            kind, m = found
            sign = "" if kind != NORM else "§" if rest.startswith("§") else "Art."
            out.append(("part", Part(kind, m[1], sign)))
            at += len(m[0]) - (m[0].endswith(".") and not rest[m.end() :].strip().startswith(("§", "A", "S", "N", "B")) and m.end() < len(rest))
        elif m := re.match(r"([a-z]{1,3})\)", rest):
            out.append(("part", Part(LETTER, m[1])))
            at += m.end()
        elif m := re.match(r"(\d+[a-z]?)\.(?=\s|$)", rest):
            out.append(("part", Part(NUMBER, m[1])))
            at += m.end()
        elif m := _SKIP.match(rest):
            at += m.end()
        elif m := re.match(rf"({_VALUE})(?![\wäöüß])", rest):
            out.append(("value", m[1]))
            at += m.end()
        else:
            return None
    return out


def _singular(division: str) -> str:
    return re.sub(r"(?<=[a-z])(?:es|s)$", "", division) if not division.startswith("Kapitel") else "Kapitel"


def parse_many(phrase: str) -> list[Locator]:
    """The units that a phrase names, in its order; empty if it is not understood."""
    tokens = _tokens(phrase)
    if not tokens:
        return []
    out: list[list[Part]] = []
    current: list[Part] | None = None
    fresh, span = True, False
    for kind, token in tokens:
        if kind == "and":
            fresh, span = True, False
        elif kind == "to":
            span = True
        elif kind == "part":
            if span:
                if not current or current[-1].kind != token.kind or (labels := expand(current[-1].value, token.value)) is None:
                    return []
                out += [[*current[:-1], Part(token.kind, x, token.sign)] for x in labels[1:]]
                current, span = out[-1], False
            elif fresh and current is not None:
                upper = []
                for p in current:
                    if p.kind == token.kind or RANK[p.kind] >= RANK[token.kind]:
                        break
                    upper.append(p)
                current = [*upper, token]
                out.append(current)
            elif current is None:
                current = [token]
                out.append(current)
            elif token.kind == current[-1].kind and token.kind in (NORM, PARA, SENTENCE, HALF, NUMBER):
                return []  # "Absatz 3 Absatz 4" names nothing
            else:
                current.append(token)
            fresh = False
        else:
            if current is None or not current[-1].value:
                return []
            last = current[-1]
            if span:
                if (labels := expand(last.value, token)) is None:
                    return []
                out += [[*current[:-1], Part(last.kind, x, last.sign)] for x in labels[1:]]
                current, span = out[-1], False
            elif fresh:
                current = [*current[:-1], Part(last.kind, token, last.sign)]
                out.append(current)
            else:
                return []
            fresh = False
    return [tuple(x) for x in out]


def names_nothing(phrase: str) -> bool:
    """Whether a phrase is understood but has no unit of its own, like "im Satzteil vor Nummer 1" or "dem Wortlaut"."""
    return _tokens(phrase) == []


def parse(phrase: str) -> Locator | None:
    """The one unit that a phrase names; None if it names several, or is not understood."""
    found = parse_many(phrase)
    return found[0] if len(found) == 1 else None


def point_path(phrase: str) -> str:
    """"Nummer 8 Buchstabe a Doppelbuchstabe bb" as the outline path "8. a) bb)"."""
    number = re.search(r"N(?:umme|)r\.? ?(\d+[a-z]?)", phrase)
    letter = re.search(r"(?<!pel)(?<!fach)[Bb]uchst(?:abe|\.) ?([a-z])(?![a-z])", phrase)
    double = re.search(r"Doppelbuchst(?:abe|\.) ?([a-z]{2})", phrase)
    parts = [(number, "."), (letter, ")"), (double, ")")]
    return " ".join(m[1] + end for m, end in parts if m)
