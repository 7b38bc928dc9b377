"""Sentences of legal texts, and their official numbers."""

from __future__ import annotations

import re

from lexloom.functions.columns import DIGITS, MONTHS, SUPERSCRIPTS

#: Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = [
    "Abs", "Art", "Artt", "Aufl", "Bd", "bzw", "ca", "d", "Dr", "e", "etc", "evtl", "ff", "f", "gem", "ggf", "h", "Hrsg", "i", "lit", "max", "mind", "Mio", "Mrd", "Nr", "Nrn", "o", "Prof",
    "Rn", "S", "s", "sog", "St", "Std", "str", "Tz", "u", "usw", "v", "vgl", "z", "zzgl", "BGBl", "GVBl", "GVOBl", "GBl", "GV", "Amtsbl", "ABl", "Bek", "inkl", "einschl", "Buchst", "Halbs", "Ziff",
    "insbes", "Doppelbuchst", "RGBl", "BAnz", "BayRS", "Nds", "NRW", "NW", "entspr", "Unterabs", "Anm", "Abschn", "Kap", "Anl",
]
#: Words for divisions that an ordinal number may precede.
_UNITS = "Abschnitt|Teil|Kapitel|Buch|Titel|Unterabschnitt|Absatz|Halbsatz|Satz|Alternative|Lebensjahr|Schuljahr|Jahrgangsstufe"
_MARKS = re.compile(rf"[{SUPERSCRIPTS}]+")
_END = re.compile(r"[.!?][“”\")]*\s+(?=[A-ZÄÖÜ„(§«])")
_OFFICIAL = re.compile(rf"(?:(?<=^)|(?<=[\s(„]))([{SUPERSCRIPTS}]+)(?=[^\s){SUPERSCRIPTS}])")


def to_number(superscript: str) -> str:
    return superscript.translate(str.maketrans(SUPERSCRIPTS, DIGITS))


def to_superscript(number: int | str) -> str:
    return str(number).translate(str.maketrans(DIGITS, SUPERSCRIPTS))


def official_numbers(text: str) -> list[tuple[int, str]]:
    """(place, number) of superscripts that open a sentence; footnote marks like ⁶) do not."""
    return [(m.start(1), to_number(m[1])) for m in _OFFICIAL.finditer(text)]


def _ends_sentence(text: str, m: re.Match) -> bool:
    before, after = text[: m.start()], text[m.end() :]
    if m[0][0] != ".":
        return True
    word = re.search(r"[\w]+$", before)
    if not word:
        return True
    token = word[0]
    line = before[before.rfind("\n") + 1 :]
    if re.fullmatch(r"\s*(?:\d+[a-z]?(?:\.\d+)*|[a-z]{1,3}|[ivx]+)", line):
        return False  # the mark of an item
    if token in ABBREVIATIONS:
        return False
    if re.fullmatch("[a-z]", token) and not re.search(r"\d\s*$", before[: word.start()]):
        return False  # "z. B.", but "§ 3 Nr. 4 a." ends
    if re.fullmatch("[A-Z]", token) and re.search(r"(?<!\w)(?:z|u|i|o|s|a|d)\.\s?$", before[: word.start()]):
        return False  # "z. B. Der": one abbreviation of several letters
    if token.isdigit() and re.match(rf"(?:{'|'.join(MONTHS)})\b|(?:{_UNITS})", after):
        return False
    return True


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of each sentence.  Official numbers, where a text has them, are exact borders."""
    marks = official_numbers(text)
    if any(n != "1" for _, n in marks):
        cuts = [0] + [at for at, n in marks if n != "1" and at > 0]
    else:
        cuts = [0] + [m.end() for m in _END.finditer(text) if _ends_sentence(text, m)]
    out = []
    for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True):
        end = a + len(text[a:b].rstrip())
        if end > a:
            out.append((a, end))
    return out


def sentence_span(text: str, label: str) -> tuple[int, int] | None:
    """The sentence with that number: by official numbers if there are any, else by position."""
    found = sentences(text)
    if not found:
        return None
    if label == "letzter":
        return found[-1]
    if official_numbers(text):
        for a, b in found:
            m = _MARKS.match(text[a:b].lstrip("„("))
            if m and to_number(m[0]) == label:
                return a, b
        return None
    k = int(label) if label.isdigit() else 0
    return found[k - 1] if 0 < k <= len(found) else None


def half_sentence_span(text: str, label: str) -> tuple[int, int] | None:
    """The part before or after the first semicolon; there are two."""
    cut = text.find(";")
    if cut < 0:
        return None
    if label == "1":
        return 0, cut + 1
    if label == "2":
        start = cut + 1 + (len(text[cut + 1 :]) - len(text[cut + 1 :].lstrip()))
        return start, len(text)
    return None


def numbered(text: str) -> str:
    """A one-line text of two sentences or more with official numbers, set anew."""
    bare = re.sub(rf"(^|(?<=\s))[{SUPERSCRIPTS}]+(?=[^\s)])", "", text)
    found = sentences(bare)
    if "\n" in bare or len(found) < 2:
        return bare if "\n" not in text else text
    out, at = [], 0
    for k, (a, _) in enumerate(found, 1):
        out += [bare[at:a], to_superscript(k)]
        at = a
    return "".join([*out, bare[at:]])
