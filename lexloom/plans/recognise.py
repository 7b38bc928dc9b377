"""Amendment prose to commands: an ordered list of rules, of which the first that matches decides.

Quotes are masked («0», «1», …) before the rules are tried, so no rule looks into a quote.  A rule whose
locator is not understood gives no command.  Rules for one clause come first, then
pairs, then clauses joined by "und" or ";".
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from lexloom.functions import locator as L
from lexloom.functions.labels import expand, natural, predecessor
from lexloom.plans.model import Command

#: A longer text is no command.
LONGEST = 4000
#: Names of punctuation marks and the marks.
MARKS = {"Punkt": ".", "Komma": ",", "Semikolon": ";", "Strichpunkt": ";", "Doppelpunkt": ":", "Beistrich": ","}

_Q = r"«(\d+)»"
_NOUN = r"(?:Worte?n?|Wort(?:es|s)?|Wörtern?|Angaben?|Zahlen?|Ziffern?|Textstellen?|Satzteile?s?|Klammerzusätze?n?|Klammerzusatz(?:es)?|Bezeichnung(?:en)?|Abkürzung(?:en)?|Wortfolgen?|Datum(?:s)?|Verweisung(?:en)?|Paragrafenangaben?|Betr[aä]ge?n?|Betrag(?:es|s)?|Passagen?|Formulierung(?:en)?|Halbsatz|Fundstellen?|Begriffe?n?|Begriffs?)"
_WORD = rf"(?:das |die |der |den |dem |ein |eine )?{_NOUN}"
_MARK = r"(?:der|das|den|dem|ein|einen|eines|einem) (Punkt|Komma|Semikolon|Strichpunkt|Doppelpunkt|Beistrich)(?:s|es)?"
_BE = r"(?:wird|werden)"
_LEVEL = r"(Paragrafen?|Paragraphen?|§§?|Art(?:ikel|\.)|Abs(?:atz|ätze|ätzen|\.)|Satz|Sätze|Sätzen|Halbsatz|Halbsätze|Nummern?|Nrn?\.|(?:Doppel)?[Bb]uchstaben?)"
_LABELS = r"((?: ?\d+[a-z]{0,2}| ?[a-z]{1,3}(?![a-zäöü]))(?:(?: und | bis |, )(?:\d+[a-z]{0,2}|[a-z]{1,3}(?![a-zäöü])))*)?"
_NEXT = r"(?:de[rnm]|die|das|es)? ?(?:folgende[rnsm]?|neue[rnsm]?)(?: neue[rnsm]?)?"
_LEVELS = {"Par": L.NORM, "§": L.NORM, "Art": L.NORM, "Abs": L.PARA, "Sat": L.SENTENCE, "Sät": L.SENTENCE, "Hal": L.HALF, "Num": L.NUMBER, "Nr": L.NUMBER, "Buc": L.LETTER, "buc": L.LETTER, "Dop": L.LETTER}


def level_of(word: str) -> str:
    return next(v for k, v in _LEVELS.items() if word.startswith(k))


@dataclass
class Clause:
    """A masked clause with the quotes that its masks stand for."""

    text: str
    quotes: list[str]
    context: L.Locator

    def quote(self, k: str | int) -> str:
        return self.quotes[int(k)]

    def words(self, k: str | int) -> str:
        """A quote of words: its white space is folded."""
        return re.sub(r"\s+", " ", self.quote(k)).strip()

    def at(self, phrase: str | None) -> list[L.Locator]:
        """The locators of a phrase within the context; the context alone without a phrase."""
        if phrase is None or not phrase.strip() or self.context and L.names_nothing(phrase):
            return [self.context]
        return [L.within(self.context, x) for x in L.parse_many(phrase)]


Builder = Callable[[Clause, re.Match], Command | None]
RULES: list[tuple[str, re.Pattern, Builder]] = []


def rule(name: str, pattern: str) -> Callable[[Builder], Builder]:
    def register(f: Builder) -> Builder:
        RULES.append((name, re.compile(pattern), f))
        return f

    return register


def joined(commands: list[Command]) -> Command | None:
    """One command, or a compound of several."""
    if not commands:
        return None
    return commands[0] if len(commands) == 1 else Command("compound", commands[0].at, parts=tuple(commands))


def _each(c: Clause, phrase: str | None, make: Callable[[L.Locator], Command]) -> Command | None:
    return joined([make(x) for x in c.at(phrase)])


def _block_labels(labels: str | None) -> list[str]:
    if not labels:
        return []
    out: list[str] = []
    for part in re.split(r" und |, ", labels.strip()):
        ends = part.strip().split(" bis ")
        out += (expand(*ends) or ends) if len(ends) == 2 else ends
    return out


# ------------------------------------------------------- table of contents, references


@rule("reference", r"^Die Inhaltsübersicht ist (?:entsprechend|dementsprechend) (?:zu ändern|anzupassen)$|^Die Inhaltsübersicht wird (?:entsprechend|dementsprechend) (?:geändert|angepasst)$")
def _reference(c, m):
    return Command("refer", (L.Part(L.TOC),))


@rule("reference to a point", r"^Die Inhaltsübersicht wird entsprechend der (?:vorstehenden |vorgenannten )?(Nummer.+?|Nr\..+?) geändert$")
def _reference_to_point(c, m):
    return Command("refer", (L.Part(L.TOC),), text=L.point_path(m[1]))


@rule("toc replaced", rf"^Die Inhaltsübersicht {_BE} durch (?:die )?folgende Inhaltsübersicht ersetzt: {_Q}$")
def _toc_replaced(c, m):
    return Command("redraft", (L.Part(L.TOC),), text=c.quote(m[1]))


@rule("toc insert", rf"^(?:In der Inhaltsübersicht {_BE} )?([Nn]ach|[Vv]or) (?:der|den) Angaben? zu[rm]? (.+?) {_BE}? ?(?:die )?folgende(?:n)? Angaben? (?:zu .+? )?eingefügt: {_Q}$")
def _toc_insert(c, m):
    found = L.parse_many(m[2])
    at = (L.Part(L.TOC), *found[-1]) if found else None
    return at and Command("insert_unit", at, before=m[1].lower() == "vor", text=c.quote(m[3]), level=L.NORM)


@rule("toc append", rf"^(?:(?:Der|In der) Inhaltsübersicht {_BE} )?(?:am Ende )?(?:die )?[Ff]olgende(?:n)? Angaben? (?:zu .+? )?angefügt: {_Q}$")
def _toc_append(c, m):
    return Command("append", (L.Part(L.TOC),), text=c.quote(m[1]))


@rule("toc entry", rf"^(?:In der Inhaltsübersicht {_BE} )?[Dd]ie Angaben? zu[rm]? (.+?) (?:{_BE} )?(?:wie folgt gefasst|durch (?:die )?folgenden? Angaben?(?: zu .+?)? ersetzt|erhält folgende Fassung|durch die Angabe): {_Q}$")
def _toc_entry(c, m):
    found = [(L.Part(L.TOC), *x) for x in L.parse_many(m[1])]
    if not found:
        return None
    return Command("redraft", found[0], text=c.quote(m[2])) if len(found) == 1 else Command("replace_units", found[0], to=found[-1], text=c.quote(m[2]), level=L.NORM)


@rule("toc repeal", rf"^(?:In der Inhaltsübersicht {_BE} )?[Dd]ie Angaben? zu[rm]? ([^«]+?) (?:{_BE} )?(?:gestrichen|aufgehoben)$")
def _toc_repeal(c, m):
    return joined([Command("repeal", (L.Part(L.TOC), *x)) for x in L.parse_many(m[1])])


# ------------------------------------------------------------------- redrafts


@rule("norms redrafted", rf"^(?:Die )?(?:bisherigen )?§§ ([^«]+?) (?:werden wie folgt (?:neu )?gefasst|erhalten (?:die )?folgende Fassung): ?{_Q}$")
def _norms_redraft(c, m):
    found = c.at("§§ " + m[1])
    if len(found) < 2:
        return None
    return Command("replace_units", found[0], to=found[-1], level=L.NORM, text=c.quote(m[2]), labels=tuple(str(x[-1]) for x in found))


@rule("redraft", rf"^(.*?) ?(?:(?:{_BE} )?(?:jeweils )?[Ww]ie folgt (?:neu )?gefasst|{_BE} neu gefasst|erh(?:ält|alten) (?:jeweils )?(?:die )?folgende Fassung|lautet(?: nun| künftig)? wie folgt|{_BE} wie folgt ersetzt): ?{_Q}$")
def _redraft(c, m):
    found = c.at(m[1])
    if not found:
        return None
    if len(found) == 1:
        return Command("redraft", found[0], text=c.quote(m[2])) if found[0] else None
    kinds = {x[-1].kind for x in found}
    return Command("replace_units", found[0], to=found[-1], level=kinds.pop(), text=c.quote(m[2])) if len(kinds) == 1 else None


@rule("text becomes paragraph", r"^(?:In (.+?) wird )?(?:[Dd]er )?(?:bisherige )?(?:Wortlaut|Text)(?: (?:des|der|von) (.+?))? wird (?:zu |zum )?(Absatz|Abs\.|Satz) (\d+[a-z]?)$")
def _text_becomes(c, m):
    at = c.at(m[1] or m[2])
    return Command("text_to_para" if m[3].startswith("Abs") else "text_to_sentence", at[0], label=m[4]) if len(at) == 1 and at[0] else None


@rule("footnote", r"^(?:In (.+?) (?:wird|werden) )?(?:[Dd]ie )?Fußnoten? ([\d⁰¹²³⁴⁵⁶⁷⁸⁹]+(?:(?:, | und )[\d⁰¹²³⁴⁵⁶⁷⁸⁹]+)*)\)?(?: zu (.+?))? (?:wird |werden )?(?:aufgehoben|gestrichen)$")
def _footnote(c, m):
    from lexloom.functions.sentences import to_number

    at = c.at(m[1] or m[3])
    return Command("repeal_footnote", at[0], labels=tuple(to_number(x) for x in re.split(r", | und ", m[2]))) if len(at) == 1 and at[0] else None


@rule("sentence number", r"^(?:In (.+?) (?:wird|werden) )?[Dd]ie (?:Satznummerierung|Satzbezeichnung|Satznummer)(?: «(\d+)»| (\d+|[⁰¹²³⁴⁵⁶⁷⁸⁹]+))? (?:wird )?(?:gestrichen|aufgehoben)$")
def _sentence_number(c, m):
    from lexloom.functions.sentences import to_number

    at = c.at(m[1])
    label = to_number(c.words(m[2])) if m[2] else to_number(m[3]) if m[3] else None
    return _each(c, m[1], lambda x: Command("strike_sentence_number", x, label=label)) if at and at[0] else None


@rule("heading replaced", rf"^(.*?Überschrift.*?) {_BE} durch (?:die )?folgende Überschrift ersetzt: {_Q}$")
def _heading(c, m):
    return _each(c, m[1], lambda x: Command("redraft", x, text=c.quote(m[2])))


@rule("heading replaced in", rf"^(?:In|Im) (.+?) {_BE} die Überschrift (?:durch (?:die )?folgende Überschrift ersetzt|wie folgt gefasst): {_Q}$")
def _heading_in(c, m):
    return _each(c, m[1], lambda x: Command("redraft", (*x, L.Part(L.HEADING)), text=c.quote(m[2])))


@rule("division headings inserted", rf"^(Nach|Vor) (.+?) (?:wird|werden) (?:die |der )?folgende[nr]? (?:Überschrift(?:en)?(?: zu .+?)?|(?:Teil|Kapitel|Abschnitts?|Unterabschnitts?)(?:s?überschrift(?:en)?)?)(?: \w+)? eingefügt: {_Q}$")
def _division_insert(c, m):
    at = c.at(m[2])
    return Command("division_headings", at[0], before=m[1] == "Vor", text=c.quote(m[3])) if len(at) == 1 and L.has(at[0], L.NORM) else None


@rule("division headings replaced", rf"^Die (?:bisherigen )?Überschrift(?:en)? (?:des|der|von|zu|zum) (.+?) (?:wird|werden) durch (?:die )?folgenden? (?:Überschrift(?:en)?|Gliederungsüberschriften)(?: zu .+?)? ersetzt: {_Q}$")
def _division_replace(c, m):
    at = c.at(m[1])
    return Command("division_headings", at[0], text=c.quote(m[2])) if len(at) == 1 and at[0][-1].kind == L.DIVISION else None


@rule("units replaced", rf"^(.+?) (?:wird|werden) durch {_NEXT} {_LEVEL}{_LABELS} ersetzt: ?{_Q}$")
def _units(c, m):
    found, level = c.at(m[1]), level_of(m[2])
    if not found or found[0] == c.context:
        return None
    new = _block_labels(m[3])
    if len(found) == 1 and found[0][-1].kind == level and len(new) <= 1 and not re.match(r"Abs(?:ätz)|Sätze|Nummern|Buchstaben|§§|Nrn", m[2]):
        return Command("redraft", found[0], text=c.quote(m[4]))
    return Command("replace_units", found[0], to=found[-1] if len(found) > 1 else L.EMPTY, level=level, text=c.quote(m[4]))


# -------------------------------------------------------------- words replaced


def _new_of(c: Clause, new: str) -> str | None:
    """What stands after "durch": a mark, a mark and words, or words."""
    if m := re.fullmatch(rf"{_MARK}", new):
        return MARKS[m[1]]
    if m := re.fullmatch(rf"{_MARK} und (?:{_WORD} )?{_Q}", new):
        return f"{MARKS[m[1]]} {c.words(m[2])}"
    if m := re.fullmatch(rf"(?:{_WORD} )?{_Q}(?: und {_MARK})?", new):
        return c.words(m[1]) + (MARKS[m[2]] if m[2] else "")
    return None


@rule("mark replaced", rf"^(?:(?:In|Im|Am Ende|An) ?(.*?) ?{_BE} )?(?:[Dd]er|[Dd]as|[Dd]en) (?:abschließende |Schluss)?(Punkt|Komma|Semikolon|Strichpunkt|Doppelpunkt)(?:s|es)?( am (?:Satz)?[Ee]nde(?: de[rs] (.+?))?)?(?: {_BE})? durch (.+?) ersetzt$")
def _mark_replaced(c, m):
    new = _new_of(c, m[5])
    if new is None:
        return None
    at_end = bool(m[3]) or m[0].startswith("Am Ende")
    return _each(c, m[1] or m[4], lambda x: Command("replace", x, MARKS[m[2]], new, at_end=at_end) if x else None) if c.at(m[1] or m[4])[:1] not in ([], [()]) else None


@rule("named mark repealed, wording appended", rf"^(?:In |Im )?(.+?) {_BE}(?: am (?:Text|Satz)?[Ee]nde)?(?: nach (?:{_WORD} )?{_Q})? das Satzzeichen «(\d+)» aufgehoben und folgende[nrs]? (?:Wortlaut |Wörter )?angefügt: «(\d+)»$")
def _named_mark(c, m):
    named = c.words(m[m.lastindex - 1])
    mark = MARKS.get(named, named if named in MARKS.values() else None)
    if mark is None:
        return None
    return _each(c, m[1], lambda x: Command("replace", x, old=mark, new=c.words(m[m.lastindex]), at_end=True))


@rule("words replaced", rf"^(?:In|Im|An|Am Ende)(?: (?:der|dem|den))? ?(.*?) {_BE} (jeweils )?(?:am Ende )?(?:nach (?:{_WORD} )?{_Q} )?(?:{_WORD} )?{_Q} (am Ende )?(jeweils )?durch (.+?) (?:jeweils )?ersetzt$")
def _replaced(c, m):
    new = _new_of(c, m[7])
    if new is None:
        return None
    each = bool(m[2] or m[6])
    return _each(c, m[1], lambda x: Command("replace", x, c.words(m[4]), new, each=each, at_end=bool(m[5])))


@rule("words replaced without place", rf"^(Jeweils )?(?:(?:[Dd]as|[Dd]ie|[Dd]er|[Dd]en) )?(?:{_WORD} )?{_Q} {_BE} (jeweils )?durch (.+?) (jeweils )?ersetzt$")
def _replaced_here(c, m):
    new = _new_of(c, m[4])
    return Command("replace", c.context, c.words(m[2]), new, each=bool(m[1] or m[3] or m[5])) if new is not None and c.context else None


# -------------------------------------------------------------- words inserted


@rule("words inserted", rf"^(?:In|Im|An|Dem|Der) ?(.*?) {_BE} (?:jeweils )?(nach|vor|hinter) (?:jeweils )?(?:{_WORD} )?{_Q} (?:{_BE} )?(?:jeweils )?(?:ein Komma und )?(?:{_MARK}|(?:{_WORD} )?{_Q}) (?:eingefügt|angefügt)$")
def _inserted(c, m):
    new = MARKS[m[4]] if m[4] else c.words(m[5])
    if re.search(r"(?:jeweils )?ein Komma und (?:\w+ \w+ )?«\d+» (?:eingefügt|angefügt)$", m[0]):
        new = ", " + new
    side = "before" if m[2] == "vor" else "after"
    return _each(c, m[1], lambda x: Command("insert_words", x, anchor=(side, c.words(m[3])), text=new))


@rule("words inserted before comma", rf"^(?:In|Im) (.+?) {_BE} vor dem Komma am Ende (?:{_WORD} )?{_Q} eingefügt$")
def _before_comma(c, m):
    return _each(c, m[1], lambda x: Command("insert_words", x, anchor=("before_comma", ""), text=c.words(m[2])))


@rule("words inserted, anchor first", rf"^([Nn]ach|[Vv]or|[Hh]inter) (?:{_WORD} )?{_Q} {_BE} (?:jeweils )?(ein Komma und )?(?:{_MARK}|(?:{_WORD} )?{_Q}) eingefügt$")
def _inserted_here(c, m):
    if not c.context:
        return None
    new = MARKS[m[4]] if m[4] else (", " if m[3] else "") + c.words(m[5])
    return Command("insert_words", c.context, anchor=("before" if m[1].lower() == "vor" else "after", c.words(m[2])), text=new)


@rule("words prepended", rf"^(?:(?:In|Im) (.+?) {_BE} )?[Dd]e[mnr] {_NOUN} {_Q} (?:{_BE} )?(?:{_WORD} )?{_Q} vorangestellt$")
def _words_prepended(c, m):
    return _each(c, m[1], lambda x: Command("insert_words", x, anchor=("before", c.words(m[2])), text=c.words(m[3])) if x else None) if c.at(m[1])[:1] not in ([], [()]) else None


@rule("words and mark before the full stop", rf"^(?:In|Im|Dem|Der) ?(.*?) {_BE} vor dem (?:abschließenden )?Punkt(?: am Ende)? (ein Komma und (?:werden |wird )?)?(?:{_WORD} )?{_Q} eingefügt$")
def _before_stop(c, m):
    new = f", {c.words(m[3])}." if m[2] else f" {c.words(m[3])}."
    return _each(c, m[1], lambda x: Command("replace", x, ".", new, at_end=True))


@rule("words at the end", rf"^(?:In|Im|Dem|Der|Am Ende) ?(.*?) {_BE} (?:am Ende )?(ein Komma und )?(?:{_WORD} )?{_Q} (?:am Ende )?(?:angefügt|eingefügt)$")
def _at_end(c, m):
    text = (", " if m[2] else "") + c.words(m[3])
    return _each(c, m[1], lambda x: Command("insert_words", x, anchor=("end", ""), text=text))


# -------------------------------------------------------------- units inserted


@rule("unit inserted at words", rf"^(?:(?:In|Im) (.+?) {_BE} )?([Nn]ach|[Vv]or) (?:{_WORD} )?{_Q} (?:{_BE} )?{_NEXT} {_LEVEL}{_LABELS} eingefügt: ?{_Q}$")
def _unit_at_words(c, m):
    at = c.at(m[1])
    labels = _block_labels(m[5])
    if len(at) != 1 or not at[0]:
        return None
    side = "before" if m[2].lower() == "vor" else "after"
    return Command("insert_unit", at[0], level=level_of(m[4]), label=labels[0] if len(labels) == 1 else None, before=side == "before", anchor=(side, c.words(m[3])), text=c.quote(m[6]))


@rule("unit inserted", rf"^(?:(?:In|Im) (.+?) {_BE} )?([Nn]ach|[Vv]or|[Hh]inter) ([^«]+?) (?:{_BE} )?{_NEXT} {_LEVEL}{_LABELS} (?:eingefügt|angefügt|vorangestellt): ?{_Q}$")
def _unit(c, m):
    level, labels = level_of(m[4]), _block_labels(m[5])
    outer = c.at(m[1])
    if len(outer) != 1:
        return None
    found = [L.within(outer[0], x) for x in L.parse_many(m[3])]
    if not found:
        return None
    at = found[0] if m[2].lower() == "vor" else found[-1]
    if level == L.NORM and L.has(at, L.NORM):
        at = tuple(p for p in at if p.kind == L.NORM)
    elif L.RANK[at[-1].kind] > L.RANK[level] and level in (L.PARA, L.SENTENCE):
        at = tuple(p for p in at if L.RANK[p.kind] <= L.RANK[level] or p.kind == L.NUMBER and level == L.SENTENCE)
    return Command("insert_unit", at, level=level, label=labels[0] if len(labels) == 1 else None, before=m[2].lower() == "vor", text=c.quote(m[6]))


@rule("prepended", rf"^(?:Dem|Der|Den|In|Im) ?(.*?) {_BE} {_NEXT} {_LEVEL}{_LABELS} vorangestellt: ?{_Q}$")
def _prepended(c, m):
    labels = _block_labels(m[3])
    at = c.at(m[1])
    if len(at) != 1 or not at[0]:
        return None
    level, label = level_of(m[2]), labels[0] if len(labels) == 1 else None
    if at[0][-1].kind == level:
        return Command("insert_unit", at[0], level=level, label=label, before=True, text=c.quote(m[4]))
    return Command("prepend", at[0], level=level, label=label, text=c.quote(m[4]))


@rule("prepended here", rf"^(?:Es {_BE} )?(?:[Dd]ie )?[Ff]olgende[rns]? {_LEVEL}{_LABELS} (?:{_BE} )?vorangestellt: ?{_Q}$")
def _prepended_here(c, m):
    labels = _block_labels(m[2])
    return Command("prepend", c.context, level=level_of(m[1]), label=labels[0] if len(labels) == 1 else None, text=c.quote(m[3])) if c.context else None


@rule("inserted without anchor", rf"^(?:(?:In|Im) (.+?) {_BE}|Es {_BE})? ?(?:[Ff]olgende[rns]?|{_NEXT}) {_LEVEL}{_LABELS} (?:{_BE} )?eingefügt: ?{_Q}$")
def _no_anchor(c, m):
    level, labels = level_of(m[2]), _block_labels(m[3])
    at = c.at(m[1])
    before = predecessor(labels[0]) if labels else None
    if len(at) != 1 or before is None:
        return None
    sign = "§" if not m[2].startswith("Art") else "Art."
    anchor = L.within(at[0], (L.Part(level, before, sign if level == L.NORM else ""),))
    return Command("insert_unit", anchor, level=level, label=labels[0] if len(labels) == 1 else None, text=c.quote(m[4]))


# ---------------------------------------------------------------------- appended


def _holder(at: L.Locator, level: str) -> L.Locator:
    """The unit that holds units of that level: a number is appended beside a number, not in it."""
    return at[:-1] if at and at[-1].kind == level and level in (L.NUMBER, L.LETTER, L.PARA) else at


@rule("appended", rf"^(?:Dem|Der|Den|An|In|Im|Am Ende) ?(.*?) {_BE} (?:am Ende )?{_NEXT} {_LEVEL}{_LABELS} (?:angefügt|hinzugefügt): ?{_Q}$")
def _appended(c, m):
    labels = _block_labels(m[3])
    level = level_of(m[2])
    at = c.at(m[1])
    if not at and level == L.NORM and re.fullmatch(r"(?:dem |des )?(?:Gesetz|Verordnung)(?:es)?", m[1]):
        at = [()]
    return Command("append", _holder(at[0], level), level=level, label=labels[0] if len(labels) == 1 else None, text=c.quote(m[4])) if len(at) == 1 and (at[0] or level == L.NORM) else None


@rule("supplemented", rf"^(.+?) {_BE} um {_NEXT} {_LEVEL}{_LABELS} ergänzt: ?{_Q}$")
def _supplemented(c, m):
    labels, at = _block_labels(m[3]), c.at(m[1])
    return Command("append", at[0], level=level_of(m[2]), label=labels[0] if len(labels) == 1 else None, text=c.quote(m[4])) if len(at) == 1 and at[0] else None


@rule("appended here", rf"^(?:Es {_BE} |Am Ende {_BE} )?(?:[Dd]ie |[Dd]er |[Dd]as )?(?:[Ff]olgende[rns]?|[Nn]eue[rns]?)(?: neue[rns]?)? {_LEVEL}{_LABELS}(?: {_BE})? (?:angefügt|hinzugefügt): ?{_Q}$")
def _appended_here(c, m):
    labels, level = _block_labels(m[2]), level_of(m[1])
    return Command("append", _holder(c.context, level), level=level, label=labels[0] if len(labels) == 1 else None, text=c.quote(m[3])) if c.context or level == L.NORM else None


# ------------------------------------------------------------- repealed and struck


@rule("paragraph label struck", r"^(?:In (.+?) wird )?[Dd]ie Absatzbezeichnung(?: «\d+»| \(\d+\w?\))?(?: (?:des|von) (.+?))? (?:wird )?gestrichen$")
def _label_struck(c, m):
    at = c.at(m[1] or m[2])
    number = re.search(r"«(\d+)»", m[0])
    if len(at) != 1 or not at[0]:
        return None
    where = at[0]
    if number and not L.has(where, L.PARA):
        where = (*where, L.Part(L.PARA, c.words(number[1]).strip("()")))
    return Command("repeal", (*where, L.Part(L.LABEL)))


@rule("repealed", rf"^(.+?) (?:{_BE} (?:jeweils )?(?:ersatzlos )?aufgehoben|entf(?:ällt|allen))$")
def _repealed(c, m):
    if "«" in m[1]:
        return None
    found = c.at(m[1])
    if not found or found[0] == c.context:
        return None
    return joined([Command("repeal", x) for x in sorted(found, key=lambda x: natural(x[-1].value), reverse=True)])


@rule("words struck", rf"^(?:(?:In|Im|Am Ende) ?(.*?) {_BE} )(jeweils )?(?:am Ende )?(?:nach (?:{_WORD} )?{_Q} )?(?:{_WORD} )?{_Q}((?:, (?:{_WORD} )?«\d+»)*(?: und (?:{_WORD} )?«\d+»)?) (?:jeweils )?(?:ersatzlos )?(?:gestrichen|aufgehoben)$")
def _struck(c, m):
    quotes = [m[4], *re.findall(_Q, m[5] or "")]
    return joined([Command("strike", x, c.words(q)) for x in c.at(m[1]) for q in quotes])


@rule("words struck here", rf"^(?:(?:[Dd]as|[Dd]ie|[Dd]er|[Dd]en) )?(?:{_WORD} )?{_Q}((?:, (?:{_WORD} )?«\d+»)*(?: und (?:{_WORD} )?«\d+»)?) {_BE} (?:jeweils )?(?:gestrichen|aufgehoben)$")
def _struck_here(c, m):
    return joined([Command("strike", c.context, c.words(q)) for q in [m[1], *re.findall(_Q, m[2] or "")]]) if c.context else None


@rule("unit struck", rf"^(.+?) {_BE} (?:ersatzlos )?gestrichen$")
def _unit_struck(c, m):
    found = c.at(m[1]) if "«" not in m[1] else []
    return joined([Command("repeal", x) for x in found]) if found and found[0] != c.context else None


# -------------------------------------------------------------------- renumbered


@rule("renumbered", rf"^(?:Die |Der |Das |[Dd]er |[Dd]ie )?(?:bisherige[nr]? )?([^«]+?) {_BE} (?:zu[rm]? )?(?:den |der |die )?((?:§|Art|Abs|Satz|Sätz|N(?:umm|r)|Buchst|Doppelb|Halb|Abschn|Kapit|Teil|Anlage)[^«]*)$")
def _renumbered(c, m):
    old, new = c.at(m[1]), c.at(m[2])
    if not old or not new or any(x == c.context for x in old + new):
        return None
    if re.search(r"\bbis\b", m[1]) and old[0][-1].kind in (L.NORM, L.PARA) and len(old) != len(new):
        return Command("renumber_range", old[0], labels=tuple(x[-1].value for x in old), new_labels=tuple(x[-1].value for x in new))
    if len(old) != len(new):
        return Command("renumber_range", old[0], labels=tuple(x[-1].value for x in old), new_labels=tuple(x[-1].value for x in new))
    pairs = list(zip(old, new, strict=True))
    if old[0][-1].kind != L.NORM:
        pairs.reverse()  # from the end, so that labels do not collide; norms are put in order by what depends on what
    return joined([Command("renumber", a, to=(*a[:-1], b[-1])) for a, b in pairs])


# ------------------------------------------------------------------ whole texts


_FRAME = re.compile(rf"^(.+?) {_BE} wie folgt geändert:?$")


def frame(text: str) -> L.Locator | None:
    """The context that "… wird wie folgt geändert:" sets for the points under it."""
    m = _FRAME.match(text.strip())
    found = L.parse_many(m[1]) if m else []
    return found[0] if len(found) == 1 else None


def mask(text: str) -> tuple[str, list[str]]:
    """The text with its outermost quotes masked, and the quotes."""
    out, quotes, depth, start, at = [], [], 0, 0, 0
    for k, ch in enumerate(text):
        if ch == "„":
            if depth == 0:
                out.append(text[at:k])
                start = k + 1
            depth += 1
        elif ch == "“" and depth:
            depth -= 1
            if depth == 0:
                out.append(f"«{len(quotes)}»")
                quotes.append(text[start:k])
                at = k + 1
    out.append(text[at:] if depth == 0 else text[start - 1 :])
    return "".join(out), quotes


def _outside_mark(text: str, quotes: list[str]) -> tuple[str, list[str]]:
    """A mark that is printed before the quote that it belongs to is put into it."""
    m = re.search(r": ((?:\d+[a-z]?\.|[a-z]{1,3}\)|\(\d+[a-z]?\))) «(\d+)»[.,;]?$", text)
    if not m:
        return text, quotes
    k = int(m[2])
    return f"{text[: m.start()]}: «{k}»", [f"{m[1]} {q.lstrip()}" if j == k else q for j, q in enumerate(quotes)]


def _tidy(text: str) -> str:
    text = re.sub(r"\s+", " ", text).strip()
    text = re.sub(rf"durch (?:die )?folgenden?s? (?:Wörter|Wort) ersetzt: («\d+»)", r"durch die Wörter \1 ersetzt", text)
    text = re.sub(r"(«\d+»)[.,;]?$", r"\1", text)
    return re.sub(r"[.;,]$", "", text).strip()


def _single(c: Clause) -> Command | None:
    """The command of the first rule that the clause matches; if that rule cannot make out its place or its text, none: the clause is not guessed at."""
    for _, pattern, build in RULES:
        if m := pattern.match(c.text):
            try:
                return build(c, m)
            except (IndexError, StopIteration):  # a place or a quote that the rule needs is not there
                return None
    return None


_PAIRS = re.compile(rf"^((?:In|Im) .+? {_BE} (?:jeweils )?)(.+) (ersetzt|eingefügt|gestrichen)$")


def _pairs(c: Clause) -> Command | None:
    """"A durch B und C durch D ersetzt": each pair is a command of its own with the shared place and verb."""
    m = _PAIRS.match(c.text)
    if not m:
        return None
    word = rf"(?:(?:jeweils )?(?:nach |vor )?(?:{_WORD} )?«\d+»|(?:nach |vor )?(?:der|das|den) (?:Punkt|Komma|Semikolon))"
    parts = re.split(rf"(?:, | und |, und |; )(?={word} )", m[2])
    if len(parts) < 2:
        return None
    if m[3] == "ersetzt" and not all(" durch " in p for p in parts):
        return None
    found = [_single(Clause(f"{m[1]}{p} {m[3]}", c.quotes, c.context)) for p in parts]
    return joined(found) if all(found) else None


_VERB = re.compile(r"(?:aufgehoben|gestrichen|ersetzt|eingefügt|angefügt|gefasst|vorangestellt|Fassung)\b")


def _subject(found: Command) -> L.Locator:
    last = found.parts[-1] if found.kind == "compound" else found
    if last.kind == "text_to_para":
        return (*last.at, L.Part(L.PARA, last.label or "1"))
    return last.to if last.kind == "renumber" else last.at


def _clauses(c: Clause) -> Command | None:
    """Clauses joined by "und", "sowie" or a semicolon; all of them must be understood."""
    for sep in re.finditer(r"; (?:und )?|, und | und | sowie |, ", c.text):
        left, right = c.text[: sep.start()], c.text[sep.end() :]
        for verb in ("", *(f" {v[0]}" for v in list(_VERB.finditer(c.text))[-1:])):
            first = _single(Clause(_tidy(left) if not verb else f"{left}{verb}", c.quotes, c.context))
            if first is None and verb == "":
                first = _pairs(Clause(_tidy(left), c.quotes, c.context))
            if first is None:
                continue
            second = _right(Clause(_tidy(right), c.quotes, c.context), first, left)
            if second is not None:
                parts = [p for x in (first, second) for p in (x.parts if x.kind == "compound" else (x,))]
                return joined(parts)
    return None


def _right(c: Clause, first: Command, left: str) -> Command | None:
    """A clause after another: punctuation without a place means the unit just renumbered; a missing place or verb is shared."""
    subject = _subject(first)
    text = c.text[:1].upper() + c.text[1:]
    loose = re.match(r"(?:Der|Das|Den) (?:Punkt|Komma|Semikolon)", text)
    last = first.parts[-1] if first.kind == "compound" else first
    renumbered = last.kind in ("renumber", "text_to_para")
    candidates = [(text, subject if renumbered and loose else c.context)]
    place = re.match(rf"((?:In|Im) .+? {_BE}) ", left)
    if place and re.match(r"(?:[Ff]olgende|[Dd]ie folgenden)", text):
        candidates.insert(0, (f"{place[1]} {c.text}", c.context))
    if renumbered and subject[-1].kind in (L.PARA, L.NORM) and (m := re.match(rf"(?:In|Im|Nach|Vor) (?:der |dem |den )?(.+?) {_BE} ", text)):
        own = L.parse_many(m[1])
        if own and L.RANK[own[0][0].kind] > L.RANK[subject[-1].kind]:
            candidates.insert(0, (text, subject))  # a finer place lies in the unit just renumbered
    if m := re.match(r"[Ii]n (?:ihr|ihm|diese[rm]) ((?:wird|werden) .*)", text):
        candidates.insert(0, (f"In {L.show(subject[-1:])} {m[1]}", subject[:-1]))
    if m := re.match(r"(?:wird|werden) (.*)", c.text):
        candidates.append((m[1][:1].upper() + m[1][1:], subject))
        if place:
            candidates.append((f"{place[1]} {m[1]}", c.context))
    if place and not re.match(r"(?:In|Im|Nach|Vor) ", text) or place and re.match(r"(?:Nach|Vor) (?:dem|der|den) W", text):
        candidates.append((f"{place[1]} {c.text}", c.context))
    if renumbered or not re.match(r"(?:In|Im) ", text):
        candidates.append((text, subject))
    for t, context in candidates:
        clause = Clause(t, c.quotes, context)
        found = _single(clause) or _pairs(clause) or _clauses(clause)
        if found is not None:
            return found
    return None


def recognise_masked(text: str, quotes: list[str], context: L.Locator = L.EMPTY) -> Command | None:
    if len(text) > LONGEST:
        return None
    text, quotes = _outside_mark(re.sub(r"\s+", " ", text).strip(), quotes)
    clause = Clause(_tidy(text), quotes, context)
    found = _single(clause)
    if found is None and (m := re.match(r"^(.+?) (?:und|sowie) (?:wird |werden )?wie folgt geändert: (.+)$", clause.text)):
        first = _single(Clause(m[1], quotes, context))
        second = first and recognise_masked(m[2][:1].upper() + m[2][1:], quotes, _subject(first))
        if second is not None:
            return joined([p for x in (first, second) for p in (x.parts if x.kind == "compound" else (x,))])
    if found is None and (m := re.match(rf"^(.+?) {_BE} wie folgt geändert: (.+)$", clause.text)):
        inner = L.parse_many(m[1])
        if len(inner) == 1:
            found = recognise_masked(m[2][:1].upper() + m[2][1:], quotes, L.within(context, inner[0]))
    return found or _pairs(clause) or _clauses(clause)


def recognise(text: str, context: L.Locator = L.EMPTY) -> Command | None:
    """The command of a text with its quotes in place; None if it is not understood."""
    masked, quotes = mask(text)
    found = recognise_masked(masked, quotes, context)
    if found is None and text.count("“") > text.count("„"):
        cut = text.rfind("“")
        masked, quotes = mask(text[:cut] + text[cut + 1 :])
        found = recognise_masked(masked, quotes, context)
    return found


