"""An amendment document to the commands that concern one law."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from lexloom.functions import locator as L
from lexloom.plans.commencement import Rule, german_date, read_rules
from lexloom.plans.model import Command, Law, Origin
from lexloom.plans.outline import Point, extract_quotes, normal_quotes, restore_quotes, scan_outline
from lexloom.plans.recognise import frame, recognise_masked

_HEADER = re.compile(r"^\s*((?:Artikel|Art\.) \d+[a-z]?|§ \d+[a-z]?)\s*$|^\s*((?:Artikel|Art\.) \d+[a-z]?)\s+(?!Abs|Satz|Nummer|Nr\.)(?=[A-ZÄÖÜ])(.*[^.,;:])$")
_REASONING = re.compile(r"^\s*(?:(?:A\.|I\.)?\s*)?(?:Begründung|B e g r ü n d u n g)\s*:?\s*$")
_AMENDS = re.compile(r"(?:wird|werden)\s+wie\s+folgt\s+geändert\s*:?")


@dataclass
class Compiled:
    commands: list[Command] = field(default_factory=list)
    rules: list[Rule] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    articles: list[str] = field(default_factory=list)


def stem(text: str) -> str:
    """Words without an inflection at their end, where four letters are left."""
    return " ".join(re.sub(r"^(.{4,}?)(?:es|er|en|em|e|s|n)$", r"\1", w) for w in re.split(r"\s+", text.strip()))


def concerns(preamble: str, law: Law) -> bool:
    """Whether an article's preamble amends the law: by title (words compared by stem) or abbreviation."""
    if not _AMENDS.search(preamble):
        return False
    text = re.sub(r"\s+", " ", preamble)
    implementing = r"(?:zur (?:Aus|Durch)führung|zum Vollzug) (?:des|der) "
    if not re.search(implementing, law.title):
        text = re.sub(implementing + r".*?(?=(?: in der Fassung|,| vom | wird))", "", text)
    for name in filter(None, {law.title, law.short}):
        if stem(name).lower() in stem(re.sub(r"[,.;:()–-]", " ", text)).lower() or stem(re.sub(r"[,.;:()–-]", " ", name)).lower() in stem(re.sub(r"[,.;:()–-]", " ", text)).lower():
            return True
    return bool(law.abbreviation and re.search(rf"(?<![\w-]){re.escape(law.abbreviation)}(?![\w-])", text))


def split_articles(text: str) -> list[tuple[str, str]]:
    """(label, body) of each article; the reasoning that follows them is none."""
    out: list[tuple[str, list[str]]] = []
    for line in text.split("\n"):
        if _REASONING.match(line) and out:
            break
        if (m := _HEADER.match(line)) and not (m[1] or "").startswith("§"):
            out.append(((m[1] or m[2]).replace("Art. ", "Artikel "), [m[3] or ""]))
        elif out:
            out[-1][1].append(line)
    return [(label, "\n".join(body).strip("\n")) for label, body in out] or split_sections(text)


def split_sections(text: str) -> list[tuple[str, str]]:
    """(label, body) of each § of an act that is divided by §§."""
    out: list[tuple[str, list[str]]] = []
    for line in text.split("\n"):
        if _REASONING.match(line) and out:
            break
        if (m := _HEADER.match(line)) and m[1] and m[1].startswith("§"):
            out.append((m[1], []))
        elif out:
            out[-1][1].append(line)
    return [(label, "\n".join(body).strip("\n")) for label, body in out]


def _leaf(text: str, quotes: list[str], context: L.Locator, origin: Origin) -> Command:
    found = recognise_masked(text, quotes, context)
    return (found or Command("unknown", context, text=restore_quotes(text, quotes))).with_origin(origin)


_VERB_FRAME = re.compile(r"^(?:Es |Im Übrigen )?(wird|werden) (?:jeweils )?(ersetzt|gestrichen|aufgehoben|eingefügt|angefügt)\s*:$")


def _completed(text: str, be: str, verb: str) -> str:
    """A point under "Es werden ersetzt:" names only the place and the objects."""
    text = re.sub(r"(?:[,;.]| und| sowie)+$", "", text).strip()
    m = re.match(r"^[Ii]n (.+?) ((?:jeweils )?(?:die |das |der |den |dem |nach |vor |hinter ).*)$", text)
    if m:
        return f"In {m[1]} {be} {m[2]} {verb}."
    return f"{text[:1].upper()}{text[1:]} {be} {verb}."


def _walk(point: Point, quotes: list[str], context: L.Locator, article: str) -> list[Command]:
    text = re.sub(r"\s+", " ", point.text).strip()
    if point.children and (m := _VERB_FRAME.match(text)):
        for child in point.children:
            if not child.children:
                child.wording = re.sub(r"\s+", " ", child.text).strip()
                child.text = _completed(child.wording, m[1], m[2])
        return [c for p in point.children for c in _walk(p, quotes, context, article)]
    origin = Origin(article, " ".join(point.path), restore_quotes(point.wording or text, quotes))
    if not point.children:
        return [_leaf(text, quotes, context, origin)]
    out: list[Command] = []
    inner = frame(re.sub(r"wie folgt gefasst:?$", "wie folgt geändert:", text))
    if inner is None:
        # "… wird Absatz 3 und wie folgt geändert:" is a command and a frame.
        if m := re.match(r"^(.+?) (?:und|sowie) (?:wird )?wie folgt geändert:?$", text):
            command = recognise_masked(m[1], quotes, context)
            if command is not None:
                out.append(command.with_origin(origin))
                last = command.parts[-1] if command.kind == "compound" else command
                inner_context = last.to if last.kind == "renumber" else last.at
                return out + [c for p in point.children for c in _walk(p, quotes, inner_context, article)]
        if m := re.match(r"^(?:In|Im) (.+?)(?: (?:wird|werden))?:?$", text):
            found = L.parse_many(m[1])
            inner = found[0] if len(found) == 1 else None
        if inner is None:
            return [Command("unknown", context, text=restore_quotes(text, quotes), origin=origin)] + [c for p in point.children for c in _walk(p, quotes, context, article)]
    context = L.within(context, inner)
    return [c for p in point.children for c in _walk(p, quotes, context, article)]


def _embedded_target(preamble: str) -> L.Locator:
    """"§ 2 Satz 1 des Gesetzes … wird wie folgt geändert" sets the place of all points; a citation in the middle of a sentence does not."""
    before = ""
    for line in preamble.split("\n"):
        m = re.match(r"\s*((?:§|Art\.) ?\d+[a-z]?(?: (?:Abs(?:atz|\.)|Satz|Nummer|Nr\.|Halbsatz) \w+)*) (?:des|der)\b", line)
        if m and not re.search(r"(?:,|durch|nach|von|und|gemäß|mit)\s*$", before):
            return L.parse(m[1]) or ()
        if line.strip():
            before = line
    return ()


def _last_cited(preamble: str):
    """The date of the version that a preamble says it amends."""
    dates = [d for m in re.finditer(r"vom (\d{1,2}\. \w+ \d{4})", preamble) if (d := german_date(m[1]))]
    return max(dates, default=None)


def compile_act(text: str, law: Law, only_article: str | None = None) -> Compiled:
    """The commands of the articles that amend the law, in document order.

    Every leaf of the outline gives one command, if only an unknown one; nothing is dropped.
    """
    out = Compiled()
    text, out.warnings = normal_quotes(text)
    quoted = extract_quotes(text)
    out.warnings += quoted.warnings
    articles = split_articles(quoted.text)
    if not only_article and not any(concerns(scan_outline(body)[0], law) for _, body in articles):
        # No article concerns the law, but a § of the act may.
        sections = split_sections(quoted.text)
        if any(concerns(scan_outline(body)[0], law) for _, body in sections):
            articles = sections
    last = -1
    for k, (label, body) in enumerate(articles):
        if only_article and label not in (f"Artikel {only_article}", f"§ {only_article}", only_article):
            continue
        preamble, points = scan_outline(body)
        if not only_article and not concerns(preamble, law) or only_article and not _AMENDS.search(preamble) and not points and not concerns(body, law):
            continue
        last = k
        out.articles.append(label)
        m = _AMENDS.search(re.sub(r"\s+", " ", preamble))
        cited = _last_cited(preamble)
        stand = german_date(law.stand or "")
        newest = max(filter(None, [stand, *(german_date(x.date or "") for x in law.marks)]), default=None)
        if cited and newest and newest > cited:
            out.warnings.append(f"Das Stammgesetz hat den Stand {newest}, {label} ändert die Fassung vom {cited}.")
        flat = re.sub(r"\s+", " ", preamble).strip()
        context = _embedded_target(preamble)
        if points and m and (inner := frame(flat[m.end() :].strip())) is not None:
            context = L.within(context, inner)  # "…: Art. 28 Abs. 1 wird wie folgt geändert:"
        if not points and m:
            rest = flat[m.end() :].strip()
            if rest:
                out.commands.append(_leaf(rest, quoted.quotes, context, Origin(label, "", restore_quotes(rest, quoted.quotes))))
        for point in points:
            out.commands += _walk(point, quoted.quotes, context, label)
    for _, body in articles[last + 1 :]:
        if not _AMENDS.search(body) and (rules := read_rules(restore_quotes(body, quoted.quotes))):
            out.rules = rules
            break
    return out
