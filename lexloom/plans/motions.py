"""Motions that amend a draft: their commands are applied to the draft's text, not to the law."""

from __future__ import annotations

import re

from lexloom.functions import locator as L
from lexloom.functions.sentences import half_sentence_span, sentence_span
from lexloom.plans.apply import occurrences, quote_paragraphs, replaced
from lexloom.plans.documents import Document
from lexloom.plans.model import MANUAL, Command, Entry, Failure, Origin, item_mark, mark_depth
from lexloom.plans.outline import extract_quotes, normal_quotes, restore_quotes, scan_outline
from lexloom.plans.recognise import recognise_masked

_START = re.compile(r"wolle?n? (?:\w+ ){0,4}beschließen\s*:?")
_END = re.compile(r"^\s*Begründung\s*:?", re.M)


def _ellipsis(text: str) -> str:
    """"…: „A“ statt „B““ and missing verbs, completed."""
    m = re.fullmatch(r"(In .+?) statt («\d+») (?:muss es heißen|:)? ?(«\d+»)\.?", text)
    if m:
        return f"{m[1]} werden die Wörter {m[2]} durch die Wörter {m[3]} ersetzt."
    return text


def read_motion(text: str) -> list[tuple[str, str, Command]]:
    """(article, outline path in the draft, command) of each point between the formula and the reasoning."""
    text, _ = normal_quotes(text)
    start = _START.search(text)
    body = text[start.end() if start else 0 :]
    end = _END.search(body)
    quoted = extract_quotes(body[: end.start()] if end else body)
    head, points = scan_outline(quoted.text)
    out = []

    def walk(texts: list[str], article: str, path: str, context: L.Locator, place: str) -> None:
        for x in texts:
            out.append(read(x, article, path, context, place))

    def read(x: str, article: str, path: str, context: L.Locator, place: str):
        flat = _ellipsis(re.sub(r"\s+", " ", x).strip())
        article, path, flat = _target(flat, article, path)
        found = recognise_masked(flat, quoted.quotes, context)
        origin = Origin("Änderungsantrag", place, restore_quotes(x.strip(), quoted.quotes))
        return article, path, (found or Command("unknown", text=restore_quotes(x, quoted.quotes))).with_origin(origin)

    def deep(point, article: str, path: str) -> None:
        flat = re.sub(r"\s+", " ", point.text).strip()
        a, p, rest = _target(flat, article, path)
        if point.children:
            for child in point.children:
                deep(child, a, p)
        else:
            walk([point.text], article, path, (), " ".join(point.path))

    if points:
        a, p, _ = _target(re.sub(r"\s+", " ", head).strip(), "Artikel 1", "")
        for point in points:
            deep(point, a, p)
    elif head.strip():
        walk([head.strip()], "Artikel 1", "", (), "")
    return out


def _target(text: str, article: str, path: str) -> tuple[str, str, str]:
    """"In Artikel 1 Nummer 3 Buchstabe a …" names a point of the draft; the rest is a command on its text."""
    m = re.match(r"(?P<i>In |Dem |Nach )?(?P<a>(?:Artikel|Art\.|§) \d+[a-z]?)? ?(?P<n>(?:Nummer|Nr\.) \d+[a-z]?(?: Buchst(?:abe|\.) [a-z])?(?: Doppelbuchst(?:abe|\.) [a-z]{2})?)(?P<c>,? )?", text)
    if not m or not m["n"]:
        m2 = re.match(r"(?:In )?((?:Artikel|Art\.) \d+[a-z]?) (.*)", text)
        return (m2[1].replace("Art. ", "Artikel "), path, "In " + m2[2]) if m2 else (article, path, text)
    rest = text[m.end() :].strip()
    own = (m["a"] or article).replace("Art. ", "Artikel ")
    new = L.point_path(m["n"])
    if inner := re.match(r"(wird|werden) (?:in|im) (.+?) ((?:jeweils )?(?:die|das|der|den|nach|vor) .*)", rest):
        rest = f"In {inner[2]} {inner[1]} {inner[3]}"  # the place in the quoted norm
    elif re.match(r"(?:wird|werden|erhält) ", rest):
        rest = f"In § 0 {rest}" if m["i"] == "In " else f"§ 0 {rest}"  # the point itself
    elif rest and m["i"] == "In ":
        rest = f"In {rest}"
    return own, new, rest


def _masked(text: str) -> str:
    """Quotes as blanks of equal length, so that places stay."""
    out, depth = [], 0
    for ch in text:
        depth += ch == "„"
        out.append(ch if depth == 0 else " ")
        depth -= ch == "“" and depth > 0
    return "".join(out)


def point_span(draft: str, article: str, path: str) -> tuple[int, int] | None:
    """The lines of a point of the draft, up to the next mark of its level or above."""
    masked = _masked(draft)
    m = re.search(rf"^[ \t]*{re.escape(article)}\b", masked, re.M)
    if not m:
        return None
    end = re.search(r"^[ \t]*Artikel \d+", masked[m.end() :], re.M)  # blanks of a masked quote are no part of the line
    low, high = m.end(), m.end() + end.start() if end else len(draft)
    order = [r"\d+[a-z]?\.", r"[a-z]\)", r"([a-z])\1\)"]
    for depth, mark in enumerate(path.split()):
        found = re.search(rf"(?:^|(?<=\s)){re.escape(mark)}\s", masked[low:high], re.M)
        if not found:
            return None
        start = low + found.start()
        stop = re.search("|".join(rf"^[ \t]*{x}\s" for x in order[: depth + 1]), masked[start + len(mark) : high], re.M)
        low, high = start, (start + len(mark) + stop.start() if stop else high)
    return low, high


def _item_span(text: str, label: str, low: int, high: int) -> tuple[int, int] | None:
    """The item with that label: from its mark to the next mark of its level or above, paragraph or norm."""
    start, depth, at = None, 0, low
    for line in text[low:high].splitlines(keepends=True):
        mark = item_mark(line)
        if start is None:
            if mark and mark.rstrip(".)") == label:
                start, depth = at + len(line) - len(line.lstrip()), mark_depth(mark)
        elif mark and mark_depth(mark) <= depth or re.match(r"\s*(?:\(\d+[a-z]?\)|§ ?\d|Art\. ?\d)", line):
            return start, at
        at += len(line)
    return None if start is None else (start, high)


def _place(inner: str, at: L.Locator) -> tuple[int, int]:
    """The part of a quote that a locator names; raises Failure where it names none."""
    low, high = 0, len(inner)
    for part in at:
        found = None
        if part.kind == L.NORM:
            heads = [m.start() for m in re.finditer(r"(?:^|\n)\s*(?:§|Art\.) \d+[a-z]?\b", inner)] + [len(inner)]
            own = [k for k in range(len(heads) - 1) if re.match(rf"\s*{re.escape(str(part))}\b", inner[heads[k] :])]
            # A quote that shows one norm, or none, is the norm as a whole.
            found = (heads[own[0]], heads[own[0] + 1]) if own else (low, high) if part.value == "0" or len(heads) <= 2 else None
        elif part.kind == L.PARA:
            if m := re.search(rf"\({part.value}\) (?:.(?!\(\d+[a-z]?\) ))*.", inner[low:high], re.S):
                found = low + m.start(), low + m.end()
        elif part.kind in (L.NUMBER, L.LETTER):
            found = _item_span(inner, part.value, low, high)
        elif part.kind in (L.SENTENCE, L.HALF):
            if span := (sentence_span if part.kind == L.SENTENCE else half_sentence_span)(inner[low:high], part.value):
                found = low + span[0], low + span[1]
        if found is None:
            raise Failure("PLACE_NOT_FOUND", f"{part} ist im Zitat nicht auffindbar.")
        low, high = found
    return low, high


def apply_to_draft(draft: str, article: str, path: str, c: Command) -> str:
    """The draft with one command applied to the quote of a point; raises Failure."""
    span = point_span(draft, article, path)
    if span is None:
        raise Failure("PLACE_NOT_FOUND", f"{article} {path} ist im Entwurf nicht auffindbar.")
    body = draft[span[0] : span[1]]
    if c.kind == "repeal" and (not c.at or L.show(c.at) == "§ 0"):
        return draft[: span[0]] + draft[span[1] :]
    if c.kind == "redraft" and (not c.at or L.show(c.at) == "§ 0"):
        mark = path.split()[-1] if path else ""
        return draft[: span[0]] + f"{mark} {re.sub(rf'^{re.escape(mark)}\\s+', '', c.text.strip())}\n" + draft[span[1] :]
    quote = re.search(r"„(.*)“", body, re.S)
    if not quote:
        raise Failure("BAD_QUOTE", f"{article} {path} enthält kein Zitat.")
    a, b = quote.span(1)
    inner = body[a:b]
    low, high = _place(inner, c.at)
    text = inner[low:high]
    if c.kind == "replace":
        # Laxer than on a law: without "jeweils" the first occurrence is meant.
        places = occurrences(text, c.old)
        if not places:
            raise Failure("TARGET_MISSING", f"„{c.old}“ kommt im Entwurf nicht vor.")
        if c.at_end:
            new = replaced(text.rstrip(), c.old, c.new, at_end=True) + text[len(text.rstrip()) :]
        else:
            new = replaced(text, c.old, c.new, True) if c.each else text[: places[0]] + c.new + text[places[0] + len(c.old) :]
    elif c.kind == "strike":
        if not occurrences(text, c.old):
            raise Failure("TARGET_MISSING", f"„{c.old}“ kommt im Entwurf nicht vor.")
        new = replaced(text, c.old, "", True)  # the seams heal, indentation stays
    elif c.kind == "redraft":
        new = c.text.strip()
        if high - low < len(inner) and c.at and c.at[-1].kind == L.PARA and not quote_paragraphs(new)[0].number:
            new = f"({c.at[-1].value}) {new}"
    elif c.kind == "repeal":
        new = ""
    else:
        raise Failure("UNSUPPORTED", "Diese Änderung eines Entwurfs wird nicht unterstützt.")
    return draft[: span[0]] + body[:a] + inner[:low] + new + inner[high:] + body[b:] + draft[span[1] :]


def apply_motion(draft: str, motion: str) -> tuple[str, list[Entry]]:
    """The draft as the motion leaves it, and a protocol; a command of several parts is done as a whole or not at all."""
    entries = []
    for article, path, command in read_motion(motion):
        parts = command.parts if command.kind == "compound" else (command,)
        try:
            new = draft
            for p in parts:
                if p.kind == "unknown":
                    raise Failure("NOT_RECOGNISED", "Der Befehl wurde nicht erkannt.")
                new = apply_to_draft(new, article, path, p)
            draft = new
            entries.append(Entry(command, "APPLIED", "", (f"{article} {path}".strip(),)))
        except Failure as x:
            entries.append(Entry(command, MANUAL, x.prose, (), x.reason))
    return draft, entries


def draft_for(motion: Document, k: int, documents: list[tuple[int, Document]]) -> int | None:
    """Which draft a motion amends: the one whose number it cites, else the last one before it, by original places."""
    drafts = [(j, d) for j, d in documents if d.is_draft]
    for j, d in drafts:
        if d.own_number and d.own_number in motion.refers_to:
            return j
    before = [j for j, _ in drafts if j < k]
    return before[-1] if before else None
