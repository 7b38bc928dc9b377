"""The order of application.

A step frees labels (what it renumbers away or repeals) and occupies labels (what it renumbers to or
inserts).  Before a step runs, every step that frees a label which it occupies; otherwise steps keep
document order, and a cycle is left in document order.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from lexloom.functions import locator as L
from lexloom.functions.labels import natural
from lexloom.plans.model import Command


@dataclass
class Step:
    command_no: int
    part_no: int
    command: Command
    fallback: Command | None = None


_WORDS = ("replace", "strike", "insert_words")
_QUOTED = {L.PARA: r"(?:^|(?<=\s))\((\d+[a-z]?)\)\s", L.NUMBER: r"^\s*(\d+[a-z]?)\. ", L.LETTER: r"^\s*([a-z]{1,3})\) ", L.NORM: r"(?:^|(?<=[.“] ))(?:§|Art\.) (\d+[a-z]{0,2})\s"}


def frees(c: Command) -> set[str]:
    return {L.show(c.at)} if c.kind in ("renumber", "repeal") else set()


def _new_labels(c: Command) -> list[str]:
    if c.label:
        return [c.label]
    pattern = _QUOTED.get(c.level)
    return re.findall(pattern, c.text, re.M) if pattern else []


def _sibling(at: L.Locator, level: str, label: str, append: bool) -> str:
    head = at if append else at[:-1]
    if level == L.NORM:
        norm = L.get(at, L.NORM)
        return f"{norm.sign or '§' if norm else '§'} {label}"
    return L.show((*head, L.Part(level, label)))


def _upward(c: Command) -> bool:
    return c.kind == "renumber" and natural(c.to[-1].value) > natural(c.at[-1].value)


def occupies(c: Command, freed_upwards: set[str]) -> set[str]:
    if c.kind == "renumber":
        return {L.show(c.to)}
    if c.kind in ("insert_unit", "append", "prepend") and c.level in _QUOTED:
        out = {_sibling(c.at, c.level, x, c.kind != "insert_unit" or bool(c.anchor)) for x in _new_labels(c)}
        return out - {L.show(c.at)}
    if c.kind == "replace_units":
        return {_sibling(c.at, c.level, x, False) for x in _new_labels(c)} - {L.show(c.at)}
    if c.kind == "redraft":
        return {L.show(c.at)} & freed_upwards
    return set()


def steps_of(commands: list[Command]) -> list[Step]:
    out = []
    for k, c in enumerate(commands):
        parts = _flat(c)
        moved: Command | None = None
        for n, p in enumerate(parts):
            fallback = None
            if moved is not None and p.kind in _WORDS and p.at[: len(moved.at)] != moved.to:
                rest = p.at[len(moved.at) :] if p.at[: len(moved.at)] == moved.at else ()
                fallback = Command(p.kind, (*moved.to, *rest), p.old, p.new, p.each, p.at_end, anchor=p.anchor, text=p.text, origin=p.origin)
            out.append(Step(k, n, p, fallback))
            if p.kind == "renumber":
                moved = p
    return out


def _last(step: Step) -> bool:
    """A reference to what other commands did comes after them."""
    return step.command.kind == "refer"


def _flat(c: Command) -> list[Command]:
    return [x for p in c.parts for x in _flat(p)] if c.kind == "compound" else [c]


def steps_in_order(commands: list[Command]) -> list[Step]:
    steps = steps_of(commands)
    freed = [frees(s.command) for s in steps]
    upwards = {L.show(s.command.at) for s in steps if _upward(s.command)}
    held = [occupies(s.command, upwards) for s in steps]
    by_label: dict[str, list[int]] = {}
    for k, labels in enumerate(freed):
        for x in labels:
            by_label.setdefault(x, []).append(k)
    seen, out = set(), []
    for first in range(len(steps)):
        stack = [(first, False)]
        while stack:
            k, ready = stack.pop()
            if ready:
                out.append(steps[k])
                continue
            if k in seen:
                continue
            seen.add(k)
            stack.append((k, True))
            stack += [(j, False) for j in sorted({j for x in held[k] for j in by_label.get(x, ())}, reverse=True) if j not in seen]
    return sorted(out, key=_last)
