"""Labels of units: their natural order, successors and ranges."""

from __future__ import annotations

import re

ROMAN = [(1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")]


def to_roman(n: int) -> str:
    out = ""
    for value, sign in ROMAN:
        while n >= value:
            out, n = out + sign, n - value
    return out


def from_roman(text: str) -> int | None:
    """The number, if the text is written the way that it would be."""
    n, rest = 0, text.lower()
    for value, sign in ROMAN:
        while rest.startswith(sign):
            n, rest = n + value, rest[len(sign) :]
    return n if n and to_roman(n) == text.lower() else None


def natural(label: str) -> tuple:
    """A key by which 9, 10, 10a, 10b and 11 sort as read; runs of digits count as numbers."""
    return tuple((0, int(x), "") if x.isdigit() else (1, 0, x) for x in re.findall(r"\d+|\D+", label))


def _letters_after(label: str) -> str:
    """b after a, aa after z is not a letter label: ab follows aa only as a doubled letter."""
    if len(set(label)) == 1 and label[0] != "z":
        return chr(ord(label[0]) + 1) * len(label)
    return ""


def successors(label: str) -> set[str]:
    """Labels that may come next in an outline: 2 to 3 or 2a, 2a to 2b or 3, a to b or a1, aa to bb, i to ii, 6.1 to 6.2."""
    out: set[str] = set()
    if m := re.fullmatch(r"(\d+)([a-z]?)", label):
        number, letter = int(m[1]), m[2]
        out |= {str(number + 1), f"{number}{chr(ord(letter) + 1) if letter else 'a'}"}
    elif m := re.fullmatch(r"((?:\d+\.)+)(\d+)", label):
        out.add(f"{m[1]}{int(m[2]) + 1}")
    elif m := re.fullmatch(r"([a-z])(\d+)", label):
        out |= {f"{m[1]}{int(m[2]) + 1}", _letters_after(m[1])}
    elif re.fullmatch(r"[a-z]+", label):
        out.add(_letters_after(label))
        if len(label) == 1:
            out.add(f"{label}1")
        if (n := from_roman(label)) is not None:
            out.add(to_roman(n + 1))
    return out - {""}


def is_successor(before: str, label: str) -> bool:
    return label in successors(before)


def predecessor(label: str) -> str | None:
    """The label that stands before in an unbroken row: 3 before 4, 3 before 3a, 3a before 3b, b before c."""
    if m := re.fullmatch(r"(\d+)([a-z]?)", label):
        number, letter = int(m[1]), m[2]
        if letter == "a":
            return m[1]
        if letter:
            return f"{number}{chr(ord(letter) - 1)}"
        return str(number - 1) if number > 1 else None
    if re.fullmatch(r"([b-z])\1*", label):
        return chr(ord(label[0]) - 1) * len(label)
    return None


def expand(low: str, high: str) -> list[str] | None:
    """The labels of a range of numbers (of at most six digits) or of single letters; others cannot be told."""
    if low.isdigit() and high.isdigit() and int(low) <= int(high) < 10**6:
        return [str(n) for n in range(int(low), int(high) + 1)]
    if re.fullmatch("[a-z]", low) and re.fullmatch("[a-z]", high) and low <= high:
        return [chr(c) for c in range(ord(low), ord(high) + 1)]
    if (m := re.fullmatch(r"(\d+)([a-z])", low)) and (k := re.fullmatch(r"(\d+)([a-z])", high)) and m[1] == k[1] and m[2] <= k[2]:
        return [m[1] + chr(c) for c in range(ord(m[2]), ord(k[2]) + 1)]
    return None
