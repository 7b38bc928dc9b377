"""Passages that repeat across documents, by MinHash banding over paragraphs cut by content.

A paragraph begins where a document's words have the least hash within ``REACH`` words either way, a
sentence's or line's first word going before all others.  That looks at the words around only, so a passage
is cut alike wherever it is pasted, and every word lies in one paragraph.  Paragraphs get MinHash
signatures over word shingles, in as few bands as the wanted recall at the threshold needs
(``tuned``).  Those that collide in a band are verified by exact Jaccard similarity of their shingles; links
form components, and of each component only the first place stays.

The ends of a passage lie inside paragraphs that differ.  Neighbouring repeated paragraphs
are a run, and a run is extended word by word both ways, as far as the words are those next to its outer paragraph's first or last
place.  Runs at most ``GAP`` words apart are one passage, and a passage counts if ``RUN`` of its words repeat.

A band's key is aggregated before the shuffle to its least and greatest text, so texts
that collide with nothing cost one small row for each band.  Within a band, visits emit tree
edges only; a large one is dealt out as pairs of blocks.  Extension compares with two places of a class, never with all.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.common import Workspace, partitions
from lexloom.llm.components import connected_components

WIDTH, SIMILAR = 5, 0.8
#: Words within which a paragraph's first has the least hash, and words after which a paragraph is cut anyway.
REACH, MOST = 6, 64
#: Repeated words that make a passage, words between two of its parts, and words a run is extended by.
RUN, GAP, CONTEXT = 50, 5, 32
#: Recall at the threshold that bands are tuned for, and hashes in a band.
RECALL, ROWS = 0.99, 2
#: Shingles of a paragraph up to which its bands are tuned by their number.
SMALL = 8
#: Paragraphs of a band that are compared together.
BLOCK = 512
_MARKS = ".!?\n"
_TOP = np.uint64(2**64 - 1)


def tuned(similar: float = SIMILAR, rows: int = ROWS, recall: float = RECALL) -> int:
    """The fewest bands of so many rows in which texts at the threshold collide with that probability."""
    bands = 1
    while 1 - (1 - similar**rows) ** bands < recall:
        bands += 1
    return bands


def tuned_for(size: int, similar: float = SIMILAR, rows: int = ROWS, recall: float = RECALL) -> int:
    """The bands that a set of so many shingles needs: small sets are similar to few others, and more than at the threshold.

    Of two sets of n and m shingles that differ and share k, the similarity is k / (n + m - k).  The least such value that reaches
    the threshold decides; sets that no different one is similar to need one band, for their equals.
    """
    found = [
        k / (size + other - k)
        for other in range(int(size * similar), int(size / similar) + 2)
        for k in range(max(1, int(size * similar)), min(size, other) + 1)
        if similar - 1e-9 <= k / (size + other - k) < 1
    ]
    return max(tuned(x, rows, recall) for x in found) if found else 1


def _mixed(x: np.ndarray, k: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point whether it is of a word, as for the pattern \\w, or a mark that ends sentences or lines (2); and a number for word hashes."""
    kinds = np.fromiter(map(str.isalnum, map(chr, range(0x110000))), np.uint8, 0x110000)
    kinds[ord("_")] = 1
    kinds[[ord(x) for x in _MARKS]] = 2
    return kinds, _mixed(np.arange(0x110000, dtype=np.uint64), 33)


class _Stream(NamedTuple):
    """Small-letter texts as one stream of words: 64-bit hashes, and where words begin and end in the stream of code points."""

    hashes: np.ndarray
    low: np.ndarray
    high: np.ndarray
    begins: np.ndarray  # the first word of each text, and the number of words
    at: np.ndarray  # the first code point of each text, and one behind the last
    marks: np.ndarray  # the code points that end sentences or lines


def _stream(texts: list[str]) -> _Stream:
    """A word's hash is the sum of its letters' numbers, each multiplied by one for its place in the word."""
    kinds, numbers = _letters()
    codes = np.frombuffer("\n".join(["", *texts, ""]).encode("utf-32-le"), np.uint32)
    at = np.cumsum([1, *(len(x) + 1 for x in texts)])
    kinds = kinds[codes]
    inside = kinds == 1
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    low, high = edges[::2], edges[1::2]
    sizes = high - low
    first = np.cumsum(sizes) - sizes
    places = _mixed(np.arange(sizes.max(initial=0), dtype=np.uint64), 34) | np.uint64(1)
    with np.errstate(over="ignore"):
        parts = numbers[codes[inside]] * places[np.arange(sizes.sum()) - np.repeat(first, sizes)]
        hashes = _mixed(np.add.reduceat(parts, first) if len(first) else parts, 35)
    return _Stream(hashes, low, high, np.searchsorted(low, at), at, np.flatnonzero(kinds == 2))


class _Words(NamedTuple):
    """Texts as one stream of words: short hashes, and where each word begins and ends, as code points of its text."""

    hashes: np.ndarray
    low: np.ndarray
    high: np.ndarray
    begins: np.ndarray  # the first word of each text, and the number of words


def spans_of(texts: list[str]) -> _Words:
    lower = [x.lower() for x in texts]
    w = _stream(lower)
    base = np.repeat(w.at[:-1], np.diff(w.begins))
    low, high = (w.low - base).astype(np.int32), (w.high - base).astype(np.int32)
    for k in [k for k, x in enumerate(lower) if len(x) != len(texts[k])]:  # code points whose small letters are more than one
        of = np.repeat(np.arange(len(texts[k])), [len(c.lower()) for c in texts[k]])
        own = slice(w.begins[k], w.begins[k + 1])
        low[own], high[own] = of[low[own]], of[high[own] - 1] + 1
    return _Words((w.hashes >> np.uint64(32)).astype(np.uint32).view(np.int32), low, high, w.begins)


def _shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of so many words."""
    n = max(0, len(hashes) - width + 1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = out * np.uint64(0x100000001B3) + (hashes[k : k + n] ^ (hashes[k : k + n] >> np.uint64(29)))
    return _mixed(out, 0)


class _Cut(NamedTuple):
    """Texts as one stream of word hashes, and its paragraphs of at least WIDTH words."""

    hashes: np.ndarray
    begins: np.ndarray  # the first word of each text
    first: np.ndarray  # of each paragraph: its first word, words, and text
    size: np.ndarray
    owner: np.ndarray


def _starts_less(rank: np.ndarray, owner: np.ndarray, reach: int) -> np.ndarray:
    """Whether each rank is the least within reach in its text, the first of equals going before the others."""
    at = np.arange(len(rank)) + (owner + 1) * reach
    padded = np.full(len(rank) + (int(owner[-1]) + 2) * reach if len(rank) else reach, _TOP)
    padded[at] = rank
    low = padded.copy()  # the least of the reach ranks from each on
    held = 1
    while held < reach:
        step = min(held, reach - held)
        low[: len(low) - step] = np.minimum(low[: len(low) - step], low[step:])
        held += step
    return (rank < low[at - reach]) & (rank <= low[at + 1])


def cut(texts: list[str], reach: int = REACH, most: int = MOST) -> _Cut:
    """Cuts texts to paragraphs."""
    w = _stream([x.lower() for x in texts])
    hashes, owner = w.hashes, np.repeat(np.arange(len(texts)), np.diff(w.begins))
    opens = np.diff(np.searchsorted(w.marks, w.low), prepend=0) > 0
    n = len(hashes)
    new = np.ones(n, bool)
    new[1:] = owner[1:] != owner[:-1]
    following = np.zeros(n, np.uint64)
    following[:-1] = np.where(new[1:], np.uint64(0), hashes[1:])
    with np.errstate(over="ignore"):
        rank = _mixed(hashes * np.uint64(3) + (following ^ (following >> np.uint64(29))), 77) >> np.uint64(1)
    rank |= np.where(opens | new, np.uint64(0), np.uint64(1 << 63))
    begin = new | _starts_less(rank, owner, reach)
    if n:
        since = np.arange(n) - np.maximum.accumulate(np.where(begin, np.arange(n), 0))
        begin |= since % most == 0
    first = np.flatnonzero(begin)
    size = np.diff(np.append(first, n))
    long = size >= WIDTH
    return _Cut(hashes, w.begins[:-1], first[long], size[long], owner[first[long]])


def _names(c: _Cut) -> np.ndarray:
    """A hash of each paragraph's words."""
    if not len(c.first):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        x = _mixed(c.hashes ^ ((_places(c).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)), 55)
        ends = np.stack([c.first, c.first + c.size], 1).ravel()
        total = np.add.reduceat(np.append(x, np.uint64(0)), ends)[::2]
        return _mixed(total ^ c.size.astype(np.uint64), 56)


def _places(c: _Cut) -> np.ndarray:
    """Each word's number in its paragraph; of words in none, any."""
    last = np.zeros(len(c.hashes), np.int64)
    last[c.first] = c.first
    return np.arange(len(c.hashes)) - np.maximum.accumulate(last)


def _sizes(c: _Cut, shingles: np.ndarray) -> np.ndarray:
    """How many distinct shingles each paragraph has, up to SMALL; SMALL + 1 for more, and for those that repeat one."""
    n = c.size - WIDTH + 1
    repeats = np.zeros(len(shingles) + 1, np.int64)
    for back in range(1, SMALL):
        again = np.flatnonzero(shingles[back:] == shingles[:-back]) + back
        if len(again):
            repeats[again] |= np.searchsorted(c.first, again, "right") == np.searchsorted(c.first, again - back, "right")
    many = np.add.reduceat(repeats, np.stack([c.first, c.first + n], 1).ravel())[::2] > 0
    return np.where((n > SMALL) | many, SMALL + 1, n)


def _keys(c: _Cut, needed: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """How many band keys each paragraph has, and the keys laid end to end; needed are the bands for each number of shingles."""
    bands = int(needed.max())
    keys = np.zeros((len(c.first), bands), np.uint64)
    counts = np.zeros(0, np.int64)
    if len(c.first):
        shingles = _shingles(c.hashes, WIDTH)
        counts = needed[_sizes(c, shingles)]
        shingles = np.append(shingles, np.uint64(0))
        ends = np.stack([c.first, c.first + c.size - WIDTH + 1], 1).ravel()
        with np.errstate(over="ignore"):
            for band in range(bands):
                for row in range(rows):
                    k = 2 * (band * rows + row) + 1
                    spread = shingles * np.uint64(k * 0x9E3779B97F4A7C15 % 2**64 | 1) ^ (shingles >> np.uint64(23 + k % 16))
                    least = np.minimum.reduceat(spread * np.uint64(0xD6E8FEB86659FD93), ends)[::2]
                    keys[:, band] = _mixed(keys[:, band] ^ least, 1000 + band)
    return counts, keys[np.arange(bands) < counts[:, None]]


def _lists(sizes: np.ndarray, flat: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), flat)


def _slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _units(needed: np.ndarray, rows: int):
    """Rows (doc_id, tid, text) to a row for each paragraph, with its words' hash and band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 512):
            c = cut([t or "" for t in batch.column(2).to_pylist()])
            of = pa.array(c.owner)
            word = (c.first - c.begins[c.owner]).astype(np.int32)
            counts, keys = _keys(c, needed, rows)
            keys = _lists(counts, pa.array(keys.view(np.int64)))
            yield pa.record_batch(
                [batch.column(0).take(of), batch.column(1).take(of), pa.array(word), pa.array(c.size.astype(np.int32)), pa.array(_names(c).view(np.int64)), keys],
                names=["doc_id", "tid", "word", "words", "h", "bands"],
            )

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, paragraphs (word, words, h)) to (h, sorted distinct shingle hashes)."""
    for batch in _slices(batches, 256):
        w = _stream([(t or "").lower() for t in batch.column(0).to_pylist()])
        wanted = batch.column(1)
        flat = wanted.values.slice(wanted.offsets[0].as_py(), wanted.offsets[-1].as_py() - wanted.offsets[0].as_py())
        first = flat.field("word").to_numpy() + np.repeat(w.begins[:-1], np.diff(wanted.offsets.to_numpy()))
        shingles = _shingles(w.hashes, WIDTH)
        sets = [np.unique(shingles[a : a + n - WIDTH + 1]).tobytes() for a, n in zip(first.tolist(), flat.field("words").to_pylist(), strict=True)]
        yield pa.record_batch([flat.field("h"), pa.array(sets, pa.binary())], names=["h", "shingles"])


def _alike(own: np.ndarray, sizes: np.ndarray, owners: np.ndarray, values: np.ndarray, similar: float) -> np.ndarray:
    """Positions whose set has Jaccard similarity of at least ``similar`` with own."""
    shared = np.bincount(owners[np.isin(values, own)], minlength=len(sizes))
    return np.flatnonzero(shared >= similar * (len(own) + sizes - shared) - 1e-9)


def _tree_edges(members: dict[int, np.ndarray], similar: float) -> Iterator[tuple[int, int]]:
    """Edges that connect whatever similar pairs connect; each member is visited once."""
    if len(members) <= 8:
        sets = [(h, set(x.tolist())) for h, x in members.items()]
        for k, (g, x) in enumerate(sets):
            for h, y in sets[k + 1 :]:
                shared = len(x & y)
                if shared >= similar * (len(x) + len(y) - shared) - 1e-9:
                    yield g, h
        return
    rest = list(members)
    while rest:
        queue, rest = [rest[0]], rest[1:]
        while queue and rest:
            own = queue.pop()
            sizes = np.array([len(members[h]) for h in rest])
            found = _alike(members[own], sizes, np.repeat(np.arange(len(rest)), sizes), np.concatenate([members[h] for h in rest]), similar)
            if len(found):
                taken = {rest[k] for k in found.tolist()}
                yield from ((own, h) for h in taken)
                queue.extend(taken)
                rest = [h for h in rest if h not in taken]


def _verified(similar: float):
    """Rows sorted by (band key, x, y), each group held alone, to edges between texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, out = None, {}, []
        for batch in batches:
            for key, x, y, h, shingles in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, x, y) != last:
                    out.extend(_tree_edges(held, similar))
                    last, held = (key, x, y), {}
                held[h] = np.frombuffer(shingles, np.uint64)
            if len(out) > 50_000:
                yield _edges(out)
                out = []
        out.extend(_tree_edges(held, similar))
        yield _edges(out)

    return run


def _edges(pairs: list) -> pa.RecordBatch:
    a = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.record_batch([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["a", "b"])


#: What a document tells of its repeated paragraphs: their code points (side 0); and for the paragraph at a word the words
#: before it (side 1) or behind it (side 2), going away from it, with the code points where each begins or ends.
_TOLD = "doc_id {}, tid long, side int, word int, class_id long, ref boolean, hashes array<int>, chars array<int>"


def _flat(column: pa.ListArray) -> tuple[pa.StructArray, np.ndarray]:
    """The structs of a list column laid end to end, and each one's row."""
    bounds = column.offsets.to_numpy()
    return column.values.slice(bounds[0], bounds[-1] - bounds[0]), np.repeat(np.arange(len(column)), np.diff(bounds))


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, tid, text, paragraphs (word, words), edges (word, words, class_id, side, ref)) to rows of _TOLD."""
    names = ["doc_id", "tid", "side", "word", "class_id", "ref", "hashes", "chars"]
    for batch in _slices(batches, 256):
        w = spans_of([t or "" for t in batch.column(2).to_pylist()])
        units, of = _flat(batch.column(3))
        first = units.field("word").to_numpy() + w.begins[of]
        spans = np.stack([w.low[first], w.high[first + units.field("words").to_numpy() - 1]], 1).ravel()
        n = batch.num_rows
        yield pa.record_batch(
            [
                batch.column(0), batch.column(1), pa.array(np.zeros(n, np.int32)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_()),
                _lists(np.zeros(n, np.int64), pa.array(w.hashes[:0])), _lists(2 * np.bincount(of, minlength=n), pa.array(spans)),
            ],
            names=names,
        )
        edges, of = _flat(batch.column(4))
        side, word, ref = edges.field("side").to_numpy(), edges.field("word").to_numpy(), edges.field("ref").to_numpy(zero_copy_only=False)
        after = word + edges.field("words").to_numpy()
        left = side == 1
        count = np.minimum(CONTEXT, np.where(left, word, np.diff(w.begins)[of] - after))
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        at = np.repeat(w.begins[of] + np.where(left, word - 1, after), count) + np.where(np.repeat(left, count), -step, step)
        chars = np.where(np.repeat(left, count), w.low[at], w.high[at])[np.repeat(~ref, count)]
        rows = pa.array(of)
        yield pa.record_batch(
            [
                batch.column(0).take(rows), batch.column(1).take(rows), edges.field("side"), edges.field("word"), edges.field("class_id"), edges.field("ref"),
                _lists(count, pa.array(w.hashes[at])), _lists(np.where(ref, 0, count), pa.array(chars)),
            ],
            names=names,
        )


_FOUND = ["doc_id", "tid", "passage", "start", "length", "words", "class_id", "keep_doc_id", "keep_tid", "keep_word", "removed"]


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, tid, paragraphs, code points, extensions), one for each document, to the paragraphs of its passages."""
    for batch in _slices(batches, 1024):
        units, of = _flat(batch.column(2))
        if not len(of):
            continue
        word, words, stays = units.field("word").to_numpy().astype(np.int64), units.field("words").to_numpy().astype(np.int64), units.field("stays").to_numpy(zero_copy_only=False)
        chars, bounds = batch.column(3).values.to_numpy(), batch.column(3).offsets.to_numpy()
        start, end = chars[bounds[0] : bounds[-1]].reshape(-1, 2).T.astype(np.int64)
        far = 1 << 40  # farther than any word or code point; documents are laid out so far apart
        ends, whose = _flat(batch.column(4))
        key = (of * far + word) * 4
        known = (whose * far + ends.field("word").to_numpy()) * 4 + ends.field("side").to_numpy()
        order = np.argsort(known)
        reach, taken, char = (ends.field(x).fill_null(-1).to_numpy()[order].astype(np.int64) for x in ("all", "first", "char"))
        sides = []
        for side in (1, 2):
            at = np.searchsorted(known[order], key + side)
            hit = at < len(known)
            hit[hit] = known[order][at[hit]] == (key + side)[hit]
            at = np.where(hit, at, 0)
            sides.append([np.where(hit, x[at], none) if len(x) else np.full(len(of), none) for x, none in ((reach, 0), (taken, 0), (char, -1))])
        (left, left_taken, left_char), (right, right_taken, right_char) = sides
        low, high = of * far + word - left, of * far + word + words + right
        before = np.append(-far, np.maximum.accumulate(high)[:-1])
        before = np.where(before < of * far, low - GAP - 1, before)  # the last word reached in the same document
        group = np.cumsum((low > before + GAP) | (np.diff(of, prepend=-1) > 0)) - 1
        repeated = np.bincount(group, np.maximum(0, high - np.maximum(low, np.where(low > before + GAP, low, before))))
        keep = repeated[group] >= RUN
        # A paragraph that goes takes the words with it that stand next to its first place too.
        start, end = np.where(left_char >= 0, left_char, start), np.where(right_char >= 0, right_char, end)
        done = np.maximum.accumulate(np.where(keep, of * far + end, -1))
        start = np.maximum(start, np.maximum(0, np.append(-1, done[:-1]) - of * far))
        keep &= end > start
        # Passages are numbered from 0 in each document.
        found = np.flatnonzero(keep)
        new = np.diff(group[found], prepend=-1) > 0
        number = np.cumsum(new)
        opens = np.diff(of[found], prepend=-1) > 0
        number = number - np.maximum.accumulate(np.where(opens, number, 0))
        chosen, rows = units.take(pa.array(found)), pa.array(of[found])
        place = chosen.field("keep")
        int32 = lambda x: pa.array(x[found].astype(np.int32))  # noqa: B023, E731
        yield pa.record_batch(
            [
                batch.column(0).take(rows), batch.column(1).take(rows), pa.array(number.astype(np.int32)), int32(start), int32(end - start), int32(words + left_taken + right_taken),
                chosen.field("class_id"), place.field("doc_id"), place.field("tid"), place.field("word"), pa.array(~stays[found]),
            ],
            names=_FOUND,
        )


def _same(a: Column, b: Column) -> Column:
    """Elements that two arrays begin with alike."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), False)
    return F.when(a.isNull() | b.isNull(), 0).when(differs == 0, F.size(a)).otherwise(differs - 1).cast("int")


def _at(place: str) -> Column:
    return F.struct(f"{place}.doc_id", f"{place}.tid", f"{place}.word")


def repeated_passages(spark: SparkSession, docs: DataFrame, similar: float = SIMILAR, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, tid, passage, start, length, words, class_id, keep_doc_id, keep_tid, keep_word, removed) for each paragraph of a passage that repeats.

    passage numbers a document's passages; start and length are code points of the text, from a paragraph's first word to its last.  A class is a
    component of paragraphs linked by equality or by Jaccard similarity of at least ``similar`` over distinct shingles of WIDTH
    words; its first place (by doc_id, tid, then word) stays and is named, and the others are removed.  A paragraph at an end
    of a run takes with it the words next to it that also stand next to its class's first place, up to CONTEXT of them, so that what is
    removed stands elsewhere.  A passage has at least RUN repeated words, those next to a class's last place counted too.

    Words are compared by 64-bit hashes in paragraphs and 32-bit ones next to them.  tid is a hash of the text: rows that share
    doc_id and text are one document, rows that share a doc_id only are different ones.  Passages repeated within one document count too.  Null and empty texts
    have no paragraphs; rows with a null doc_id are left out.  Other columns are left out; an empty table gives no rows.
    """
    work = Workspace(spark, "passages")
    needed = np.array([1, *(tuned_for(n, similar) for n in range(1, SMALL + 1)), tuned(similar)])
    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("tid"), F.col(text).alias("text"))
    id_type, own = rows.schema["doc_id"].dataType.simpleString(), ["doc_id", "tid"]
    units = work.table(rows.mapInArrow(_units(needed, ROWS), f"doc_id {id_type}, tid long, word int, words int, h long, bands array<long>"), "units")

    keyed = units.select("h", F.explode("bands").alias("key"))
    # Written, so that the join has plain shuffles on both sides, of which adaptive execution splits a hot one.
    shared = work.table(keyed.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("z")).where("a != z").select("key"), "shared")
    members = work.table(keyed.join(shared, "key").distinct(), "members")
    nominees = members.select("h").distinct().withColumn("nominee", F.lit(True))
    place = F.struct(*own, "word", "words")
    texts = units.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    texts = work.table(texts.join(nominees, "h", "left").where("first != last or nominee"), "texts")

    wanted = texts.where("nominee").groupBy("first.doc_id", "first.tid").agg(F.collect_list(F.struct("first.word", "first.words", "h")).alias("wanted"))
    sets = rows.join(wanted, own).select("text", "wanted").mapInArrow(_sets, "h long, shingles binary")
    sets = work.table(sets.dropDuplicates(["h"]), "sets")
    counts = members.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("h"), F.col("blocks")).cast("int")
    dealt = members.join(counts, "key").select("key", "h", block.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "h").join(sets, "h")
    dealt = dealt.select("key", "x", "y", "h", "shingles").repartition(partitions(spark), "key", "x", "y").sortWithinPartitions("key", "x", "y")
    roots = connected_components(work, dealt.mapInArrow(_verified(similar), "a long, b long"))

    classes = texts.join(roots, texts.h == roots.node, "left").select("h", "first", "last", F.coalesce("root", "h").alias("class_id"))
    classes = work.table(classes, "classes")
    keep = classes.groupBy("class_id").agg(F.min("first").alias("keep"), F.max("last").alias("last")).where("keep.doc_id != last.doc_id or keep.tid != last.tid")
    keep = work.table(keep, "keep")
    named = work.table(classes.select("h", "class_id").join(keep, "class_id"), "named")
    found = units.drop("bands").join(named, "h").select(*own, F.struct("word", "words", "class_id", "keep", "last").alias("u"))
    found = work.table(found.groupBy(*own).agg(F.sort_array(F.collect_set("u")).alias("units")), "found")
    for name in ("units", "shared", "members", "texts", "sets", "classes", "keep", "named"):
        work.drop(name)

    # The outer paragraphs of runs, and their classes' first and last places.
    stop = lambda u: u["word"] + u["words"]
    opens = lambda u, k: F.coalesce(stop(F.get("units", k - 1)) != u["word"], F.lit(True))
    closes = lambda u, k: F.coalesce(F.get("units", k + 1)["word"] != stop(u), F.lit(True))
    ends = lambda u, k: F.array_compact(F.array(F.when(opens(u, k), 1), F.when(closes(u, k), 2)))
    marked = F.filter(F.transform("units", lambda u, k: F.struct(u.alias("u"), ends(u, k).alias("sides"))), lambda x: F.size(x["sides"]) > 0)
    each = found.select(*own, F.explode(marked).alias("e")).select(*own, "e.u", F.explode("e.sides").alias("side"))
    outer = work.table(each.select(*own, "u.word", "u.words", "u.class_id", "side", F.col("u.keep").alias("f"), F.col("u.last").alias("l")), "outer")
    compared = outer.groupBy("class_id", "side").agg(F.any_value("f").alias("f"), F.any_value("l").alias("l"))
    refs = compared.select("class_id", "side", F.explode(F.array("f", "l")).alias("p")).select("p.*", "class_id", "side", F.lit(True).alias("ref"))
    asked = outer.select(*own, "word", "words", "class_id", "side", F.lit(False).alias("ref")).unionByName(refs)
    asked = asked.groupBy(*own).agg(F.collect_set(F.struct("word", "words", "class_id", "side", "ref")).alias("ends"))
    asked = found.select(*own, F.transform("units", lambda u: F.struct(u["word"].alias("word"), u["words"].alias("words"))).alias("units")).join(asked, own)
    told = work.table(rows.join(asked, own).select(*own, "text", "units", "ends").mapInArrow(_told, _TOLD.format(id_type)), "told")

    refs = told.where("ref").groupBy("class_id", "side", *own, "word").agg(F.any_value("hashes").alias("hashes"))
    refs = refs.join(compared, ["class_id", "side"]).select("class_id", "side", "f", "l", (_at("f") == F.struct(*own, "word")).alias("is_f"), (_at("l") == F.struct(*own, "word")).alias("is_l"), "hashes")
    pick = lambda which: F.max(F.when(F.col(which), F.col("hashes"))).alias(f"{which}_hashes")
    refs = work.table(refs.groupBy("class_id", "side", "f", "l").agg(pick("is_f"), pick("is_l")), "refs")
    edges = told.where("not ref").join(refs, ["class_id", "side"])
    here = F.struct("doc_id", "tid", "word")
    with_first = F.when(here == _at("f"), 0).otherwise(_same(F.col("hashes"), F.col("is_f_hashes")))
    with_last = F.when(here == _at("l"), 0).otherwise(_same(F.col("hashes"), F.col("is_l_hashes")))
    edges = edges.select(*own, "word", "side", "chars", (here == _at("f")).alias("stays"), with_first.alias("with_first"), with_last.alias("with_last"))
    # What stays is shown with all words that repeat next to it.
    reached = F.greatest("with_first", "with_last")
    edges = edges.select(*own, "word", "side", "chars", reached.alias("all"), F.when(F.col("stays"), reached).otherwise(F.col("with_first")).alias("first"))
    edges = edges.groupBy(*own).agg(F.collect_set(F.struct("word", "side", "all", "first", F.get("chars", F.col("first") - 1).alias("char"))).alias("ends"))

    places = F.transform("units", lambda u: F.struct(
        u["word"].alias("word"), u["words"].alias("words"), u["class_id"].alias("class_id"), u["keep"].alias("keep"),
        ((u["keep"]["doc_id"] == F.col("doc_id")) & (u["keep"]["tid"] == F.col("tid")) & (u["keep"]["word"] == u["word"])).alias("stays"),
    ))
    chars = told.where("side = 0").groupBy(*own).agg(F.any_value("chars").alias("chars"))
    whole = found.select(*own, places.alias("units")).join(chars, own).join(edges, own).select(*own, "units", "chars", "ends")
    schema = f"doc_id {id_type}, tid long, passage int, start int, length int, words int, class_id long, keep_doc_id {id_type}, keep_tid long, keep_word int, removed boolean"
    return whole.mapInArrow(_passages, schema)


def without_passages(docs: DataFrame, passages: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the removed paragraphs cut out of the text; documents without any are untouched.

    Rows that share doc_id and text lose the same words; null texts and ids have nothing to lose.
    """
    span = F.struct(F.col("start").cast("int").alias("start"), F.col("length").cast("int").alias("length"))
    spans = passages.where("removed").groupBy(F.col("doc_id").alias("__of"), F.col("tid").alias("__tid")).agg(F.sort_array(F.collect_set(span)).alias("__spans"))
    whole = F.col(text)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out")).cast("struct<at:int,out:string>")
    step = lambda a, s: F.struct((s["start"] + s["length"]).alias("at"), F.concat(a["out"], F.substring(whole, a["at"] + 1, s["start"] - a["at"])).alias("out"))
    left = F.aggregate("__spans", start, step, lambda a: F.concat(a["out"], F.substring(whole, a["at"] + 1, F.length(whole))))
    joined = docs.join(spans, (docs[doc_id] == spans["__of"]) & (F.xxhash64(docs[text]) == spans["__tid"]), "left")
    return joined.withColumn(text, F.when(F.col("__spans").isNull(), whole).otherwise(left)).select(*docs.columns)
