"""Training sequences packed along a space-filling curve.

A document's vector is the mean of hashed token signs in a few dimensions; its key is
the place of that vector on a Hilbert curve, so neighbours on the curve are alike.
Documents are range-sorted by (key, hash of the id) into buckets of about ``ROWS``
documents; the hash keeps a large group of equal documents from falling into one
bucket.  Within a bucket the token streams are laid end to end along the curve and
cut every ``WIDTH`` tokens.  A bucket's remainder becomes sequences whose lengths are
powers of two, which need no padding, so nothing is padded at all.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.common import partitions, whole_text

WIDTH = 2048
#: Id that ends each document.
END_ID = 1
#: Documents of a bucket, about, and the most buckets whose bounds the driver holds.
ROWS, MOST_BUCKETS = 1024, 1 << 16
#: Documents read for the bounds, for each bucket.
SAMPLE = 32
DIMS, DIM_BITS = 4, 10
#: ASCII marks that end a run of letters or digits; those of special tokens, and the apostrophe of contractions, are none.
MARKS = b".,;:!?*#$%&()-/+=@[]{}~^`"
#: Words of a worker's memory; it starts afresh beyond.
REMEMBERED = 1_000_000


def _byte_letters() -> list[str]:
    """The character by which byte-level models write each byte: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


class _Words(dict):
    """Ids of words, as little-endian bytes; the tokenizer is asked once for each.

    The tokenizer drops white space and never joins tokens across it, so a text's
    ids are those of its words.  Words part at ASCII white space only; any other
    white space stays inside a word, for the tokenizer to drop.  A word of small
    letters in composed form is what the tokenizer's normalizer and splitter would make of it,
    so its model alone gives the ids.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()

    def plain(self, text: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(text)]).tobytes()

    def ids(self, word: bytes) -> bytes:
        text = word.decode()
        if text.isalpha() and is_normalized("NFC", text):
            small = text.lower()
            # Beyond Latin letters, case rules may look at a letter's neighbours; the tokenizer's own do not.
            if small == text or max(text) < "\u0250" and small.isalpha():
                return self.plain("".join([self.letters[b] for b in small.encode()]))
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, word: bytes) -> bytes:
        # The methods of bytes know ASCII letters only, of which each word is one run for the tokenizer.
        if word.isalpha():
            value = self.plain(word.decode()) if word.islower() else self[word.lower()]
        else:
            # Marks after a letter or digit are a token run of their own; most new words are known without them.
            stem = word.rstrip(MARKS)
            if stem and len(stem) < len(word) and stem.decode()[-1].lower()[-1].isalnum():
                value = self[stem] + self[word[len(stem) :]]
            else:
                value = self.ids(word)
        self[word] = value
        return value


@lru_cache
def _words(path: str) -> _Words:
    return _Words(path)


def encode(text: str, path: str) -> bytes:
    """The text's ids and END_ID, as little-endian unsigned 32-bit integers."""
    words = _words(path)
    if len(words) > REMEMBERED:
        words.clear()
    return b"".join(map(words.__getitem__, text.encode().split())) + END_ID.to_bytes(4, "little")


@lru_cache
def _signs(dims: int) -> np.ndarray:
    """+1 or -1 for each dimension of each token id, by a fixed hash."""
    ids = np.arange(1 << 16, dtype=np.uint64)
    with np.errstate(over="ignore"):
        x = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
    return ((x[:, None] >> np.arange(dims, dtype=np.uint64)[None, :]) & np.uint64(1)).astype(np.int8) * 2 - 1


def vector(ids: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """The mean of the ids' signs: a hashed bag of tokens, projected to a few dimensions."""
    counts = np.bincount(ids & 0xFFFF, minlength=1 << 16) if len(ids) > 4096 else None
    total = counts @ _signs(dims) if counts is not None else _signs(dims)[ids & 0xFFFF].sum(0)
    return total / max(1, len(ids))


def hilbert(cells: np.ndarray, bits: int = DIM_BITS) -> np.ndarray:
    """Places of integer points (rows) on the Hilbert curve, by Skilling's transposition (2004)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    place = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            place = (place << 1) | ((x[i] >> b) & 1)
    return place


def curve_keys(vectors: np.ndarray) -> np.ndarray:
    """Vectors lie within a cube of side 1 around zero nearly always; others are put on its border."""
    top = (1 << DIM_BITS) - 1
    return hilbert(np.clip(((vectors + 0.5) * top).astype(np.int64), 0, top))


def _kind(path: str) -> str:
    """Two bytes hold an id of a small vocabulary, which halves what is shuffled."""
    return "<u2" if _words(path).tokenizer.get_vocab_size() <= 1 << 16 else "<u4"


def _encoded(tokenizer: str, bounds: list[tuple[int, int]] | None, kind: str = "<u4"):
    """Rows (.., tie, text) to (.., tie, place, and ids with their bucket, if bounds are given)."""
    edge = np.array(bounds or [], dtype=np.int64).reshape(-1, 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                ids = [encode(t, tokenizer) for t in batch.column(batch.num_columns - 1).to_pylist()]
                place = curve_keys(np.array([vector(np.frombuffer(x, "<u4")) for x in ids]))
                columns, names = batch.columns[:-1] + [pa.array(place)], batch.schema.names[:-1] + ["place"]
                if bounds is not None:
                    tie = batch.column(batch.num_columns - 2).to_numpy()
                    bucket = np.searchsorted(edge[:, 0], place, "left")
                    last = np.searchsorted(edge[:, 0], place, "right")
                    for k in np.flatnonzero(bucket < last):  # bounds with the same place part by the tie
                        bucket[k] += np.searchsorted(edge[bucket[k] : last[k], 1], tie[k], "right")
                    columns, names = [*columns, pa.array(bucket.astype(np.int32)), pa.array([np.frombuffer(x, "<u4").astype(kind).tobytes() for x in ids], pa.binary())], [*names, "bucket", "ids"]
                yield pa.record_batch(columns, names=names)

    return run


def _pieces(doc_type: pa.DataType, kind: str, width: int, with_ids: bool):
    """Rows come sorted by (bucket, place, tie); one document and one unfinished sequence are held at a time."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "ids"][: 8 + with_ids]
    kinds = [doc_type, *[pa.int64()] * 7, pa.binary()][: 8 + with_ids]

    def row(doc, start, n, ids, sequence, offset, size):
        data = ids[start : start + n].astype("<u4").tobytes()
        return (doc, start, n, zlib.crc32(data), len(ids), sequence, offset, size, data)[: 8 + with_ids]

    def closed(held: list, sequence: int, size: int) -> list:
        return [row(doc, start, n, ids, sequence, offset, size) for doc, start, n, ids, offset in held]

    def remainder(held: list, sequence: int) -> list:
        """An unfinished sequence, cut anew into lengths that are powers of two, the longest first."""
        out, room = [], 0
        left = sum(x[2] for x in held)
        for doc, start, n, ids, _ in held:
            while n:
                if not room:
                    size = room = 1 << (left.bit_length() - 1)
                    left, sequence = left - size, sequence + 1
                take = min(room, n)
                out.append(row(doc, start, take, ids, sequence - 1, size - room, size))
                start, n, room = start + take, n - take, room - take
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _words.cache_clear()  # all ids are made by now; a worker outlives this stage, and its words would stay beside whatever runs next
        now, sequence, held, filled = None, 0, [], 0
        record = lambda out: pa.record_batch([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [()] * len(kinds), kinds, strict=True)], names=names)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                out = []
                for doc, bucket, data in zip(*(c.to_pylist() for c in whole.slice(at, 256).columns), strict=True):
                    if bucket != now:
                        out += remainder(held, sequence)
                        now, sequence, held, filled = bucket, bucket << 32, [], 0
                    ids, start = np.frombuffer(data, kind), 0
                    while start < len(ids):
                        take = min(width - filled, len(ids) - start)
                        held.append((doc, start, take, ids, filled))
                        start, filled = start + take, filled + take
                        if filled == width:
                            out += closed(held, sequence, width)
                            sequence, held, filled = sequence + 1, [], 0
                yield record(out)
        yield record(remainder(held, sequence))

    return run


def pack(
    spark: SparkSession, docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, with_ids: bool = True
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens, and ids if asked for.

    A document's ids are the tokenizer's, then END_ID; a null or empty text has END_ID
    alone.  Repeated rows are packed once each, with a null id too.  Each id of each row lies in
    exactly one piece; a long document is cut into several.  Every sequence is full or
    as long as a power of two.  sequence_id is the bucket (high 32 bits) and the place in
    it.  Other columns are left out; an empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(doc_id), F.col(text)).alias("tie"), whole_text(text).alias("text"))
    id_field = rows.select("doc_id").limit(0).toArrow().schema.field(0).type
    id_type = rows.schema["doc_id"].dataType.simpleString()
    n = rows.count()
    buckets = max(1, min(n // ROWS, MOST_BUCKETS))
    bounds = []
    if buckets > 1:  # A sample of about SAMPLE * buckets rows places the borders between buckets, and decides nothing else.
        sample = rows.where(F.pmod(F.xxhash64("tie"), F.lit(max(1, n // (SAMPLE * buckets)))) == 0)
        places = sample.mapInArrow(_encoded(tokenizer, None), f"doc_id {id_type}, tie long, place long").select("place", "tie").toArrow()
        ranked = np.stack([places.column(k).to_numpy() for k in range(2)], 1)  # 16 bytes a row, 32 MB at the most buckets
        ranked = ranked[np.lexsort((ranked[:, 1], ranked[:, 0]))]
        bounds = [tuple(ranked[len(ranked) * k // buckets].tolist()) for k in range(1, buckets)] if len(ranked) else []
    kind = _kind(tokenizer)
    coded = rows.mapInArrow(_encoded(tokenizer, bounds, kind), f"doc_id {id_type}, tie long, place long, bucket int, ids binary")
    ordered = coded.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket", "place", "tie").select("doc_id", "bucket", "ids")
    schema = f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long"
    return ordered.mapInArrow(_pieces(id_field, kind, width, with_ids), schema + ", ids binary" * with_ids)
