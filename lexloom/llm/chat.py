"""Training records from conversations, with loss masks aligned by offsets.

A conversation is rendered whole and encoded once; each turn's span of bytes
is known from the rendering, each token's from the lengths of the tokens before it.  Both lists are sorted, so
the tokens of all turns are found by one binary search, and what is trained on is the
intersection of assistant spans with token spans.

Template: ``<|im_start|>role<|im_sep|>text<|im_end|>`` for each turn.  Control strings
are single tokens and end where a text begins, so no token runs across a border.
Inside roles and texts a backslash becomes two and ``<|`` becomes ``<\\|``, which no
control string contains; unescaping is exact.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
TOKENIZER = "byte_bpe_50k.tiktoken"
#: How that vocabulary's texts are split before their bytes are merged; a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Conversations whose records are held as Python objects at a time.
SLICE = 64


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    """Undoes escape; left to right, a backslash stands for the character after it."""
    out, at = [], 0
    while (k := text.find("\\", at)) >= 0:
        out.append(text[at:k])
        out.append(text[k + 1 : k + 2])
        at = k + 2
    return "".join([*out, text[at:]])


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int, bool]]]:
    """The formatted conversation, and the sorted spans of its texts, in bytes, with whether they are trained on."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{SEP}", escape(text)
        start = at + _size(head)
        at = start + _size(body)
        spans.append((start, at, role == "assistant"))
        out += (head, body, END)
        at += len(END)
    return "".join(out), spans


def _size(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode())


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    turns = formatted.split(START)[1:]
    return [tuple(map(unescape, turn[: -len(END)].split(SEP, 1))) for turn in turns]


def loss_mask(spans: list[tuple[int, int, bool]], ends: np.ndarray) -> np.ndarray:
    """Rows (first, last, from, to), one for each trained span that is not empty: its tokens (last not included) and the bytes they cover in it.

    ends are the tokens' last bytes; a token begins where the one before it ends.
    """
    trained = np.array([(a, b) for a, b, t in spans if t and a < b], np.int64).reshape(-1, 2)
    first = np.searchsorted(ends, trained[:, 0], "right")
    last = np.searchsorted(ends, trained[:, 1], "left") + 1
    begins = np.concatenate([[0], ends])
    return np.stack([first, last, np.maximum(trained[:, 0], begins[first]), np.minimum(trained[:, 1], begins[last])], 1).astype(np.int32)


def masked_text(formatted: str, mask) -> str:
    """What stands under the mask, each byte once."""
    data = formatted.encode()
    return "".join(unescape(data[a:b].decode()) for _, _, a, b in mask)


class _Encoder:
    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        first = max(ranks.values()) + 2  # the id after the vocabulary's is its own end mark's
        controls = {x: first + k for k, x in enumerate((START, SEP, END))}
        self.coding = tiktoken.Encoding("chat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=controls)
        self.lengths = np.zeros(first + len(controls), np.int64)
        for token, k in [*ranks.items(), *controls.items()]:
            self.lengths[k] = len(token)

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and where each token ends, in bytes."""
        ids = self.coding.encode_to_numpy(text, allowed_special="all")
        return ids, np.cumsum(self.lengths[ids])


@lru_cache
def _encoder(path: str) -> _Encoder:
    return _Encoder(path)


def format_turns(turns: list[tuple[str, str]], path: str) -> dict:
    """formatted, input_ids, ends of the tokens and loss mask of one conversation."""
    formatted, spans = render(turns)
    ids, ends = _encoder(path)(formatted)
    return {"formatted": formatted, "input_ids": ids, "ends": ends, "mask": loss_mask(spans, ends)}


def format_chats(chats: DataFrame, tokenizer: str, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, input_ids, and loss (first, last, from, to), one for each trained turn with a text.

    The tokens from first to last, not included, are trained on; from and to are their bytes in the formatted text.

    Rows of a conversation go by turn (null first), then role and text; repeated rows
    all stay.  Null roles and texts are empty, and rows with a null conv_id form one
    conversation.  Other columns are left out; an empty table gives no rows.  A
    conversation is one record, so its own turns are the most that one task must hold.
    """
    said = chats.select(
        F.col(conv_id).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"),
    )
    whole = said.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")).select("conv_id", F.col("t.role").alias("roles"), F.col("t.text").alias("texts"))
    id_type = whole.schema["conv_id"].dataType.simpleString()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                made = [format_turns(list(zip(r, t, strict=True)), tokenizer) for r, t in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                flat = np.concatenate([x["mask"] for x in made]) if made else np.zeros((0, 4), np.int32)
                loss = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in range(4)], names=["first", "last", "from", "to"])
                ids = pa.array(np.concatenate([x["input_ids"] for x in made]).astype(np.int32)) if made else pa.array([], pa.int32())
                yield pa.record_batch(
                    [
                        part.column(0), pa.array([x["formatted"] for x in made], pa.string()), pa.ListArray.from_arrays(_ends(x["input_ids"] for x in made), ids),
                        pa.ListArray.from_arrays(_ends(x["mask"] for x in made), loss),
                    ],
                    names=["conv_id", "formatted", "input_ids", "loss"],
                )

    return whole.mapInArrow(build, f"conv_id {id_type}, formatted string, input_ids array<int>, loss array<struct<first:int,last:int,from:int,to:int>>")


def _ends(parts: Iterator[np.ndarray]) -> pa.Array:
    return pa.array(np.cumsum([0, *map(len, parts)]).astype(np.int32))


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for batch in (whole.slice(at, SLICE) for whole in batches for at in range(0, whole.num_rows, SLICE)):
        rows = []
        for conv, formatted, loss in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            turns = parse(formatted)
            under = masked_text(formatted, [tuple(x.values()) for x in loss])
            rows.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(under), sha(under), len(formatted)))
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        kinds = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from format_chats: turns and trained text, as digests."""
    id_type = formatted.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {id_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select("conv_id", "formatted", "loss").mapInArrow(_digest_batches, schema)
