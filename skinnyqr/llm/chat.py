"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, encoded once with offsets, and the spans
of the assistant's turns are intersected with the token spans by binary
search.  Control strings inside texts are escaped reversibly, and the
template's own marks are special tokens, so no token straddles a turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import AddedToken, Tokenizer

from ..session import ship_package
from .alignment import rank_encoding

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Control strings of this and other templates; each is escaped where a text holds it.
CONTROLS = (TURN, TEXT, END, "<|endoftext|>", "<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_HELD = re.compile("|".join(rf"{re.escape(c[0])}(?P<e{i}>\\*){re.escape(c[1:])}" for i, c in enumerate(CONTROLS)))


def escape(text: str) -> str:
    """One more backslash after the first character of each control string (with or without backslashes there)."""
    if "<" not in text and "[" not in text:  # every control string starts with one of them
        return text
    return _HELD.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    if "\\" not in text:
        return text
    return _HELD.sub(lambda m: m[0][0] + (m[0][2:] if m[0][1] == "\\" else m[0][1:]), text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The whole conversation and the (sorted) spans of the assistant's texts."""
    out, at, spans = [], 0, []
    for role, text in turns:
        head, body = TURN + escape(role) + TEXT, escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), spans


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """The turns, read back from the output."""
    for part in formatted.split(TURN)[1:]:
        role, _, rest = part.partition(TEXT)
        yield unescape(role), unescape(rest.removesuffix(END))


def loss_mask(spans: list[tuple[int, int]], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mask of the tokens (sorted spans) that lie in one of the sorted turn spans."""
    mask = np.zeros(len(starts) + 1, np.int64)
    if len(spans):
        s = np.asarray(spans, np.int64)
        first = np.searchsorted(starts, s[:, 0], "left")
        last = np.searchsorted(ends, s[:, 1], "right")
        # tokens of no length at a bound of an empty turn are none
        full = s[:, 1] > s[:, 0]
        np.add.at(mask, first[full], 1)
        np.add.at(mask, last[full], -1)
    return np.cumsum(mask[:-1]) > 0


def byte_offsets(text: str) -> np.ndarray | None:
    """The byte of UTF-8 where each character starts, and the length; None for ASCII, where it is the same number."""
    if text.isascii():
        return None
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.concatenate([[0], np.cumsum(1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000))])


@lru_cache(maxsize=2)
def _encoder(path: str):
    """Text -> (ids, first byte, byte behind) of its tokens; the template's marks are tokens of their own."""
    marks = (TURN, TEXT, END)
    encoding, texts = rank_encoding(path, marks)
    if encoding is not None:
        size = np.array([len(t) for t in texts], np.int64)

        def encode(text: str):
            ids = encoding.encode(text, allowed_special="all", disallowed_special=())
            ends = np.cumsum(size[ids]) if ids else np.zeros(0, np.int64)
            return ids, np.append(0, ends[:-1]) if ids else ends, ends

        return encode
    tok = Tokenizer.from_file(path)
    tok.add_special_tokens([AddedToken(c, special=True, normalized=False) for c in marks])
    tok.no_truncation()
    tok.no_padding()

    def by_library(text: str):
        enc = tok.encode(text, add_special_tokens=False)
        off, at = np.asarray(enc.offsets, np.int64).reshape(-1, 2), byte_offsets(text)
        off = off if at is None else at[off]
        return enc.ids, off[:, 0], off[:, 1]

    return by_library


def masked_text(formatted: bytes, mask: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    """The stretches of text under the mask, one per run of masked tokens."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return [formatted[starts[a] : ends[b - 1]].decode() for a, b in zip(edge[::2], edge[1::2])]


def format_conversations(
    turns: DataFrame, vocabulary: str, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    with_output: bool = False, partitions: int | None = None,
) -> DataFrame:
    """One row per conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_tokens, n_loss_tokens.

    with_output adds formatted (the text), ids and loss_mask.  Rows are
    ordered by turn, then role and text, nulls first; rows that repeat are
    turns of their own.  Null texts and roles are empty.  Rows with a null
    id form a conversation of their own.  Other columns are ignored.

    Rows are hash-partitioned by conversation and sorted, and read as a
    stream, so a task holds one conversation at a time, whatever the number
    of conversations; a single conversation must fit in memory, as the text
    that is encoded whole.
    """
    spark = turns.sparkSession
    ship_package(spark)
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long"
    if with_output:
        schema += ", formatted string, ids array<int>, loss_mask array<boolean>"

    def finish(conv, rows, encode):
        formatted, spans = render(rows)
        ids, first, behind = encode(formatted)
        at = byte_offsets(formatted)
        mask = loss_mask(spans if at is None else [(int(at[a]), int(at[b])) for a, b in spans], first, behind)
        turns_hash, n = hashlib.sha256(), 0
        for role, text in parse(formatted):
            n += 1
            turns_hash.update(f"{role}\n{text}\n".encode())
        loss = [unescape(x) for x in masked_text(formatted.encode(), mask, first, behind)]
        loss_hash = hashlib.sha256("".join(loss).encode())
        out = (conv, n, turns_hash.hexdigest(), sum(map(len, loss)), loss_hash.hexdigest(), len(formatted), len(ids), int(mask.sum()))
        return (*out, formatted, ids, mask.tolist()) if with_output else out

    def run(it):
        encode = _encoder(vocabulary)
        conv, rows, out, names = None, [], [], [c.split(" ")[0] for c in schema.split(", ")]

        def batch(done):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names=names)

        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.bool_())]
        for b in it:
            for c, role, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                if rows and c != conv:
                    out.append(finish(conv, rows, encode))
                    rows = []
                    if len(out) >= 256:
                        yield batch(out)
                        out = []
                conv = c
                rows.append((role, text))
        if rows:
            out.append(finish(conv, rows, encode))
        if out:
            yield batch(out)

    src = turns.select(
        F.col(id_col).cast("long").alias("conv_id"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col(turn_col).alias("turn"),
    )
    parts = src.repartition(partitions, "conv_id") if partitions else src.repartition("conv_id")
    return parts.sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(run, schema)
