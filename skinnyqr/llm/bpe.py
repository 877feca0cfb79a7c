"""BPE encoding and decoding as bounded-lookahead streaming transducers.

A merge list has a finite lookahead: symbols further than that from the
unknown rest of a word can't change any more.  The encoder computes it from
the list, holds that many symbols, and emits tokens as soon as they are
stable, so memory is constant however long a word or a text is.  The decoder
is a byte-to-text state machine that keeps an unfinished character between
tokens.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package

#: Entries of each of the two generations of a worker's memo of short words; the older one goes when the newer is full.
MEMO = 250_000
#: Characters read at a time, and the longest word that is looked up whole.
CHUNK, WHOLE = 1 << 16, 64


def byte_alphabet() -> list[str]:
    """The printable stand-in character of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, nxt = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b], nxt = chr(nxt), nxt + 1
    return [out[b] for b in range(256)]


class MergeList:
    """Vocabulary, merges (by pair of ids) and their sufficient lookahead."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.texts = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        #: by left token, the rank of the merge with each right token
        self.rank: list[dict[int, int]] = [{} for _ in range(max(self.texts, default=-1) + 1)]
        for rank, (a, b) in enumerate(merges):
            self.rank[self.vocab[a]][self.vocab[b]] = rank
        self.merged = [self.vocab[a + b] for a, b in merges]
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.lookahead = self._lookahead(merges)
        letters = byte_alphabet()
        self.symbol = [self.vocab[c] for c in letters]
        self.last = [self.vocab[c + self.suffix] for c in letters]

    def _lookahead(self, merges: list[tuple[str, str]]) -> int:
        """How many symbols back from the end of the known input a token can still change.

        The common part of two tokenisations with the same beginning shrinks
        only when its last token u merges to the right in one of them.  The
        next token can do so, by a later merge, only with a token that has u
        at its left end.  The longest such chain of merges, in rank order, is
        the bound.
        """
        left: dict[str, str] = {}
        chain: dict[str, int] = {}
        longest = 0
        width = lambda s: len(s.removesuffix(self.suffix)) if self.suffix else len(s)
        for u, v in merges:
            most, x = 0, v
            while x is not None:
                most, x = max(most, chain.get(x, 0)), left.get(x)
            reach = width(u) + most
            chain[u] = max(chain.get(u, 0), reach)
            longest = max(longest, reach)
            left.setdefault(u + v, u)
        return longest + 1

    def apply(self, ids: list[int]) -> list[int]:
        """Merge a short list of symbol ids in rank order, leftmost first."""
        rank, merged, never = self.rank, self.merged, len(self.merged)
        found = [rank[a].get(b, never) for a, b in zip(ids, ids[1:])]
        while found and (best := min(found)) < never:
            at = found.index(best)
            ids[at] = token = merged[best]
            del ids[at + 1], found[at]
            if at:
                found[at - 1] = rank[ids[at - 1]].get(token, never)
            if at < len(found):
                found[at] = rank[token].get(ids[at + 1], never)
        return ids


class WordMemo:
    """Packed tokens of short words in two generations, so that frequent words outlive a full memo."""

    def __init__(self):
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def put(self, word: str, packed: bytes) -> None:
        if len(self.new) >= MEMO:
            self.old, self.new = self.new, {}
        self.new[word] = packed


class WordTransducer:
    """Streams the bytes of one word to token ids."""

    def __init__(self, merges: MergeList):
        self.m, self.held = merges, bytearray()

    def feed(self, data: bytes) -> list[int]:
        """Tokens that no further input can change."""
        out: list[int] = []
        m, step = self.m, 8 * self.m.lookahead
        self.held += data
        while len(self.held) > step:
            window = self.held[:step]
            stable, used = step - m.lookahead, 0
            for t in m.apply([m.symbol[b] for b in window]):
                used_next = used + len(m.texts[t])
                if used_next > stable:
                    break
                out.append(t)
                used = used_next
            assert used, "the lookahead leaves some token stable"
            del self.held[:used]
        return out

    def finish(self) -> list[int]:
        m, held, self.held = self.m, self.held, bytearray()
        return m.apply([m.symbol[b] for b in held[:-1]] + [m.last[held[-1]]]) if held else []


_PIECES = regex.compile(r"\p{L}+|'s|'t|'re|'ve|'m|'ll|'d|\p{N}|[^\s\p{L}\p{N}]+")


def _latin_pieces() -> re.Pattern:
    """The same for texts below U+0100, with the classes spelt out for the faster engine."""
    chars = [chr(i) for i in range(256)]
    letters, digits, blanks = ("".join(re.escape(c) for c in chars if regex.match(k, c)) for k in (r"\p{L}", r"\p{N}", r"\s"))
    return re.compile(rf"[{letters}]+|'s|'t|'re|'ve|'m|'ll|'d|[{digits}]|[^{blanks}{letters}{digits}]+")


_LATIN = _latin_pieces()


def _pieces(text: str) -> list[str]:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _PIECES.findall(text)
    return _LATIN.findall(text)


def _starts_anew(before: str, c: str) -> bool:
    """Whether normalisation can't join ``c`` with what comes before it."""
    return not unicodedata.combining(c) and unicodedata.normalize("NFC", before + c)[-1:] == c


class StreamEncoder:
    """Streams text to token ids (packed, little-endian 32-bit)."""

    def __init__(self, merges: MergeList, memo: WordMemo):
        self.m, self.memo = merges, memo
        self.special = merges.special_pattern
        self.raw = ""  # not yet normalised
        self.text = ""  # normalised, not yet cut
        self.word: WordTransducer | None = None  # of a run that goes on
        self.kind: regex.Pattern | None = None

    @staticmethod
    def _pack(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> bytes:
        """Tokens of a word that the memo's newer generation lacks."""
        got = self.memo.old.get(word)
        if got is None:
            m, data = self.m, word.encode()
            if len(data) <= 8 * m.lookahead:  # no token is out before the word's end
                ids = [m.symbol[b] for b in data]
                ids[-1] = m.last[data[-1]]
                got = self._pack(m.apply(ids))
            else:
                t = WordTransducer(m)
                ids = t.feed(data)
                got = self._pack(ids + t.finish())
        if len(word) <= WHOLE:
            self.memo.put(word, got)
        return got

    _RUNS = (regex.compile(r"\p{L}+"), regex.compile(r"[^\s\p{L}\p{N}]+"))

    def _cut(self, last: bool) -> Iterator[bytes]:
        """Words of self.text; a long run at its end goes to a transducer piece by piece."""
        if self.word is not None:
            m = self.kind.match(self.text)
            run = m[0] if m else ""
            ends = len(run) < len(self.text) or last
            yield self._pack(self.word.feed(run.encode()))
            self.text = self.text[len(run) :]
            if not ends:
                return
            yield self._pack(self.word.finish())
            self.word = None
        words = _pieces(self.text)
        tail = ""
        if not last and words and self.text.endswith(words[-1]):
            # an unfinished word, or a quote that a letter may follow
            tail = words.pop()
            while words and len(tail) < 4 and self.text.endswith(words[-1] + tail) and "'" in words[-1] + tail:
                tail = words.pop() + tail
        get, word = self.memo.new.get, self._word
        yield b"".join([get(w) or word(w) for w in words])
        self.text = tail
        if len(tail) > CHUNK:
            for kind in self._RUNS:
                if (m := kind.fullmatch(tail)) and not tail.startswith("'"):
                    self.kind, self.word, self.text = kind, WordTransducer(self.m), ""
                    yield self._pack(self.word.feed(m[0].encode()))
                    return

    def _normal(self, raw: str) -> str:
        if not raw.isascii():
            raw = unicodedata.normalize("NFC", raw).replace("Σ", "σ")  # no special final sigma
        return raw.lower()

    def _plain(self, raw: str, last: bool) -> Iterator[bytes]:
        self.text += self._normal(raw)
        yield from self._cut(last)

    def feed(self, chunk: str, last: bool = False) -> Iterator[bytes]:
        self.raw += chunk
        if self.special is not None:
            while m := self.special.search(self.raw):
                yield from self._plain(self.raw[: m.start()], True)
                yield self._pack([self.m.special[m[0]]])
                self.raw = self.raw[m.end() :]
        cut = len(self.raw)
        if not last:
            longest = max(map(len, self.m.special), default=1)
            for k in range(max(0, cut - longest + 1), cut):  # a special token may have begun
                if any(s.startswith(self.raw[k:]) for s in self.m.special):
                    cut = k
                    break
            while cut > 0 and not (cut < len(self.raw) and _starts_anew(self.raw[cut - 1], self.raw[cut])):
                cut -= 1
        head, self.raw = self.raw[:cut], self.raw[cut:]
        yield from self._plain(head, last)


class TextMachine:
    """Byte-to-text state machine: token ids in, text out, unfinished characters kept."""

    def __init__(self, merges: MergeList, as_library: bool = True):
        self.table, self.sep = _decode_table(merges, as_library)
        self.begun = False
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int], last: bool = False) -> str:
        data = self.sep.join(map(self.table.__getitem__, ids))
        if data and self.sep:
            data = self.sep + data if self.begun else data
            self.begun = True
        return self.utf8.decode(data, last)


@lru_cache(maxsize=4)
def _decode_table(merges: MergeList, as_library: bool) -> tuple[dict[int, bytes], bytes]:
    """Bytes of each id, and what stands between ids.

    as_library: the tokens as they stand in the vocabulary with blanks
    between, which is what the library gives for files without a decoder.
    Else the bytes that the tokens stand for, a blank for each end of a word.
    """
    if as_library:
        return {i: t.encode() for i, t in merges.texts.items()}, b" "
    back = {c: bytes([b]) for b, c in enumerate(byte_alphabet())}
    special = set(merges.special.values())
    out = {}
    for i, t in merges.texts.items():
        if i in special:
            out[i] = t.encode()
            continue
        body = t.removesuffix(merges.suffix) if merges.suffix else t
        out[i] = b"".join(back[c] for c in body) + (b" " if body != t else b"")
    return out, b""


@lru_cache(maxsize=2)
def _loaded(path: str) -> tuple[MergeList, WordMemo]:
    return MergeList(path), WordMemo()


def encode_document(merges: MergeList, memo: WordMemo, text: str) -> bytes:
    enc = StreamEncoder(merges, memo)
    out = bytearray()
    for i in range(0, max(len(text), 1), CHUNK):
        for part in enc.feed(text[i : i + CHUNK], i + CHUNK >= len(text)):
            out += part
    return bytes(out)


def bpe_round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) of every row.

    ``vocabulary`` is the path of a tokenizer file that every executor has.
    Null texts count as empty: no tokens, and the digests of no bytes.
    Repeated rows and null ids are kept as they are; other columns are ignored.
    """
    ship_package(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(it):
        merges, memo = _loaded(vocabulary)
        for b in it:
            rows = []
            ids_out = []
            for text in b.column(1):
                packed = encode_document(merges, memo, text.as_py() or "")
                ids = np.frombuffer(packed, "<u4")
                machine, digest = TextMachine(merges), hashlib.sha256()
                for i in range(0, len(ids), CHUNK):
                    digest.update(machine.feed(ids[i : i + CHUNK].tolist()).encode())
                digest.update(machine.feed([], True).encode())
                rows.append((len(ids), hashlib.sha256(packed).hexdigest(), digest.hexdigest()))
                if with_ids:
                    ids_out.append(ids.astype(np.int32))
            n, a, d = zip(*rows) if rows else ((), (), ())
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols, names = [*cols, pa.array(ids_out, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, schema)
