"""Token counts by a linear longest-match automaton.

The vocabulary is a trie with failure links; each link carries how many
tokens are popped on the way, so a word's greedy longest-match length is
found in one pass over its bytes, without building the pieces.  In
vocabularies with word ends a piece either stands inside a word or ends it:
pieces are popped while bytes follow, and what is left at the end of the word,
which is the string of the last node, is counted with the pieces that end one.
"""

from __future__ import annotations

import json
from collections import deque
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .bpe import byte_alphabet

MEMO = 300_000
_WORD = regex.compile(rb"[^\x20\x09-\x0D]+")


class LongestMatch:
    """``inner``: pieces with more of the word behind them; ``final``: pieces that end a word (default: the same)."""

    def __init__(self, inner: set[bytes], final: set[bytes] | None = None):
        self.inner = inner
        self.final = inner if final is None else final
        self.child: dict[int, int] = {}  # node * 256 + byte
        self.text: list[bytes] = [b""]
        for p in sorted(self.inner | self.final):
            v = 0
            for i, b in enumerate(p):
                nxt = self.child.get(v << 8 | b)
                if nxt is None:
                    nxt = self.child[v << 8 | b] = len(self.text)
                    self.text.append(p[: i + 1])
                v = nxt
        self.fail: list[int] = [-1] * len(self.text)
        self.pops: list[int] = [0] * len(self.text)
        edges: dict[int, list[tuple[int, int]]] = {}
        for key, v in self.child.items():
            edges.setdefault(key >> 8, []).append((key & 255, v))
        queue = deque([0])
        while queue:
            u = queue.popleft()
            for b, v in edges.get(u, ()):
                if self.text[v] in self.inner:
                    self.fail[v], self.pops[v] = 0, 1
                else:
                    z, n = self.fail[u], self.pops[u]
                    while z >= 0 and z << 8 | b not in self.child:
                        n += self.pops[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[v], self.pops[v] = self.child[z << 8 | b], n
                queue.append(v)
        self.ending = [self._ending(t) for t in self.text]

    def _ending(self, rest: bytes) -> int:
        """Pieces of the end of a word, each the longest that fits; -1 if none does.  ``rest`` is no longer than a piece."""
        n = 0
        while rest:
            n += 1
            if rest in self.final:
                return n
            cut = next((j for j in range(len(rest) - 1, 0, -1) if rest[:j] in self.inner), 0)
            if not cut:
                return -1
            rest = rest[cut:]
        return n

    def length(self, word: bytes) -> int:
        """Number of pieces of the greedy longest match; -1 if it gets stuck."""
        child, fail, pops = self.child.get, self.fail, self.pops
        v, n = 0, 0
        for b in word:
            nxt = child(v << 8 | b)
            while nxt is None:
                n += pops[v]
                v = fail[v]
                if v < 0:
                    return -1
                nxt = child(v << 8 | b)
            v = nxt
        return n + self.ending[v] if self.ending[v] >= 0 else -1


def byte_pieces(path: str) -> tuple[set[bytes], set[bytes] | None]:
    """Byte strings of a byte-level vocabulary file: pieces inside a word, and those that end one (None: the same)."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    back = {c: b for b, c in enumerate(byte_alphabet())}
    suffix = model.get("end_of_word_suffix") or ""
    read = lambda tokens: {bytes(back[c] for c in t) for t in tokens if t and all(c in back for c in t)}
    if not suffix:
        return read(model["vocab"]), None
    return read(t for t in model["vocab"] if not t.endswith(suffix)), read(t.removesuffix(suffix) for t in model["vocab"] if t.endswith(suffix))


@lru_cache(maxsize=2)
def _loaded(path: str) -> tuple[LongestMatch, dict[bytes, int]]:
    return LongestMatch(*byte_pieces(path)), {}


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_pieces, n_stuck, longest) of every row.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; n_pieces sums
    their greedy longest-match lengths over the vocabulary's byte strings (the
    last piece of a word is one that ends words, where the vocabulary has such
    pieces), a word that gets stuck counting as one piece (and in n_stuck);
    longest is the most pieces of a word.  Null and empty texts have no words.
    Repeated rows and null ids stay as they are; an empty table gives no rows;
    a long text is read word by word; other columns are ignored.
    """
    ship_package(docs.sparkSession)

    def run(it):
        machine, memo = _loaded(vocabulary)
        for b in it:
            rows = []
            for text in b.column(1).cast(pa.large_binary()):
                lengths = []
                for w in _WORD.findall((text.as_py() or b"").lower()):
                    n = memo.get(w)
                    if n is None:
                        n = machine.length(w)
                        if len(w) <= 64:
                            if len(memo) >= MEMO:
                                memo.clear()
                            memo[w] = n
                    lengths.append(n)
                stuck = lengths.count(-1)
                rows.append((len(lengths), sum(lengths) + 2 * stuck, stuck, max(1, *lengths) if lengths and len(lengths) > 1 else abs(lengths[0]) if lengths else 0))
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols)], names=["doc_id", "n_words", "n_pieces", "n_stuck", "longest"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, n_words long, n_pieces long, n_stuck long, longest long")
