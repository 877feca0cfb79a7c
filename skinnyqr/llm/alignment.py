"""Cross-tokenizer alignment by pointer jumping (operator 12).

Tokens of two tokenizers over the same bytes are nodes; two overlap when
their byte ranges do.  Every token points to its farthest-right overlapping
token.  Doubling the pointers of a whole batch of texts at once
(``succ = succ[succ]``) converges, in as many steps as the longest chain has
binary digits, to each component's last token, which labels the group.

Links and their corpus-wide counts: texts are encoded once and their links
written; pairs are counted per batch before the shuffle.  The commonest pairs
(at most MAX_PAIRS) go to every worker, rarer ones are joined.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .bpe import byte_alphabet
from .common import Scratch, save
from .hashtable import HashTable
from .shingles import bounded

#: Pairs of ids whose counts every worker may hold (17 bytes each).
MAX_PAIRS = 1_000_000
#: Bytes of text encoded at a time.
SLICE_BYTES = 1 << 19
_TOP = np.uint64(1 << 63)


#: How byte-level vocabularies cut a text into words.
_WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PLAIN = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}


def rank_encoding(path: str, marks: tuple[str, ...] = ()):
    """(tiktoken encoding or None, bytes of each id) of a byte-level vocabulary; ``marks`` get the next free ids.

    Where ids follow the order of the merges, as they do in the usual files,
    merging the pair with the smallest id is the same as merging by the list;
    tiktoken then encodes, on the ranks of this file, several times as fast as
    the library that reads the file itself.  Else None.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    byte_of = {c: i for i, c in enumerate(byte_alphabet())}
    vocab = spec["model"]["vocab"]
    texts = [b""] * (max(vocab.values()) + 1)
    for t, i in vocab.items():
        texts[i] = bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode()
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    made = [vocab[a + b] for a, b in merges]
    special = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {texts[i]: i for t, i in vocab.items() if t not in special}
    plain = not spec["normalizer"] and {k: (spec["pre_tokenizer"] or {}).get(k) for k in _PLAIN} == _PLAIN and not spec["model"].get("ignore_merges")
    if not plain or made != sorted(set(made)) or len(ranks) != len(made) + 256 or max(ranks[bytes([x])] for x in range(256)) > made[0]:
        return None, texts
    import tiktoken

    own = {m: len(texts) + i for i, m in enumerate(marks)}
    return tiktoken.Encoding("byte-level", pat_str=_WORDS, mergeable_ranks=ranks, special_tokens=own), texts + [m.encode() for m in marks]


@lru_cache(maxsize=2)
def byte_level(path: str):
    """(encode, bytes of each id) of a byte-level vocabulary; special strings are ordinary text."""
    encoding, texts = rank_encoding(path)
    if encoding is not None:
        return lambda batch: list(map(encoding.encode_ordinary, batch)), texts
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    tok.no_truncation()
    tok.no_padding()
    return lambda batch: [e.ids for e in tok.encode_batch_fast(batch, add_special_tokens=False)], texts


@lru_cache(maxsize=2)
def piece_level(path: str):
    """(encode, bytes of each id) of a piece vocabulary: U+2581 is a space, <0xHH> a byte."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in range(sp.get_piece_size())]
    return lambda batch: sp.encode(batch, num_threads=1), texts


def farthest(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """Successor of each token (A's, then B's): the overlapping token that ends last.

    A token's last byte lies in one token of the other side, which ends there
    or later.  Where both end together B's token is last and points to itself.
    """
    n = len(ends_a)
    of_a = n + np.searchsorted(ends_b, ends_a)
    at = np.searchsorted(ends_a, ends_b)
    of_b = np.where(ends_a[np.minimum(at, n - 1)] > ends_b, at, n + np.arange(len(ends_b))) if n else np.zeros(0, np.int64)
    return np.concatenate([of_a, of_b])


def jump(succ: np.ndarray) -> np.ndarray:
    """The end of each chain of successors, by doubling."""
    while True:
        further = succ[succ]
        if np.array_equal(further, succ):
            return succ
        succ = further


def groups(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group, numbered from 0 in order, of each token of A and of B."""
    n = len(ends_a)
    last = jump(farthest(ends_a, ends_b)) - n
    number = np.cumsum(last[n:] == np.arange(len(ends_b))) - 1
    return number[last[:n]], number[last[n:]]


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    count = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.int32, int(count.sum())), count


class Aligner:
    """Alignment of batches of texts between a byte-level and a piece vocabulary."""

    def __init__(self, path_a: str, path_b: str):
        (self.encode_a, self.bytes_a), (self.encode_b, self.bytes_b) = byte_level(path_a), piece_level(path_b)
        self.len_a = np.array([len(t) for t in self.bytes_a])
        self.len_b = np.array([len(t) for t in self.bytes_b])
        #: decimal ids with each of the signs that may follow: , | ; and none
        self.signed = [b"%d%s" % (i, s) for i in range(max(len(self.bytes_a), len(self.bytes_b))) for s in (b",", b"|", b";", b"")]

    def __call__(self, texts: list[str]) -> dict:
        """Ids of both sides of all texts, their groups and where texts and groups end; texts that disagree have none."""
        ids_a, ids_b = self.encode_a([" " + t for t in texts]), self.encode_b(texts)
        get_a, get_b = self.bytes_a.__getitem__, self.bytes_b.__getitem__
        for i, t in enumerate(texts):
            whole = b" " + t.encode()
            if not t or b"".join(map(get_a, ids_a[i])) != whole or b"".join(map(get_b, ids_b[i])) != whole:
                ids_a[i], ids_b[i] = [], []
        a, n_a = _flat(ids_a)
        b, n_b = _flat(ids_b)
        ends_a, ends_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        group_a, group_b = groups(ends_a, ends_b)
        size_a, size_b = np.bincount(group_a), np.bincount(group_b)
        last_a, last_b = np.cumsum(size_a) - 1, np.cumsum(size_b) - 1
        upto = np.append(0, group_b + 1)[np.cumsum(n_b)]  # groups up to the end of each text
        return {
            "a": a, "b": b, "n_a": n_a, "n_b": n_b, "group_a": group_a, "group_b": group_b, "ends": ends_b[last_b],
            "last_a": last_a, "last_b": last_b, "upto": upto, "n_groups": np.diff(upto, prepend=0),
        }

    def digests(self, x: dict) -> list[str]:
        """Digest of ``a1,a2|b1;a3|b2,b3`` of each text; without tokens an empty string."""
        a, b, last_a, last_b = x["a"], x["b"], x["last_a"], x["last_b"]
        sign_a, sign_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        sign_a[last_a], sign_b[last_b] = 1, 2
        final = x["upto"][x["n_groups"] > 0] - 1
        sign_b[last_b[final]] = 3
        codes = np.empty(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + np.append(0, last_b + 1)[x["group_a"]]] = a * 4 + sign_a
        codes[np.arange(len(b)) + (last_a + 1)[x["group_b"]]] = b * 4 + sign_b
        text = list(map(self.signed.__getitem__, codes.tolist()))
        cut = np.append(0, np.cumsum(x["n_a"] + x["n_b"])).tolist()
        return [hashlib.sha256(b"".join(text[i:j])).hexdigest() if j > i else "" for i, j in zip(cut, cut[1:])]


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def _aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(values))


_DOCS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = True, with_links: bool = False) -> DataFrame:
    """One row per row of ``docs``: token and group counts, and the digest of the groups.

    A encodes a space and the text by the byte-level vocabulary ``path_a``, B the
    text by the piece vocabulary ``path_b``, which adds that space.  Null and empty texts, and texts of which
    either side's joined bytes differ from the space and the text, have no
    tokens: zeros and an empty digest.  ``with_groups`` adds ``a_ids``,
    ``b_ids``, the group (from 0) of each token, ``a_group`` and ``b_group``,
    and ``group_end``, the byte of the text where each group ends.
    ``with_links`` adds the linked id pairs, ``a << 32 | b``, as bytes.
    """
    ship_package(docs.sparkSession)

    def run(it):
        aligner = _aligner(path_a, path_b)
        for batch in it:
            for part in bounded(batch, 1, SLICE_BYTES):
                x = aligner(["" if t is None else t for t in part.column(1).to_pylist()])
                n = x["n_groups"]
                out = [part.column(0), pa.array(x["n_a"]), pa.array(x["n_b"]), pa.array(n), pa.array(n), pa.array(aligner.digests(x), pa.string())]
                if with_groups:
                    before = np.append(0, x["upto"][:-1])
                    start = np.append(0, x["ends"])[before]  # bytes before each text
                    out += [_lists(x["a"], x["n_a"]), _lists(x["b"], x["n_b"])]
                    out += [_lists((x[f"group_{s}"] - np.repeat(before, x[f"n_{s}"])).astype(np.int32), x[f"n_{s}"]) for s in "ab"]
                    out += [_lists(x["ends"] - np.repeat(start, n) - 1, n)]
                if with_links:
                    pair = (x["a"][x["last_a"]].astype(np.int64) << 32) | x["b"][x["last_b"]]
                    cut = np.append(0, x["upto"]).tolist()
                    out += [pa.array([pair[i:j].tobytes() for i, j in zip(cut, cut[1:])], pa.binary())]
                yield pa.RecordBatch.from_arrays(out, names=names)

    schema = _DOCS + (", a_ids array<int>, b_ids array<int>, a_group array<int>, b_group array<int>, group_end array<long>" if with_groups else "")
    schema += ", links binary" if with_links else ""
    names = [c.split()[0] for c in schema.split(", ")]
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, schema)


def link_counts(aligned: DataFrame) -> DataFrame:
    """(pair, c, best): links of each id pair over all texts; best: c is the highest of the pair's B id."""

    def run(it):
        for batch in it:
            for b in bounded(batch, 0, 16 << 20):
                pairs = np.frombuffer(b"".join(x for x in b.column(0).to_pylist() if x), np.int64)
                p, c = np.unique(pairs, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(c, pa.int64())], names=["pair", "c"])

    counts = aligned.select("links").mapInArrow(run, "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c"))
    b_id = F.col("pair").bitwiseAND(0xFFFFFFFF)
    return counts.withColumn("b", b_id).withColumn("best", F.expr("c = max(c) OVER (PARTITION BY b)")).drop("b")


def _commonest(pairs: DataFrame, most: int) -> int:
    """Smallest power of two so that at most ``most`` pairs have that count or more; 0: all fit."""
    sizes = {r["s"]: r["count"] for r in pairs.groupBy(F.floor(F.log2("c")).cast("int").alias("s")).count().collect()}
    total, least = 0, 0
    for s in sorted(sizes, reverse=True):
        total += sizes[s]
        if total > most:
            return 1 << (s + 1)
    return least


def alignment_table(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`align`'s counts and digest of every row, with ``n_best`` and ``count_sum`` of its links.

    n_best: links whose pair has its B id's highest count over all texts, ties
    included; count_sum: the sum of those counts over the row's links.
    Repeated rows and ids count as often as they occur; an empty table gives no
    rows; other columns are ignored; very long texts are encoded one by one.
    """
    with Scratch(docs.sparkSession) as keep:
        aligned = align(docs, path_a, path_b, id_col, text_col, with_groups=False, with_links=True)
        aligned = keep.save(aligned.withColumn("nth", F.monotonically_increasing_id()), "aligned")
        pairs = keep.save(link_counts(aligned), "pairs")
        least = _commonest(pairs, MAX_PAIRS)
        held = pairs.filter(F.col("c") >= least).toArrow()
        keys = held.column("pair").to_numpy().view(np.uint64) | _TOP
        data = (keys, np.append(held.column("c").to_numpy(), 0), np.append(held.column("best").to_numpy(zero_copy_only=False), False))
        shipped = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, data))

        plain = [c for c in aligned.columns if c != "links"]
        names = [*plain, "n_best", "count_sum", "rare"]

        def run(it):
            table, count, best = _pair_table(shipped)
            for batch in it:
                for b in bounded(batch, len(plain)):
                    links = [x or b"" for x in b.column(len(plain)).to_pylist()]
                    cut = np.append(0, np.cumsum([len(x) // 8 for x in links])).astype(np.int64)
                    pair = np.frombuffer(b"".join(links), np.uint64)
                    at = table.find(pair | _TOP)
                    lost = at < 0
                    per = lambda v: np.diff(np.append(0, np.cumsum(v, dtype=np.int64))[cut])
                    sums = [pa.array(per(best[at])), pa.array(per(count[at])), _lists(pair[lost].view(np.int64), per(lost))]
                    yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(plain))] + sums, names=names)

        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in aligned.schema if f.name != "links")
        out = aligned.select(*plain, "links").mapInArrow(run, schema + ", n_best long, count_sum long, rare array<long>")
        if least:  # the rarer pairs' counts are joined
            out = keep.save(out, "sums")
            rare = out.select("nth", F.explode("rare").alias("pair")).groupBy("nth", "pair").agg(F.count("*").alias("k"))
            rare = rare.join(pairs.filter(F.col("c") < least), "pair").groupBy("nth")
            rare = rare.agg(F.sum(F.col("k") * F.col("best").cast("long")).alias("rb"), F.sum(F.col("k") * F.col("c")).alias("rc"))
            out = out.join(rare, "nth", "left")
            for c, more in (("n_best", "rb"), ("count_sum", "rc")):
                out = out.withColumn(c, F.col(c) + F.coalesce(more, F.lit(0)))
        return save(out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"), "alignments")


_PAIRS: dict[str, tuple] = {}


def _pair_table(shipped):
    """The lookup table of the broadcast pairs, built once per worker."""
    token, (keys, count, best) = shipped.value
    if token not in _PAIRS:
        _PAIRS.clear()
        _PAIRS[token] = (HashTable(keys), count, best)
    return _PAIRS[token]
