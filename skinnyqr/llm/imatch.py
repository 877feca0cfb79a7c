"""I-Match document fingerprints with randomised lexicons (operator 13).

* Lexicon: the terms (lower-cased words, cut at blanks and ``.,;:!?``) whose
  inverse document frequency ln(N / df) lies in a band.  Stop words and terms
  of hardly any document say little about copies.  The lower frequency is a
  share of all documents, so the lexicon has at most (mean number of distinct
  terms of a document) * e**high terms, however many documents there are.
* Signature: the sorted distinct lexicon terms of a text, hashed.
* Randomised lexicons: SUBSETS random subsets of the lexicon at densities 1,
  1/4, 1/16, ...; a subset's sorted terms that occur in the text are hashed.
  A fingerprint holds the two densities that leave about one term and a
  quarter of one, so it has one size for texts of every length.  Of the
  subsets that either of two texts has terms in, the share with equal hashes
  approaches the overlap of their term sets.
"""

from __future__ import annotations

import hashlib
import math
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package
from .collocations import word_spans
from .common import Scratch, save
from .hashtable import HashTable
from .shingles import bounded, mix64, text_bytes

#: Band of ln(N / df).
IDF_BAND = (2.0, 7.0)
#: Random subsets of the lexicon at each density.
SUBSETS = 32
#: With a smaller share of its distinct terms in the band, a text keeps all of them.
LEAST_SHARE = 0.125
#: Bytes of text of a range that one task sorts and compares.
RANGE_BYTES = 32 << 20

_SALTS = np.random.Generator(np.random.PCG64(13)).integers(0, 2**64, size=SUBSETS, dtype=np.uint64)
_LARGEST = (1 << 64) - 1


def _terms(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, term): the distinct terms of each text of a slice, sorted."""
    raw, offs = text_bytes(col)
    starts, _, hashes, _ = word_spans(raw, offs, 0) if len(raw) else (np.zeros(0, np.int64), None, np.zeros(0, np.uint64), None)
    text = np.searchsorted(offs, starts, side="right") - 1
    order = np.lexsort((hashes, text))
    text, hashes = text[order], hashes[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
    return text[new], hashes[new]


def lexicon(docs: DataFrame, band: tuple[float, float] = IDF_BAND, text_col: str = "text") -> tuple[np.ndarray, int]:
    """(sorted hashes of the terms in the band, bytes of all texts).

    Document frequencies cover all rows; a null text is empty.  The terms in
    the band come to the driver: at most (mean number of distinct terms of a
    row) * e**band[1], whatever the number of rows.
    """
    ship_package(docs.sparkSession)

    def run(it):
        for b in it:
            for part in bounded(b, 0):
                _, terms = _terms(part.column(0))
                h, c = np.unique(terms, return_counts=True)
                # term 0: rows and bytes of the slice
                size = pa.compute.sum(pa.compute.binary_length(part.column(0))).as_py() or 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.append(h, np.uint64(0)).view(np.int64)), pa.array(np.append(c, part.num_rows)), pa.array(np.append(np.zeros(len(h), np.int64), size))], names=["term", "df", "size"]
                )

    counts = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "term long, df long, size long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("size").alias("size"))
    with Scratch(docs.sparkSession) as keep:
        counts = keep.save(counts, "terms")
        total = counts.filter("term = 0").first()
        if total is None:
            return np.zeros(0, np.uint64), 0
        idf = F.log(F.lit(float(total["df"])) / F.col("df"))
        held = counts.filter((F.col("term") != 0) & idf.between(*band)).select("term").toArrow()
        return np.sort(held.column("term").to_numpy().view(np.uint64)), int(total["size"])


class Fingerprints:
    """Fingerprints of a list of texts: signature, density and SUBSETS * 2 entries of 16 bits (0: no term)."""

    def __init__(self, table: HashTable, col: pa.Array):
        n = len(col)
        self.signature, self.density = np.zeros(n, np.uint64), np.zeros(n, np.int64)
        self.entries = np.zeros((n, 2 * SUBSETS), np.uint16)
        text, terms = _terms(col)
        inside = table.find(terms) >= 0
        count = np.bincount(text, minlength=n)
        enough = np.bincount(text[inside], minlength=n) >= LEAST_SHARE * count
        keep = inside | ~enough[text]
        text, terms = text[keep], terms[keep]
        at = np.flatnonzero(np.diff(text, prepend=-1))
        some = text[at]
        # texts without a word: one term for the whole text
        bare = np.setdiff1d(np.arange(n), some)
        self.signature[bare] = [int.from_bytes(hashlib.sha256(t.encode()).digest()[:8], "little") for t in col.take(pa.array(bare)).fill_null("").to_pylist()]
        self.entries[bare] = (self.signature[bare] | np.uint64(1)).astype(np.uint16)[:, None]
        if not len(at):
            return
        size = np.diff(np.append(at, len(text)))
        self.density[some] = np.floor(np.log2(2.0 * size) / 2)  # about size / 4**density terms: a half to two
        place = np.arange(len(text)) - np.repeat(at, size)
        sorted_terms = mix64(terms + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.signature[some] = mix64(np.add.reduceat(sorted_terms, at))
        limit = np.array([_LARGEST >> (2 * d) for d in range(40)], np.uint64)[np.repeat(self.density[some], size)]
        for r, salt in enumerate(_SALTS):
            u = mix64(terms ^ salt)
            value = mix64(u + np.uint64(0x2545F4914F6CDD1D))
            for k in (0, 1):
                member = u <= (limit >> np.uint64(2 * k))
                total = np.add.reduceat(np.where(member, value, np.uint64(0)), at)
                entry = (mix64(total) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
                self.entries[some, k * SUBSETS + r] = np.where(np.add.reduceat(member.astype(np.int64), at) > 0, entry, 0)

    def texts(self) -> list[str]:
        rows = self.entries.astype(">u2").tobytes().hex()
        w = 8 * SUBSETS
        return [f"{s:016x}{d:02x}{rows[i * w : i * w + w]}" for i, (s, d) in enumerate(zip(self.signature.tolist(), self.density.tolist()))]


def _read(col: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, density, entries) of fingerprints as text."""
    raw = np.frombuffer(bytes.fromhex("".join(col)), np.uint8).reshape(len(col), 9 + 4 * SUBSETS)
    return raw[:, :8].copy().view(">u8")[:, 0], raw[:, 8].astype(np.int64), raw[:, 9:].copy().view(">u2")


def _likeness(sig_a, den_a, ent_a, sig_b, den_b, ent_b) -> np.ndarray:
    lo, hi = slice(0, SUBSETS), slice(SUBSETS, None)
    ahead = (den_b == den_a + 1)[:, None], (den_a == den_b + 1)[:, None]
    a = np.where(ahead[0], np.hstack([ent_a[:, hi], 0 * ent_a[:, hi]]), ent_a)
    b = np.where(ahead[0], np.hstack([ent_b[:, lo], 0 * ent_b[:, lo]]), ent_b)
    a = np.where(ahead[1], np.hstack([ent_a[:, lo], 0 * ent_a[:, lo]]), a)
    b = np.where(ahead[1], np.hstack([ent_b[:, hi], 0 * ent_b[:, hi]]), b)
    either = ((a != 0) | (b != 0)).sum(axis=1)
    equal = ((a == b) & (a != 0)).sum(axis=1)
    share = np.where(np.abs(den_a - den_b) <= 1, equal / np.maximum(either, 1), 0.0)
    return np.where(sig_a == sig_b, 1.0, share)


@F.pandas_udf(T.DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """Likeness, 0 to 1, of two fingerprints; 1 if their signatures are equal."""
    return pd.Series(_likeness(*_read(a), *_read(b)), dtype="float64")


_TABLES: dict[str, HashTable] = {}


def _ship(docs: DataFrame, terms: np.ndarray):
    return docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, terms))


def _table(shipped) -> HashTable:
    """The lexicon's lookup table, built once per worker."""
    token, terms = shipped.value
    if token not in _TABLES:
        _TABLES.clear()
        _TABLES[token] = HashTable(terms)
    return _TABLES[token]


def fingerprints(docs: DataFrame, terms: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every row under the lexicon ``terms``; map-only.

    Equal texts have equal fingerprints; a null text is empty; a text without a
    word is one term of its own; a text with less than LEAST_SHARE of its
    distinct terms in the lexicon keeps all of them.
    """
    ship_package(docs.sparkSession)
    shipped = _ship(docs, terms)

    def run(it):
        for b in it:
            for part in bounded(b, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(Fingerprints(_table(shipped), part.column(1)).texts(), pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, fingerprint string")


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [c.split()[0] for c in _OUT.split(", ")]


def _edits(table: HashTable, ids: list, texts: list[str], following: list[str]) -> list[pa.Array]:
    """The columns of ``_OUT`` for texts and the texts that follow them."""
    edited = [t[: len(t) - len(t) // 4] + f[: len(t) // 4] for t, f in zip(texts, following)]
    own, other = Fingerprints(table, pa.array(texts, pa.string())), Fingerprints(table, pa.array(edited, pa.string()))
    after = own if not following else Fingerprints(table, pa.array(following[-1:], pa.string()))
    nxt = [np.concatenate([x[1:], y]) for x, y in zip((own.signature, own.density, own.entries), (after.signature, after.density, after.entries))]
    mine = (own.signature, own.density, own.entries)
    return [
        pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()), pa.array(own.texts(), pa.string()), pa.array(other.texts(), pa.string()),
        pa.array(_likeness(*mine, other.signature, other.density, other.entries)), pa.array(_likeness(*mine, *nxt)),
    ]


def edit_probe(docs: DataFrame, band: tuple[float, float] = IDF_BAND, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's fingerprint beside that of its edited text and of the next row.

    Rows are ordered by id, then by a hash of the text (null ids first; equal rows follow one another); after
    the last comes the first.  The edited text has the last floor(n_chars / 4)
    characters replaced by the first as many (or all) of the next row's text.
    Rows are dealt by ranges of that order and compared inside their range; the
    last row of a range meets the first of the next in a join of these few
    rows.  A null text is empty; an empty table gives no rows; a single row
    follows itself; other columns are ignored.
    """
    spark = docs.sparkSession
    terms, size = lexicon(docs, band, text_col)
    shipped = _ship(docs, terms)
    parts = max(spark.sparkContext.defaultParallelism, math.ceil(size / RANGE_BYTES))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    order = ["id", "tie", "nth"]
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("nth", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("id", "text")
    edge = ", part long, role string, text string"
    names = [*_NAMES, "part", "role", "text"]
    none = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(it):
        from pyspark import TaskContext

        table, part, last = _table(shipped), TaskContext.get().partitionId(), None

        def at_edge(role, doc_id, text):
            cols = [pa.array([doc_id], pa.int64()), *(pa.nulls(1, t) for t in none[1:]), pa.array([part], pa.int64()), pa.array([role]), pa.array([text], pa.string())]
            return pa.RecordBatch.from_arrays(cols, names=names)

        for batch in it:
            for b in bounded(batch, 1):
                ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
                if last is None:
                    yield at_edge("first", ids[0], texts[0])
                else:
                    ids.insert(0, last[0])
                    texts.insert(0, last[1])
                last = (ids.pop(), texts.pop())
                if ids:
                    n = len(ids)
                    done = _edits(table, ids, texts, [*texts[1:], last[1]])
                    yield pa.RecordBatch.from_arrays([*done, pa.array([part] * n, pa.int64()), pa.array(["row"] * n), pa.nulls(n, pa.string())], names=names)
        if last is not None:
            yield at_edge("last", *last)

    with Scratch(spark) as keep:
        out = keep.save(rows.mapInArrow(run, _OUT + edge), "ranges")
        used = sorted(r["part"] for r in out.filter("role = 'first'").select("part").collect())  # one number a range
        follows = spark.createDataFrame(list(zip(used, [*used[1:], *used[:1]])), "part long, next_part long")
        firsts = out.filter("role = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
        edges = out.filter("role = 'last'").select("part", "doc_id", "text").join(F.broadcast(follows), "part").join(firsts, "next_part")

        def close(it):
            table = _table(shipped)
            for b in it:
                ids, texts, nxt = (b.column(i).to_pylist() for i in range(3))
                for row in zip(ids, texts, nxt):
                    yield pa.RecordBatch.from_arrays(_edits(table, *([x] for x in row)), names=_NAMES)

        closed = edges.select("doc_id", "text", "next_text").mapInArrow(close, _OUT)
        return save(out.filter("role = 'row'").select(*_NAMES).unionByName(closed), "fingerprints")
