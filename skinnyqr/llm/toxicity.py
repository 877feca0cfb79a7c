"""Toxicity by noisy-channel deobfuscation.

A token with leetspeak, repeated letters or spaced letters becomes a lattice
of readings; Viterbi decoding under a character language model restores the
likeliest.  Words and word beginnings of the plain and restored text are
scored by a lexicon of log-odds that is learned from labelled rows, and a
logistic function of the strongest evidence gives the score.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import Scratch, broadcast_if_small
from .hashtable import HashTable
from .shingles import _LOWER, _ZOBRIST, bounded, mix64, text_bytes

#: Labelled rows that are learned from at most: those with the smallest hash of their id.
MAX_LABELLED = 60_000
#: A lexicon entry occurs in at least so many toxic documents, and is so many times (log) likelier there.
LEAST_TOXIC, LEAST_LOG_ODDS = 4, 2.5
#: Bytes of word beginnings that are entries of their own.
STEMS = (4, 5, 6)
PREDICT = 0.7
MAX_BROADCAST = 2_000_000
#: Words a worker remembers (some 300 bytes each), and bytes of text it looks at at once: its arrays take some 50 times as much.
MEMO = 100_000
SLICE_BYTES = 1 << 18

#: Fixed values of the channel: what a sign may stand for.
SIGNS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "¢": "c"}
#: Costs (natural log) of reading a sign as a letter, of dropping a mark between letters, of one letter for two and for three or more.
COST_SIGN, COST_MARK, COST_TWO, COST_MANY = 0.5, 0.3, 2.0, 0.2
MARKS = ".-_*~'"
_DECORATION = "!?.,;:()[]{}\"'`#%&*<>|+=/\\-_~"
_NO_SIGN = "".join(c for c in _DECORATION if c not in SIGNS)
#: Letters of the words that are looked for in a run of spaced letters.
SPACED = range(4, 25)

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in SIGNS if c.isascii()]] = True
_FIRM = _SIGN.copy()  # signs that count as obfuscation after a letter as well
_FIRM[[ord(c) for c in "!|+"]] = False
_SOLID = _LETTER | _FIRM  # what is never decoration
_DECORATES = np.zeros(256, bool)
_DECORATES[[ord(c) for c in _DECORATION]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(9, 14)]] = True
#: Classes of the character model: 0 anything else, 1..26 letters, others by their low bits.
_CLASS = np.zeros(256, np.int64)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[128:] = 27 + (np.arange(128, 256) & 31)


def _runs(raw: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the runs of ``inside`` bytes; a run never spans two texts."""
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    first = offs[:-1][offs[1:] > offs[:-1]]
    begin[first] = inside[first]
    starts = np.flatnonzero(begin)
    stop = np.flatnonzero(~inside)
    limit = np.append(stop, raw.size)
    ends = limit[np.searchsorted(limit, starts)]
    if len(starts):
        ends = np.minimum(ends, offs[np.searchsorted(offs, starts, side="right")])
    return starts, ends


def entry_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the word, hash) of every word and its beginnings."""
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    lengths = ends - starts
    total = int(lengths.sum())
    base = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    pos = np.arange(total) - np.repeat(base, lengths)
    body = raw[pos + np.repeat(starts, lengths)]
    vals = _ZOBRIST[((pos & 255) << 8) + body] * (2 * (pos >> 8) + 1).astype(np.uint64)
    n = np.arange(len(starts))
    out = [(n, mix64(np.add.reduceat(vals, base)))]
    for s in STEMS:
        long = lengths > s
        part = vals.copy()
        part[pos >= s] = 0
        out.append((n[long], mix64(np.add.reduceat(part, base)[long] + np.uint64(s))))
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


class Restorer:
    """Viterbi decoding of character lattices under a class trigram model (natural-log costs)."""

    def __init__(self, costs: np.ndarray):
        self.costs = costs.tolist()
        self.memo: dict[str, bytes] = {}

    def lattice(self, word: str) -> list[list[tuple[str, float]]]:
        """For each run of one character, its readings and their costs."""
        out = []
        for c, group in itertools.groupby(word):
            n = len(list(group))
            if c in SIGNS:
                reads = [(x * k, COST_SIGN * k) for x in SIGNS[c] for k in ((1, 2) if n > 1 else (1,))]
            elif c.isalpha():
                reads = [(c, 0.0)] if n == 1 else [(c * 2, 0.0), (c, COST_TWO)] if n == 2 else [(c * 2, COST_MANY), (c, COST_MANY)]
            else:
                reads = [("", COST_MARK * n)]
            out.append(reads)
        return out

    def restore(self, word: str) -> bytes:
        """The likeliest reading of an obfuscated word."""
        got = self.memo.get(word)
        if got is not None:
            return got
        best = {(0, 0): (0.0, b"")}
        for reads in [*self.lattice(word), [("\0", 0.0)]]:
            new: dict = {}
            for text, cost in reads:
                data = text.encode()
                for (a, b), (had, path) in best.items():
                    total, x, y = had + cost, a, b
                    for byte in data:
                        z = int(_CLASS[byte])
                        total += self.costs[(x * 64 + y) * 64 + z]
                        x, y = y, z
                    if (x, y) not in new or total < new[x, y][0]:
                        new[x, y] = (total, path + data)
            best = new
        got = min(best.values())[1][:-1]
        if len(self.memo) >= MEMO:
            self.memo.clear()
        if len(word) <= 64:
            self.memo[word] = got
        return got


def suspicious_words(raw: np.ndarray, offs: np.ndarray) -> list[tuple[int, str, bool]]:
    """(text index, word, spaced) of the words to be restored: signs among letters, doubled letters, spaced letters."""
    if raw.size == 0:
        return []
    letter, sign = _LETTER[raw], _SIGN[raw]
    ascii_letter = letter & (raw < 128)
    joint = np.ones(raw.size, bool)  # follows a byte of the same text
    joint[offs[:-1][offs[1:] > offs[:-1]]] = False
    odd = np.zeros(raw.size, bool)
    odd[:-1] |= sign[:-1] & letter[1:] & joint[1:]
    odd[1:] |= letter[:-1] & _FIRM[raw[1:]] & joint[1:]
    odd[1:] |= ascii_letter[1:] & (raw[1:] == raw[:-1]) & joint[1:]
    for c in (c.encode() for c in SIGNS if not c.isascii()):
        n = len(c)
        found = np.ones(max(raw.size - n + 1, 0), bool)
        for j, byte in enumerate(c):
            found &= raw[j : j + len(found)] == byte
        odd[: len(found)] |= found
    mark = np.isin(raw, np.frombuffer(MARKS.encode(), np.uint8))
    odd[4:] |= letter[:-4] & mark[1:-3] & letter[2:-2] & mark[3:-1] & letter[4:] & joint[1:-3] & joint[2:-2] & joint[3:-1] & joint[4:]  # i.d.i.o.t
    starts, ends = _runs(raw, offs, ~_SPACE[raw])
    count = np.concatenate([[0], np.cumsum(odd)])
    hit = np.flatnonzero(count[ends] > count[starts])
    doc = np.searchsorted(offs, starts, side="right") - 1
    out = []
    for i in hit:
        word = raw[starts[i] : ends[i]].tobytes().decode("utf-8", "replace").strip(_NO_SIGN)
        # '!', '|' and '+' at an edge are letters or decoration
        forms = {word}
        if word and (word[0] in _DECORATION or word[-1] in _DECORATION):
            forms |= {word.strip(_DECORATION), word.lstrip(_DECORATION), word.rstrip(_DECORATION)}
        for word in forms:
            kept = word.rstrip("$@")
            if len(word) - len(kept) > 2:  # a row of signs is decoration
                word = kept
            if word and not (word.isalpha() and not _twice(word)):
                out.append((int(doc[i]), word, False))
    # one letter or sign with nothing but decoration around it
    solid, around = _SOLID[raw], np.concatenate([[0], np.cumsum(_DECORATES[raw])])
    number, at = np.concatenate([[0], np.cumsum(solid)]), np.append(np.flatnonzero(solid), 0)
    one = (number[ends] - number[starts] == 1) & (around[ends] - around[starts] == ends - starts - 1)
    core = np.where(one, at[number[starts]], starts)
    single = one | ((ends - starts == 1) & sign[starts])
    if single.sum() >= 4:
        s = np.flatnonzero(single)
        group = np.cumsum(np.concatenate([[0], (np.diff(s) != 1) | (np.diff(doc[s]) != 0)]))
        for g in np.flatnonzero(np.bincount(group) >= 4):
            own = s[group == g] if len(s) < 10_000 else s[np.searchsorted(group, g) : np.searchsorted(group, g, side="right")]
            out.append((int(doc[own[0]]), raw[core[own]].tobytes().decode("utf-8", "replace"), True))
    return out


def _twice(word: str) -> bool:
    return any(a == b for a, b in zip(word, word[1:]))


def document_entries(col: pa.Array, restorer: Restorer) -> tuple[np.ndarray, np.ndarray]:
    """(text index, entry hash), each entry once per text, of the plain and the restored words."""
    raw, offs = text_bytes(col)
    raw = _LOWER[raw]
    starts, ends = _runs(raw, offs, _LETTER[raw])
    word, h = entry_hashes(raw, starts, ends)
    doc = (np.searchsorted(offs, starts, side="right") - 1)[word]
    odd = suspicious_words(raw, offs)
    if odd:
        texts, of = [], []
        for d, w, spaced in odd:
            text = restorer.restore(w.lower())
            # spaced letters have no ends of words: every part may be one
            own = {text, *(text[i : i + n] for n in SPACED for i in range(len(text) - n + 1))} if spaced else (text,)
            texts += own
            of += [d] * len(own)
        data = np.frombuffer(b"".join(texts), np.uint8)
        to = np.cumsum([len(t) for t in texts])
        full = np.array([len(t) > 0 for t in texts])
        at = np.array(of)[full]
        w2, h2 = entry_hashes(data, (to - [len(t) for t in texts])[full], to[full])
        doc, h = np.concatenate([doc, at[w2]]), np.concatenate([h, h2])
    return doc, h


def character_costs(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """-ln P(class | two classes before) with Witten-Bell smoothing, from all texts (64^3 counts)."""

    def run(it):
        n = np.zeros(64**3, np.int64)
        for b in it:
            for part in bounded(b, 0):
                raw, _ = text_bytes(part.column(0))
                for at in range(0, raw.size - 2, SLICE_BYTES):
                    c = _CLASS[_LOWER[raw[at : at + SLICE_BYTES + 2]]]
                    n += np.bincount((c[:-2] * 64 + c[1:-1]) * 64 + c[2:], minlength=64**3)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["at", "n"])

    got = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(64**3)
    n[got["at"].to_numpy()] = got["n"].to_numpy()
    tri = n.reshape(64, 64, 64)
    bi, uni = tri.sum(0), tri.sum((0, 1))
    p = (uni + 1) / (uni.sum() + 64)
    kinds = (bi > 0).sum(1, keepdims=True)
    p = (bi + (kinds + 1) * p) / (bi.sum(1, keepdims=True) + kinds + 1)
    kinds = (tri > 0).sum(2, keepdims=True)
    p = (tri + (kinds + 1) * p[None]) / (tri.sum(2, keepdims=True) + kinds + 1)
    return -np.log(p).ravel()


@dataclass
class ToxicModel:
    costs: np.ndarray
    keys: np.ndarray
    weights: np.ndarray
    beta: np.ndarray

    def tools(self) -> tuple[Restorer, HashTable]:
        if not hasattr(self, "_tools"):
            self._tools = (Restorer(self.costs), HashTable(self.keys))
        return self._tools

    def evidence(self, col: pa.Array) -> np.ndarray:
        """(n, 3): the strongest entry of each text, the next strongest ones' sum, and their number."""
        restorer, table = self.tools()
        n = len(col)
        out = np.zeros((n, 3))
        doc, h = document_entries(col, restorer)
        at = table.find(h) if len(self.keys) else np.full(len(h), -1)
        pair = np.unique(doc[at >= 0] * np.int64(len(self.keys) + 1) + at[at >= 0])
        d, w = pair // (len(self.keys) + 1), self.weights[pair % (len(self.keys) + 1)] if len(self.keys) else np.empty(0)
        np.maximum.at(out[:, 0], d, w)
        total = np.bincount(d, w, n)
        out[:, 1] = np.minimum(total - out[:, 0], 30.0) / 10
        out[:, 2] = np.log1p(np.bincount(d, minlength=n))
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.beta[0] + x @ self.beta[1:], -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.2) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    pen = ridge * np.eye(len(beta))
    pen[0, 0] = 1e-6
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        beta += np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + pen, x.T @ (y - p) - pen @ beta)
    return beta


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> ToxicModel:
    """Character model from all texts; lexicon and logistic weights from labelled rows outside the held-out third.

    Rows with a null label or id teach nothing; of repeated labels the largest holds.
    Without labels of both classes no text is predicted toxic.
    """
    ship_package(docs.sparkSession)
    costs = character_costs(docs, text_col)
    own = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    own = own.filter(~is_held_out(F.col("label_id"))).groupBy("label_id").agg(F.max("toxic").alias("toxic"))
    own = own.orderBy(F.xxhash64("label_id"), "label_id").limit(MAX_LABELLED)
    src = docs.select(F.col(id_col).cast("long").alias("label_id"), F.col(text_col).cast("string").alias("text"))
    rows = src.join(broadcast_if_small(own, MAX_BROADCAST), "label_id").select("text", "toxic")
    with Scratch(docs.sparkSession) as keep:
        return _fitted(keep.save(rows, "labelled"), costs)


def _fitted(rows: DataFrame, costs) -> ToxicModel:
    """The model of labelled texts (text, toxic)."""
    n_toxic, n_all = rows.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    # labels of one class, or without a telling word, can't call a text toxic: every score is a half at most
    prior = min(0.0, np.log((n_toxic + 0.5) / (n_all - n_toxic + 1.0)))
    none = ToxicModel(costs, np.empty(0, np.uint64), np.empty(0), np.array([prior, 0, 0, 0]))
    if not n_toxic or n_toxic == n_all:
        return none

    def counted(df: DataFrame, only: np.ndarray | None) -> DataFrame:
        def run(it):
            restorer = Restorer(costs)
            table = HashTable(only) if only is not None else None
            for b in it:
                for part in bounded(b, 0, SLICE_BYTES):
                    doc, h = document_entries(part.column(0), restorer)
                    if table is not None:
                        at = table.find(h)
                        doc, h = doc[at >= 0], h[at >= 0]
                    order = np.lexsort((doc, h))
                    doc, h = doc[order], h[order]
                    once = np.ones(len(h), bool)
                    once[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                    keys, n = np.unique(h[once], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

        return df.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))

    toxic = counted(rows.filter("toxic = 1"), None).filter(F.col("n") >= LEAST_TOXIC).toArrow()  # at most the toxic rows' entries / LEAST_TOXIC
    keys, pos = toxic["h"].to_numpy().view(np.uint64), toxic["n"].to_numpy()
    if not len(keys):
        return none
    clean = counted(rows.filter("toxic = 0"), keys).toArrow()
    table = HashTable(keys)
    neg = np.zeros(len(keys))
    neg[table.find(clean["h"].to_numpy().view(np.uint64))] = clean["n"].to_numpy()
    odds = np.log((pos + 0.5) / (n_toxic + 1)) - np.log((neg + 0.5) / (n_all - n_toxic + 1))
    strong = odds >= LEAST_LOG_ODDS
    model = ToxicModel(costs, keys[strong], odds[strong], np.zeros(4))

    def run(it):
        for b in it:
            for part in bounded(b, 0, SLICE_BYTES):
                x = model.evidence(part.column(0))
                yield pa.RecordBatch.from_arrays([*(pa.array(x[:, j]) for j in range(3)), part.column(1)], names=["a", "b", "c", "toxic"])

    got = rows.mapInArrow(run, "a double, b double, c double, toxic int").toArrow()  # at most MAX_LABELLED rows
    x = np.column_stack([got[c].to_numpy() for c in "abc"])
    return ToxicModel(costs, model.keys, model.weights, _logistic(x, got["toxic"].to_numpy().astype(float)))


def toxicity_scores(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    Null and empty texts have no evidence and get the score of none.
    Repeated rows get the same score; null ids stay null (held_out as the
    empty text); other columns are ignored.
    """
    spark = docs.sparkSession
    ship_package(spark)
    held = spark.sparkContext.broadcast(model)  # at most the toxic rows' entries, a character table

    def run(it):
        m = held.value
        for b in it:
            for part in bounded(b, 1, SLICE_BYTES):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(m.score(m.evidence(part.column(1))))], names=["doc_id", "score"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = src.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= PREDICT).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: ToxicModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns: a pass without a shuffle."""
    spark = docs.sparkSession
    ship_package(spark)
    held = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")  # the texts stay in Arrow's buffers: a pandas one would hold each of a batch twice more
    def score(texts: pa.Array) -> pa.Array:
        m = held.value
        batch = pa.RecordBatch.from_arrays([texts], names=["text"])
        out = [m.score(m.evidence(part.column(0))) for part in bounded(batch, 0, SLICE_BYTES)]
        return pa.array(np.concatenate(out) if out else np.empty(0))

    return docs.filter(score(F.col(text_col).cast("string")) < PREDICT)
