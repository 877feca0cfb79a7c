"""Phrase collocation mining with counting quotient filters (operator 11).

1. Words are counted per language by 64-bit hashes (that no two words share
   one is checked; else another hash is taken).  Only words with the least
   count can be in a candidate; they get dense ids.
2. The texts are written once as word ids, 0 where a piece ends or a rarer
   word stands.
3. For n = 2, 3, ...: every task counts its n-grams of ids in a counting
   quotient filter (:mod:`.cqf`), cut by the leading bits of the permuted
   keys; the sorted filters of one range are merged.  An n-gram is counted
   only where both of its (n-1)-grams passed a bit table of frequent ones.
   That table has a fixed size: it may let too much through, never too
   little, and the least count is checked on the merged, exact counters.
4. Cuts, scores, maximality and ranks are joins and windows over the
   frequent phrases.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from . import cqf
from .common import Scratch, save
from .hashtable import HashTable
from .shingles import _FAR, _LOWER, _POS, _ZOBRIST, bounded, mix64, text_bytes

#: Words whose ids every worker may hold; with more, ids are joined to buckets of texts instead.
MAX_SHIPPED_WORDS = 1_000_000
#: Texts of one bucket in that case, in bytes.
BUCKET_BYTES = 4 << 20
#: log2 of the bits of the table of frequent n-grams that prunes longer ones (8 MB, whatever the data).
TABLE_BITS = 26
#: Entries a task holds in one filter before it emits it, and word occurrences behind one range of merged filters.
TASK_ENTRIES, RANGE_WORDS = 2_000_000, 2_000_000
#: Widest word id, so that five fit into a key.
MAX_ID_BITS = 24

_LETTER, _BLANK, _END = 0, 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = _BLANK
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = _END


def word_spans(raw: np.ndarray, offs: np.ndarray, seed: int):
    """(starts, lengths, hashes, new): the words of the texts; ``new`` where a word starts a piece."""
    kind = _KIND[raw]
    letter = kind == _LETTER
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    heads = offs[:-1][offs[1:] > offs[:-1]]
    first[heads] = letter[heads]  # a word never spans two texts
    starts = np.flatnonzero(first)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), np.zeros(0, bool)
    span = np.diff(np.append(starts, len(raw)))
    body = slice(int(starts[0]), None)
    pos = np.arange(starts[0], len(raw), dtype=np.int64) - np.repeat(starts, span)
    vals = _ZOBRIST[((pos & (_POS - 1)) << 8) + _LOWER[raw[body]]]
    if span.max() > _POS:
        far = pos >= _POS
        powers = np.multiply.accumulate(np.full(int(pos.max() >> 8) + 1, _FAR, np.uint64))
        vals[far] *= powers[pos[far] >> 8]
    inside = letter[body]
    # the blanks behind a word are not in it: a run of letters ends where letters stop
    vals[~inside] = 0
    hashes = np.add.reduceat(vals, starts - starts[0])
    hashes = mix64(hashes + np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    lengths = np.add.reduceat(inside.astype(np.int64), starts - starts[0])
    # pieces: how many ends lie before each word
    ends = np.cumsum(kind == _END, dtype=np.int64)[starts]
    text = np.searchsorted(offs, starts, side="right")
    new = np.ones(len(starts), bool)
    new[1:] = (ends[1:] != ends[:-1]) | (text[1:] != text[:-1])
    return starts, lengths, hashes | np.uint64(1), new


def _by_lang(batch: pa.RecordBatch, seed: int):
    """(lang, raw bytes, starts, lengths, hashes, new) of bounded slices, one language at a time."""
    for part in bounded(batch, 1):
        langs = part.column(0)
        for lang in langs.unique().to_pylist():
            rows = part.filter(pa.compute.equal(langs, lang))
            raw, offs = text_bytes(rows.column(1))
            if len(raw):
                yield lang, raw, *word_spans(raw, offs, seed)


def _source(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def _words(src: DataFrame, seed: int) -> DataFrame:
    """(lang, h, word, c): the distinct words of bounded slices of texts with their counts there."""

    def run(it):
        for b in it:
            for lang, raw, starts, lengths, hashes, _ in _by_lang(b, seed):
                if not len(starts):
                    continue
                h, at, c = np.unique(hashes, return_index=True, return_counts=True)
                low = _LOWER[raw].tobytes()
                words = [low[s : s + n] for s, n in zip(starts[at].tolist(), lengths[at].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(h), pa.string()), pa.array(h.view(np.int64)), pa.array(words, pa.binary()).cast(pa.string()), pa.array(c, pa.int64())],
                    names=["lang", "h", "word", "c"],
                )

    return src.mapInArrow(run, "lang string, h long, word string, c long")


_TABLES: dict[str, dict] = {}


def _tables(shipped) -> dict:
    """The lookup tables of a broadcast vocabulary, built once per worker."""
    token, vocab = shipped.value
    if token not in _TABLES:
        _TABLES.clear()
        _TABLES[token] = {lang: (HashTable(h), np.append(i, 0).astype(np.int64)) for lang, (h, i) in vocab.items()}
    return _TABLES[token]


def _ids_of(hashes: np.ndarray, new: np.ndarray, ids: np.ndarray, wide: bool) -> bytes:
    """Word ids with a 0 before each piece."""
    out = np.zeros(len(hashes) + int(new.sum()), np.int32 if wide else np.uint16)
    out[np.arange(len(hashes)) + np.cumsum(new)] = ids
    return out.tobytes()


_ENCODED = "lang string, n long, ids binary"


def _row(lang: str, n: int, ids: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([n], pa.int64()), pa.array([ids], pa.binary())], names=["lang", "n", "ids"])


def _encode_shipped(src: DataFrame, vocab: DataFrame, seed: int, wide: bool) -> DataFrame:
    """Texts as ids by a vocabulary that every worker holds (its size has been checked)."""
    rows = vocab.select("lang", "h", "id").toArrow()
    parts = {}
    for lang in rows.column("lang").unique().to_pylist():
        mine = rows.filter(pa.compute.equal(rows.column("lang"), lang))
        parts[lang] = (mine.column("h").to_numpy().view(np.uint64), mine.column("id").to_numpy().astype(np.int32))
    shipped = src.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, parts))

    def run(it):
        tables = _tables(shipped)
        for b in it:
            for lang, _, _, _, hashes, new in _by_lang(b, seed):
                if lang in tables:
                    table, ids = tables[lang]
                    yield _row(lang, len(hashes), _ids_of(hashes, new, ids[table.find(hashes)], wide))
                elif len(hashes):
                    yield _row(lang, len(hashes), b"")

    return src.mapInArrow(run, _ENCODED)


def _encode_joined(src: DataFrame, vocab: DataFrame, seed: int, wide: bool, keep: Scratch) -> DataFrame:
    """Texts as ids for a vocabulary of any size: each bucket of texts meets the ids of its own words."""
    mean = src.agg(F.avg(F.octet_length("text"))).first()[0] or 1.0
    rows = max(1, int(BUCKET_BYTES / max(1.0, mean)))
    nth = F.monotonically_increasing_id()
    bucket = F.shiftleft(F.shiftright(nth, 33), 33) + F.floor(nth.bitwiseAND((1 << 33) - 1) / rows)
    src = keep.save(src.withColumn("bucket", bucket), "bucketed")  # written, so that both reads see the same buckets

    def distinct(it):
        for b in it:
            for bucket in b.column(2).unique().to_pylist():
                part = b.filter(pa.compute.equal(b.column(2), bucket))
                for lang, _, _, _, hashes, _ in _by_lang(part, seed):
                    h = np.unique(hashes).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([bucket] * len(h), pa.int64()), pa.array([lang] * len(h), pa.string()), pa.array(h)], names=["bucket", "lang", "h"])

    used = src.mapInArrow(distinct, "bucket long, lang string, h long").distinct()
    known = used.join(vocab.select("lang", "h", "id"), ["lang", "h"]).select("bucket", "lang", "h", "id")

    def run(texts: pa.Table, words: pa.Table) -> pa.Table:
        out = []
        for b in texts.combine_chunks().to_batches():
            for lang, _, _, _, hashes, new in _by_lang(b, seed):
                mine = words.filter(pa.compute.equal(words.column("lang"), lang))
                h = mine.column("h").to_numpy().view(np.uint64)
                order = np.argsort(h)
                h, ids = h[order], mine.column("id").to_numpy()[order]
                found = np.zeros(len(hashes), np.int64)
                if len(h):
                    at = np.minimum(np.searchsorted(h, hashes), len(h) - 1)
                    found = np.where(h[at] == hashes, ids[at], 0)
                out.append(_row(lang, len(hashes), _ids_of(hashes, new, found, wide)))
        return pa.Table.from_batches(out, schema=_row("", 0, b"").schema)

    return src.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(run, _ENCODED)


def _bit_of(left: np.ndarray, right: np.ndarray, lang: str) -> np.ndarray:
    salt = np.uint64(int.from_bytes(lang.encode()[:8].ljust(8, b"\1"), "little"))
    return mix64(mix64(left ^ salt) + right) & np.uint64((1 << TABLE_BITS) - 1)


def _ngram_starts(ids: np.ndarray, n: int, bits: int, lang: str, table: np.ndarray | None):
    """Keys of the n-grams without a 0, of those only whose two (n-1)-grams are in the table."""
    at = np.flatnonzero(ids[: len(ids) - n + 1] != 0) if len(ids) >= n else np.zeros(0, np.int64)
    for j in range(1, n):
        at = at[ids[at + j] != 0]
    if table is not None and len(at):
        for shift in (0, 1):
            left, right, _ = cqf.pack([ids[at + shift + j] for j in range(n - 1)], bits)
            b = _bit_of(left, right, lang)
            at = at[(table[(b >> np.uint64(6)).astype(np.int64)] >> (b & np.uint64(63))) & np.uint64(1) != 0]
    return cqf.pack([ids[at + j] for j in range(n)], bits)


def _filters(encoded: DataFrame, n: int, bits: int, wide: bool, range_bits: int, shipped) -> DataFrame:
    """(lang, rng, filter): each task's counting quotient filters of its n-grams, cut into ranges."""

    def run(it):
        table = shipped.value if shipped is not None else None
        held: dict[str, list[cqf.QuotientFilter]] = {}

        def emit(lang):
            parts = list(cqf.merge(held.pop(lang)).split(range_bits))
            return pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(parts), pa.string()), pa.array([p.prefix for p in parts], pa.int64()), pa.array([p.to_bytes() for p in parts], pa.binary())],
                names=["lang", "rng", "filter"],
            )

        for b in it:
            for lang, raw in zip(b.column(0).to_pylist(), b.column(2)):
                ids = np.frombuffer(raw.as_buffer(), np.int32 if wide else np.uint16)
                left, right, half = _ngram_starts(ids, n, bits, lang, table)
                if not len(left):
                    continue
                held.setdefault(lang, []).append(cqf.QuotientFilter.of(left, right, half))
                if len(held[lang]) > 1 and sum(map(len, held[lang])) > TASK_ENTRIES:
                    held[lang] = [cqf.merge(held[lang])]
                if sum(len(f) for fs in held.values() for f in fs) > 2 * TASK_ENTRIES:
                    yield emit(max(held, key=lambda x: sum(map(len, held[x]))))
        for lang in list(held):
            yield emit(lang)

    return encoded.mapInArrow(run, "lang string, rng long, filter binary")


def _merged(filters: DataFrame, n: int, bits: int, least: int) -> DataFrame:
    """(lang, ids, a, bit): the n-grams with the least count, from the merged filters of each range."""

    def run(group: pa.Table) -> pa.Table:
        lang = group.column("lang")[0].as_py()
        f = cqf.merge([cqf.QuotientFilter.from_bytes(x.as_buffer()) for c in group.column("filter").chunks for x in c]).at_least(least)
        left, right = f.keys()
        ids = np.stack(cqf.unpack(left, right, n, bits), axis=1).astype(np.int32)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(f) + 1, dtype=np.int32) * n), pa.array(ids.reshape(-1)))
        bit = _bit_of(left, right, lang).astype(np.int64)
        return pa.table({"lang": pa.array([lang] * len(f), pa.string()), "ids": flat, "a": f.counts, "bit": bit})

    return filters.groupBy("lang", "rng").applyInArrow(run, "lang string, ids array<int>, a long, bit long")


def _bit_table(frequent: DataFrame) -> np.ndarray:
    """The bits of the frequent n-grams: 2**TABLE_BITS bits, at most that / 64 rows to the driver."""
    words = frequent.groupBy(F.shiftright("bit", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 AS int))")).alias("m")).toArrow()
    out = np.zeros(1 << (TABLE_BITS - 6), np.uint64)
    out[words.column("w").to_numpy()] = words.column("m").to_numpy().view(np.uint64)
    return out


def phrase_counts(docs: DataFrame, keep: Scratch, min_count: int = 100, max_words: int = 5, lang_col: str = "lang", text_col: str = "text"):
    """(phrases, vocabulary, totals): (lang, ids, a) of phrases of 1 to ``max_words`` words, (lang, id, word), (lang, n)."""
    ship_package(docs.sparkSession)
    src = _source(docs, lang_col, text_col)
    for seed in range(8):
        counts = _words(src, seed).groupBy("lang", "h").agg(F.sum("c").alias("a"), F.min("word").alias("word"), F.max("word").alias("other"))
        words = keep.save(counts.filter((F.col("a") >= min_count) | (F.col("word") != F.col("other"))), "words")
        if words.filter("word <> other").isEmpty():  # else two words share a hash: take another hash
            break
    else:  # pragma: no cover
        raise RuntimeError("words share a hash under every seed")
    size = words.count()
    # dense ids without one global window: numbered within parts, interleaved
    parts = size // 200_000 + 1
    part = F.pmod("h", F.lit(parts))
    nth = F.row_number().over(Window.partitionBy("lang", part).orderBy(F.desc("a"), "h"))
    vocab = keep.save(words.select("lang", "h", "word", "a", ((nth - 1) * parts + part + 1).cast("long").alias("id")), "vocabulary")
    top = vocab.agg(F.max("id")).first()[0] or 1
    bits = max(2, int(top).bit_length() + int(top).bit_length() % 2)
    if bits > MAX_ID_BITS:
        raise ValueError(f"a language has more than 2**{MAX_ID_BITS} words with {min_count} occurrences; raise min_count")
    wide = bits > 16
    joined = size > MAX_SHIPPED_WORDS
    encoded = keep.save(_encode_joined(src, vocab, seed, wide, keep) if joined else _encode_shipped(src, vocab, seed, wide), "encoded")
    totals = keep.save(encoded.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    most = totals.agg(F.max("n")).first()[0] or 0
    phrases = [vocab.select("lang", F.array(F.col("id").cast("int")).alias("ids"), "a")]
    table = None
    for n in range(2, max_words + 1):
        ranges = min(max(3, math.ceil(math.log2(max(1.0, most / RANGE_WORDS)))), n * bits // 2)
        shipped = docs.sparkSession.sparkContext.broadcast(table) if table is not None else None
        frequent = keep.save(_merged(_filters(encoded, n, bits, wide, ranges, shipped), n, bits, min_count), f"phrases{n}")
        phrases.append(frequent.select("lang", "ids", "a"))
        if n < max_words:
            table = _bit_table(frequent)
    out = phrases[0]
    for p in phrases[1:]:
        out = out.unionByName(p)
    return out, vocab.select("lang", "id", "word"), totals


def collocations(
    docs: DataFrame, min_count: int = 100, max_words: int = 5, top: int = 2000, percent: int = 100, lang_col: str = "lang", text_col: str = "text"
) -> DataFrame:
    """Each language's best ``top`` phrases: (lang, rank, phrase, a, l, r, n, score).

    Texts are lower-cased (A-Z), cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and
    those into words ``[^\\x20\\x09]+``.  Candidates are phrases of 2 to
    ``max_words`` words inside a piece with ``a >= min_count`` occurrences,
    overlapping ones included.  A cut after k words has l and r occurrences of
    its parts; the score is floor(1000 a n / (l r)) of the cut that scores
    least (ties: smallest k), in exact decimal arithmetic.  Candidates inside
    a longer one with ``100 f(longer) >= percent * a`` are dropped (if any
    longer phrase does so, one with one word more does, so only those are
    compared).  Order: score, a descending, phrase in byte order.

    A null text is empty, a null language ``und``; empty texts and empty tables
    give no rows; texts of any length are cut into words in bounded memory;
    repeated rows and ids count as often as they occur; other columns are
    ignored.  The result is a written table; all others are deleted.
    """
    with Scratch(docs.sparkSession) as keep:
        phrases, vocab, totals = phrase_counts(docs, keep, min_count, max_words, lang_col, text_col)
        cand = phrases.filter(F.size("ids") > 1)
        cuts = cand.select("lang", "ids", "a", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
        cuts = cuts.withColumn("head", F.slice("ids", 1, F.col("k"))).withColumn("tail", F.slice("ids", F.col("k") + 1, F.size("ids") - F.col("k")))
        cuts = cuts.join(phrases.select("lang", F.col("ids").alias("head"), F.col("a").alias("l")), ["lang", "head"])
        cuts = cuts.join(phrases.select("lang", F.col("ids").alias("tail"), F.col("a").alias("r")), ["lang", "tail"])
        big = lambda c: f"cast({c} AS decimal(19, 0))"
        score = F.expr(f"cast(cast(1000 * {big('a')} AS decimal(22, 0)) * cast(n AS decimal(15, 0)) AS decimal(38, 0)) div ({big('l')} * cast(r AS decimal(18, 0)))")
        cuts = cuts.join(F.broadcast(totals) if totals.count() <= 100_000 else totals, "lang").withColumn("score", score)
        best = cuts.groupBy("lang", "ids", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
        inner = F.array(F.slice("ids", 1, F.size("ids") - 1), F.slice("ids", 2, F.size("ids") - 1))
        longer = cand.filter(F.size("ids") > 2).select("lang", F.explode(inner).alias("ids"), F.col("a").alias("f")).groupBy("lang", "ids").agg(F.max("f").alias("f"))
        best = best.join(longer, ["lang", "ids"], "left").filter(F.col("f").isNull() | (100 * F.col("f") < percent * F.col("a")))
        best = best.select("lang", "ids", "a", "n", F.col("cut.score").cast("long").alias("score"), "cut.l", "cut.r")
        # ties at the end of the list stay until their phrases are spelled out
        by_score = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
        best = keep.save(best.withColumn("place", F.rank().over(by_score)).filter(F.col("place") <= top).drop("place"), "best")
        spelled = best.select("lang", "ids", F.posexplode("ids").alias("i", "id")).join(vocab, ["lang", "id"])
        spelled = spelled.groupBy("lang", "ids").agg(F.array_sort(F.collect_list(F.struct("i", "word"))).alias("w"))
        named = best.join(spelled, ["lang", "ids"]).withColumn("phrase", F.array_join(F.col("w.word"), " "))
        order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
        out = named.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
        return save(out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
