"""LM scoring by prediction by partial matching.

Spark counts the byte n-grams of the training texts; the trie of contexts
(up to ORDER bytes) gets escape estimates (method C) and symbol exclusion:
after an escape, symbols seen in the longer context have no share in the
shorter one.  Because symbols seen in a context are seen in every shorter
one, what exclusion changes depends on the context alone and is computed
with the model, so a text is scored by bulk lookups.

The trie holds every n-gram of the training texts, in written tables by
order.  The probabilities of the distinct n-grams of all texts are computed
there by joins.  Those of frequent n-grams, of proven number, are broadcast;
the others of a text are joined with the written table, so nothing is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .common import save
from .hashtable import HashTable
from .shingles import bounded, text_bytes, word_hashes

ORDER = 5
#: Least share of the n-grams of all texts that one is broadcast for; rarer ones are joined.
GRAM_RATE = 2.5e-7
#: Least share of the training words that a word is broadcast for; rarer words are joined.
WORD_RATE = 2.5e-7
END = b"\n"  # no word holds it
END_WORD = 0x1D872B41F3A9C6E5
TAG = np.uint64(1 << 63)  # no key of a hash table is 0
FLUSH = 3_000_000


def normal(text: bytes) -> bytes:
    """A-Z lower-cased, words joined by one blank, and the end."""
    return b" ".join(text.lower().split()) + END


def _grams(raw: np.ndarray) -> np.ndarray:
    """The ORDER + 1 bytes up to each position (from the ORDER-th on) as one integer."""
    n = len(raw) - ORDER
    out = np.zeros(n, np.uint64)
    for j in range(ORDER + 1):
        out = out << np.uint64(8) | raw[j : j + n].astype(np.uint64)
    return out


def _stream(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with ORDER ends before each text, its n-grams, offsets of the texts' n-grams)."""
    pad = END * ORDER
    texts = [normal(t.as_py() or b"") for t in col.cast(pa.large_binary())]
    raw = np.frombuffer(b"".join(pad + t for t in texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    grams = _grams(raw) if len(raw) else np.empty(0, np.uint64)
    # drop the n-grams that end in a pad
    begin = np.concatenate([[0], np.cumsum(sizes + ORDER)])[:-1]
    offs = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(offs[-1], dtype=np.int64) + np.repeat(begin - offs[:-1], sizes)
    return raw, grams[at], offs


def _counts(docs: DataFrame) -> DataFrame:
    """(kind, key, n): words (kind 0, by 64-bit hash, the end among them) and n-grams (kind 1) of the texts.

    With a second column, only rows where it is true count so; n-grams of the others are of kind 2.
    """

    def unique(parts, kind):
        keys, n = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["kind", "key", "n"])

    def run(it):
        parts, held = [[], [], []], 0
        for b in it:
            for part in bounded(b, 0):
                col = part.column(0)
                train = part.column(1) if part.num_columns > 1 else pa.array([True] * len(col))
                other = col.filter(pc.invert(train))
                col = col.filter(train)
                words, _ = word_hashes(*text_bytes(col))
                parts[0] += [words, np.full(len(col), END_WORD, np.uint64)]
                for kind, c in ((1, col), (2, other)):
                    _, grams, _ = _stream(c)
                    parts[kind].append(grams)
                    held += len(grams)
                if held > FLUSH:
                    yield from (unique(p, kind) for kind, p in enumerate(parts))
                    parts, held = [[], [], []], 0
        if parts[0]:
            yield from (unique(p, kind) for kind, p in enumerate(parts))

    return docs.mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _low(key, size: int) -> Column:
    """The last ``size`` bytes of an integer."""
    return F.col(key).bitwiseAND(F.lit((1 << 8 * size) - 1))


def _orders(grams: DataFrame) -> dict[int, DataFrame]:
    """For each order k: (key, n, up) of every n-gram of k + 1 bytes; up is the count of its last k bytes."""
    out, src = {}, grams
    for k in range(ORDER, -1, -1):
        up = F.sum("n").over(Window.partitionBy(_low("key", k))) if k else F.lit(0).cast("long")
        out[k] = save(src.select("key", "n", up.alias("up")), f"order{k}")
        src = out[k].select(_low("key", k).alias("key"), F.col("up").alias("n")).distinct()
    return out


def trie(grams: DataFrame, total: int = 0) -> DataFrame:
    """(k, ctx, sym, n, all): all symbols of each context of k bytes, and the context's whole count; nothing depends on ``total``."""
    out = None
    for k, level in _orders(grams).items():
        own = level.select(F.lit(k).alias("k"), F.shiftrightunsigned("key", 8).alias("ctx"), _low("key", 1).alias("sym"), "n")
        own = own.join(own.groupBy("k", "ctx").agg(F.sum("n").alias("all")), ["k", "ctx"])
        out = own if out is None else out.unionByName(own)
    return out


def _contexts(orders: dict[int, DataFrame]) -> dict[int, DataFrame]:
    """For each order: (ctx, whole, q, found, missed) of every context: its count, its symbols, and what an escape from it adds."""
    out = {}
    for k in range(ORDER + 1):
        own = orders[k].groupBy(F.shiftrightunsigned("key", 8).alias("ctx")).agg(F.sum("n").alias("whole"), F.count("*").alias("q"), F.sum("up").alias("up"))
        own = own.withColumn("leave", F.expr("log10(q / (whole + q))"))
        if k == 0:
            own = own.selectExpr("ctx", "whole", "q", "leave", "leave + log10(256) - log10(greatest(1, 256 - q)) AS found", "0D AS missed")
        else:
            # symbols of a context are symbols of the next shorter one: up is what exclusion takes from its count
            par = out[k - 1].select(F.col("ctx").alias("pctx"), F.col("whole").alias("pw"), F.col("q").alias("pq"), F.col("leave").alias("pl"))
            par = F.broadcast(par) if k <= 3 else par  # at most 65,536 rows
            own = own.join(par, _low("ctx", k - 1) == F.col("pctx")).withColumn("den", F.expr("pw - up + pq - q"))
            own = own.selectExpr(
                "ctx", "whole", "q", "leave", "leave + log10((pw + pq) / greatest(den, 1)) AS found",
                "leave - pl + CASE WHEN den > 0 THEN log10(greatest(pq - q, 1e-300D) / den) ELSE 0D END AS missed",
            )
        out[k] = save(own, f"contexts{k}")
    return out


def gram_scores(counts: DataFrame) -> DataFrame:
    """(key, m, lp): log10 probability of the last byte of each n-gram of kinds 1 and 2 after the bytes before it, and its count in both."""
    orders = _orders(counts.filter("kind = 1").select("key", "n"))
    contexts = _contexts(orders)
    every = counts.filter("kind > 0").groupBy("key").agg(F.sum(F.expr("CASE WHEN kind = 1 THEN n ELSE 0L END")).alias("n"), F.sum("n").alias("m"))
    every = save(every, "every")
    seen = every.filter("n > 0").join(contexts[ORDER].select("ctx", "whole", "q"), F.shiftrightunsigned("key", 8) == F.col("ctx"))
    parts = [seen.selectExpr("key", "m", "log10(n / (whole + q)) AS lp")]
    # the others go down the orders until their last byte is a symbol of the context; found and missed: of the context escaped from
    todo = every.filter("n = 0").selectExpr("key", "m", "0D AS lp", "CAST(NULL AS double) AS found", "CAST(NULL AS double) AS missed")
    for k in range(ORDER, -1, -1):
        small = F.broadcast if k <= 1 else lambda df: df  # at most 65,536 rows
        at = small(contexts[k].selectExpr("ctx", "whole", "q", "found AS own_found", "missed AS own_missed"))
        todo = todo.withColumns({"part": _low("key", k + 1)}).withColumn("c", F.shiftrightunsigned("part", 8)).join(at, F.col("c") == F.col("ctx"), "left")
        if k < ORDER:
            todo = todo.join(small(orders[k].selectExpr("key AS node", "n")), F.col("part") == F.col("node"), "left")
        else:
            todo = todo.withColumn("n", F.lit(None).cast("long"))  # not seen
        todo = save(todo.selectExpr("*", "n IS NOT NULL AS hit"), f"todo{k}")
        parts.append(todo.filter("hit").selectExpr("key", "m", "lp + coalesce(found, 0D) + log10(n / (whole + q)) AS lp"))
        todo = todo.filter("NOT hit").selectExpr("key", "m", "lp + coalesce(missed, 0D) AS lp", "own_found AS found", "own_missed AS missed")
    parts.append(todo.selectExpr("key", "m", "lp + coalesce(found, 0D) - log10(256) AS lp"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


class Model:
    """The same in memory, of a trie that fits there: log10 probabilities of symbols, and what an escape from each context adds."""

    def __init__(self, k, ctx, sym, n, whole):
        self.node_key = self.tag(k + 8, (ctx << np.uint64(8)) | sym)
        order = np.lexsort((ctx, k))
        ck = np.stack([k[order], ctx[order]], 1)
        new = np.ones(len(ck), bool)
        new[1:] = (ck[1:] != ck[:-1]).any(1)
        group = np.empty(len(k), np.int64)
        group[order] = np.cumsum(new) - 1
        at = order[new]
        self.c_key = self.tag(k[at], ctx[at])
        kept = np.bincount(group, n)
        q = np.bincount(group).astype(float)
        whole_c = whole[at].astype(float)
        rest = whole_c - kept
        self.log_p = np.log10(n / (whole_c[group] + q[group]))
        leave = np.log10((rest + q) / (whole_c + q))
        # the next shorter context, and the excluded symbols' counts there
        contexts, nodes = HashTable(self.c_key), HashTable(self.node_key)
        up_k, cut = k[at], np.uint64(8) * k[at]
        one = np.uint64(1)
        shorter = np.where(up_k > 0, ctx[at] & ((one << np.where(up_k > 0, cut - np.uint64(8), cut)) - one), 0).astype(np.uint64)
        parent = np.where(up_k > 0, contexts.find(self.tag(np.maximum(up_k, 1) - one, shorter)), -1)
        pn = np.where(k > 0, nodes.find(self.tag(np.maximum(k, 1) + np.uint64(7), (shorter[group] << np.uint64(8)) | sym)), -1)
        excluded = np.bincount(group, np.where(pn >= 0, n[pn], 0))
        par = np.maximum(parent, 0)
        more_q = q[par] - q
        den = whole_c[par] - excluded + more_q
        with np.errstate(divide="ignore", invalid="ignore"):
            found = leave + np.log10((whole_c[par] + q[par]) / np.maximum(den, 1.0))
            on = np.where(den > 0, np.log10(np.maximum(rest[par] + more_q, 1e-300) / np.maximum(den, 1e-300)), 0.0)
        missed = leave + on - leave[par]
        root = parent < 0
        self.found = np.where(root, leave + np.log10(256.0) - np.log10(np.maximum(1.0, 256.0 - q)), found)
        self.missed = np.where(root, 0.0, missed)

    @staticmethod
    def tag(k, key):
        return key.astype(np.uint64) | (k.astype(np.uint64) + np.uint64(1)) << np.uint64(56)

    def tables(self) -> None:
        self.contexts, self.nodes = HashTable(self.c_key), HashTable(self.node_key)

    def log10(self, grams: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each n-gram after the bytes before it."""
        out = np.zeros(len(grams))
        todo, pending, g = np.arange(len(grams)), np.full(len(grams), -1, np.int32), grams
        for k in range(ORDER, -1, -1):
            part = g & np.uint64((1 << (8 * (k + 1))) - 1)
            node = self.nodes.find(part | np.uint64((k + 9) << 56))
            hit = node >= 0
            add = np.where(hit, self.log_p[node], 0.0)
            has = pending >= 0
            add += np.where(has, np.where(hit, self.found[pending], self.missed[pending]), 0.0)
            out[todo] += add
            miss = ~hit
            todo, g, part = todo[miss], g[miss], part[miss]
            pending = self.contexts.find((part >> np.uint64(8)) | np.uint64((k + 1) << 56))
        out[todo] += np.where(pending >= 0, self.found[pending], 0.0) - np.log10(256.0)
        return out


def held_out_fold(doc_id: Column, mod: int, rest: int) -> Column:
    """Whether crc32 of the id's text leaves ``rest``; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % mod == rest


def lm_scores(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    ``train`` marks the rows to learn from.  score: log10 probability that
    the model gives the normalised text (A-Z lower-cased, words joined by a
    blank, and the end).  base_score: the same of its words under an
    add-one unigram model.  Null and empty texts consist of the end alone.
    Repeated rows count as often as they occur; null ids stay null; without
    training rows every byte has probability 1/256.  Other columns are ignored.
    """
    spark = docs.sparkSession
    ship_package(spark)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), train.alias("train"), F.col(text_col).cast("string").alias("text"))
    counts = save(_counts(src.select("text", F.coalesce("train", F.lit(False)))), "counts")
    words = counts.filter("kind = 0").select("key", "n")
    n_all, v_all = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    grams = save(gram_scores(counts), "grams")
    least_gram = max(2, int(np.ceil(grams.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0] * GRAM_RATE)))
    frequent = grams.filter(F.col("m") >= least_gram).toArrow()  # at most 1 / GRAM_RATE rows
    least = max(2, int(np.ceil(n_all * WORD_RATE)))
    top = words.filter(F.col("n") >= least).toArrow()  # at most 1 / WORD_RATE rows
    known = spark.sparkContext.broadcast((top["key"].to_numpy().view(np.uint64), np.log10(top["n"].to_numpy() + 1.0)))
    held = spark.sparkContext.broadcast((frequent["key"].to_numpy().view(np.uint64) | TAG, frequent["lp"].to_numpy()))

    def run(it):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        gram_keys, gram_logs = held.value
        gram_table = HashTable(gram_keys)
        keys, logs = known.value
        table = HashTable(keys)
        for b in it:
            for part in bounded(b, 2, 1 << 20):
                _, g, offs = _stream(part.column(2))
                place = gram_table.find(g | TAG)
                cached = place >= 0
                lp = np.where(cached, gram_logs[place], 0.0) if len(gram_logs) else np.zeros(len(g))
                score = np.add.reduceat(lp, offs[:-1]) if len(g) else np.empty(0)
                rest = g[~cached].view(np.int64)
                cut = np.concatenate([[0], np.cumsum(~cached)])[offs].astype(np.int32)
                hashes, at = word_hashes(*text_bytes(part.column(2)))
                hit = table.find(hashes)
                add = np.concatenate([[0.0], np.cumsum(np.where(hit >= 0, logs[hit], 0.0) if len(logs) else np.zeros(len(hit)))])
                seen = np.concatenate([[0], np.cumsum(hit >= 0)])
                end = table.find(np.array([END_WORD], np.uint64))[0]
                ends = float(logs[end]) if end >= 0 else 0.0
                rare = [hashes[at[j] : at[j + 1]][hit[at[j] : at[j + 1]] < 0].view(np.int64) for j in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + part.num_rows)), part.column(0), part.column(1),
                        pa.array((np.diff(at) + 1).astype(np.int64)), pa.array((seen[at[1:]] - seen[at[:-1]] + (end >= 0)).astype(np.int64)),
                        pa.array(add[at[1:]] - add[at[:-1]] + ends), pa.array(score), pa.array(rare, pa.list_(pa.int64())), pa.array([end < 0] * part.num_rows),
                        pa.ListArray.from_arrays(pa.array(cut), pa.array(rest)),
                    ],
                    names=names,
                )
                row += part.num_rows

    names = ["row", "doc_id", "train", "n_tokens", "known", "logs", "score", "rare", "end_rare", "rest"]
    scored = src.select("doc_id", "train", "text").mapInArrow(run, "row long, doc_id long, train boolean, n_tokens long, known long, logs double, score double, rare array<long>, end_rare boolean, rest array<long>")
    scored = save(scored, "scored")
    rare = scored.select("row", F.explode(F.concat("rare", F.when(F.col("end_rare"), F.array(F.lit(np.uint64(END_WORD).astype(np.int64).item()))).otherwise(F.array().cast("array<bigint>")))).alias("key"))
    extra = rare.join(words, "key").groupBy("row").agg(F.sum(F.log10(F.col("n") + 1.0)).alias("more"), F.count("*").alias("more_known"))
    rest = scored.select("row", F.explode("rest").alias("key")).join(grams.filter(F.col("m") < least_gram).select("key", "lp"), "key").groupBy("row").agg(F.sum("lp").alias("more_score"))
    return scored.join(extra, "row", "left").join(rest, "row", "left").select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(int(n_all)).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(np.log10(n_all + v_all + 1)))).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )
