"""I-Match fingerprints against a brute-force version written from the definition."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from skinnyqr.llm import imatch

SCHEMA = "doc_id long, text string, lang string, n_chars long, part string, role string, tie string"


def corpus():
    rnd = random.Random(11)
    words = ["w%d" % i for i in range(300)] + ["naïve", "日本", "q" * 400]
    weight = [1 / (i + 1) for i in range(len(words))]
    rows = [(None, None), (None, "null id"), (1, ""), (2, " .;\n"), (3, "one"), (3, "one"), (3, "other text under the same id"), (4, "!!"), (5, "zz " * 30_000)]
    for i in range(150):
        rows.append((100 + 3 * i, " ".join(rnd.choices(words, weight, k=rnd.randint(1, 250))) + rnd.choice(["", ".", "\nEnd"])))
    base = rows[-1][1]
    rows += [(10_000 + i, base) for i in range(80)]  # a third of the rows is one text
    rnd.shuffle(rows)
    return [(*r, "en", 7, "p", "r", "t") for r in rows]


def terms(text):
    return {re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.split(r"[ \t.,;:!?\n\x0b\f\r]+", text or "") if w}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5).cache()


def test_lexicon_is_the_band(docs):
    df, n = collections.Counter(), len(corpus())
    for r in corpus():
        df.update(terms(r[1]))
    for band in ((2.0, 7.0), (1.0, 3.0)):
        got, size = imatch.lexicon(docs, band)
        assert len(got) == sum(band[0] <= math.log(n / c) <= band[1] for c in df.values())
        assert size == sum(len((r[1] or "").encode()) for r in corpus())


def test_edits_and_order(docs):
    got = [r.asDict() for r in imatch.edit_probe(docs).collect()]
    assert len(got) == len(corpus())
    tie = {r.text: r.h for r in docs.select(F.coalesce("text", F.lit("")).alias("text")).distinct().withColumn("h", F.xxhash64("text")).collect()}
    rows = sorted(((r[0], r[1] or "") for r in corpus()), key=lambda r: (r[0] is not None, r[0] or 0, tie[r[1]]))
    want = []
    for (i, t), (_, f) in zip(rows, rows[1:] + rows[:1]):
        k = len(t) // 4
        want.append((i, len(t), hashlib.sha256((t[: len(t) - k] + f[:k]).encode()).hexdigest()))
    key = lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=key) == sorted(want, key=key)
    assert all(0 <= r[c] <= 1 for r in got for c in ("near_edited", "near_next"))
    copies = [r for r in got if r["doc_id"] and r["doc_id"] >= 10_000]
    assert len({r["fingerprint"] for r in copies}) == 1
    assert all(r["near_next"] == 1.0 for r in copies if r["doc_id"] < 10_079)


def test_fingerprint_is_the_same_for_equal_texts_and_alone(docs):
    lex, _ = imatch.lexicon(docs)
    by = collections.defaultdict(set)
    rows = imatch.fingerprints(docs, lex).join(docs.select("doc_id", "text"), "doc_id")
    probe = {(r.doc_id, r.fingerprint) for r in imatch.edit_probe(docs).collect()}
    for r in rows.filter("doc_id > 5").collect():
        by[r.text].add(r.fingerprint)
        assert (r.doc_id, r.fingerprint) in probe
    assert all(len(x) == 1 for x in by.values())
    assert len({min(x) for x in by.values()}) == len(by)  # different texts differ here


def test_entries_hash_the_terms_of_each_subset():
    """An entry is the same exactly if the texts have the same terms in its subset."""
    import pyarrow as pa

    rnd, table = random.Random(2), imatch.HashTable(np.zeros(0, np.uint64))
    texts = [" ".join("t%d" % rnd.randint(0, 60) for _ in range(rnd.randint(1, 90))) for _ in range(200)]
    f = imatch.Fingerprints(table, pa.array(texts))
    member = {}
    for t in sorted(set().union(*map(terms, texts))):
        one = imatch._terms(pa.array([t]))[1]
        member[t] = [int(imatch.mix64(one ^ s)[0]) for s in imatch._SALTS]
    for k in (0, 1):
        for r in range(imatch.SUBSETS):
            seen = {}
            for i, text in enumerate(texts):
                limit = imatch._LARGEST >> (2 * (int(f.density[i]) + k))
                inside = frozenset(t for t in terms(text) if member[t][r] <= limit)
                e = int(f.entries[i, k * imatch.SUBSETS + r])
                assert (e == 0) == (not inside)
                assert seen.setdefault(inside, e) == e
    assert [int(d) for d in f.density] == [math.floor(math.log(2 * len(terms(t)), 4) + 1e-12) for t in texts]


def test_likeness_follows_overlap(spark):
    rnd = random.Random(9)
    words = ["v%d" % i for i in range(20_000)]
    rows = []
    for i in range(60):
        a = rnd.sample(words, 400)
        rows += [(3 * i, " ".join(a)), (3 * i + 1, " ".join(a[:360] + rnd.sample(words, 40))), (3 * i + 2, " ".join(rnd.sample(words, 400)))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    f = {r.doc_id: r.fingerprint for r in imatch.fingerprints(d, np.zeros(0, np.uint64)).collect()}
    pairs = spark.createDataFrame([(f[3 * i], f[3 * i + 1], f[3 * i + 2]) for i in range(60)], "a string, b string, c string")
    near, far, same = pairs.select(F.avg(imatch.likeness("a", "b")), F.avg(imatch.likeness("a", "c")), F.min(imatch.likeness("a", "a"))).first()
    assert near > 0.55 and far < 0.1 and same == 1.0


def test_few_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert imatch.edit_probe(empty).count() == 0
    one = imatch.edit_probe(spark.createDataFrame([(7, "abcd efgh", "en", 1, "", "", "")], SCHEMA)).collect()
    assert len(one) == 1 and one[0].edited_sha256 == hashlib.sha256(b"abcd efab").hexdigest() and one[0].near_next == 1.0
