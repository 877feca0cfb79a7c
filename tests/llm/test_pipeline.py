"""The pipeline on a small corpus, its filtering stages, and the training-data queries against their SQL."""

import hashlib
import math
import os
import random
from types import SimpleNamespace

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from skinnyqr.llm import quality, toxicity
from skinnyqr.llm.queries import ORACLES, QUERIES, WORD_BPE

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def _words(rnd, n):
    return " ".join(rnd.choice(["then", "on", "rather", "is", "winter", "market", "river", "under", "stone"]) + rnd.choice(["", "s", "ly", "ing"]) + str(rnd.randint(0, 60)) for _ in range(n))


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """Documents with planted copies, toxic words, junk and a benchmark passage, as the stages read them."""
    rnd, out = random.Random(4), str(tmp_path_factory.mktemp("sf"))
    rows, labels = [], []
    for i in range(240):
        text = _words(rnd, rnd.randint(60, 120))
        toxic = i % 6 == 0
        if toxic:
            text += " " + rnd.choice(["scumbag", "vermin"]) + " you " + rnd.choice(["scumbag", "vermin"])
        rows.append((i, text, "en", "a"))
        labels.append((i, 1, int(toxic)))
    item = "The wooden bridge over the northern canal was painted green by nine local builders during the long and rainy autumn"
    rows += [(1000 + i, rows[8 * i + 1][1] + (" more" if i % 2 else ""), "en", "a") for i in range(20)]  # copies of clean documents
    rows += [(2000 + i, _words(rnd, 30) + " " + item + " " + _words(rnd, 30), "en", "a") for i in range(5)]
    rows += [(3000, None, "en", "a"), (3001, "", None, None), (3002, "x y z " * 40, "en", "a")]
    tables = {
        "documents": spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], COLUMNS),
        "labels": spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame([(7, item)], "item_id long, text string"),
    }
    for name, df in tables.items():
        df.write.parquet(f"{out}/{name}.parquet")
    return out


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept, names = [], [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, sf_dir)
        assert docs.columns == before.columns
        path = os.path.join(sf_dir, f"after-{name.replace(' ', '-')}")
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    good, clean, single, free = kept
    everything = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert not good & {3000, 3001, 3002} and len(good) >= len(everything) - 6
    toxic = {i for i in range(240) if i % 6 == 0}
    assert not clean & toxic and clean >= good - toxic
    originals = {8 * i + 1 for i in range(20)}
    assert not single & set(range(1000, 1020)) and single >= (clean - set(range(1000, 1020))) and originals - toxic <= single
    assert free == single - set(range(2000, 2005))


def test_run(spark, sf_dir):
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    tok = Tokenizer.from_file(WORD_BPE)
    for i in sorted(out)[::17]:
        ids = tok.encode(text[i], add_special_tokens=False).ids
        assert out[i].n_tokens == len(ids)
        assert out[i].ids_sha256 == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest()
    assert not set(out) & {3000, 3001, 2000, 1000, 0}


def test_filters_keep_other_columns_and_null_ids(spark):
    rnd = random.Random(5)
    rows = [(None if i % 3 else i, _words(rnd, 80), "en", "a", i, "x", "y") for i in range(90)] + [(5, None, None, None, 900, "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, quality_key long, rep string, grp string")
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and {r.quality_key for r in kept.collect()} == set(range(90))
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.keep_clean(docs, model).count() == 91


@pytest.mark.parametrize("label", [0, 1])
def test_labels_of_one_class_call_nothing_toxic(spark, label):
    rnd = random.Random(6)
    docs = spark.createDataFrame([(i, _words(rnd, 20)) for i in range(60)] + [(100, "w" * 50_000)], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, label) for i in range(60)], "doc_id long, toxic int"))
    scores = [r.score for r in toxicity.toxicity_scores(docs, model).collect()]
    assert len(scores) == 61 and max(scores) <= 0.5
    assert toxicity.keep_clean(docs, model).count() == 61


def test_toxicity_looks_at_little_text_at_once(spark, monkeypatch):
    """4 MB of texts in one batch: what a call allocates in a worker, by tracemalloc."""

    class Watched(toxicity.ToxicModel):
        def evidence(self, col):
            import tracemalloc

            tracemalloc.start()
            try:
                out = super().evidence(col)
                assert tracemalloc.get_traced_memory()[1] < 40 << 20
                return out
            finally:
                tracemalloc.stop()

    # a broadcast can't pickle a local class, a function's closure can
    send = spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda value: send(value) if isinstance(value, bytes) else SimpleNamespace(value=value))
    docs = spark.createDataFrame([(i, "then on rather winter market river under stone " * 50) for i in range(1800)], "doc_id long, text string").coalesce(1)
    model = Watched(np.ones(64**3), np.arange(1, 9, dtype=np.uint64), np.ones(8), np.array([-1.0, 0, 0, 0]))
    assert toxicity.keep_clean(docs, model).count() == 1800
    assert toxicity.toxicity_scores(docs, model).agg({"score": "sum"}).first()[0] > 0


def test_toxic_entries_do_not_depend_on_the_texts_beside():
    texts = ["stop!", "there", "be", "e at", "a", "$", None, "x", "i.d", ".i.o", "t", "n", "4", "u"]
    restorer = toxicity.Restorer(np.ones(64**3))
    doc, h = toxicity.document_entries(pa.array(texts), restorer)
    for i, text in enumerate(texts):
        assert set(h[doc == i]) == set(toxicity.document_entries(pa.array([text], pa.string()), restorer)[1]), text


def test_concentration_reaches_a_fixed_point(spark):
    """One more step from the estimate's best start does not lower the determinant (numpy, without bins)."""
    import numpy as np

    from skinnyqr.llm.common import Scratch

    rnd = np.random.default_rng(3)
    x = np.vstack([rnd.normal([3000, 500, 500, 300, 200], [300, 400, 400, 200, 100], (400, 5)), rnd.normal([9000, 3000, 100, 2000, 1000], 200, (80, 5))]).round().clip(0)
    stats = spark.createDataFrame([("g", *map(int, r)) for r in x], "grp string, " + ", ".join(f"{f} long" for f in quality.STATS))
    with Scratch(spark) as keep:
        est = quality.estimates(stats, keep).first()
    centre = np.array([est[f"m{i}"] for i in range(5)])
    low = np.array([[est[f"l{i}{j}"] if j <= i else 0.0 for j in range(5)] for i in range(5)])

    def fit(rows):
        return rows.mean(axis=0), np.cov(rows.T, bias=True) + np.diag(np.square(quality.FLOORS).astype(float))

    def distance(mean, cov):
        return np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)

    best = None
    for seed in range(40):  # brute force: many random starts, concentrated to the end
        mean, cov = fit(x[np.random.default_rng(seed).choice(len(x), 6, replace=False)])
        mean, cov = fit(x[np.argsort(distance(mean, cov), kind="stable")[: math.ceil(quality.SHARE * len(x))]])  # a subset of that size
        while True:
            near = np.argsort(distance(mean, cov), kind="stable")[: math.ceil(quality.SHARE * len(x))]
            new = fit(x[near])
            if np.linalg.det(new[1]) >= np.linalg.det(cov) * (1 - 1e-12):
                break
            mean, cov = new
        if best is None or np.linalg.det(cov) < best[0]:
            best = np.linalg.det(cov), mean, cov
    want = fit(x[distance(*best[1:]) <= quality.REWEIGHT])
    assert np.allclose(centre, want[0], rtol=0.01, atol=5) and np.allclose(low @ low.T, want[1], rtol=0.05, atol=2000)
    far = distance(centre, low @ low.T) > quality.REJECT
    assert far[400:].all() and far[:400].mean() < 0.02


def test_repeated_lines_alone_reject(spark):
    rnd = random.Random(8)
    rows = [(i, _words(rnd, 90), "en", "a") for i in range(100)]
    lines = [_words(rnd, 1) for _ in range(14)]
    rows.append((500, "\n".join(rnd.choice(lines) for _ in range(100)), "en", "a"))
    got = {r.doc_id: r for r in quality.quality_table(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not got[500].base_failed and got[500].n_dup_lines == 86 and not got[500].kept
    assert all(got[i].kept for i in range(100))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("driver test data not present")
    con = duckdb.connect()
    for f in os.listdir(SF):
        if f.endswith(".parquet"):
            con.execute(f"create view {f[:-8]} as select * from read_parquet('{SF}/{f}')")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    res = con.execute(ORACLES[name])
    at = [[d[0] for d in res.description].index(c) for c in cols]
    assert sorted(repr(tuple(r[c] for c in cols)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in res.fetchall())
