"""Phrase collocations and counting quotient filters against brute force."""

import collections
import random
import re

import numpy as np
import pytest

from skinnyqr.llm import collocations as col
from skinnyqr.llm import cqf

SCHEMA = "doc_id long, text string, lang string, n long, score string, a string, ids string"


def corpus():
    rnd = random.Random(5)
    words = ["The", "of", "é", "ab", "x\u0001y", "new", "york", "stock", "exchange", "q" * 300, "c-d", "(z)"]
    rows = [(None, None, None), (1, "", "en"), (2, " \t\n..!", "en"), (3, "one", "und"), (3, "one", None), (4, "new york " * 9000, "de")]
    for i in range(120):
        t = " ".join(rnd.choice(words) + rnd.choice(["", "", "", ",", ".\n", ":x", "\t", "\r"]) for _ in range(rnd.randint(0, 120)))
        rows.append((i, t + " new york stock exchange", rnd.choice(["en", "de", None])))
    rows += rows[20:30]
    return [(*r, 5, "s", "a", "i") for r in rows]


def brute(rows, least, most, top, percent):
    f, total = collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n\x0b\f\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^ \t]+", piece)
            total[lang] += len(w)
            for n in range(1, most + 1):
                f[lang].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = set()
    for lang, c in f.items():
        c = {p: a for p, a in c.items() if a >= least}
        inside = collections.Counter()
        for p, a in c.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i : i + m]] = max(inside[p[i : i + m]], a)
        found = []
        for p, a in c.items():
            if len(p) > 1 and 100 * inside[p] < percent * a:
                s, k = min((1000 * a * total[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                found.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]], total[lang]))
        for rank, (s, a, p, l, r, n) in enumerate(sorted(found)[:top], 1):
            out.add((lang, rank, p.decode(), -a, l, r, n, -s))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.mark.parametrize("least,top,percent", [(5, 2000, 100), (3, 40, 60), (100, 7, 100)])
@pytest.mark.parametrize("shipped", [True, False])
def test_collocations(docs, monkeypatch, least, top, percent, shipped):
    if not shipped:  # ids joined to buckets of texts, small filters, a bit table that lets nearly everything through
        monkeypatch.setattr(col, "MAX_SHIPPED_WORDS", 0)
        monkeypatch.setattr(col, "BUCKET_BYTES", 3000)
        monkeypatch.setattr(col, "TASK_ENTRIES", 50)
    got = {tuple(r) for r in col.collocations(docs, min_count=least, top=top, percent=percent).collect()}
    assert got == brute(corpus(), least, 5, top, percent)


def test_no_texts(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert col.collocations(empty).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert col.collocations(empty).count() == 0


@pytest.mark.parametrize("n", [2, 3, 4, 5])
@pytest.mark.parametrize("bits", [2, 8, 16, 24])
def test_quotient_filter_is_lossless(n, bits):
    rng = np.random.default_rng(n * bits)
    ids = [rng.integers(1, min(2**bits, 60), 4000) for _ in range(n)]
    want = collections.Counter(zip(*[x.tolist() for x in ids]))
    left, right, half = cqf.pack(ids, bits)
    whole = cqf.QuotientFilter.of(left, right, half)
    shards = [cqf.QuotientFilter.of(left[i::3], right[i::3], half) for i in range(3)]
    ranges = collections.defaultdict(list)
    for s in shards:
        for part in s.split(2):
            ranges[part.prefix].append(cqf.QuotientFilter.from_bytes(part.to_bytes()))
    got = collections.Counter()
    for parts in ranges.values():
        f = cqf.merge(parts)
        got.update(dict(zip(zip(*[x.tolist() for x in cqf.unpack(*f.keys(), n, bits)]), f.counts.tolist())))
    assert got == want and len(whole) == len(want)


def test_counters_beyond_a_byte():
    left, right, half = cqf.pack([np.repeat([1, 2, 3], [254, 255, 70_000]), np.ones(70_509, int)], 8)
    f = cqf.QuotientFilter.from_bytes(cqf.QuotientFilter.of(left, right, half).to_bytes())
    assert sorted(f.counts.tolist()) == [254, 255, 70_000]
    assert len(cqf.QuotientFilter.from_bytes(f.at_least(80_000).to_bytes())) == 0
