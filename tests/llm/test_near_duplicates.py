"""keep_one and set components against brute force, with repeated ids, shared passages and chains of near copies."""

import collections
import itertools
import random
import re

import pytest

from skinnyqr.llm import jaccard

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, h long, node string, gone_id string, nth long"


def shingles(t, k):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset()


def corpus():
    rnd = random.Random(17)
    words = ["u%d" % i for i in range(3000)]
    fresh = lambda n: [rnd.choice(words) for _ in range(n)]
    rows = [(None, None), (None, ""), (1, ""), (1, "  \n"), (1, ""), (2, "a b"), (2, "A b"), (2, "a b"), (3, "a b"), (None, "a b")]
    one, two = fresh(200), fresh(200)
    rows += [(50, " ".join(one)), (50, " ".join(two))]  # one id, two unrelated texts
    rows += [(60, " ".join(one[:-3] + fresh(3))), (40, " ".join(two[:-3] + fresh(3)))]  # a near copy of each
    for g in range(4):  # groups of edits of one text, some within reach of it, some only of each other, some of none
        base = fresh(120 + 400 * g)
        for i in range(14):
            t = list(base)
            for _ in range(int(len(t) * i / 160)):
                t[rnd.randrange(len(t))] = rnd.choice(words)
            rows.append((100 + 20 * g + i, " ".join(t)))
    walk = fresh(150)  # a chain: neighbours are near, ends are not
    for i in range(12):
        rows.append((300 + i, " ".join(walk)))
        for _ in range(3):
            walk[rnd.randrange(len(walk))] = rnd.choice(words)
    passage = fresh(60)  # many documents that share only a passage
    rows += [(400 + i, " ".join(fresh(rnd.randint(20, 400)) + passage + fresh(rnd.randint(20, 400)))) for i in range(40)]
    rows += [(500 + i, " ".join(base)) for i in range(30)] + [(500, " ".join(base))] * 3
    rnd.shuffle(rows)
    return [(d, t, 1, "n", "g", 2) for d, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5).cache()


def components(rows, k, num, den):
    sets = [shingles(r[1], k) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
            root[find(j)] = find(i)
    return sets, [find(i) for i in range(len(rows))]


@pytest.mark.parametrize("k,num,den", [(5, 80, 100), (3, 90, 100), (5, 50, 100)])
def test_components(docs, k, num, den):
    rows = corpus()
    sets, comp = components(rows, k, num, den)
    ids = collections.defaultdict(list)
    for r, s, c in zip(rows, sets, comp):
        if s and r[0] is not None:
            ids[c].append(r[0])
    want = sorted((repr(r[0]), len(s), repr(min(ids[c], default=None) if s else r[0])) for r, s, c in zip(rows, sets, comp))
    got = sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in jaccard.similar_components(docs, k, num, den).collect())
    assert got == want


def test_keep_one(docs):
    rows = corpus()
    sets, comp = components(rows, 5, 80, 100)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    got = collections.Counter((r.doc_id, r.text) for r in kept.collect())
    # what names no group stays whole
    free = collections.Counter((r[0], r[1]) for r, s in zip(rows, sets) if not s or r[0] is None)
    assert not free - got
    by = collections.defaultdict(list)
    for r, s, c in zip(rows, sets, comp):
        if s and r[0] is not None:
            by[c].append((r[0], r[1]))
    rest = got - free
    for members in by.values():
        mine = [m for m in set(members) if rest[m]]
        assert len(mine) == 1 and rest[mine[0]] == 1 and mine[0][0] == min(m[0] for m in members)
    assert sum(rest.values()) == len(by)
    fifty = [t for (d, t) in rest if d == 50]
    assert len(fifty) == 1 and rest[(40, next(t for d, t, *_ in rows if d == 40))] == 1  # only a link or an equal text lets a row go


def test_unrelated_texts_of_one_id_both_stay(spark):
    rows = [(1, " ".join(f"a{i}" for i in range(50))), (1, " ".join(f"b{i}" for i in range(50))), (2, " ".join(f"a{i}" for i in range(50)))]
    got = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text[0]) for r in got) == [(1, "a"), (1, "b")]


def test_nothing_to_keep(spark):
    assert jaccard.keep_one(spark.createDataFrame([], SCHEMA)).count() == 0


def test_passages_make_no_pairs(docs, spark):
    """Documents that share a passage only are left out before pairs are made."""
    from skinnyqr.llm.common import Scratch

    with Scratch(spark) as keep:
        sets = keep.save(jaccard.shingle_sets(docs, 5, 80, 100), "sets")
        needs = sets.filter("n_shingles > 0").groupBy("d1").agg({"need0": "min", "need1": "min"}).toDF("node", "need0", "need1")
        rows = jaccard._peeled(jaccard.segment_keys(docs, 5, 80, 100).distinct(), needs, jaccard.F.col("node"), keep)
        left = {r.node for r in rows.select("node").distinct().collect()}
        passage = {r.d1 for r in sets.filter("doc_id >= 400 AND doc_id < 440").collect()}
    assert len(left & passage) < 8 < len(passage)


def test_rounds_that_change_nothing_are_left_out(spark, monkeypatch):
    """Each written table costs the driver plans, broadcasts and threads, however few rows it has."""
    names, write = [], jaccard.Scratch.save
    monkeypatch.setattr(jaccard.Scratch, "save", lambda self, df, name: names.append(name) or write(self, df, name))
    rnd = random.Random(3)
    text = lambda: " ".join("w%d" % rnd.randrange(10**6) for _ in range(80))
    alone = [(i, text()) for i in range(30)]  # nothing is shared
    got = jaccard.keep_one(spark.createDataFrame(alone, "doc_id long, text string"), 5, 80, 100)
    assert sorted(r[0] for r in got.collect()) == list(range(30))
    assert names.count("open") == 0 and "stars" not in names and "candidates" not in names
    names.clear()
    near = alone + [(100, alone[4][1] + " end"), (101, alone[9][1] + " end")]  # two pairs: done after the first star round
    got = jaccard.keep_one(spark.createDataFrame(near, "doc_id long, text string"), 5, 80, 100)
    assert sorted(r[0] for r in got.collect()) == list(range(30))
    assert names.count("stars") == 1 and names.count("candidates") == 1


def test_saved_tables_are_counted_while_written(spark):
    from skinnyqr.llm.common import save_counted

    for n in (0, 7):
        df, seen = save_counted(spark.range(n).repartition(3), "counted")
        assert seen == n == df.count()
    df, seen = save_counted(spark.range(9).filter("id < 0").groupBy("id").count(), "counted")
    assert seen == 0 == df.count()
