"""Training-data operators against brute force, on small tables with nulls, empties, ties, repeats and extra columns."""

import bisect
import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skinnyqr.llm import bpe, chat, decontam, jaccard, ppm, quality, sharding, toxicity, urlfilter, wordpiece

WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD_BPE, BYTE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rep string, grp string"


def low(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


def corpus():
    rnd = random.Random(7)
    words = ["".join(rnd.choice(["th", "er", "on", "an", "é", "re", "st"]) for _ in range(rnd.randint(1, 4))) for _ in range(400)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "one two"), (5, "ONE two"), (6, "x" * 70_000), (6, "x" * 70_000)]
    base = [rnd.choice(words) for _ in range(300)]
    for i in range(40):  # near copies at every distance
        t = list(base)
        for _ in range(i // 2):
            t[rnd.randrange(len(t))] = rnd.choice(words)
        rows.append((100 + i, " ".join(t)))
    rows += [(200 + i, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 60)))) for i in range(60)]
    rows += [(300 + i, " ".join(base)) for i in range(5)]
    rows.append((None, "no id here at all"))
    return [(i, t, "en" if t else None, "s", None, "r", "g") for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(4).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("k,num,den", [(3, 90, 100), (5, 80, 100)])
def test_jaccard_components(docs, k, num, den):
    def shingles(t):
        w = WORD.findall(low(t))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()

    rows = [(r[0], shingles(r[1])) for r in corpus()]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = rows[i][1], rows[j][1]
        if a and b and den * len(a & b) >= num * len(a | b):
            root[find(j)] = find(i)
    least = collections.defaultdict(list)
    for i, (d, s) in enumerate(rows):
        if d is not None:
            least[find(i)].append(d)
    want = sorted((repr(d), len(s), repr(d if not s else min(least[find(i)], default=None))) for i, (d, s) in enumerate(rows))
    got = sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in jaccard.similar_components(docs, k, num, den).collect())
    assert got == want


def test_bpe_matches_library(spark, docs):
    tok = Tokenizer.from_file(WORD_BPE)
    texts = {r[0]: r[1] or "" for r in corpus()}
    odd = ["it's 'S <|endoftext|>x", "ΑΣ σς İ é x̣́", "한국어 １２ ½ 😀", "ab" * 9000 + "!" * 9000]
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    texts |= {1000 + i: t for i, t in enumerate(odd)}
    for r in bpe.bpe_round_trip(docs.select("doc_id", "text").union(more), WORD_BPE).collect():
        ids = tok.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize("size", [1, 5, 64])
def test_bpe_stream_does_not_depend_on_chunks(monkeypatch, size):
    m, tok, rnd = bpe.MergeList(WORD_BPE), Tokenizer.from_file(WORD_BPE), random.Random(size)
    monkeypatch.setattr(bpe, "CHUNK", size)
    for _ in range(60):
        t = "".join(rnd.choice("abé'stré́ \n.!12<|endoftext|>中") for _ in range(rnd.randint(0, 90)))
        assert np.frombuffer(bpe.encode_document(m, bpe.WordMemo(), t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


def test_wordpiece_lengths():
    pieces = {b"a", b"ab", b"abcd", b"b", b"bc", b"c"}
    machine = wordpiece.LongestMatch(pieces)

    def greedy(w):
        n = i = 0
        while i < len(w):
            j = next((j for j in range(len(w), i, -1) if w[i:j] in pieces), None)
            if j is None:
                return -1
            n, i = n + 1, j
        return n

    for k in range(8):
        for w in map(bytes, itertools.product(b"abcd", repeat=k)):
            assert machine.length(w) == greedy(w)


def test_quality_statistics(docs):
    def brute(t):
        t = t or ""
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        seen = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        again = {i + j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(5)}
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again)

    extra = docs.select("doc_id", "text", "lang", "source").union(
        docs.sparkSession.createDataFrame([(900, "a b c d e f a b c d e\n\n a b c d e\nq\nq # <x>", "en", "s"), (901, "é é é é é é é", "en", "s")], "doc_id long, text string, lang string, source string")
    )
    want = sorted((repr(r.doc_id), *brute(r.text)) for r in extra.collect())
    rows = quality.quality_table(extra).collect()
    assert sorted((repr(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == want
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept) for r in rows)


def test_quality_rejects_outliers(spark):
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choice(["then", "on", "rather", "is", "winter"]) + rnd.choice(["", "s", "ly"]) + str(j % 7) for j in range(80)), "en", "a") for i in range(120)]
    rows += [(1000 + i, " ".join(w + "***" for w in rows[i][1].split()), "en", "a") for i in range(15)]
    got = {r.doc_id: r.kept for r in quality.quality_table(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i] for i in range(120)) and not any(got[1000 + i] for i in range(15))


def test_sharding_is_minimax(spark):
    rnd = random.Random(5)
    texts = [None, ""] + ["a" * rnd.randint(0, 40) + str(rnd.randint(0, 50)) for _ in range(300)] + ["hot" * 30] * 40
    rows = sharding.shard_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 8).collect()
    groups = collections.Counter()
    shards, slots, of = collections.Counter(), collections.defaultdict(list), {}
    for r in rows:
        t = texts[r.doc_id] or ""
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(t) + 1, zlib.crc32(t.encode()), "bytes", None)
        groups[hashlib.md5(t.encode()).hexdigest()] += r.size
        shards[r.shard] += r.size
        slots[r.shard].append(r.slot)
        assert of.setdefault(t, r.shard) == r.shard
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(rows) == len(texts)

    def needs(cap):
        n, held = 1, 0
        for _, s in sorted(groups.items()):
            if s > cap:
                return 99
            n, held = (n + 1, s) if held + s > cap else (n, held + s)
        return n

    best = next(c for c in range(1, sum(groups.values()) + 1) if needs(c) <= 8)
    assert max(shards.values()) <= best


def _greedy_cuts(groups, shards):
    """(smallest capacity, places in the order at which shards 1.. begin) over all single groups."""
    sizes = [s for _, s in sorted(groups)]
    ends = [0, *itertools.accumulate(sizes)]
    total, n = ends[-1], len(sizes)

    def fits(cap, left, at=0):
        while at < n and left:
            at, left = bisect.bisect_right(ends, ends[at] + cap) - 1, left - 1
        return at == n

    low, high = max(sizes), total
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid, shards) else (mid + 1, high)
    at, out = 0, []
    for left in range(shards, 1, -1):
        most = bisect.bisect_right(ends, ends[at] + low) - 1
        at = min(bisect.bisect_left(ends, ends[at] - (ends[at] - total) // left), most)
        while not fits(low, left - 1, at):
            at += 1
        out.append(at)
    return low, out


@pytest.mark.parametrize("giants", [(), (0.02, 0.02), (0.3,), (40,)])
def test_sharding_sends_few_sums_to_the_driver(spark, monkeypatch, giants):
    made = spark.range(40_000).selectExpr("md5(cast(id AS string)) AS key", "1 + id * 7919 % 5000 AS size").toPandas()
    groups = list(zip(made["key"].tolist(), made["size"].tolist()))
    for i, share in enumerate(giants):
        groups[1000 * i] = (groups[1000 * i][0], int(share * 1e8))
    inner, sent = sharding._ranges, []
    monkeypatch.setattr(sharding, "_ranges", lambda *a: (sent.append(out := inner(*a)), out)[1])
    capacity, cuts = sharding.minimax_cuts(spark.createDataFrame(groups, "key string, size long"), 8)
    keys = sorted(k for k, _ in groups)
    assert (capacity, [bisect.bisect_left(keys, c) for c in cuts]) == _greedy_cuts(groups, 8)
    assert sum(map(len, sent)) < 10_000  # ranges split all along the order would be 40,000


def test_sharding_cuts_are_those_of_single_groups():
    rnd = random.Random(11)
    sizes = [lambda: 1, lambda: rnd.randint(1, 5), lambda: rnd.randint(1, 10**6), lambda: min(int(rnd.paretovariate(0.5)), 10**14), lambda: 10**9 if rnd.random() < 0.01 else rnd.randint(1, 999)]
    for trial in range(300):
        lead, size, shards = rnd.choice(["", "", "abc", "abc01"]), rnd.choice(sizes), rnd.choice([1, 2, 3, 8, 8, 20])
        groups = [((lead + hashlib.md5(f"{trial} {i}".encode()).hexdigest())[:32], size()) for i in range(rnd.choice([1, 2, 3, 10, 100, 600]))]

        def ask(prefixes, groups=groups):
            by = collections.defaultdict(list)
            for k, s in groups:
                if prefixes is None:
                    by[k[: sharding.FIRST_DIGITS]].append((k, s))
                for p in prefixes or ():
                    if k.startswith(p):
                        by[k[: len(p) + sharding.MORE_DIGITS]].append((k, s))
            return [sharding.Range(g[0][0] if len(g) == 1 else p, sum(s for _, s in g), max(s for _, s in g), len(g)) for p, g in by.items()]

        capacity, cuts = sharding.find_cuts(ask, shards)
        keys = sorted(k for k, _ in groups)
        assert (capacity, [bisect.bisect_left(keys, c) for c in cuts]) == _greedy_cuts(groups, shards)


def test_url_rules(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("a.example.net", "/en/x", "block"), ("net", "/", "block")]
    urls = [None, "", "no scheme", "HTTP://A.Example.NET/en/x?q", "http://example.net", "http://b.net#f", "https://xnet/", "ftp://example.net/EN/", "http://q://net/"]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, rule string"), spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("a.example.net", "/en/x", "a.example.net/en/x", "block")
    assert got[4] == ("example.net", "", None, "allow") and got[5] == ("b.net", "", None, "allow")
    assert got[6] == ("xnet", "/", None, "allow") and got[7] == ("example.net", "/EN/", "net/", "block")


def test_bloom_has_no_false_negatives():
    rng = np.random.default_rng(1)
    keys, other = rng.integers(-(2**63), 2**63, 5000), rng.integers(-(2**63), 2**63, 20000)
    b = urlfilter.BlockedBloom(len(keys))
    words = np.zeros(b.blocks * urlfilter.BLOCK, np.uint64)
    at, bit = b.masks(keys)
    np.bitwise_or.at(words, at.ravel(), bit.ravel())
    hold = lambda k: ((words[b.masks(k)[0]] & b.masks(k)[1]) == b.masks(k)[1]).all(1)
    assert hold(keys).all() and hold(other).mean() < 0.05


def test_chat_round_trip(spark):
    rnd = random.Random(2)
    parts = ["<", "|", "\\", "turn|>", "<|turn|>", "</s>", "[INST]", "[", "a", "\n", "<|end|>", "é", "<|text|>", "<|", "😀"]
    make = lambda: "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))
    for _ in range(3000):
        x = make()
        assert chat.unescape(chat.escape(x)) == x and not any(c in chat.escape(x) for c in chat.CONTROLS)
    rows = [(c, t, rnd.choice(["user", "assistant", "system", None]), rnd.choice([None, "", make()])) for c in [*range(20), None] for t in range(rnd.randint(1, 6))]
    want = collections.defaultdict(list)
    for c, t, role, text in rows:
        want[c].append((t, role or "", text or ""))
    got = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), BYTE_BPE).collect()
    assert len(got) == len(want)
    for r in got:
        turns = sorted(want[r.conv_id])
        said = "".join(x for _, role, x in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())


def test_decontamination(spark):
    item = "A farmer near Lyon sells 12 crates of apples to Marie for 30 euros and then Marie sells 12 of them again to her neighbour"
    other = item.replace("12", "45").replace("30", "71").replace("Marie", "Jeanne")
    broken = item.replace("12", "45", 1).replace("30", "71")  # the same value became two
    filler = "so it was said that nothing of the sort had ever been seen there before and yet "
    docs = [(1, filler + item + ". " + filler), (2, filler + other + " " + filler), (3, filler + broken), (4, filler * 3), (5, None), (6, ""), (None, item), (1, filler + item + ". " + filler)]
    bench = [(7, item), (8, None), (9, "too short"), (None, filler)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = sorted((repr(r.doc_id), r.item_id, r.reparameterised) for r in decontam.contaminated(df, b).collect())
    assert got == [("1", 7, False), ("2", 7, True), ("None", 7, False)]
    assert sorted(repr(r.doc_id) for r in decontam.without_benchmark(df, b).collect()) == ["3", "4", "5", "6"]


def test_ppm(spark, docs):
    train = ~ppm.held_out_fold(F.col("doc_id"), 7, 2)
    rows = ppm.lm_scores(docs, train).collect()
    data = [(r[0], r[1] or "") for r in corpus()]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    count = collections.Counter()
    for i, t in data:
        if not held(i):
            count.update([*WORD.findall(low(t)), "\n"])
    n, v = sum(count.values()), len(count)
    want = sorted((repr(i), held(i), len(w), sum(count[x] > 0 for x in w), round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), 4)) for i, t in data for w in [[*WORD.findall(low(t)), "\n"]])
    assert sorted((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, round(r.base_score, 4)) for r in rows) == want
    assert all(r.train_tokens == n and r.score < 0 for r in rows)
    t = ppm.trie(ppm._counts(docs.select("text")).filter("kind = 1").select("key", "n"), 1000).toArrow()
    u = lambda c: t[c].to_numpy().astype(np.uint64)
    m = ppm.Model(u("k"), u("ctx"), u("sym"), t["n"].to_numpy(), t["all"].to_numpy())
    m.tables()
    grams = ppm._grams(np.frombuffer(b"".join(ppm.normal(x.encode()) for _, x in data[8:20]) + bytes(range(256)), np.uint8))
    for g in grams[::97]:  # the probabilities of all bytes sum to one
        assert abs((10 ** m.log10((g & ~np.uint64(255)) | np.arange(256, dtype=np.uint64))).sum() - 1) < 1e-9


def _found(spark, bench, docs):
    b = spark.createDataFrame(bench, "item_id long, text string")
    return sorted((r.doc_id, r.item_id, r.reparameterised) for r in decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), b).collect())


def test_decontamination_of_slots_and_short_items(spark):
    sums, other = "12 + 30 = 42; 7 x 8 = 56; 9 - 4 = 5", "13 + 31 = 44; 7 x 9 = 63; 8 - 4 = 4"
    table = "Row 1 kg 2 mg 5 has 3 4 5 red 6 7 8 blue 9 10 11 green 12 13 14 end"
    far = " ".join(str(int(w) + 100) if w.isdigit() else w for w in table.split())
    bench = [(1, sums), (2, other), (3, "水は何度で沸騰しますか"), (4, "What is gravity?"), (5, table)]
    docs = [(10, "so it is said " + sums + " and so on"), (11, "as in " + other), (12, "問題 水は何度で沸騰しますか 答え"), (13, "Well. What is gravity? It pulls."), (14, "see " + far + " there"), (15, "what is gravity to them")]
    assert _found(spark, bench, docs) == [(10, 1, False), (11, 2, False), (12, 3, False), (13, 4, False), (14, 5, True)]


def test_decontamination_in_other_case_and_layout(spark):
    item = "A farmer near Lyon sells 12 crates of apples to Marie for 30 euros and then Paul asks Jean if Claire or Luc knew of it"
    bench = [(1, item), (2, "Alice bought 5 apples for 3 dollars")]
    filler = "so it was said that nothing of the sort "
    docs = [(10, filler + item.lower()), (11, filler + item.upper()), (12, filler + item.replace(" Marie", "\nMarie").replace(" Paul", "  Paul"))]
    docs += [(13, filler + item.lower().replace("12", "45")), (14, "Bob bought 7 apples for 4 dollars"), (15, item.replace(" and then Paul", ". Paul"))]
    got = _found(spark, bench, docs)
    assert got[:5] == [(10, 1, False), (11, 1, False), (12, 1, False), (13, 1, True), (14, 2, True)]


def test_decontamination_of_long_passages(spark):
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200)]
    part = lambda a, b: "it was " + " ".join(words[a:b]) + " was it"
    docs = [(10, part(0, 110)), (11, part(120, 133)), (12, part(120, 132)), (13, part(0, 12) + " " + part(50, 60))]
    assert _found(spark, [(1, " ".join(words))], docs) == [(10, 1, False), (11, 1, False)]


@pytest.mark.parametrize("rate", [2.5e-7, 0.01])
def test_ppm_scores_by_whole_trie(spark, docs, monkeypatch, rate):
    monkeypatch.setattr(ppm, "GRAM_RATE", rate, raising=False)
    more = spark.createDataFrame([(5000, "Zürich once qx\0\0\0\0\0\0\0"), (5001, "zürich 中文 once!")], "doc_id long, text string")
    df = docs.select("doc_id", "text").union(more)
    data = [*((r[0], r[1] or "") for r in corpus()), *((r.doc_id, r.text) for r in more.collect())]
    train = {i for i, _ in data if i is not None and i % 3 != 2}
    count = collections.Counter()
    for i, t in data:
        if i in train:
            x = b"\n" * 5 + ppm.normal(t.encode())
            count.update((k, x[j - k : j], x[j]) for j in range(5, len(x)) for k in range(6))
    symbols = collections.defaultdict(dict)
    for (k, ctx, sym), n in count.items():
        symbols[ctx][sym] = n

    def logp(ctx, sym):
        p, out = 1.0, {}
        for k in range(5, -1, -1):
            own = {s: n for s, n in symbols.get(ctx[5 - k :], {}).items() if s not in out}
            if not own:
                continue
            whole = sum(own.values()) + len(own)
            if sym in own:
                return math.log10(p * own[sym] / whole)
            p, out = p * len(own) / whole, out | own
        return math.log10(p / (256 - len(out)))

    def score(t):
        x = b"\n" * 5 + ppm.normal(t.encode())
        return sum(logp(x[j - 5 : j], x[j]) for j in range(5, len(x)))

    got = sorted((repr(r.doc_id), round(r.score, 6)) for r in ppm.lm_scores(df, F.coalesce(F.col("doc_id") % 3 != 2, F.lit(False))).collect())
    memo = {t: round(score(t), 6) for t in {t for _, t in data}}
    assert [a for a, _ in got] == sorted(repr(i) for i, _ in data)
    for (i, s), (_, w) in zip(got, sorted((repr(i), memo[t]) for i, t in data)):
        assert abs(s - w) < 1e-4 * max(1, abs(w) / 100), (i, s, w)


def test_toxicity(spark):
    rnd = random.Random(1)
    fill = lambda: " ".join(rnd.choice(["then", "stone", "river", "idol", "moves", "another", "weather", "is"]) for _ in range(30))
    rows = [(i, fill() + (" you utter idiot" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, y, 1) for i, _, y in rows] + [(None, 1, 1), (3, None, 1)], "doc_id long, toxic int, quality int"))
    tests = [(0, "that 1d10t there"), (1, "an i.d.i.o.t now"), (2, "i d i o t you"), (3, "idioooot"), (4, fill()), (5, ""), (6, None)]
    got = {r.doc_id: r.predicted for r in toxicity.toxicity_scores(spark.createDataFrame(tests, "doc_id long, text string"), model).collect()}
    assert [got[i] for i in range(7)] == [1, 1, 1, 1, 0, 0, 0]


def test_toxicity_of_edges_runs_and_doubles():
    at = np.arange(64**3)
    restorer = toxicity.Restorer(np.where((at % 64 == 4) & (at // 64 % 64 == 4), 6.0, 1.0))  # "dd" is rare
    texts = ["you !diot", "+rash!", "i d i o t, he", "(m o r o n.", "a s t u p i d", "y o u i d i o t s a y", "iddiot", "s¢um", "cr€ep"]
    doc, h = toxicity.document_entries(pa.array(texts), restorer)
    for i, word in enumerate(["idiot", "trash", "idiot", "moron", "stupid", "idiot", "idiot", "scum", "creep"]):
        data = np.frombuffer(word.encode(), np.uint8)
        want = toxicity.entry_hashes(data, np.array([0]), np.array([len(data)]))[1][0]
        assert want in h[doc == i], (texts[i], word)


def test_empty_tables(spark, empty):
    assert jaccard.similar_components(empty).count() == 0
    assert quality.quality_table(empty).count() == 0
    assert bpe.bpe_round_trip(empty, WORD_BPE).count() == 0
    assert wordpiece.token_counts(empty, WORD_BPE).count() == 0
    assert ppm.lm_scores(empty, F.lit(True)).count() == 0
    assert sharding.shard_documents(empty).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contaminated(empty, none).count() == 0
    model = toxicity.fit(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.toxicity_scores(empty, model).count() == 0
    assert urlfilter.judge(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "host string, path string, verdict string")).count() == 0
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), BYTE_BPE).count() == 0


def test_characters_apart_are_those_of_scripts_without_blanks(spark):
    """Every code point: the range in front of the scripts leaves none out and adds none."""
    from skinnyqr.llm import decontam

    plain = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"
    points = spark.range(0x110000).filter("id NOT BETWEEN 55296 AND 57343")
    chars = points.select("id", F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    found = chars.agg(
        F.count_if(F.col("c").rlike(plain)).alias("n"), F.count_if(F.col("c").rlike(plain) != F.col("c").rlike(decontam.APART)).alias("wrong")
    ).first()
    assert found["n"] > 90_000 and found["wrong"] == 0
    tokens = spark.createDataFrame([("Übung 東京は2 กข ລາວ x",)], "t string").select(decontam.template_tokens(F.col("t"))).first()[0]
    assert [x.lstrip("\u0001\u0002\u0003\u0004") for x in tokens] == ["übung", "東", "京", "は", "2", "ก", "ข", "ລ", "າ", "ວ", "x"]


def test_template_tokens_as_rule_by_rule(spark):
    """The patterns that read white space as it is mark what those that even it out first did."""
    mark = {n: getattr(decontam, n) for n in ("NUMBER", "NAME", "UNIT", "START")}
    parts = ["a", "The", "Marie", " ", "  ", "\n", "\t", "\u00a0", "\x0b", "\x85", "\u2003", ".", ",", ";", "!", *mark.values(), "12", "3.5", "kg", " kg", "5 kg", "5\n\tkg", "é", "É"]
    parts += ["Σ", "ΑΣ", "😀", "東", "ไ", "İ", "ß", "Ⅷ", "-", "'", "A ", "in", "IN", "\u0301", "²", "X", "$", "\\"]
    rnd = random.Random(11)
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(20000)]
    t = F.regexp_replace(F.translate("t", "".join(mark.values()), "    "), r"[\s\u00a0]{2,}|[\t-\r\u00a0]", " ")
    t = F.regexp_replace(t, r" (?<=[\p{Ll},;] )(?=\p{Lu})", f" {mark['NAME']}")
    words = "|".join(decontam.FUNCTION_WORDS)
    t = F.lower(F.regexp_replace(t, rf"(^|[^\p{{L}}\p{{N}},; {mark['NAME']}] ?)(?=\p{{Lu}})(?!(?:{words})(?![\p{{L}}\p{{N}}]))", f"$1{mark['START']}"))
    t = F.regexp_replace(F.regexp_replace(t, f"({decontam.APART})", " $1 "), r"(^|[^\p{L}\p{N}])([0-9])", f"$1{mark['NUMBER']}$2")
    t = F.regexp_replace(t, rf"({mark['NUMBER']}[0-9.,]+ )({'|'.join(decontam.UNITS)})([^\p{{L}}\p{{N}}]|$)", f"$1{mark['UNIT']}$2$3")
    want = F.array_remove(F.split(t, rf"[^\p{{L}}\p{{N}}{mark['NUMBER']}-{mark['START']}]+"), "")
    rows = spark.createDataFrame([(x,) for x in texts], "t string").select("t", decontam.template_tokens(F.col("t")).alias("got"), want.alias("want"))
    assert [r for r in rows.collect() if r.got != r.want] == []
    # one word that starts with a capital beyond U+FFFF: no start inside it
    first = spark.createDataFrame([("\U00010400X and",)], "t string").select(decontam.template_tokens(F.col("t"))).first()[0]
    assert first == [mark["START"] + "\U00010428x", "and"]


def test_windows_of_documents(spark):
    """Each view's windows against plain slices; no array function makes them, since those are interpreted."""
    rnd = random.Random(12)
    parts = ["so", "it", "was", "at", "Lyon", "Marie", "12", "7 kg", "30", ".", ",", "The", "Then", "red"]
    docs = [(i, " ".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60)))) for i in range(60)] + [(60, None), (61, ""), (62, "so it was red " * 8), (63, "12 30 7 9 " * 8)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    kinds = {("T", 8), ("S", 8), ("L", 8), ("X", 8), ("T", 5), ("W", decontam.WIDE)}
    number, name, unit, start = decontam.NUMBER, decontam.NAME, decontam.UNIT, decontam.START
    plain = {"T": start, "S": "", "L": start + name, "V": start + name + number + unit}  # read as literals
    want = set()
    for r in df.select("doc_id", decontam.template_tokens(F.col("text")).alias("x")).collect():
        marks = [t[0] for t in r.x if t[0] in number + name + unit + start]
        views = "T" + "S" * (start in marks) + "L" * (name in marks) + "V" * (marks.count(number) * 4 > 5)
        for view in views:
            read = [t[1:] if t[0] in plain[view] else name if t[0] == start else t[0] if t[0] in number + name + unit else t for t in r.x]
            for w in (5, 8) + (decontam.WIDE,) * (view == "T"):
                want |= {(r.doc_id, p, (w, *read[p : p + w])) for p in range(len(read) - w + 1)}
    got = decontam.document_windows(df, kinds)
    held = collections.defaultdict(set)
    for r in got.collect():
        held[r.h].add((r.doc_id, r.p))
    windows = collections.defaultdict(set)
    for doc, p, key in want:
        windows[key].add((doc, p))
    assert len(held) == len(windows) and sorted(map(sorted, held.values())) == sorted(map(sorted, windows.values()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "xxhash64(8" in plan and "zip_with" not in plan and "slice(" not in plan
