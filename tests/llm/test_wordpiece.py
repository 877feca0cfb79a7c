"""Longest-match token counts against brute force, with and without word ends."""

import itertools
import random
import re

import public_tokenizers
import pytest

from skinnyqr.llm import wordpiece

WORD_BPE, BYTE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, n_words long, longest string"


def greedy(word, inner, final):
    """Longest piece first; one that takes the rest of the word must end words."""
    n = 0
    while word:
        n += 1
        if word in final:
            return n
        j = next((j for j in range(min(len(word) - 1, 130), 0, -1) if word[:j] in inner), 0)
        if not j:
            return -1
        word = word[j:]
    return n


def test_all_small_vocabularies_agree():
    rnd = random.Random(1)
    strings = [bytes(x) for k in range(1, 5) for x in itertools.product(b"ab", repeat=k)]
    words = [bytes(x) for k in range(0, 9) for x in itertools.product(b"abc", repeat=k) if k < 7 or x[0] == 97]
    for trial in range(25):
        inner = set(rnd.sample(strings, rnd.randint(1, 12)))
        final = None if trial % 3 == 0 else set(rnd.sample(strings, rnd.randint(1, 12)))
        machine = wordpiece.LongestMatch(inner, final)
        for w in rnd.sample(words, 600):
            assert machine.length(w) == greedy(w, inner, inner if final is None else final)


@pytest.mark.parametrize("path", [WORD_BPE, BYTE_BPE])
def test_table(spark, path):
    rnd = random.Random(2)
    inner, final = wordpiece.byte_pieces(path)
    assert (final is not None) == (path == WORD_BPE)
    bits = ["the", "ing", "Straße", "naïve", "日本", "🙂", "x", "123", ".", "tion"]
    rows = [(None, None), (1, ""), (2, " \t\n"), (3, "The"), (3, "The"), (4, "y" * 30_000), (5, "the cat " * 9000)]
    rows += [(10 + i, " ".join("".join(rnd.choice(bits) for _ in range(rnd.randint(1, 5))) for _ in range(rnd.randint(0, 40)))) for i in range(60)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)
    want = []
    for doc_id, text in rows:
        words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode())
        n = [greedy(w, inner, inner if final is None else final) for w in words]
        want.append((doc_id, len(n), sum(max(x, 1) for x in n), sum(x < 0 for x in n), max((abs(x) for x in n), default=0)))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted((tuple(r) for r in wordpiece.token_counts(docs, path).collect()), key=key) == sorted(want, key=key)
    assert wordpiece.token_counts(docs.limit(0), path).count() == 0


def test_ends_of_words_count():
    machine = wordpiece.LongestMatch({b"a", b"ab", b"b"}, {b"b", b"bc"})
    assert machine.length(b"ab") == 2  # a, b that ends the word: ab ends none
    assert machine.length(b"abbc") == 2 and machine.length(b"aba") == -1
