"""Cross-tokenizer alignment against brute force over overlapping byte ranges."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from skinnyqr.llm import alignment as al
from skinnyqr.llm.bpe import byte_alphabet

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, n_a long, links string, nth string, pair string"


def corpus():
    rnd = random.Random(3)
    bits = ["the ", "Straße", "naïve", " über", "日本語", "🙂", "  ", "\n", "x", "123", "...", "tion", " and", "▁", " ", "<|endoftext|>", "</s>", "<0x41>", "é"]
    rows = [(None, None), (1, ""), (2, " "), (3, "a"), (3, "a"), (4, "▁ lower block"), (5, "y" * 20_000), (6, "ｆｕｌｌ　ｗｉｄｔｈ")]
    rows += [(10 + i, "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 60)))) for i in range(150)]
    rows += [(200, "the cat sat on the mat " * 800), (201, "the cat sat on the mat " * 800)]
    return [(*r, "en", 1, "l", "n", "p") for r in rows]


def brute(rows):
    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    byte_of = {c: i for i, c in enumerate(byte_alphabet())}
    sp = sentencepiece.SentencePieceProcessor(model_file=B)

    def piece(i):
        p = sp.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()

    docs, counts = [], collections.Counter()
    for doc_id, text, *_ in rows:
        a = tok.encode(" " + text, add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        ta = [bytes(byte_of[c] for c in tok.id_to_token(i)) for i in a]
        tb = [piece(i) for i in b]
        if not text or b"".join(ta) != (" " + text).encode() or b"".join(tb) != (" " + text).encode():
            a, b, ta, tb = [], [], [], []
        ea, eb = np.cumsum([len(t) for t in ta]).tolist(), np.cumsum([len(t) for t in tb]).tolist()
        out, at = [], 0
        for end in sorted(set(ea) & set(eb)):
            out.append(([i for i, e in zip(a, ea) if at < e <= end], [i for i, e in zip(b, eb) if at < e <= end]))
            at = end
        links = [(i, j) for i, e in zip(a, ea) for j, f in zip(b, eb) if e == f] if len(a) < 3000 else [(x[-1], y[-1]) for x, y in out]
        counts.update(links)
        text_of = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in out)
        docs.append((doc_id, len(a), len(b), len(out), links, hashlib.sha256(text_of.encode()).hexdigest() if a else ""))
    best = collections.defaultdict(int)
    for (_, j), c in counts.items():
        best[j] = max(best[j], c)
    return collections.Counter((d, na, nb, g, len(ls), sum(counts[p] == best[p[1]] for p in ls), sum(counts[p] for p in ls), s) for d, na, nb, g, ls, s in docs)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.mark.parametrize("most", [al.MAX_PAIRS, 20, 0])
def test_alignment_table(docs, monkeypatch, most):
    monkeypatch.setattr(al, "MAX_PAIRS", most)
    monkeypatch.setattr(al, "SLICE_BYTES", 2000)
    assert collections.Counter(tuple(r) for r in al.alignment_table(docs, A, B).collect()) == brute(corpus())


def test_groups_of_each_text(docs):
    for r in al.align(docs, A, B).collect():
        assert len(r.a_group) == len(r.a_ids) == r.n_a and len(r.b_group) == len(r.b_ids) == r.n_b
        assert sorted(set(r.a_group)) == sorted(set(r.b_group)) == list(range(r.n_groups)) and len(r.group_end) == r.n_groups
        by = collections.defaultdict(lambda: ([], []))
        for side, (ids, group) in enumerate([(r.a_ids, r.a_group), (r.b_ids, r.b_group)]):
            for i, g in zip(ids, group):
                by[g][side].append(i)
        text = ";".join(",".join(map(str, by[g][0])) + "|" + ",".join(map(str, by[g][1])) for g in range(r.n_groups))
        assert r.groups_sha256 == (hashlib.sha256(text.encode()).hexdigest() if r.n_groups else "")
        if r.doc_id == 200:
            assert r.group_end[-1] == len("the cat sat on the mat " * 800)


def test_no_texts(spark):
    assert al.alignment_table(spark.createDataFrame([], SCHEMA), A, B).count() == 0


def test_jumping_labels_components():
    rng = np.random.default_rng(0)
    for _ in range(200):
        total = int(rng.integers(1, 60))
        ends = [np.unique(np.append(rng.integers(1, total + 1, rng.integers(0, total)), total)) for _ in range(2)]
        ga, gb = al.groups(*ends)
        common = np.intersect1d(*ends)
        assert ga.tolist() == np.searchsorted(common, ends[0]).tolist() and gb.tolist() == np.searchsorted(common, ends[1]).tolist()
    long = [np.append(np.arange(1, 200_001, 2), 200_001), np.append(np.arange(2, 200_002, 2), 200_001)]
    assert al.groups(*long)[0].max() == 0  # one chain over all tokens


def test_ranks_and_library_encode_alike(monkeypatch):
    """The fast encoder, the library that reads the file, and the fast one's condition."""
    rnd = random.Random(8)
    texts = ["".join(chr(rnd.choice([*range(32, 127), 9, 10, 0x3B1, 0x4E2D, 0x1F600, 0x301, 0xA0, 0x2003])) for _ in range(rnd.randint(0, 80))) for _ in range(2000)]
    texts += ["<|endoftext|>", "a'll I'VE", "1234567 12 3", "   \n\n x", "é" * 500]
    fast = al.byte_level.__wrapped__(A)[0](texts)
    monkeypatch.setattr(al, "_PLAIN", {"type": "other"})
    slow = al.byte_level.__wrapped__(A)[0](texts)
    assert fast == slow
