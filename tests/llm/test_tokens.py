"""Tokenizers against the libraries."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from logweave.llm import bpe, viterbi

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def odd_texts(seed=1, n=300):
    rnd = random.Random(seed)
    pick = lambda: chr(
        rnd.choice([rnd.randrange(32, 127), 32, rnd.randrange(0x20, 0x3000), rnd.randrange(0x1F300, 0x1F700)])
    )
    made = ["".join(pick() for _ in range(rnd.randrange(80))) for _ in range(n)]
    return made + [
        "", " ", "  ", "a", "\n", " \t\n  x ", "a \nb", "a\n \nb", "a\n b", "x  y   z ", "A" * 3000, "ab" * 700, "'ll'LL don't",
        "<|endoftext|>", "x<|endoftext|>  <|endoftext|>y", "\u0085 　 x\x1c \x1dq", "é ñ 日本語 １２３ ½", "▁▁ b ▁", "<s> <0x41>",
    ]


@pytest.fixture(scope="module")
def coder():
    return bpe.load_tokenizer(BPE)


def test_same_ids_and_text_as_the_library(coder):
    library, texts = Tokenizer.from_file(BPE), odd_texts()
    for text, made, expected in zip(texts, coder.encode(texts), library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(made, "<u4").tolist() == expected.ids, text
        assert coder.decode(made) == library.decode(expected.ids, skip_special_tokens=False) == text


def test_decoding_of_broken_and_unknown_ids(coder):
    library = Tokenizer.from_file(BPE)
    rnd = random.Random(2)
    for _ in range(200):
        ids = [rnd.randrange(50257) for _ in range(rnd.randrange(9))]
        assert coder.decode(ids) == library.decode(ids, skip_special_tokens=False)
    assert coder.decode([50256, 60000, 64]) == "<|endoftext|>" + coder.decode([64])


def test_long_and_short_trees_agree(coder):
    """Trees that merge in step and a tree of its own give the plain merge order."""
    rnd = random.Random(3)
    words = ["".join(rnd.choice("thealonisred ") for _ in range(rnd.randrange(2, 64))) for _ in range(300)]
    coder.learn(words)

    def plain(data):
        tokens = coder.byte_ids[np.frombuffer(data, np.uint8)].tolist()
        while True:
            ranks = [coder.ranks.get(a * coder.size + b, 1 << 40) for a, b in zip(tokens, tokens[1:])]
            if not ranks or min(ranks) == 1 << 40:
                return tokens
            i = ranks.index(min(ranks))
            tokens[i : i + 2] = [int(coder.merged[ranks[i]])]

    for word in words:
        expected = plain(word.encode())
        assert np.frombuffer(coder._held[word], "<u4").tolist() == expected == coder.merge_one(word.encode())


def test_bpe_of_documents(docs, rows, nothing):
    library = Tokenizer.from_file(BPE)
    expected = Counter()
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        expected[(i, len(ids), digest, hashlib.sha256(decoded.encode()).hexdigest())] += 1
    found = bpe.round_trip_digests(docs, BPE).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found) == expected
    back = bpe.decode_documents(bpe.encode_documents(docs, BPE), BPE).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter((i, t or "") for i, t in rows)
    assert bpe.round_trip_digests(nothing, BPE).count() == 0


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY", 50)
    small, library = bpe.load_tokenizer(BPE), Tokenizer.from_file(BPE)
    for text in odd_texts(5, 60):
        assert np.frombuffer(small.encode([text])[0], "<u4").tolist() == library.encode(text).ids


# --- unigram counts ----------------------------------------------------------------------------------------------------

SMALL = [
    ("<unk>", 0.0), ("a", -1.0), ("b", -2.0), ("ab", -3.0), ("aab", -4.0), ("▁a", -2.0), ("▁", -1.5), ("ba", -3.0),
    ("xy", -5.0), ("▁ab", -3.0),
]


def library_counts(vocabulary, texts, fallback):
    tokenizer = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=fallback))
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_counts_equal_the_library():
    vocabulary, texts = viterbi.load_vocabulary(PIECES), odd_texts(7)
    counter = viterbi.UnigramCounter(vocabulary)
    assert [counter.text(t)[1] for t in texts] == library_counts(vocabulary, texts, True)


def test_ties_and_unknown_runs_equal_the_library():
    rnd = random.Random(8)
    texts = ["".join(rnd.choice("ab xy") for _ in range(rnd.randrange(16))) for _ in range(3000)]
    counter = viterbi.UnigramCounter(SMALL)
    assert [counter.text(t)[1] for t in texts] == library_counts(SMALL, texts, False)


def test_best_score_is_the_best_of_all_segmentations():
    scores = dict(SMALL)
    counter = viterbi.UnigramCounter(SMALL)

    def best(word):
        if not word:
            return 0.0
        found = [scores[word[:k]] + best(word[k:]) for k in range(1, len(word) + 1) if word[:k] in scores]
        return max(found + ([] if word[0] in scores else [counter.unknown + best(word[1:])]))

    rnd = random.Random(9)
    for _ in range(200):
        word = "▁" + "".join(rnd.choice("abxyz") for _ in range(rnd.randrange(9)))
        assert counter.word(word)[1] == best(word)


def test_counts_of_documents(docs, rows, nothing):
    counter = viterbi.UnigramCounter(viterbi.load_vocabulary(PIECES))
    expected = Counter((i, *counter.text(t or "")) for i, t in rows)
    found = viterbi.count_tokens(docs, PIECES).collect()
    assert Counter((r.doc_id, r.n_words, r.n_tokens, r.score) for r in found) == expected
    assert viterbi.count_tokens(nothing, PIECES).count() == 0
