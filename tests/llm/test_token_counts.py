from __future__ import annotations

import random

import public_tokenizers
from tokenizers import Tokenizer

from touchline.llm import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
BITS = ["a", "the", " ", "  ", "\n", "\t", "é", "漢", "😀", "'s", "'ll", "don't", "123", "½", "²", "_", "--", "<|endoftext|>", "\x00", "\x1c",
        " ", "　", "ñ", "Ⅷ", "٣", "é", "“", "…", "\r", "word", "Tion", "​"]


def test_counts_equal_the_library(monkeypatch):
    monkeypatch.setattr(token_counts, "STEADY", 300)
    monkeypatch.setattr(token_counts, "FRESH", 100)
    rng = random.Random(9)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 20))) for _ in range(6000)]
    texts += ["".join(chr(rng.randint(32, 0x24F)) for _ in range(12)) for _ in range(3000)]
    tok = Tokenizer.from_file(PATH)
    counter = token_counts.Counter(PATH, token_counts.frequent_lengths(PATH))
    want = [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert [counter.count(t) for t in texts] == want


def test_every_character_is_counted_alike():
    tok = Tokenizer.from_file(PATH)
    counter = token_counts.Counter(PATH, token_counts.frequent_lengths(PATH))
    texts = [f"a{chr(c)} {chr(c)}b{chr(c)}" for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000]
    assert [counter.count(t) for t in texts] == [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_table_cases(spark, docs_of):
    long = "antidisestablishmentarianism" * 3000
    rows = [(1, None), (2, ""), (3, "one two"), (3, "one two"), (None, "x"), (5, long)]
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs_of(rows), PATH).collect())
    n = len(Tokenizer.from_file(PATH).encode(long).ids)
    assert got == [(0, 1, 1, False), (1, 0, 0, False), (2, 0, 0, False), (3, 7, 2, False), (3, 7, 2, False), (5, len(long), n, True)]
    assert token_counts.token_counts(docs_of(rows).limit(0), PATH).count() == 0
