"""The encoder's short ways give the tokenizer's own ids, and known words outlive a full table."""

import random

import numpy as np

from meshquarry.llm import tokens
from meshquarry.llm.tokens import Encoder, public_path


def test_short_ways_equal_the_tokenizer():
    enc, rng = Encoder(public_path()), random.Random(3)
    assert enc.plain and enc.units
    letters, marks = "abstrveldmzéßÀÿªº", "'.,!$%&*()-_<>|/:;@[]`{}~\"#+=?^\\0123 \n\t  "
    texts = ["".join(rng.choice(letters if rng.random() < p else marks) for _ in range(rng.randrange(60))) for p in (0.1, 0.5, 0.8, 0.95) for _ in range(400)]
    texts += ["A$$$ re%%% école!!! don't DON'TS ''s ,'s 'll'd", "a<|endoftext|>b", "a<|b", "x²y ½ µm", "ﬁn ΑΣ é", "a\x1cb\x85c\xa0d", "\x00a", "l'été.''", "WORD" * 400, "!" * 500]
    for _ in range(2):
        got = [np.frombuffer(x, enc.kind).tolist() for x in enc.encode(texts)]
        assert got == [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_known_words_outlive_a_full_table(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT_BYTES", 4_000)
    enc, asked = Encoder(public_path()), []
    plain = enc.plain

    class Counted:
        def encode_batch_fast(self, texts, **how):
            asked.extend(w for t in texts for w in t.split())
            return plain.encode_batch_fast(texts, **how)

    enc.plain = Counted()
    for k in range(60):
        (got,) = enc.encode([f"often met {''.join(chr(97 + (k * 7 + j) % 26) for j in range(9))}" + " zw" + chr(97 + k % 26) * (k + 1)])
        assert np.frombuffer(got, enc.kind).tolist()[:2] == enc.tokenizer.encode("often met", add_special_tokens=False).ids
    assert asked.count("often") == 1 and len(enc.stems) + len(enc.old[1]) < 60
