"""Words remembered while tokenising, and the tokens counted together in a task of the Jaccard join."""

from __future__ import annotations

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from siltworks.llm import jaccard_join, packing


def test_a_word_behind_a_space_is_tokenised_once(monkeypatch):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids_of = packing.WordIds(tok)
    texts = ["one two two one", "two one two", "a  b", "a \x85b", "", "one"]
    want = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):
        assert [np.frombuffer(g, "<u4").tolist() for g in ids_of.encode(texts)] == want
    # The words themselves are the keys: no text is built for a word that is known.
    assert set(ids_of.known) == {"one", "two", "\x85b"}


def test_tokens_seen_twice_are_counted_and_what_is_held_let_go():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 50, 9000):
        held = [np.unique(rng.integers(0, n + 1, n).astype(np.uint64) << np.uint64(50)) for _ in range(4)]
        tokens, counts = np.unique(np.concatenate(held), return_counts=True)
        want = [(int(t), int(c)) for t, c in zip(tokens.view(np.int64), counts) if c > 1]
        got = [tuple(r.values()) for b in jaccard_join._seen_twice(held) for r in b.to_pylist()]
        assert got == want and not held
    assert not list(jaccard_join._seen_twice([]))
