"""Words are hashed for many texts at once, with the values they have one by one."""

from __future__ import annotations

import random

import pytest
import xxhash
from siltworks.llm import substring_dedup

RULE = substring_dedup.Passages()


class Long(dict):
    """Hashes of long words; short ones must not be asked for."""

    def __missing__(self, word: bytes) -> int:
        assert len(word) >= 32
        return xxhash.xxh64_intdigest(word)


def odd_texts() -> list[bytes]:
    rng = random.Random(5)
    texts = [b"", b" ", b"a", b"A\x0bB\x0c c\r\n\tdd\x1fE\x00 \x85", "Ünï  cöde  x　".encode(), b" ".join(bytes([97 + n % 26]) * n for n in range(80))]
    return texts + [bytes(rng.choice(b" \t\n\x0b\x1cabcXYZ\xc3\x85\x00") for _ in range(rng.randrange(300))) for _ in range(200)]


@pytest.mark.parametrize("texts", [odd_texts(), [], [b""], [b"", b" \n"], [b"x" * 31 + b" " + b"Y" * 32]])
def test_hashes_of_words_together_are_those_of_each_word(texts):
    hashes, words = substring_dedup.word_hashes(texts, Long())
    found = [t.lower().split() for t in texts]
    assert words.tolist() == [len(f) for f in found]
    assert hashes.tolist() == [xxhash.xxh64_intdigest(w) for f in found for w in f]


@pytest.mark.parametrize("together", [1, 500, 1 << 20])
def test_rows_of_each_text_whatever_is_hashed_together(monkeypatch, together):
    monkeypatch.setattr(substring_dedup, "TOGETHER", together)
    texts = [b"", *odd_texts(), b"one two three four five", b""]
    got = list(substring_dedup._row_of_each(texts, RULE.shingle, Long()))
    assert [g.tolist() for g in got] == [substring_dedup.shingle_row(t, RULE.shingle, Long()).tolist() for t in texts]
    assert not list(substring_dedup._row_of_each([], RULE.shingle, Long()))


def test_alignments_that_no_round_has_tried(spark):
    kind = "x long, y long, shifts array<long>"
    pairs = spark.createDataFrame([(1, 2, [3, 4, 5]), (1, 3, [0]), (2, 3, [7, 8]), (4, 1, [-1])], kind)
    tried = spark.createDataFrame([(1, 2, [3]), (1, 2, [5, 9]), (1, 3, [0, 1]), (4, 2, [-1])], kind)
    got = {(r["x"], r["y"]): sorted(r["shifts"]) for r in substring_dedup._untried(pairs, tried).collect()}
    assert got == {(1, 2): [4], (2, 3): [7, 8], (4, 1): [-1]}


def test_words_of_whole_copies(spark):
    text = "\x0b".join(f"w{i}" for i in range(60)) + " x \x1c\n"
    short = " ".join("ab" for _ in range(49))
    rows = [(1, text), (2, text), (None, text), (3, short), (4, short), (5, "x" * 200), (6, "x" * 200), (7, None), (8, "")]
    found = substring_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["start"], r["end"], r["match_id"]) for r in found) == [("2", 0, 61, 1), ("None", 0, 61, 1)]
