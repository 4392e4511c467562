"""Fertility rules against plain counts, and against the labels of the given documents."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from siltworks.llm import fertility
from siltworks.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def brute(text: str | None) -> tuple:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed


def test_base_columns_of_odd_texts(spark):
    words = " ".join(f"w{i}" for i in range(80))
    texts = [None, "", " \n\t\n", words, words + " " + words, "a a a a", "a a a", "x\ny\nx\n \n \nx", "#$|<>&%* " * 60, "  " * 90, "word" * 60_000, ("l\n" + words + "\n") * 3, "\U0001f600 " * 55]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(None, words, None), (3, words, "en")]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as measures", "2 as kept", "3 as grp", "'q' as _reasons", "4 as k0")
    got = fertility.rules(frame.repartition(4), ["doc_id"])
    assert got.count() == len(rows)
    found = sorted((str(r["doc_id"]), *(r[c] for c in BASE), r["kept"]) for r in got.collect())
    assert found == sorted((str(i), *brute(t), not brute(t)[-1]) for i, t, _ in rows)


def test_empty_table_and_no_language_column(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert fertility.rules(empty, ["doc_id"]).count() == 0
    frame = spark.createDataFrame([(1, "слово " * 3, None), (2, "", None), (3, "1 2 3", None)], SCHEMA)
    groups = {r["doc_id"]: r["band_group"] for r in fertility.rules(frame, ["doc_id"], lang_col=None).collect()}
    assert groups == {1: "script:CYRILLIC", 2: "script:", 3: "script:"}


def test_measures_of_known_tokens():
    encode, broken = fertility.loaded(fertility.default_vocabularies()[0])
    ids = encode("the the cat")
    n, per_token, share, entropy = fertility.token_measures(np.array(ids), broken, 9)
    counts = Counter(ids).values()
    assert (n, per_token, share) == (len(ids), 9 / len(ids), 0.0)
    assert math.isclose(entropy, -sum(c / n * math.log2(c / n) for c in counts))
    rare = np.array(encode("\U00012345" * 5))
    assert fertility.token_measures(rare, broken, 5)[2] > 0.3
    piece = fertility.loaded(fertility.Vocabulary("piece", "piece", public_tokenizers.path("piece_bpe_32k.model")))
    assert piece[1].sum() == 256 and piece[1][piece[0]("\U00012345")].any()


def test_slices_cover_the_text():
    for text in ("a" * 200_000, "ab cd\n" * 40_000, "", " " * 70_000, "é" * 65_537):
        parts = list(fertility.slices(text))
        assert "".join(parts) == text and all(len(p) <= fertility.SLICE for p in parts)


def prose(i: int, n: int = 120) -> str:
    stems = "river stone garden window letter market winter paper silver forest travel morning story music bread water light road house green".split()
    rng = random.Random(i)
    return " ".join(rng.choice(stems) + rng.choice(("", "s", "ed", "ing")) for _ in range(n))


def test_bands_by_language_survive_a_flood_of_copies(spark):
    rows = [(i, prose(i), "en") for i in range(150)]
    rows += [(1000 + i, rows[5][1], "en") for i in range(400)]
    noise = [(5000 + i, " ".join(w + "$$$" + "%&"[i % 2] for w in prose(i).split()), "en") for i in range(10)]
    got = {r["doc_id"]: r for r in fertility.rules(spark.createDataFrame(rows + noise, SCHEMA), ["doc_id"]).collect()}
    clean = [i for i, t, _ in rows if not brute(t)[-1]]
    assert clean and sum(got[i]["kept"] for i in clean) >= 0.97 * len(clean)
    assert not any(got[i]["kept"] for i, *_ in noise) and all(got[i]["reasons"] for i, *_ in noise)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.1"])
def test_labelled_documents(spark, folder):
    got = QUERIES["op13_fertility"](spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet").dropDuplicates(["doc_id"])
    rows = docs.select("doc_id", "text").join(labels, "doc_id").join(got, "doc_id").collect()
    assert all(tuple(r[c] for c in BASE) == brute(r["text"]) for r in rows[::10])
    good, bad = ([r["kept"] for r in rows if r["quality"] == q and not r["base_failed"]] for q in (1, 0))
    assert sum(good) > 0.99 * len(good) and sum(bad) < 0.06 * len(bad)
