"""The pipeline from end to end on planted documents, and each stage on awkward and empty tables."""

from __future__ import annotations

import random
import zlib

import corpus_pipeline
import public_tokenizers
import pytest
from tokenizers import Tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
FOOT = "Read more on our pages and write to the editors at any time."
PASSAGE = "which of the seven rivers named in the old treaty ran dry before the second survey was made"
VILE = "you stupid worthless idiots should all shut up and get lost"


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 7))) for _ in range(n)) + "."


def planted() -> tuple[list[tuple], dict[int, str]]:
    rng, rows, kind = random.Random(8), [], {}
    near = [sentence(rng, 12) for _ in range(8)]
    for i in range(160):
        text = "\n".join(sentence(rng, 12) for _ in range(4))
        if i % 4 == 1 and i < 100:
            kind[i], text = "toxic", text + "\n" + f"{VILE}. {VILE}!"
        elif i in (100, 104, 108):
            kind[i] = "near"
            text = "\n".join([*near[:-1], near[-1].replace(".", f" {i}.")])
        elif i in (110, 114):
            kind[i], text = "leak", text + " " + PASSAGE.upper()
        elif i in (120, 121):
            kind[i], text = "foot", text + "\n" + FOOT
        else:
            kind[i] = "clean"
        if 130 <= i < 145:
            kind[i], text = "foot", text + "\n" + FOOT
        rows.append((i, text, "en", f"site{i % 23}", len(text)))
    return rows, kind


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("planted"))
    rows, kind = planted()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, int(kind[i] == "toxic")) for i, *_ in rows]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([("q1", PASSAGE), (None, None)], "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_run_keeps_clean_documents_and_drops_what_is_planted(spark, folder):
    rows, kind = planted()
    got = corpus_pipeline.run(spark, folder).collect()
    kept = {r["doc_id"] for r in got}
    assert {i for i, k in kind.items() if k in ("clean", "foot")} <= kept
    assert not kept & {i for i, k in kind.items() if k in ("toxic", "leak")}
    assert len(kept & {100, 104, 108}) == 1
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    pieces: dict[int, list] = {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append(r)
    for i, text, *_ in rows:
        if i in kept:
            text = "\n".join(line for line in text.split("\n") if line != FOOT)
            ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
            own = sorted(pieces[i], key=lambda r: r["piece"])
            assert [r["start"] for r in own] == [sum(r["length"] for r in own[:k]) for k in range(len(own))] and sum(r["length"] for r in own) == len(ids)
            for r in own:
                part = ids[r["start"] : r["start"] + r["length"]]
                assert r["ids_crc32"] == zlib.crc32(b"".join(t.to_bytes(4, "little") for t in part))
    filled: dict[int, list] = {}
    for r in got:
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in filled.values():
        assert [a for a, _ in sorted(places)] == [sum(n for _, n in sorted(places)[:k]) for k in range(len(places))] and sum(n for _, n in places) <= 2048


CLASHING = ("uid", "_t", "score", "spans", "copy", "c0", "mark", "cid")


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=[name for name, _ in corpus_pipeline.STAGES])
def test_stages_on_awkward_and_empty_tables(spark, folder, stage):
    name, function = stage
    one, two = sentence(random.Random(1), 30), sentence(random.Random(2), 4000)
    rows = [(1001, one, "en", "a", 3), (1001, one, "en", "a", 3), (1002, None, None, None, None), (1003, "", "", "", 0), (None, two, "en", "b", 1), (1004, two, None, "c", 2), (None, None, None, None, None), (1005, "\n \n", "de", "a", 3)]
    toxic = []
    if name == "toxicity":
        # Beside labelled documents, so that there is something to learn from.
        given, kind = planted()
        rows, toxic = rows + given, [r for r in given if kind[r[0]] == "toxic"]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", *[f"case when doc_id > 1001 then 'x' end as `{c}`" for c in CLASHING])
    got, none = function(spark, docs, folder), function(spark, docs.limit(0), folder)
    assert none.count() == 0 and none.schema.names == got.schema.names
    found = [tuple(r) for r in got.collect()]
    if name == "packing":
        assert sorted((r[0] is None, r[0] or 0) for r in found if r[1] == 0) == sorted((r[0] is None, r[0] or 0) for r in rows)
        return
    assert got.columns == docs.columns
    texts = sorted(repr(r[1]) for r in found)
    if name == "near_duplicates":
        # Repeated texts are one group; texts without words are linked with nothing.
        assert texts == sorted(map(repr, [one, two, None, None, "", "\n \n"]))
    elif name == "line_dedup":
        assert len(found) == len(rows) and one in {r[1] for r in found} and two in {r[1] for r in found}
    else:
        want = [tuple(r) for r in docs.collect() if tuple(r[:5]) not in toxic]
        assert sorted(found, key=repr) == sorted(want, key=repr)
