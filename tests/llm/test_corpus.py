"""The corpus operators against brute force, SQL, round trips and held-out labels, with nulls, ties and clashing names."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from siltworks.llm import components, decontaminate, exact_dedup, html_extract, jaccard_join, line_dedup, packing, quality, substring_dedup, toxicity, warc
from siltworks.llm import queries as corpus
from siltworks.llm.frames import table
from tests.oracle import compare, connect, kinds

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def prose(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns named like the operators' own."""
    long_text = " ".join(prose(20_000, 1))
    rows = [
        (1, "One text. Ärger\nline", "a"), (1, "One text. Ärger\nline", "a"), (2, "one TEXT. Ärger\nline", None), (3, "one text. ärger\nline", "b"),
        (4, None, "a"), (5, "", None), (None, "One text. Ärger\nline", "a"), (None, None, None), (6, long_text, "b"), (7, long_text, "c"), (8, "a\x00b ��", "c"),
    ]
    out = docs_of(spark, rows)
    for name in ("uid", "_uid", "doc", "norm", "mark", "cut", "_t", "c0", "C1", "spans", "score", "copy"):
        out = out.selectExpr("*", f"case when doc_id = 1 then null else 'x' end as `{name}`")
    return out


def brute_exact(rows, keep):
    groups: dict[str, list] = {}
    for i, t in rows:
        norm = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        groups.setdefault(norm, []).append(i)
    out = []
    for norm, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = keep(known) if known else None
        out += [(i, best, len(ids), hashlib.sha256(norm.encode()).hexdigest()) for i in ids]
    return out


def sort_key(row):
    return [(x is None, str(x)) for x in row]


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_groups(spark, awkward, small, keep):
    for df in (awkward, table(spark, small, "documents"), awkward.limit(0)):
        rows = [(r["doc_id"], r["text"]) for r in df.collect()]
        got = exact_dedup.exact_groups(df, keep=keep).collect()
        want = brute_exact(rows, min if keep == "smallest" else max)
        assert sorted([(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got], key=sort_key) == sorted(want, key=sort_key)
        for sha, group in itertools.groupby(sorted(got, key=lambda r: r["text_sha256"]), key=lambda r: r["text_sha256"]):
            group = list(group)
            assert sum(r["kept"] for r in group) == 1
            assert all(r["doc_id"] == r["keep_id"] for r in group if r["kept"])


def test_exact_groups_across_borders(spark):
    rows = [(i, f"Hot {i % 3 and i}", "a") for i in range(600)]
    df = docs_of(spark, rows).repartition(16)
    got = {r["doc_id"]: r for r in exact_dedup.exact_groups(df, keep="largest").collect()}
    assert {r["keep_id"] for i, r in got.items() if i % 3 == 0} == {597}
    assert {r["group_size"] for i, r in got.items() if i % 3 == 0} == {200}
    assert [i for i, r in got.items() if r["kept"] and i % 3 == 0] == [597]


PAGE = """<html><body><header class="site"><a href=/>Home</a></header><div id="cookie-notice">We use cookies to make it nice. Accept them now please.</div>
<div class="layout"><div class="post-body"><h1>Title here</h1><p>Some long text&nbsp;about &lt;things&gt; that are
 &#8220;important&#8221; in <i>li</i>fe.</p><div class="advert">Buy now! This is a great offer for you.</div><p>Short.<ul><li>one thing</li></ul></div>
<aside><h3>Related</h3><a href=x>Link one</a></aside></div><form action=x><label>Name</label><button>Send</button></form><script>var a = "<p>no</p>";</script>
<section id="comments"><p>I liked this a lot, as a reader. Very good text indeed.</p></section><footer>&copy; 2020</foo"""


def test_html_main_text(spark):
    want = "Title here Some long text about <things> that are “important” in life. Short. one thing"
    assert html_extract.main_text(PAGE, html_extract.PRIOR)[0] == want
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, None), (None, None, None, None), (3, "v", "", "x"), (4, "w", "<p", "x"), (5, "w", "<a '\"<" * 2000, "x")], "page_id long, url string, html string, text2 string")
    got = html_extract.extract(pages, html_extract.train(pages), ["page_id", "url"]).collect()
    assert [(r["page_id"], r["text"]) for r in got][:5] == [(1, want), (1, want), (None, ""), (3, ""), (4, "")]
    assert html_extract.extract(pages.limit(0), html_extract.train(pages.limit(0)), ["page_id"]).count() == 0


def test_html_given_pages_equal_their_articles(spark, small):
    import html as entities

    pages = table(spark, small, "pages")
    for r in html_extract.extract(pages, html_extract.train(pages), ["page_id", "html"]).collect():
        article = re.search(r"<article>(.*?)(</article>|<footer)", r["html"], re.S)[1]
        plain = re.sub(r"</?b>", "", re.sub(r"</?(p|h1|br)>", " ", article))
        assert r["text"] == " ".join(entities.unescape(plain).split())


def test_html_without_end_of_head():
    body = "<article><h1>Title here</h1><p>Some long text about things that are important in life.</p></article></html>"
    want = "Title here Some long text about things that are important in life."
    for head in ("<head><title>x</title><meta a=b><script>var y = '<p>';</script>", "<head><title>x</title></head>", "<head>", "<head><style>p {}</style><link rel=x><!-- c -->\n"):
        for start in ("<body>", ""):
            assert html_extract.main_text(f"<!doctype html><html>{head}{start}{body}", html_extract.PRIOR)[0] == want
    assert html_extract.main_text(f"<html><body><video src=a><svg>{body}", html_extract.PRIOR)[0] == want
    assert html_extract.main_text(f"<html><body>{body}<script>var z = 1; <p>never text", html_extract.PRIOR)[0] == want


def test_minimum_cut_is_the_least_labelling():
    rng = random.Random(3)
    for _ in range(120):
        n = rng.randint(1, 9)
        graph = html_extract.Graph([rng.uniform(-2, 2) for _ in range(n)])
        for a, b in itertools.combinations(range(n), 2):
            if rng.random() < 0.5:
                graph.tie(a, b, rng.uniform(0, 2))

        def cost(labels):
            own = sum(max(0, c) if not x else max(0, -c) for c, x in zip(graph.costs, labels))
            return own + sum(w for i, e in graph.edges.items() for j, w in e.items() if i < j and labels[i] != labels[j])

        best = min(cost(x) for x in itertools.product((False, True), repeat=n))
        assert cost(html_extract.minimum_cut(graph)) == pytest.approx(best)


def held_out_auc(scored, labels, column):
    known = {r["doc_id"]: r[column] for r in labels.collect()}
    rows = [(r["score"], known[r["doc_id"]]) for r in scored.collect() if r["held_out"] and r["doc_id"] in known]
    pairs = [(a > b) + 0.5 * (a == b) for a, x in rows if x for b, y in rows if not y]
    return sum(pairs) / len(pairs)


def test_classifiers_on_the_held_out_fold(spark):
    folder = "/root/testdata/sf0.01"
    labels = table(spark, folder, "labels")
    got = corpus.QUERIES["op3_quality"](spark, folder)
    assert held_out_auc(got, labels, "quality") > 0.95
    fold = {r["doc_id"]: r["held_out"] for r in got.collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in fold.items())
    assert held_out_auc(corpus.QUERIES["op8_toxicity"](spark, folder), labels, "toxic") > 0.85


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifiers_take_awkward_rows(spark, awkward, small, module):
    docs, labels = table(spark, small, "documents"), table(spark, small, "labels")
    for model in (module.train(docs, labels), module.train(docs, labels.limit(0)), module.train(awkward, spark.createDataFrame([(1, 0, None), (1, 1, 1), (4, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int"))):
        got = module.score(awkward, model, ["doc_id"]).collect()
        assert len(got) == awkward.count() and all(0 <= r["score"] <= 1 for r in got)
        assert module.score(awkward.limit(0), model, ["doc_id"]).count() == 0


def test_toxicity_learns_sentences_and_names_them(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(240):
        parts = [" ".join(prose(8, 1000 * i + k)) for k in range(4)]
        bad = i % 3 == 0
        if bad:
            parts[i % 4] += " grumblefoo"
        rows.append((i, ". ".join(parts) + ".", "a"))
        labels.append((i, 1, int(bad)))
        rng.random()
    docs = docs_of(spark, rows)
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    for r in toxicity.score(docs, model, ["doc_id", "text"]).collect():
        assert (r["score"] >= 0.5) == (r["doc_id"] % 3 == 0)
        assert [("grumblefoo" in r["text"].encode()[w["start"] : w["end"]].decode()) for w in r["worst"]] == [True] * (r["doc_id"] % 3 == 0)
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] % 3 for r in kept.collect()} == {1, 2}


def test_training_sample_skips_only_what_does_not_fit(spark):
    from siltworks.llm.labelled import Bound, training_rows

    rows = [(i, f"text {i} " + ("long " * 2000 if i % 7 == 0 else "short"), "a") for i in range(60)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    texts, ys, _ = training_rows(docs_of(spark, rows), labels, "toxic", Bound(text_bytes=9_000))
    taught = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5 and i % 7]
    assert sorted(texts) == sorted(rows[i][1].encode() for i in taught) and sorted(ys) == sorted(i % 2 for i in taught)
    # One identifier with many texts leaves room for the other class.
    many = docs_of(spark, [(1, f"one {i}", "a") for i in range(50)] + [(2, f"two {i}", "a") for i in range(50)])
    both = training_rows(many, spark.createDataFrame([(1, 1, 1), (2, 1, 0)], labels.schema), "toxic", Bound(rows_per_class=10))
    assert sorted(both[1]) == [0] * 10 + [1] * 10


def test_nothing_to_learn_from_drops_nothing(spark, monkeypatch):
    docs = docs_of(spark, [(i, f"text {i}", "a") for i in range(9)])
    for rows in ([], [(1, 1, 1), (2, 1, 1)]):
        labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
        assert toxicity.drop_toxic(docs, toxicity.train(docs, labels)).count() == 9
        assert quality.keep_good(docs, quality.train(docs, labels), threshold=0.6).count() == 9
        monkeypatch.setattr(corpus, "table", lambda spark, folder, name: labels if name == "labels" else docs)
        assert {r["predicted"] for r in corpus.QUERIES["op8_toxicity"](spark, "").collect()} == {0}


def test_quality_keeps_good_texts(spark, awkward, small):
    model = quality.train(table(spark, small, "documents"), table(spark, small, "labels"))
    kept = quality.keep_good(awkward, model, threshold=0.0)
    assert kept.columns == awkward.columns and kept.count() == awkward.count()


def test_warc_round_trip(spark, tmp_path):
    body = "x" * 150 + "\r\n\r\nWARC/1.1\r\n é"
    rows = [(3, "http://a/ b\r\nX: y", body), (1, None, body), (1, None, body), (2, "u", "short"), (4, "u", "short"), (None, "u", body), (None, None, None), (9, "v", "<p>" * 300_000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    index = warc.write_archives(pages, str(tmp_path / "w"))
    got = warc.read_records(index, str(tmp_path / "w")).collect()
    assert sorted((r["page_id"] or 0, r["payload_bytes"], r["payload_digest"]) for r in got) == sorted((i or 0, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest()) for i, _, h in rows)
    same = [r for r in got if r["payload_bytes"] == len(body.encode())]
    assert [(r["page_id"], r["payload"].decode()) for r in same if r["record_type"] == "response"] == [(1, body)]
    assert sorted((r["page_id"] or 0, r["refers_to"]) for r in same if r["record_type"] == "revisit") == [(0, 1), (1, 1), (3, 1)]
    assert {r["record_type"] for r in got if r["payload_bytes"] < 100} == {"response"}
    some = warc.read_records(index.where("page_id = 9"), str(tmp_path / "w")).collect()
    assert [r["payload"].decode() for r in some] == ["<p>" * 300_000]
    assert warc.read_records(warc.write_archives(pages.limit(0), str(tmp_path / "e")), str(tmp_path / "e")).count() == 0


def test_ranges_coalesce():
    rows = [("a", 0, 10), ("a", 10, 10), ("a", 100_000, 10), ("b", 0, 10)]
    assert [len(g) for g in warc.ranges(rows)] == [2, 1, 1]
    assert [len(g) for g in warc.ranges(rows, gap=1 << 20)] == [3, 1]
    assert [len(g) for g in warc.ranges(rows, read_bytes=10)] == [1, 1, 1, 1]


def brute_jaccard(rows, rule):
    def shingles(text):
        w = (text or "").encode().lower().split()
        n = min(rule.shingle, len(w))
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= rule.percent * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    members: dict[int, list] = {}
    for i, (d, _) in enumerate(rows):
        members.setdefault(find(i), []).append(d)
    least = {r: min((d for d in m if d is not None), default=None) for r, m in members.items()}
    return [(d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)]


@pytest.mark.parametrize("rule", [jaccard_join.Rule(4, 85), jaccard_join.Rule()])
def test_jaccard_join_equals_brute_force(spark, awkward, small, rule):
    rng = random.Random(11)
    made = []
    for g in range(12):
        base = prose(rng.choice((3, 9, 40, 120)), g)
        for v in range(8):
            words = list(base)
            for _ in range(int(len(words) * rng.uniform(0, 0.06))):
                words[rng.randrange(len(words))] = f"w{rng.random()}"
            made.append((100 * g + v, " ".join(words), "a"))
    for df in (docs_of(spark, made), awkward, table(spark, small, "documents"), awkward.limit(0)):
        rows = [(r["doc_id"], r["text"]) for r in df.collect()]
        got = jaccard_join.similar_groups(df, rule).collect()
        assert sorted([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got], key=sort_key) == sorted(brute_jaccard(rows, rule), key=sort_key)
    kept = jaccard_join.drop_similar(awkward)
    assert kept.columns == awkward.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect() if r["text"]) == [1, 3, 6, 8]
    assert kept.where("coalesce(text, '') = ''").count() == 3


def test_sketches_never_overstate_the_difference():
    rng = np.random.default_rng(4)
    for n, m, common in ((1, 1, 0), (40, 44, 38), (300, 257, 250), (500, 520, 10), (2000, 1800, 1700)):
        tokens = rng.integers(0, 1 << 63, n + m, dtype=np.uint64)
        a, b = np.unique(tokens[:n]), np.unique(tokens[n - common : n + m - common])
        true = len(np.setxor1d(a, b))
        assert jaccard_join.differ(jaccard_join.sketch(a), jaccard_join.sketch(b)) <= true
        assert jaccard_join.differ(jaccard_join.sketch(a), jaccard_join.sketch(b)) >= 0.6 * true - 2


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (7, 7)], "x long, y long")
    got = {r["node"]: r["root"] for r in components.components(links).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100}
    assert components.components(links.limit(0)).count() == 0


def brute_hits(text, items, window=10):
    split = lambda t: re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    w, hit, names = split(text), set(), set()
    for item, t in items:
        v = split(t)
        n = min(window, len(v))
        for i in range(len(v) - n + 1 if n else 0):
            for j in range(len(w) - n + 1):
                if w[j : j + n] == v[i : i + n]:
                    hit |= set(range(j, j + n))
                    names.add(str(item))
    return len(w), len(hit), sorted(names)


@pytest.mark.parametrize("block_bytes", [decontaminate.BLOCK_BYTES, 300])
def test_decontamination_equals_brute_force(spark, awkward, block_bytes):
    item = " ".join(prose(25, 4))
    items = [(1, item), (10, "zwölf Wörter-zwölf"), (2, None), (3, "..."), (4, item), (5, "solo")]
    texts = [item.upper(), "x " + item[20:] + " y", "Zwölf, wörter; Zwölf!", "nothing here", "so solo so Solo", item + " " + item]
    docs = docs_of(spark, [(i, t, "a") for i, t in enumerate(texts)]).unionByName(awkward.select(*DOCS.replace(" long", "").replace(" string", "").split(", ")))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = [(r["doc_id"], *brute_hits(r["text"], items)) for r in docs.where("length(text) < 5000 or text is null").collect()]
    got = decontaminate.hits(docs.where("length(text) < 5000 or text is null"), bench, ["doc_id"], block_bytes=block_bytes).collect()
    assert sorted([(r["doc_id"], r["n_words"], sum(s["b"] - s["a"] for s in r["spans"]), r["items"]) for r in got], key=sort_key) == sorted(want, key=sort_key)
    assert {r["doc_id"] for r in decontaminate.decontaminate(docs.limit(6), bench).collect()} == {3}
    cut = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(docs.limit(6), bench, remove="spans").collect()}
    assert cut[0] == "" and cut[2] == "!" and cut[4] == "so  so " and cut[3] == "nothing here"
    assert decontaminate.decontaminate(awkward, bench.limit(0)).columns == awkward.columns
    assert decontaminate.decontaminate(awkward, bench.limit(0)).count() == awkward.count()


def test_given_contamination_equals_brute_force(spark, small):
    items = [(r["item_id"], r["text"]) for r in table(spark, small, "benchmark").collect()]
    docs = table(spark, small, "documents").where("length(text) < 1500")
    got = {r["doc_id"]: (r["n_words"], sum(s["b"] - s["a"] for s in r["spans"]), r["items"]) for r in decontaminate.hits(docs, table(spark, small, "benchmark"), ["doc_id"]).collect()}
    assert got == {r["doc_id"]: brute_hits(r["text"], items) for r in docs.collect()}


def test_word_ids_are_the_tokenizers_own(spark, small):
    tok = Tokenizer.from_file(TOKENIZER)
    texts = [r["text"] for r in table(spark, small, "documents").collect()]
    texts += ["", " ", "  a", "a  b", "a \n b", "a\n\nb c", "a  b", "it's 3 o'clock x", "a <|endoftext|> b", "tab\tb c", " x y", "a\x1cb c", "né́ c", "a\r\nb c", "x\n", " lead", "trail "]
    got = packing.WordIds(tok, remembered=50).encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_packing_round_trip(spark, awkward, small):
    tok = Tokenizer.from_file(TOKENIZER)
    for df in (awkward, table(spark, small, "documents")):
        got = packing.pack_documents(df, TOKENIZER, capacity=512, group_pieces=100, keep_ids=True).collect()
        want = {}
        for r in df.collect():
            ids = tok.encode(r["text"] or "", add_special_tokens=False).ids + [0]
            want.setdefault((r["doc_id"], tuple(ids)), 0)
            want[(r["doc_id"], tuple(ids))] += 1
        found: dict = {}
        for _, own in itertools.groupby(sorted(got, key=lambda r: (r["copy"], r["piece"])), key=lambda r: r["copy"]):
            own = list(own)
            assert [r["piece"] for r in own] == list(range(len(own)))
            assert [r["start"] for r in own] == list(np.cumsum([0] + [r["length"] for r in own])[:-1])
            assert all(r["length"] == 512 for r in own[1:])
            assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in own)
            key = (own[0]["doc_id"], tuple(i for r in own for i in r["ids"]))
            found[key] = found.get(key, 0) + 1
        assert found == want
        for _, own in itertools.groupby(sorted(got, key=lambda r: (r["sequence_id"], r["offset"])), key=lambda r: r["sequence_id"]):
            own = list(own)
            assert [r["offset"] for r in own] == list(np.cumsum([0] + [r["length"] for r in own])[:-1])
            assert sum(r["length"] for r in own) <= 512
    assert packing.pack_documents(awkward.limit(0), TOKENIZER).count() == 0


def test_packing_uses_few_sequences():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 2048, 12_000)
    sequence, offset = packing.fewest(sizes, 2048)
    filled = np.bincount(sequence, sizes)
    assert filled.max() <= 2048 and len(filled) <= 1.01 * np.ceil(sizes.sum() / 2048)


def test_line_dedup_keeps_what_is_no_boilerplate(spark, awkward):
    own = [" ".join(prose(30, 50 + i)) for i in range(24)]
    rows = [(i, f"{own[i]}\n  Site notice \n\nmore {i}", f"s{i % 12}") for i in range(24)]
    rows += [(100 + i, "copied text all of it\nand its second line", f"s{i}") for i in range(12)] + [(200 + i, f"two sites only\n{own[i]}", f"s{i % 2}") for i in range(12)]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs_of(spark, rows), report=True).collect()}
    for i in range(24):
        assert got[i]["text"] == f"{own[i]}\n\nmore {i}" and (got[i]["n_lines"], got[i]["n_cut"]) == (4, 1)
    assert all(got[100 + i]["text"] == "copied text all of it\nand its second line" for i in range(12))
    assert all(got[200 + i]["n_cut"] == 0 for i in range(12))
    out = line_dedup.recount(line_dedup.dedup_lines(awkward, min_sites=2))
    assert out.columns == awkward.columns and out.count() == awkward.count()
    assert line_dedup.dedup_lines(awkward.limit(0)).count() == 0


def test_pipeline_cuts_boilerplate_whatever_its_share(spark, awkward):
    import corpus_pipeline

    head, foot = " ".join(prose(12, 61)), " ".join(prose(12, 62))
    rows = [(i, f"{head}\nshort {i}\n{foot}", f"s{i % 12}") for i in range(24)]
    rows += [(100 + i, "copied text all of it\nand its second line", f"s{i}") for i in range(12)]
    rows += [(200 + i, f"{head}\nthe same page\n{foot}", f"s{i}") for i in range(12)] + [(300, "copied text all of it\nand more", "s1"), (301, None, "s1")]
    df = docs_of(spark, rows)
    got = {r["doc_id"]: r for r in corpus_pipeline.without_boilerplate(spark, df, "").collect()}
    assert len(got) == len(rows) and got[301]["text"] is None
    for i in range(24):
        assert got[i]["text"] == f"short {i}" and got[i]["n_chars"] == len(f"short {i}")
    assert all(got[100 + i]["text"] == "copied text all of it\nand its second line" and got[200 + i]["text"] == "the same page" for i in range(12))
    assert got[300]["text"] == "copied text all of it\nand more"
    out = line_dedup.dedup_lines(awkward, min_sites=2, most_cut=None)
    assert out.columns == awkward.columns and out.count() == awkward.count()


def test_repeated_passages_are_found_and_others_are_not(spark, awkward):
    shared = [prose(70, 900 + k) for k in range(3)]
    near = list(shared[2])
    near[35] = "edited"
    rows, planted = [], {}
    for i in range(60):
        own = prose(150, 2000 + i)
        cut = 20 + i
        if i < 12:
            k = i % 3
            passage = near if k == 2 and i % 2 else shared[k]
            own = own[:cut] + passage + own[cut:]
            planted[i] = (cut, cut + 70)
        rows.append((i, " ".join(own), "a"))
    line = " ".join(prose(25, 77))
    rows = [(i, t + "\n" + line if i % 2 else line + "\n" + t, s) for i, t, s in rows]
    df = docs_of(spark, rows)
    got = substring_dedup.repeats(df).collect()
    seen = {r["doc_id"] for r in got} | {r["match_id"] for r in got}
    assert seen == set(planted)
    assert {r["doc_id"] for r in got} == set(range(3, 12))
    for r in got:
        assert r["doc_id"] % 3 == r["match_id"] % 3 and r["similarity"] >= 0.8
        shift = 0 if r["doc_id"] % 2 else 25
        a, b = planted[r["doc_id"]]
        assert abs(r["start"] - a - shift) <= 12 and abs(r["end"] - b - shift) <= 12
    texts = {r["doc_id"]: r["text"] for r in substring_dedup.cut_repeats(df).collect()}
    assert all(len(texts[i].split()) <= 190 for i in range(3, 12)) and texts[0] == rows[0][1] and texts[40] == rows[40][1]
    odd = substring_dedup.repeats(awkward).collect()
    assert {(r["doc_id"], r["match_id"], r["end"]) for r in odd} == {(7, 6, 20_000)}
    assert substring_dedup.cut_repeats(awkward).columns == awkward.columns
    assert substring_dedup.repeats(awkward.limit(0)).count() == 0


def test_rows_keep_their_numbers_when_scans_differ(spark, tmp_path):
    import pyarrow as pa

    text = " ".join(prose(120, 8000))
    rows = [(i, text if i in (3, 17, 30) else text + " " + " ".join(prose(12, 8001)) if i == 25 else " ".join(prose(120, 8002 + i)), "a") for i in range(40)]

    def mixed(batches):
        held = pa.Table.from_batches(list(batches))
        yield from held.take(np.random.default_rng().permutation(held.num_rows)).to_batches()

    # Rows come in another order in every scan, as they do when splits are cut anew for other executors.
    df = docs_of(spark, rows).coalesce(1)
    df = df.mapInArrow(mixed, df.schema)
    groups = jaccard_join.similar_groups(df, jaccard_join.Rule()).collect()
    assert {r["doc_id"]: r["component_id"] for r in groups} == {i: 3 if i in (3, 17, 25, 30) else i for i in range(40)}
    kept = jaccard_join.drop_similar(df).collect()
    assert sorted(r["doc_id"] for r in kept) == [i for i in range(40) if i not in (17, 25, 30)]
    got = substring_dedup.repeats(df).collect()
    found = {r["doc_id"] for r in got} | {r["match_id"] for r in got}
    assert found == {3, 17, 25, 30}
    texts = sorted(r["text"] for r in substring_dedup.cut_repeats(df).collect() if r["doc_id"] in (3, 17, 25, 30))
    assert sum(t.count(text[:200]) for t in texts) == 1
    index = warc.write_archives(df.selectExpr("doc_id as page_id", "source as url", "text as html"), str(tmp_path / "w"), id_col="page_id")
    pages = {r["page_id"]: r for r in warc.read_records(index, str(tmp_path / "w")).collect()}
    assert pages[3]["record_type"] == "response" and all(pages[i]["refers_to"] == 3 for i in (17, 30))


def test_exact_repeats_are_paired_whatever_else_has_their_windows(spark):
    rows, wanted = [], set()
    for i in range(24):
        passage = prose(52, 7000 + i)
        # The first text has a part of the passage only, too little to be one.
        for k, words in enumerate((passage[4:44], passage, passage)):
            own = prose(120, 7100 + 3 * i + k)
            rows.append((3 * i + k, " ".join(own[: 30 + k] + words + own[30 + k :]), "a"))
        wanted.add((3 * i + 2, 3 * i + 1))
    got = substring_dedup.repeats(docs_of(spark, rows).coalesce(1)).collect()
    assert {(r["doc_id"], r["match_id"]) for r in got} >= wanted
    assert all(r["doc_id"] // 3 == r["match_id"] // 3 for r in got)


def test_one_edited_word_anywhere_keeps_a_passage():
    rule, known = substring_dedup.Passages(), jaccard_join._Hashes()

    def row(words):
        return substring_dedup.shingle_row(" ".join(words).encode(), rule.shingle, known)

    for n in range(50, 75):
        passage = prose(n, 6000 + n)
        before, after = prose(40, 6100 + n), prose(40, 6200 + n)
        for i in range(n):
            near = passage[:i] + ["edited"] + passage[i + 1 :]
            x, y = row(before + passage + after), row(prose(25, 6300 + n) + near + prose(60, 6400 + n))
            seed = i + 1 if i < n // 2 else 0
            got = substring_dedup.passages(x, y, [(40 + seed, 25 + seed)], rule)
            assert len(got) == 1, (n, i)
            a, b, c, d, similarity = got[0]
            assert min(b - a, d - c) >= rule.width and similarity >= 0.8 and abs(a - 40) <= 12 and abs(b + 4 - 40 - n) <= 12
    assert not substring_dedup.passages(row(before + passage[:44] + after), row(after + passage[:44] + before), [(45, 45)], rule)


def test_window_positions_are_the_wide_nodes_of_the_tree():
    rng = np.random.default_rng(2)
    for n, width in ((5, 8), (40, 8), (200, 23)):
        h = rng.integers(0, 1 << 60, n).astype(np.uint64) << np.uint64(10)
        wide = []
        for c in range(n):
            a, b = c, c
            while a and h[a - 1] > h[c]:
                a -= 1
            while b + 1 < n and h[b + 1] >= h[c]:
                b += 1
            if b - a + 1 >= width:
                wide.append(c)
        assert substring_dedup.window_positions(h, width).tolist() == wide


@pytest.mark.parametrize("name", sorted(corpus.ORACLES))
def test_query_equals_sql(spark, small, name):
    con = connect(small)
    frame, relation = corpus.QUERIES[name](spark, small), con.sql(corpus.ORACLES[name])
    types = dict(zip(relation.columns, map(str, relation.types)))
    assert compare(frame.toPandas(), relation.df()) is None
    assert kinds(frame, types) == []
