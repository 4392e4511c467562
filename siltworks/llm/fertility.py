"""Quality rules from tokenisers: how well public vocabularies fit a text, judged against its language and length.

Prose of a language takes a steady number of characters per token and spreads its tokens evenly; markup, tables, shouting
and noise do not. Each text is measured once; medians and spreads of the measures are sketched per language (or script) and
octave of length, and a text outside its band is rejected.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.llm.frames import fresh, map_rows, text_of, written
from siltworks.session import pin_small

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
FEWEST_WORDS, REPEAT_PERCENT = 50, 50
# A tokeniser sees a text in slices of at most so many characters, cut after white space where there is some.
SLICE = 1 << 16


@dataclass(frozen=True)
class Vocabulary:
    """A vocabulary file: ``ranks`` of byte pairs, or a sentence ``piece`` model with byte fallback."""

    name: str
    kind: str
    path: str


@dataclass(frozen=True)
class Bands:
    """How far a measure may lie from the median of its group, in robust standard deviations.

    ``least`` texts make a group; smaller ones are judged by their whole language, then by all texts. ``floor`` is the
    smallest spread, as a share of the median, so that a flood of copies cannot narrow a band. The byte share has
    an upper band only, never below ``bytes_above`` over the median.
    """

    low: float = 3.0
    high: float = 6.0
    least: int = 64
    floor: float = 0.015
    bytes_above: float = 0.10
    accuracy: int = 1000


def default_vocabularies() -> tuple[Vocabulary, ...]:
    return (Vocabulary("byte_bpe_multi_50k", "ranks", public_tokenizers.path("byte_bpe_multi_50k.tiktoken")),)


def slices(text: str) -> Iterator[str]:
    """The text in order, in slices a tokeniser can take."""
    at = 0
    while at < len(text):
        end = min(at + SLICE, len(text))
        if end < len(text):
            cut = max(text.rfind(" ", at, end), text.rfind("\n", at, end))
            end = cut + 1 if cut > at else end
        yield text[at:end]
        at = end


def loaded(vocabulary: Vocabulary) -> tuple[Callable[[str], list[int]], np.ndarray]:
    """An encoder, and for each token whether it holds only bytes of a character and no whole one."""
    if vocabulary.kind == "ranks":
        import tiktoken

        with open(vocabulary.path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        encoding = tiktoken.Encoding(vocabulary.name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        broken = np.zeros(max(ranks.values()) + 1, dtype=bool)
        for piece, rank in ranks.items():
            broken[rank] = not piece.decode("utf-8", "ignore")
        return encoding.encode_ordinary, broken
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary.path)
    return (lambda text: model.encode(text, num_threads=1)), np.array([model.is_byte(i) for i in range(model.get_piece_size())])


def token_measures(ids: np.ndarray, broken: np.ndarray, characters: int) -> tuple[int, float, float, float]:
    """Tokens, characters per token, share of byte tokens, and entropy of the token counts in bits."""
    n = len(ids)
    if not n:
        return 0, 0.0, 0.0, 0.0
    counts = np.unique(ids, return_counts=True)[1]
    shares = counts / n
    return n, characters / n, float(broken[ids].sum()) / n, float(-(shares * np.log2(shares)).sum())


def base_measures(text: str, words: list[str]) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    seen: set[str] = set()
    repeated_lines = 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeated_lines += line in seen
            seen.add(line)
    repeats = 0
    if len(words) > 2:
        number: dict[str, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
        # Pairs are numbered first, so that a window is one number whatever the count of different words.
        pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
        _, inverse, counts = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
        twice = counts[inverse] > 1
        hit = np.zeros(len(words), dtype=bool)
        for shift in range(3):
            hit[shift : shift + len(twice)] |= twice
        repeats = int(hit.sum())
    return sum(map(len, words)), sum(map(text.count, SYMBOLS)), repeated_lines, repeats


def script_of(text: str) -> str:
    """The script of most letters, by the first word of their Unicode names; empty without letters."""
    counts: Counter[str] = Counter()
    for letter, n in Counter(text).items():
        if letter.isalpha():
            counts[unicodedata.name(letter, "OTHER").split(" ")[0]] += n
    return min(counts, key=lambda k: (-counts[k], k)) if counts else ""


def measured(docs: DataFrame, id_cols: list[str], text_col: str, lang_col: str | None, vocabularies: tuple[Vocabulary, ...]) -> tuple[DataFrame, str]:
    """The identifier columns with a struct of measures, its name given back: each text is tokenised here and nowhere else."""
    name = fresh(docs.select(*[F.col(f"`{c}`") for c in id_cols]), "measures") if id_cols else "measures"
    lang = F.lower(F.trim(F.col(f"`{lang_col}`").cast("string"))) if lang_col is not None else F.lit(None).cast("string")
    rows = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(id_cols)], lang.alias("lang"), text_of(text_col).alias("text"))
    k = len(id_cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        encoders = [loaded(v) for v in vocabularies]
        for b in batches:
            keys = [b.column(i).to_pylist() for i in range(k)]
            for i, (language, text) in enumerate(zip(b.column(k).to_pylist(), b.column(k + 1).to_pylist())):
                words = WORD.findall(text)
                chars, symbols, lines, repeats = base_measures(text, words)
                tokens = []
                for encode, broken in encoders:
                    ids = np.fromiter((t for part in slices(text) for t in encode(part)), dtype=np.int64)
                    n, per_token, share, entropy = token_measures(ids, broken, chars)
                    tokens.append({"tokens": n, "chars_per_token": per_token, "byte_share": share, "entropy": entropy})
                failed = len(words) < FEWEST_WORDS or 100 * repeats > REPEAT_PERCENT * len(words)
                group = language or f"script:{script_of(text)}"
                yield (*(key[i] for key in keys), group, len(words), chars, symbols, lines, repeats, failed, tokens)

    kinds = [f"k{i} {f.dataType.simpleString()}" for i, f in enumerate(rows.schema.fields[:k])]
    schema = ", ".join(
        [*kinds, "grp string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"]
        + ["tokens array<struct<tokens: long, chars_per_token: double, byte_share: double, entropy: double>>"]
    )
    found = map_rows(rows, run, schema)
    keys = [F.col(f"k{i}").alias(c) for i, c in enumerate(id_cols)]
    fields = ["grp", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "tokens"]
    return found.select(*keys, F.struct(*fields).alias(name)), name


def _octave(tokens: Column) -> Column:
    return F.floor(F.log2(F.greatest(tokens, F.lit(1)))).cast("int")


def band_table(texts: DataFrame, bands: Bands) -> DataFrame:
    """Median and spread of each measure per vocabulary, group and octave; null stands for all octaves, or all groups.

    ``texts`` has one row per text and vocabulary: v, grp, octave and the measures. The spread comes from the tighter
    side of the quartiles: junk, which leans to one side, does not widen it.
    """
    quartiles = [F.percentile_approx(c, [0.25, 0.5, 0.75], bands.accuracy).alias(f"q_{c}") for c in ("chars_per_token", "byte_share", "entropy")]
    levels = texts.select("v", "chars_per_token", "byte_share", "entropy", F.explode(F.array(
        F.struct("grp", "octave"), F.struct(F.col("grp"), F.lit(None).cast("int").alias("octave")),
        F.struct(F.lit(None).cast("string").alias("grp"), F.lit(None).cast("int").alias("octave")),
    )).alias("level")).select("v", "level.*", "chars_per_token", "byte_share", "entropy")
    sketched = levels.groupBy("v", "grp", "octave").agg(F.count(F.lit(1)).alias("n"), *quartiles)

    def middle(c: str) -> Column:
        return F.get(f"q_{c}", F.lit(1))

    def spread(c: str) -> Column:
        tight = F.least(middle(c) - F.get(f"q_{c}", F.lit(0)), F.get(f"q_{c}", F.lit(2)) - middle(c)) / 0.6745
        return F.greatest(tight, middle(c) * bands.floor)

    limits = F.struct(
        *[x for c in ("chars_per_token", "entropy") for x in ((middle(c) - bands.low * spread(c)).alias(f"{c}_from"), (middle(c) + bands.high * spread(c)).alias(f"{c}_to"))],
        F.greatest(middle("byte_share") + bands.high * spread("byte_share"), middle("byte_share") + bands.bytes_above).alias("byte_share_to"),
    )
    return sketched.where(F.col("n") >= bands.least).select("v", "grp", "octave", limits.alias("limits"))


def rules(
    docs: DataFrame, id_cols: list[str], text_col: str = "text", lang_col: str | None = "lang",
    vocabularies: tuple[Vocabulary, ...] | None = None, bands: Bands | None = None,
) -> DataFrame:
    """Measures and verdict of every text, ``kept`` false where the base rules or a band reject it.

    A null text has no words and no tokens; the base rules reject it, as any text of fewer than 50 words. A null or
    blank language gives way to the script of most letters. Repeated rows are judged each. Bands are taken over the texts
    that pass the base rules; where these are fewer than ``least`` in all, nothing but the base rules rejects.
    An empty table gives no rows. Other columns do not matter. ``reasons`` names the measures that lie outside.
    """
    bands = bands or Bands()
    vocabularies = vocabularies or default_vocabularies()
    found, name = measured(docs, id_cols, text_col, lang_col, vocabularies)
    rows = written(found, "fertility-measures")
    m = F.col(name)
    sound = rows.where(~m["base_failed"]).select(m["grp"].alias("grp"), F.posexplode(m["tokens"]).alias("v", "t"))
    table = pin_small(band_table(sound.select("v", "grp", _octave(F.col("t.tokens")).alias("octave"), "t.chars_per_token", "t.byte_share", "t.entropy"), bands))
    out, outside = rows, []
    for v in range(len(vocabularies)):
        t = F.get(m["tokens"], F.lit(v))
        own = table.where(F.col("v") == v)
        for level, on in (
            ("octave", (m["grp"] == F.col("_g")) & (_octave(t["tokens"]) == F.col("_o"))),
            ("grp", (m["grp"] == F.col("_g"))),
        ):
            side = own.where(F.col("octave").isNotNull() if level == "octave" else F.col("octave").isNull() & F.col("grp").isNotNull())
            out = out.join(side.select(F.col("grp").alias("_g"), F.col("octave").alias("_o"), F.col("limits").alias(f"_{level}{v}")), on, "left").drop("_g", "_o")
        # One row at most: the limits over all texts, five numbers.
        whole = own.where(F.col("grp").isNull()).select("limits.*").first()
        known = [F.struct(*[F.lit(x).alias(n) for n, x in whole.asDict().items()])] if whole is not None else []
        limits = F.coalesce(F.col(f"_octave{v}"), F.col(f"_grp{v}"), *known)
        outside += [
            F.when(t["chars_per_token"] < limits["chars_per_token_from"], "few characters per token"),
            F.when(t["chars_per_token"] > limits["chars_per_token_to"], "many characters per token"),
            F.when(t["entropy"] < limits["entropy_from"], "low token entropy"),
            F.when(t["entropy"] > limits["entropy_to"], "high token entropy"),
            F.when(t["byte_share"] > limits["byte_share_to"], "many byte tokens"),
        ]
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    out = out.withColumn("_reasons", F.array_distinct(F.array_compact(F.array(*outside))))
    return out.select(
        *[F.col(f"`{c}`") for c in id_cols], *[m[c].alias(c) for c in base], (~m["base_failed"] & (F.size("_reasons") == 0)).alias("kept"),
        m["grp"].alias("band_group"), F.get(m["tokens"], F.lit(0)).alias("tokens"), F.col("_reasons").alias("reasons"),
    )
