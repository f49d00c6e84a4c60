"""Language identification with bit-sliced Bloom filters of byte n-grams.

One table of 2**bits words: bit l of a word belongs to language l's own Bloom filter, so that reading k words and and-ing them
returns every language that contains an n-gram. A text's n-grams are counted by language (popcounts of the bit slices); a count
is corrected for false positives with the fill of that language's slice, (hits / n - f) / (1 - f) with f = fill ** k, and the
language with the largest corrected share wins.

The fit is on a bounded sample of labelled rows: `per_language` rows of each language at most, those with the smallest hash of
doc_id; rows whose hash is too large for that, by their language's count, go before the hashes are sorted, so a language that has a
third of all rows costs its task no more than another. An n-gram enters a language's filter if at least `least` sampled texts of that language have it and its share of the
language's texts is at least `purity` of the largest share that any language has. The table has a fixed size whatever the corpus
(8 bytes << bits for up to 64 languages; words per slot grow with the languages), and is what gets broadcast.

Defined cases: null text or no letter (a character that `str.isalpha` takes; digits, number signs and symbols aren't letters): `und`, score 0. Letters but no n-gram, or none known: the most frequent sampled language,
score 0. No labelled rows at all: `und`, score 0. Ties go to the language first by code point. Whole texts are read whatever
their length. Repeated rows get equal answers. Empty table: empty result. Extra columns don't matter; a null doc_id is not held
out and not learned from. `reject` carries all columns through unless they are named `_li_language` or `_li_score`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import GOLDEN, Tables, U, mix, plus, small_batches, steps, utf8

N = 4
#: Bytes that count as letters: A-Z made small, a-z, and all of a multi-byte character; the rest is a break.
FOLD = np.full(256, 32, np.uint8)
FOLD[97:123] = np.arange(97, 123)
FOLD[65:91] = np.arange(97, 123)
FOLD[128:] = np.arange(128, 256)


def grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams as uint32, index of the text). A break stands at most at the ends of an n-gram, and none crosses texts."""
    n, texts = len(data), len(off) - 1
    folded = np.full(n + 2 * texts, 32, np.uint8)  # a break before and after each text
    owner = np.repeat(np.arange(texts), np.diff(off))
    folded[np.arange(n) + 2 * owner + 1] = FOLD[data]
    x = folded.astype(np.uint32)
    if len(x) < N:
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    g = x[: -N + 1] << np.uint32(24) | x[1 : -N + 2] << np.uint32(16) | x[2 : -N + 3] << np.uint32(8) | x[3:]
    ok = np.flatnonzero((folded[1 : -N + 2] != 32) & (folded[2 : -N + 3] != 32))
    ends = off[1:] + 2 * np.arange(1, texts + 1)
    return g[ok], np.searchsorted(ends, ok, side="right")


@dataclass
class Filters:
    languages: list[str]
    bits: int
    probes: int
    table: np.ndarray  # (slots, words) uint64
    rates: np.ndarray  # false positives by language
    common: int  # the most frequent sampled language

    def hits(self, g: np.ndarray) -> np.ndarray:
        """(n-grams, words): the languages that contain each."""
        out = None
        for slot in slots(g, self.bits, self.probes):
            out = self.table[slot] if out is None else out & self.table[slot]
        return out

    def predict(self, data: np.ndarray, off: np.ndarray, texts: list[str | None]) -> tuple[list[str], list[float]]:
        g, owner = grams(data, off)
        n, k = len(texts), len(self.languages)
        total = np.bincount(owner, minlength=n)
        share = np.zeros((n, k))
        masks = self.hits(g) if k else None
        for i in range(k):
            bit = (masks[:, i // 64] >> U(i % 64)) & U(1)
            got = np.bincount(owner, weights=bit.astype(np.float64), minlength=n)
            share[:, i] = (got / np.maximum(total, 1) - self.rates[i]) / (1 - self.rates[i])
        share = np.clip(share, 0, 1)
        langs, scores = [], []
        for i, text in enumerate(texts):
            if not text or not k or not any(map(str.isalpha, text)):
                langs.append("und")
                scores.append(0.0)
                continue
            best = int(np.argmax(share[i]))
            if share[i, best] <= 0:
                best = self.common
            langs.append(self.languages[best])
            scores.append(float(share[i, best]))
        return langs, scores


def slots(g: np.ndarray, bits: int, probes: int) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        h = mix(g.astype(U) + GOLDEN)
        return [((h >> U(i * bits % 40)) * U(2 * i + 1) & U((1 << bits) - 1)).astype(np.int64) for i in range(probes)]


def held_out():
    """True where the contract's remainder is 1; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def _sample_grams(batches):
    """For each language of a batch: n-grams and in how many of its texts they are."""
    for batch in batches:
        for part in steps(batch):
            data, off = utf8(part.column("text"))
            g, owner = grams(data, off)
            names = part.column("lang").to_pylist()
            own = sorted(set(names))
            code = np.array([own.index(x) for x in names])
            pairs = np.unique(g.astype(np.int64) << 31 | owner)
            key, n = np.unique((pairs >> 31) | code[pairs & 0x7FFFFFFF] << 32, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([own[i] for i in key >> 32], pa.string()), pa.array(key & 0xFFFFFFFF, pa.int64()), pa.array(n, pa.int64())], ["lang", "gram", "n"])


def sampled(labelled: DataFrame, most: int) -> DataFrame:
    """doc_id, lang of the `most` rows of each language with the smallest hashes. Hashes are even, so of n rows those below a share of
    `most` / n, and eight standard deviations more, hold them all; only these are ranked. The counts are a row a language, which `fit` also lists on the driver."""
    n = labelled.groupBy("lang").agg(F.count("*").alias("n"))
    share = (F.lit(float(most)) + F.lit(8.0 * most**0.5 + 64)) / F.col("n")
    place = F.xxhash64("doc_id").cast("double") / F.lit(2.0**64) + 0.5  # 0 to 1, in order of the hash
    few = labelled.select("doc_id", "lang").join(F.broadcast(n), "lang").where(place <= share).select("doc_id", "lang").distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    return few.withColumn("r", rank).where(F.col("r") <= most).select("doc_id", "lang")


def fit(docs: DataFrame, per_language: int = 1500, bits: int = 20, probes: int = 2, least: int = 2, purity: float = 0.1) -> Filters:
    """Filters of a sample of at most `per_language` labelled rows a language, none of them held out."""
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    labelled = docs.where(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    chosen = Tables(spark).save(sampled(labelled, per_language), "sample")
    # `per_language` rows a language at most, so they can be broadcast
    sample = labelled.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi")
    sizes = {r["lang"]: r["n"] for r in chosen.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    wide = max(1, -(-len(languages) // 64))
    table = np.zeros((1 << bits, wide), U)
    if languages:
        counts = sample.select("lang", "text").mapInArrow(_sample_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        size = F.element_at(F.create_map(*[F.lit(x) for k, v in sizes.items() for x in (k, float(v))]), F.col("lang"))
        share = counts.withColumn("share", F.col("n") / size)
        top = share.groupBy("gram").agg(F.max("share").alias("top"))
        known = share.where(F.col("n") >= least).join(top, "gram").where(F.col("share") >= purity * F.col("top")).select("lang", "gram")
        order = {x: i for i, x in enumerate(languages)}

        def sliced(batches):
            part = np.zeros((1 << bits, wide), U)
            for batch in batches:
                g = batch.column("gram").to_numpy().astype(np.uint32)
                which = np.array([order[x] for x in batch.column("lang").to_pylist()], np.int64)
                for slot in slots(g, bits, probes):
                    np.bitwise_or.at(part, (slot, which // 64), U(1) << (which % 64).astype(U))
            full = np.flatnonzero(part.any(axis=1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.tile(full, wide), pa.int64()), pa.array(np.repeat(np.arange(wide), len(full)), pa.int64()), pa.array(part[full].T.ravel().view(np.int64), pa.int64())], ["slot", "word", "mask"]
            )

        merged = known.mapInArrow(sliced, "slot long, word long, mask long").groupBy("slot", "word").agg(F.bit_or("mask").alias("mask")).toArrow()
        table[merged["slot"].to_numpy(), merged["word"].to_numpy()] = merged["mask"].to_numpy().astype(np.int64).view(U)
    fill = np.array([((table[:, i // 64] >> U(i % 64)) & U(1)).mean() for i in range(len(languages))])
    common = max(range(len(languages)), key=lambda i: (sizes[languages[i]], -i)) if languages else 0
    return Filters(languages, bits, probes, table, np.minimum(fill**probes, 0.99), common)


def predict(docs: DataFrame, filters: Filters, language: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the columns `language` and `score` (replaced if there); everything else is carried through."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(filters)
    kept = [c for c in docs.columns if c not in (language, score)]
    docs = docs.select(*kept)

    def run(batches):
        for batch in batches:
            for part in steps(batch):
                langs, scores = shared.value.predict(*utf8(part.column("text")), part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*part.schema.names, language, score])

    return docs.mapInArrow(run, plus(docs.schema, **{language: "string", score: "double"}))


def identify(docs: DataFrame, **how) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each document."""
    filters = fit(docs, **how)
    return predict(docs.select("doc_id", "text"), filters).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def reject(docs: DataFrame, least_score: float = 0.2, **how) -> DataFrame:
    """The documents whose language is known: not `und`, and at least `least_score` of their n-grams are the language's."""
    filters = fit(docs, **how)
    judged = predict(docs, filters, "_li_language", "_li_score")
    return judged.where((F.col("_li_language") != "und") & (F.col("_li_score") >= least_score)).select(*docs.columns)
