"""Language identification with language-bitmask n-gram filters.

One bit-sliced Bloom filter holds the n-grams of every language: position i of the table is a word
of bits, one bit for each language, and the AND of the words at an n-gram's positions is the set of
all languages that contain the n-gram.  A text's n-grams are looked up at once; the population
count of every language, corrected for the filter's false positives, decides.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphlake.llm.common import Scratch, release_memory, table

SIZES = (3, 4)
SCHEMA = "lang_pred string, score double"


@dataclass(frozen=True)
class LanguageFilters:
    """The fitted model: fixed in size by ``log2_bits`` and the number of languages, not by the corpus."""

    langs: tuple[str, ...]
    words: np.ndarray | None  # (2**log2_bits, ceil(langs / 64)) uint64
    false_positive: np.ndarray  # of each language
    log2_bits: int
    hashes: int


def _positions(grams: np.ndarray, hashes: int, log2_bits: int) -> Iterator[np.ndarray]:
    """The filter positions of each n-gram: one mixed word gives the first position and the stride."""
    x = (grams ^ (grams >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    at, stride = x >> np.uint64(64 - log2_bits), x & np.uint64((1 << log2_bits) - 1) | np.uint64(1)
    for k in range(hashes):
        if k:
            at = (at + stride) & np.uint64((1 << log2_bits) - 1)
        yield at.view(np.int64)


def ngrams(text: str | None) -> np.ndarray:
    """uint64 codes of all n-grams of letters and single blanks of the whole text, lower-cased.

    Every run of other characters counts as one blank, so digits, mark-up and symbols say nothing.
    """
    if not text:
        return np.empty(0, np.uint64)
    low = text.lower()
    a = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    letter = np.zeros(a.size, bool)
    ascii_ = a < 128
    letter[ascii_] = (a[ascii_] >= 97) & (a[ascii_] <= 122)
    if not ascii_.all():
        rest = np.flatnonzero(~ascii_)
        kinds, at = np.unique(a[rest], return_inverse=True)
        letter[rest] = np.fromiter((chr(int(c)).isalpha() for c in kinds), bool, kinds.size)[at]
    if not letter.any():
        return np.empty(0, np.uint64)
    a = np.where(letter, a, np.uint64(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of a run of blanks, the first
    a = a[keep]
    a = np.concatenate(([np.uint64(32)], a[:-1] if a[-1] == 32 else a, [np.uint64(32)]))
    out = []
    for n in SIZES:
        if a.size < n:
            continue
        h = np.zeros(a.size - n + 1, np.uint64)
        for j in range(n):
            h = h * np.uint64(0x100000001B3) + a[j : j + h.size]
        out.append(h * np.uint64(8) + np.uint64(n))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of a task's rows: a few hundred texts at a time are counted and merged, before anything is shuffled."""
    total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            by: dict[str, list[np.ndarray]] = {}
            for text, lang in zip(part.column("text").to_pylist(), part.column("lang").to_pylist(), strict=True):
                by.setdefault(lang, []).append(ngrams(text))
            for lang, parts in by.items():
                g, n = np.unique(np.concatenate(parts), return_counts=True)
                if lang in total:
                    g, where = np.unique(np.concatenate((total[lang][0], g)), return_inverse=True)
                    n = np.bincount(where, np.concatenate((total[lang][1], n)), g.size).astype(np.int64)
                total[lang] = g, n
    for lang, (g, n) in total.items():
        if g.size:
            yield pa.RecordBatch.from_arrays([pa.array([lang] * g.size, pa.string()), pa.array(g.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])
    release_memory()


def training_rows(docs: DataFrame, train_rows: int) -> DataFrame:
    """(text, lang) of the labelled rows outside the held-out fold, or a sample of about ``train_rows`` of them.

    The fold is crc32(doc_id as text) mod 4 = 2.  The rows are shared out evenly over the languages: of one
    with fewer than its part all are taken, and what it leaves goes to the others.  The sample takes the rows whose
    id and text hash below their language's share of the hash range, so it is the same on every run.
    """
    labelled = docs.where("lang is not null and text is not null and pmod(crc32(cast(cast(doc_id as string) as binary)), 4) <> 2")
    sizes = sorted((r["count"], r["lang"]) for r in labelled.groupBy("lang").count().collect())
    if sum(n for n, _ in sizes) > train_rows:
        bounds, left = [], train_rows
        for i, (n, lang) in enumerate(sizes):
            take = min(n, max(1, left // (len(sizes) - i)))
            bounds.append((lang, int(take / n * (1 << 40)) + 1))
            left -= take
        bound = F.element_at(F.create_map(*(F.lit(x) for pair in bounds for x in pair)), F.col("lang"))  # an entry for each language
        labelled = labelled.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) < bound)
    return labelled.select("text", "lang")


def fit(docs: DataFrame, *, train_rows: int = 20_000, log2_bits: int = 20, hashes: int = 2, share: float = 0.5, least: int = 3) -> LanguageFilters:
    """Learns from a documented bound of ``train_rows`` labelled rows of docs(doc_id, text, lang).

    A language contains an n-gram if it uses it at least ``least`` times and at least ``share`` times as
    often, per n-gram of its text, as the language that uses it most.  Where n-grams used so often make up less than half
    of a language's text, as with few or short rows, all of its n-grams count, so every labelled language with a letter in its rows can be predicted.  The filter is built in tasks; its
    words reach the driver, which are fixed in number.
    No labelled row gives a model without languages, which answers ``und``.
    """
    scratch = Scratch(docs.sparkSession, "langid")
    counts = training_rows(docs, train_rows).mapInArrow(_count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = scratch.write(counts, "counts")
    often = F.sum(F.when(F.col("n") >= least, F.col("n")).otherwise(0)).alias("often")
    sums = counts.groupBy("lang").agg(F.sum("n").alias("total"), often).collect()  # a row for each language
    few = [r.lang for r in sums if 2 * r.often < r.total]
    counts = counts.where((F.col("n") >= least) | F.col("lang").isin(few))
    totals = sorted((r.lang, r.total if r.lang in few else r.often) for r in sums)
    langs = tuple(lang for lang, _ in totals)
    width = max(1, -(-len(langs) // 64))
    words = np.zeros((1 << log2_bits, width), np.uint64)
    if not langs:
        return LanguageFilters((), words, np.zeros(0), log2_bits, hashes)
    codes = docs.sparkSession.createDataFrame([(lang, i, float(n)) for i, (lang, n) in enumerate(totals)], "lang string, code bigint, total double")
    rated = counts.join(codes, "lang").select("code", "gram", (F.col("n") / F.col("total")).alias("rate"))
    rated = rated.withColumn("top", F.max("rate").over(Window.partitionBy("gram"))).where(F.col("rate") >= share * F.col("top"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code, gram = (b.column(c).to_numpy(zero_copy_only=False) for c in ("code", "gram"))
            bit = (np.uint64(1) << (code % 64).astype(np.uint64)).view(np.int64)
            for at in _positions(gram.view(np.uint64), hashes, log2_bits):
                yield pa.RecordBatch.from_arrays([pa.array(at * width + code // 64), pa.array(bit)], ["cell", "bits"])

    cells = rated.select("code", "gram").mapInArrow(mark, "cell bigint, bits bigint").groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()
    words.reshape(-1)[cells.column("cell").to_numpy()] = cells.column("bits").to_numpy().view(np.uint64)
    fill = np.array([((words[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(langs))])
    return LanguageFilters(langs, words, fill**hashes, log2_bits, hashes)


def classify(model: LanguageFilters, text: str | None) -> tuple[str, float]:
    """(language, score of 0 to 1); ``und`` and 0 if the text is null, has no letter or no language is known."""
    g = ngrams(text)
    if not g.size or not model.langs:
        return "und", 0.0
    found = None
    for at in _positions(g, model.hashes, model.log2_bits):
        found = model.words[at] if found is None else found & model.words[at]
    hits = np.array([int(np.count_nonzero(found[:, i // 64] & np.uint64(1 << (i % 64)))) for i in range(len(model.langs))], float)
    true = np.clip((hits - g.size * model.false_positive) / (1 - model.false_positive), 0, g.size) / g.size
    best = int(np.argmax(true))  # ties: the first name
    return model.langs[best], float(true[best])


def predict(docs: DataFrame, model: LanguageFilters, text: str = "text") -> DataFrame:
    """docs with ``lang_pred`` and ``score``; the model goes out once to each executor, in a fixed size."""
    held, rest = docs.sparkSession.sparkContext.broadcast(model.words), replace(model, words=None)

    @F.pandas_udf(SCHEMA)
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        filters = replace(rest, words=held.value)
        for texts in batches:
            yield pd.DataFrame([classify(filters, t) for t in texts], columns=["lang_pred", "score"])
        release_memory()

    return docs.withColumn("_gl_lang", judge(F.col(text))).select(*docs.columns, "_gl_lang.lang_pred", "_gl_lang.score")


def held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def op9_language_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of documents: doc_id, held_out, lang_pred, score.

    Null doc_id: held_out is null.  Null, empty or letterless text: ``und`` with score 0.  Repeated rows
    each get their row; an empty table gives no rows; further columns are not read.
    """
    docs = table(spark, sf_dir, "documents", ["doc_id", "text", "lang"])
    model = fit(docs)
    return predict(docs.select("doc_id", "text"), model).select(
        "doc_id",
        F.expr("pmod(crc32(cast(cast(doc_id as string) as binary)), 4) = 2").alias("held_out"),
        "lang_pred",
        "score",
    )
