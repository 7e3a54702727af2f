"""Personal data: base spans by pattern, and information-theoretic sanitisation around them.

The protected entities are the values that the patterns find.  Over the whole corpus it is counted in
how many documents an entity occurs, in how many a term occurs outside of the patterns' spans, and in how many both do,
for terms that stand near the entity somewhere.  The pointwise mutual information of the two, as a share of the entity's information
content, says how much of the entity the term discloses: 1 where the term never occurs without it.  A
term over the threshold is generalised, over a higher one removed, in the documents that hold both.

Every pair is judged, also of an entity in one document.  What few documents cannot tell is left to a
bound on chance: how likely the two would meet so often if they were independent.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlake.llm.common import Scratch, if_small, release_memory, table

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: Starting only where a run of digits starts finds the same matches, without trying the run's later digits.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\W\d_]+")
#: A text without these holds nothing that a pattern could find.
MAY_HOLD = re.compile(r"@|[0-9][\x20.-]?[0-9]|\+[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


@dataclass(frozen=True)
class Sanitising:
    """window: words on either side of an entity that count as near; chance: the greatest probability of as many documents with the pair if the two were independent; generalise, remove: disclosed shares from which a term is replaced or deleted; log2_bits, most_bits: least and greatest size of the filters, which have 16 bits or more for each pair between these."""

    window: int = 8
    chance: float = 0.01
    generalise: float = 0.8
    remove: float = 0.95
    log2_bits: int = 20
    most_bits: int = 28


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from their @ signs in linear time."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        s = at
        while s > end and text[s - 1] in LOCAL_CHARS:
            s -= 1
        m = DOMAIN.match(text, at + 1) if s < at else None
        if m:
            end = m.end()
            out.append((s, end))
        at = text.find("@", max(at + 1, end))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The spans of each kind; a match that fails its condition is dropped and not tried again shorter."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if not MAY_HOLD.search(text):
        return out
    out["email"] = emails(text)
    for m in IP.finditer(text):
        if all(len(x) <= 3 and int(x or "0") <= 255 for x in (part.lstrip("0") for part in m[0].split("."))):
            out["ip"].append(m.span())
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out["card"].append(m.span())
    for m in PHONE.finditer(text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out["phone"].append(m.span())
    return out


def entity(kind: str, value: str) -> int:
    """Key of a protected value: digits only, or lower case for an email."""
    value = value.lower() if kind == "email" else value if kind == "ip" else re.sub("[^0-9]", "", value)
    return xxhash.xxh64_intdigest(f"{kind}:{value}".encode()) - (1 << 63)


def term(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) - (1 << 63)


def outside(text: str, spans: dict[str, list[tuple[int, int]]]) -> list[tuple[int, int, str]]:
    """(start, end, word) of all words outside of all spans, in lower case."""
    taken = sorted(s for k in KINDS for s in spans[k])
    reach: list[int] = []
    for _, e in taken:
        reach.append(max(e, reach[-1] if reach else 0))
    starts = [s for s, _ in taken]
    words = []
    for m in WORD.finditer(text):
        k = bisect_right(starts, m.end() - 1)
        if not k or reach[k - 1] <= m.start():
            words.append((m.start(), m.end(), m[0].lower()))
    return words


def entities(text: str, spans: dict[str, list[tuple[int, int]]]) -> set[int]:
    return {entity(k, text[s:e]) for k in KINDS for s, e in spans[k]}


def contexts(text: str, spans: dict[str, list[tuple[int, int]]], window: int) -> set[tuple[int, str]]:
    """(entity, term) of terms near the entity and outside of all spans."""
    if not any(spans.values()):
        return set()
    words = outside(text, spans)
    at = [s for s, *_ in words]
    out = set()
    for kind in KINDS:
        for s, e in spans[kind]:
            c = entity(kind, text[s:e])
            lo, hi = bisect_right(at, s), bisect_right(at, e - 1)
            out.update((c, w) for *_, w in words[max(0, lo - window) : hi + window])
    return out


CONTEXT = pa.list_(pa.struct([("e", pa.int64()), ("t", pa.int64())]))
FOUND = "rid string, doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base string, who array<bigint>, near array<struct<e: bigint, t: bigint>>"


def _find(p: Sanitising):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: list[list[int]] = [[] for _ in KINDS]
            base, who, near = [], [], []
            for text in b.column("text").to_pylist():
                spans = base_spans(text or "")
                for n, k in zip(counts, KINDS, strict=True):
                    n.append(len(spans[k]))
                base.append(",".join(f"{k}:{s}:{e}" for k in KINDS for s, e in spans[k]))
                who.append(sorted(entities(text or "", spans)))
                near.append([{"e": c, "t": term(w)} for c, w in contexts(text or "", spans, p.window)])
            yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("doc_id"), *(pa.array(n, pa.int64()) for n in counts), pa.array(base, pa.string()), pa.array(who, pa.list_(pa.int64())), pa.array(near, CONTEXT)], ["rid", "doc_id", *(f"n_{k}" for k in KINDS), "base", "who", "near"])
        release_memory()

    return run


def _places(t: np.ndarray, log2_bits: int) -> np.ndarray:
    return (t.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - log2_bits)


def _pair(e: int | np.ndarray, t: np.ndarray) -> np.ndarray:
    """Key of (entity, term) in a filter that holds the entities and, as their complements, the terms, too."""
    return ((np.asarray(e, np.int64).view(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)) ^ t.view(np.uint64)).view(np.int64)


def _filter(keys: DataFrame, p: Sanitising, pairs: bool) -> np.ndarray:
    """2**log2_bits bits, whatever the corpus: those of the terms of keys(t), or of the entities, terms and pairs of keys(e, t)."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = b.column("t").to_numpy(zero_copy_only=False)
            if pairs:
                e = b.column("e").to_numpy(zero_copy_only=False)
                t = np.concatenate((e, ~t, _pair(e, t)))
            at = np.unique(_places(t, p.log2_bits)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))], ["word", "bits"])

    words = keys.mapInArrow(places, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(1 << (p.log2_bits - 6), np.int64)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return bits.view(np.uint8)


def _held(bits: np.ndarray, keys: np.ndarray, log2_bits: int) -> np.ndarray:
    at = _places(keys, log2_bits).astype(np.int64)
    return (bits[at >> 3] >> (at & 7) & 1).astype(bool)


def _together(text: str, bits: np.ndarray, log2_bits: int) -> tuple[dict[str, list[int]], dict[str, list[tuple[int, int]]]]:
    """Of the whole text, for each term the entities with which a filter holds it, with a few false ones, and its places outside of the spans."""
    spans = base_spans(text)
    who = np.fromiter(sorted(entities(text, spans)), np.int64)
    who = who[_held(bits, who, log2_bits)]
    places: dict[str, list[tuple[int, int]]] = {}
    if not who.size:
        return {}, places
    for s, e, w in outside(text, spans):
        places.setdefault(w, []).append((s, e))
    words = list(places)
    t = np.fromiter(map(term, words), np.int64, len(words))
    some = np.flatnonzero(_held(bits, ~t, log2_bits))
    met: dict[str, list[int]] = {}
    for e in who:
        for i in some[_held(bits, _pair(e, t[some]), log2_bits)]:
            met.setdefault(words[i], []).append(int(e))
    return met, places


def _document_counts(p: Sanitising, held):
    """(t, n): of terms in the filter, the documents of each batch that hold them; counted before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for b in batches:
            seen: Counter[str] = Counter()
            for text in b.column("text").to_pylist():
                if text:
                    spans = base_spans(text)
                    seen.update({w for *_, w in outside(text, spans)} if any(spans.values()) else {w.lower() for w in set(WORD.findall(text))})
            t = np.fromiter(map(term, seen), np.int64, len(seen))
            n = np.fromiter(seen.values(), np.int64, len(seen))
            ok = _held(bits, t, p.log2_bits)
            yield pa.RecordBatch.from_arrays([pa.array(t[ok]), pa.array(n[ok])], ["t", "n"])
        release_memory()

    return run


def _pair_counts(p: Sanitising, held):
    """(e, t, n): of pairs in the filter, the documents of each batch that hold both, anywhere; counted before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: Counter[tuple[int, str]] = Counter()
            for text in b.column("text").to_pylist():
                met = _together(text, held.value, p.log2_bits)[0] if text else {}
                seen.update((e, w) for w, es in met.items() for e in es)
            yield pa.RecordBatch.from_arrays([pa.array([e for e, _ in seen], pa.int64()), pa.array([term(w) for _, w in seen], pa.int64()), pa.array(list(seen.values()), pa.int64())], ["e", "t", "n"])
        release_memory()

    return run


SPOTS = "rid string, t bigint, who array<bigint>, at array<struct<s: int, x: int>>"


def _spots(p: Sanitising, held):
    """(rid, t, who, at): the terms of pairs in the filter, with their entities and, once, their places, in the documents that hold both."""
    at_type = pa.list_(pa.struct([("s", pa.int32()), ("x", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rid, t, who, at = [], [], [], []
            for i, text in zip(b.column("rid").to_pylist(), b.column("text").to_pylist(), strict=True):
                met, places = _together(text, held.value, p.log2_bits) if text else ({}, {})
                for w, es in met.items():
                    rid.append(i)
                    t.append(term(w))
                    who.append(es)
                    at.append([{"s": s, "x": x} for s, x in places[w]])
            yield pa.RecordBatch.from_arrays([pa.array(rid, pa.string()), pa.array(t, pa.int64()), pa.array(who, pa.list_(pa.int64())), pa.array(at, at_type)], ["rid", "t", "who", "at"])
        release_memory()

    return run


def _chance(n: int):
    """Chernoff's bound on the probability that n_both or more of the n_e documents hold a term that n_t of all n hold.

    Exact where all of them do: an entity and a term that only one document holds meet with probability 1 / n.
    """
    both, e, q = F.col("n_both"), F.col("n_e"), F.col("n_t") / F.lit(float(n))
    apart = F.when(both < e, (e - both) * F.log((1 - both / e) / (1 - q))).otherwise(0.0)
    return F.exp(-(both * F.log(both / e / q) + apart))


def row_key(doc_id: Column, text: Column) -> Column:
    """A key of 256 bits that rows share only if they have one doc_id and one text (null and empty texts, which hold nothing, count as one)."""
    return F.sha2(F.concat(F.coalesce(doc_id.cast("bigint").cast("string"), F.lit("")), F.lit(":"), F.coalesce(text.cast("string"), F.lit(""))), 256)


def find_spans(docs: DataFrame, p: Sanitising = Sanitising()) -> DataFrame:
    """One row per row of docs(doc_id, text): rid, doc_id, n_email, n_ip, n_card, n_phone, base, terms.

    base: the pattern spans, ``kind:start:end`` in code points, by kind and start, joined by commas.
    terms: array of (s start, x end, gone whether to remove it) of disclosing terms, by start.  Null or empty text:
    none of either.  Null doc_id and repeated rows are rows like others, and each counts as a document.
    An empty table gives no rows.  Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "pii")
    docs = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("rid"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = scratch.write(docs.mapInArrow(_find(p), FOUND), "found")
    near = found.select(F.explode("near").alias("c")).select("c.e", "c.t").distinct()
    n_entity = found.select(F.explode("who").alias("e")).groupBy("e").agg(F.count(F.lit(1)).alias("n_e"))
    pairs = scratch.write(near.join(n_entity, "e"), "pairs")
    send = spark.sparkContext.broadcast
    p = replace(p, log2_bits=min(p.most_bits, max(p.log2_bits, (16 * pairs.count()).bit_length())))
    held = send(_filter(pairs.select("t"), p, False))
    # Both counts are written, so that the joins have plain exchanges on both sides and a hot term can be split.
    n_term = docs.select("text").mapInArrow(_document_counts(p, held), "t bigint, n bigint").groupBy("t").agg(F.sum("n").alias("n_t"))
    n_term = scratch.write(n_term, "n_term")
    held.destroy()
    # An entity of one document meets all its near terms there and nowhere else.
    several = send(_filter(pairs.where("n_e > 1"), p, True))
    n_both = docs.select("text").mapInArrow(_pair_counts(p, several), "e bigint, t bigint, n bigint") if several.value.any() else spark.createDataFrame([], "e bigint, t bigint, n bigint")
    n_both = scratch.write(n_both.groupBy("e", "t").agg(F.sum("n").alias("n_both")), "n_both")
    several.destroy()
    n = found.count()
    known = pairs.join(n_both, ["e", "t"], "left").withColumn("n_both", F.coalesce("n_both", F.lit(1))).join(n_term, "t")
    # An entity in every document has no information to disclose.
    share = F.log(F.lit(float(n)) * F.col("n_both") / (F.col("n_e") * F.col("n_t"))) / F.log(F.lit(float(n)) / F.col("n_e"))
    telling = known.where(F.col("n_e") < n).withColumn("share", share).where((F.col("share") >= p.generalise) & (_chance(n) <= p.chance)).select("e", "t", "share")
    telling = scratch.write(telling, "telling")
    # Repeated rows have the same terms.
    told_by = send(_filter(telling, p, True))
    once = docs.select("rid", "text").mapInArrow(_spots(p, told_by), SPOTS).dropDuplicates(["rid", "t"])
    spots = scratch.write(once, "spots")
    told_by.destroy()
    told = spots.select("rid", "t", F.explode("who").alias("e")).join(telling, ["e", "t"]).groupBy("rid", "t").agg(F.max("share").alias("share"))
    gone = F.col("share") >= p.remove
    marks = spots.join(told, ["rid", "t"]).select("rid", F.transform("at", lambda a: F.struct(a["s"].alias("s"), a["x"].alias("x"), gone.alias("gone"))).alias("at"))
    terms = marks.groupBy("rid").agg(F.array_sort(F.flatten(F.collect_list("at"))).alias("terms"))
    return found.drop("who", "near").join(terms, "rid", "left")


def redact(text: str | None, base: str, terms: list | None) -> str | None:
    """The text with base spans as [KIND], generalised terms as [WORD] or [NAME] (if capitalised) and removed terms as nothing."""
    if text is None or not (base or terms):
        return text
    marks = [(int(s), int(e), f"[{k.upper()}]") for k, s, e in (x.split(":") for x in base.split(",") if x)]
    for t in terms if terms is not None else ():
        marks.append((t["s"], t["x"], "" if t["gone"] else "[NAME]" if text[t["s"]].isupper() else "[WORD]"))
    out, end = [], 0
    for s, e, put in sorted(marks):
        if s >= end:
            out += [text[end:s], put]
        end = max(end, e)
    text = "".join([*out, text[end:]])
    # What a removed term stood between may now read as personal data.
    joined = base_spans(text) if terms is not None and len(terms) else {}
    return redact(text, ",".join(f"{k}:{s}:{e}" for k, v in joined.items() for s, e in v), None)


def sanitise(docs: DataFrame, p: Sanitising = Sanitising()) -> DataFrame:
    """docs with their texts redacted; all other columns and rows stay as they are."""
    spans = find_spans(docs, p).where("base <> '' or terms is not null").select(F.col("rid").alias("_gl_rid"), F.col("base").alias("_gl_base"), F.col("terms").alias("_gl_terms")).dropDuplicates(["_gl_rid"])
    spans = Scratch(docs.sparkSession, "sanitise").write(spans, "spans")
    spans = if_small(spans, F.length("_gl_base") + 80 + 16 * F.greatest(F.size("_gl_terms"), F.lit(0)))

    @F.pandas_udf("string")
    def put(text: pd.Series, base: pd.Series, terms: pd.Series) -> pd.Series:
        return pd.Series([redact(t, b or "", x) for t, b, x in zip(text, base, terms, strict=True)], dtype=object)

    keyed = docs.withColumn("_gl_rid", row_key(F.col("doc_id"), F.col("text"))).join(spans, "_gl_rid", "left")
    return keyed.withColumn("text", put("text", "_gl_base", "_gl_terms")).select(*docs.columns)


def op5_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents: doc_id, the counts of each kind, base_sha256 and spans (base, then ``term:start:end``); see find_spans for odd rows."""
    found = find_spans(table(spark, sf_dir, "documents", ["doc_id", "text"]))
    terms = F.transform(F.col("terms"), lambda t: F.concat_ws(":", F.lit("term"), t["s"].cast("string"), t["x"].cast("string")))
    spans = F.array_join(F.concat(F.when(F.col("base") != "", F.array("base")).otherwise(F.array().cast("array<string>")), F.coalesce(terms, F.array().cast("array<string>"))), ",")
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), spans.alias("spans"))
