"""Repeated lines: hashes range-partitioned, read in the order of document and position, and answered with bitmaps.

Every distinct line of a document sends its hash, the document's key and its positions; no text is shuffled.  Rows are partitioned
by ranges of (hash, document), so the rows of one hash, however many, are dealt to as many tasks as their number asks for, and
sorted within.  A task reads its rows once and holds no more than the first few of a hash: as soon as enough documents have come,
these and all that follow are dropped lines.  Only the first and the last hash of a task may go on in another one; what a
task knows of these two is a handful of rows, which a second, small step adds up.  Each document gets a compressed bitmap of the lines it keeps.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlake.llm.common import Scratch, release_memory, table

_BLANKS = b" \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Lines:
    """least: documents from which a line's key goes; chars: code points of a key that counts; keep_first: whether the first occurrence, by doc_id and position, stays."""

    least: int = 10
    chars: int = 1
    keep_first: bool = False


def key_of(line: bytes) -> bytes:
    """Without blanks at both ends, A-Z as a-z."""
    return line.strip(_BLANKS).lower()


def _text_key(text: Column) -> Column:
    """With the doc_id it tells documents apart: rows that repeat both are one document."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


#: Documents that a task remembers to have hashed; more only cost rows, which the streams skip.
_REMEMBERED = 50_000


def _hashes(chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for b in batches:
            hi, lo, doc, th, lines, pos, ends = [], [], [], [], [], [], [0]
            for i, h, text in zip(b.column("doc_id").to_pylist(), b.column("th").to_pylist(), b.column("text").cast(pa.binary()), strict=True):
                if (i, h) in seen:
                    continue
                if len(seen) >= _REMEMBERED:
                    seen.clear()
                seen.add((i, h))
                own: dict[bytes, list[int]] = {}
                parts = (text.as_py() or b"").split(b"\n")
                for at, line in enumerate(parts):
                    k = key_of(line)
                    if len(k) >= chars and (chars < 2 or len(k.decode()) >= chars):
                        own.setdefault(k, []).append(at)
                for k, at in own.items():
                    x = xxhash.xxh3_128_intdigest(k)
                    hi.append((x >> 64) - (1 << 63))
                    lo.append((x & ((1 << 64) - 1)) - (1 << 63))
                    pos += at
                    ends.append(len(pos))
                doc += [i] * len(own)
                th += [h] * len(own)
                lines += [len(parts)] * len(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(doc, pa.int64()), pa.array(th, pa.int64()), pa.array(lines, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(pos, pa.int32()))],
                ["hi", "lo", "doc_id", "th", "lines", "pos"],
            )
        release_memory()

    return run


_DECIDED, _OPEN, _EDGE = 0, 1, 2
_ROW = "hi bigint, lo bigint, doc_id bigint, th bigint, lines int, pos array<int>"
_ROW_NAMES = ["hi", "lo", "doc_id", "th", "lines", "pos"]


def _out(rows: pa.RecordBatch, kind: int, first: bool = False, pid: int | None = None, n: int | None = None) -> pa.RecordBatch:
    m = rows.num_rows
    more = [pa.array([kind] * m, pa.int32()), pa.array([first] * m, pa.bool_()), pa.array([pid] * m, pa.int32()), pa.array([n] * m, pa.int64())]
    return pa.RecordBatch.from_arrays([*rows.columns, *more], [*_ROW_NAMES, "kind", "first", "pid", "n"])


def _later(rows: pa.RecordBatch) -> pa.RecordBatch:
    """rows without their first position; rows that have no other go."""
    pos = [p[1:] for p in rows.column("pos").to_pylist()]
    rows = pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(pos, pa.list_(pa.int32()))], _ROW_NAMES)
    return rows.filter(pa.array([bool(p) for p in pos], pa.bool_()))


class _Run:
    """The rows of one hash in a task, as they come."""

    def __init__(self, opening: bool, p: Lines):
        self.opening, self.p, self.n, self.held = opening, p, 0, []

    def feed(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        before, self.n = self.n, self.n + rows.num_rows
        if before >= self.p.least:
            yield _out(rows, _DECIDED)
            return
        self.held.append(rows)
        if self.n < self.p.least:
            return
        all_ = pa.Table.from_batches(self.held).combine_chunks().to_batches()[0]
        head, rest = (all_.slice(0, 1), all_.slice(1)) if self.p.keep_first else (None, all_)
        self.held = [head] if head is not None and self.opening else []
        if head is not None and not self.opening:
            yield _out(_later(head), _DECIDED)
        yield _out(rest, _DECIDED)

    def edge(self, pid: int) -> Iterator[pa.RecordBatch]:
        """What another task may need to know, and the rows that are open until then."""
        first = True
        for rows in self.held:
            if rows.num_rows:
                yield _out(rows.slice(0, 1), _OPEN, first, pid)
                yield _out(rows.slice(1), _OPEN, False, pid)
                first = False

    def summary(self, key: tuple[int, int], pid: int) -> pa.RecordBatch:
        none = pa.nulls(1, pa.int64())
        row = pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), none, none, pa.nulls(1, pa.int32()), pa.nulls(1, pa.list_(pa.int32()))], _ROW_NAMES)
        return _out(row, _EDGE, False, pid, self.n)


def _stream(p: Lines):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        key, last, now = None, None, None
        for b in batches:
            if not b.num_rows:
                continue
            hi, lo, th, doc = (b.column(c).to_numpy(zero_copy_only=False) if b.column(c).null_count == 0 else b.column(c).fill_null(0).to_numpy(zero_copy_only=False) for c in ("hi", "lo", "th", "doc_id"))
            null = b.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            tuples = np.stack((hi, lo, th, doc, null.astype(np.int64)))
            prior = np.concatenate((tuples[:, :1] if last is None else last, tuples[:, :-1]), axis=1)
            same = (tuples == prior).all(0)
            starts = (tuples[:2] != prior[:2]).any(0)
            if last is None:
                same[0], starts[0] = False, True
            last = tuples[:, -1:]
            keep = np.flatnonzero(~same)  # a row that repeats is the same document
            if not len(keep):
                continue
            b, begin = b.take(pa.array(keep)), np.flatnonzero(starts[keep])
            keys = tuples[:2, keep]
            bounds = np.r_[begin, len(keep)]
            if begin.size == 0 or begin[0] > 0:
                yield from now.feed(b.slice(0, int(bounds[0])))
            if not begin.size:
                continue
            if now is not None and now.opening:
                yield now.summary(key, pid)
                yield from now.edge(pid)
            whole = bounds[:-1][: len(begin) - 1] if now is not None else bounds[1:-1]
            if now is None and len(begin) > 1:  # the task's first hash, complete in this batch
                first = _Run(True, p)
                yield from first.feed(b.slice(0, int(bounds[1])))
                yield first.summary((int(keys[0, 0]), int(keys[1, 0])), pid)
                yield from first.edge(pid)
                whole = bounds[1:-2]
            # Hashes that begin and end within the batch.
            if len(whole):
                sizes = np.diff(np.r_[whole, bounds[-2]])
                many = sizes >= p.least
                at = np.repeat(np.where(many, whole, -1), sizes)
                rows = np.arange(int(whole[0]), int(bounds[-2]))
                head = np.isin(rows, whole)
                gone = at >= 0
                if p.keep_first:
                    if (gone & head).any():
                        yield _out(_later(b.take(pa.array(rows[gone & head]))), _DECIDED)
                    gone &= ~head
                if gone.any():
                    yield _out(b.take(pa.array(rows[gone])), _DECIDED)
            opening = now is None and len(begin) == 1
            now = _Run(opening, p)
            key = (int(keys[0, bounds[-2]]), int(keys[1, bounds[-2]]))
            yield from now.feed(b.slice(int(bounds[-2])))
        if now is not None:
            yield now.summary(key, pid)
            yield from now.edge(pid)
        release_memory()

    return run


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep, dropped = [], []
        for n, pos in zip(b.column("n_lines").to_pylist(), b.column("pos").to_pylist(), strict=True):
            bits = np.ones(n, bool)
            bits[pos] = False
            keep.append(zlib.compress(np.packbits(bits).tobytes(), 1))
            dropped.append(len(pos))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), b.column("n_lines"), pa.array(dropped, pa.int64()), pa.array(keep, pa.binary())], ["doc_id", "th", "n_lines", "n_dropped", "keep"])


def keep_bitmaps(docs: DataFrame, p: Lines = Lines()) -> DataFrame:
    """(doc_id, th, n_lines, n_dropped, keep) of documents(doc_id, text) that lose lines; the others keep all of theirs.

    A text is split at newlines; a line's key is the line without blanks at both ends and with A-Z in lower case.  Keys of p.chars code
    points or more that p.least documents hold lose all their lines, or all but the first.  keep holds a bit for each line, packed and
    compressed (see unpack); th is a hash of the text.  A document is a doc_id, null or not, with one text: rows that repeat both are one,
    rows with one id and several texts are several.  A null text is empty; an empty table gives no rows.  Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    named = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _text_key(F.col("text")).alias("th"), "text")
    hashed = scratch.write(named.mapInArrow(_hashes(p.chars), _ROW), "hashes")
    order = ["hi", "lo", "doc_id", "th"]
    # Written apart by kind: dropped lines, and the few rows that tasks hand to each other.
    schema = f"{_ROW}, kind int, first boolean, pid int, n bigint"
    path = f"{scratch.path}/streamed"
    hashed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_stream(p), schema).write.partitionBy("kind").parquet(path)
    streamed = spark.read.schema(schema).parquet(path)
    scratch.drop("hashes")
    total = streamed.where(F.col("kind") == _EDGE).groupBy("hi", "lo").agg(F.sum("n").alias("total"), F.min("pid").alias("begins")).where(F.col("total") >= p.least)
    open_ = streamed.where(F.col("kind") == _OPEN).join(total, ["hi", "lo"])
    if p.keep_first:
        head = F.col("first") & (F.col("pid") == F.col("begins"))
        open_ = open_.withColumn("pos", F.when(head, F.slice("pos", 2, F.greatest(F.size("pos") - 1, F.lit(0)))).otherwise(F.col("pos")))
    cols = ["doc_id", "th", "lines", "pos"]
    gone = streamed.where(F.col("kind") == _DECIDED).select(cols).union(open_.select(cols)).where(F.size("pos") > 0)
    # A group is what one document loses.
    by_doc = gone.groupBy("doc_id", "th").agg(F.max("lines").alias("n_lines"), F.flatten(F.collect_list("pos")).alias("pos"))
    return scratch.write(by_doc.mapInArrow(_bitmaps, "doc_id bigint, th bigint, n_lines int, n_dropped bigint, keep binary"), "bitmaps")


def unpack(keep: bytes, n: int) -> np.ndarray:
    """Of each of n lines, whether it stays."""
    return np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=n).astype(bool)


def _apply(columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for text, keep in zip(b.column("text").cast(pa.binary()), b.column("_gl_keep").to_pylist(), strict=True):
                if keep is None:
                    texts.append(text.as_py())
                    continue
                lines = (text.as_py() or b"").split(b"\n")
                texts.append(b"\n".join(x for x, k in zip(lines, unpack(keep, len(lines)), strict=True) if k))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()).cast(pa.string()) if c == "text" else b.column(c) for c in columns], columns)
        release_memory()

    return run


def without_lines(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs with the texts that their bitmaps leave, and n_lines (before), n_dropped; all rows stay.  A column of one of these two names is replaced."""
    t = F.coalesce("text", F.lit(""))
    cols = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    named = docs.select(*cols).withColumns({"_gl_th": _text_key(F.col("text")), "_gl_id": F.col("doc_id").cast("bigint"), "n_lines": (F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1).cast("bigint")})
    b = bitmaps.select(F.col("doc_id").alias("_gl_b"), F.col("th").alias("_gl_bth"), F.col("n_dropped"), F.col("keep").alias("_gl_keep"))
    both = named.join(b, F.col("_gl_id").eqNullSafe(F.col("_gl_b")) & (F.col("_gl_th") == F.col("_gl_bth")), "left")
    both = both.select(*cols, "n_lines", F.coalesce("n_dropped", F.lit(0)).cast("bigint").alias("n_dropped"), "_gl_keep")
    out = [*cols, "n_lines", "n_dropped"]
    schema = ", ".join(f"`{c}` {both.schema[c].dataType.simpleString()}" for c in out)
    return both.mapInArrow(_apply(out), schema)


def op12_line_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeated lines leave of every document: doc_id, n_lines, n_dropped, kept_sha256; see keep_bitmaps for odd rows."""
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    kept = without_lines(docs, keep_bitmaps(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP12_SQL = r"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines, coalesce(text, '') AS text FROM documents),
l AS MATERIALIZED (
  SELECT rid, doc_id, text, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT rid, doc_id, text, unnest(range(len(lines))) AS i, unnest(lines) AS line FROM docs)),
often AS (SELECT key FROM (SELECT DISTINCT key, doc_id, text FROM l WHERE length(key) >= 1) GROUP BY key HAVING count(*) >= 10),
m AS (SELECT l.*, o.key IS NOT NULL AS gone FROM l LEFT JOIN often o ON o.key = l.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY rid"""
