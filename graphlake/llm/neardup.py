"""MinHash near-duplicates with sequential Bayesian verification.

Documents with equal shingle sets form one class.  Class representatives are banded by MinHash;
banded candidates are compared by batches of their signatures and dropped as soon as the posterior
probability of a similarity at or above the threshold falls below a chosen miss probability; what is
left is verified on full shingle sets.

Only components are wanted, so pairs that components already imply are not made:

1. star: every member of a bucket against the bucket's smallest member;
2. blocks: in buckets whose members are still in several components, the surviving pairs between components,
   best estimate first, verified where they are found, so that a link at once saves the pairs it implies.

What leaves a block are links, fewer than its members, whatever the size of a group of copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlake.llm.common import Scratch, connected_components, if_small, release_memory, table

MASK = (1 << 64) - 1


@dataclass(frozen=True)
class NearDup:
    """words in a shingle; similarity as a share num / den; hashes = bands * rows; batch of hashes compared at a time; miss: the chance, at each batch, of dropping a pair at the threshold; block, bytes: members of a bucket, and bytes of their sets, that one task compares at once."""

    words: int = 5
    num: int = 75
    den: int = 100
    bands: int = 32
    rows: int = 4
    batch: int = 32
    miss: float = 1e-6
    block: int = 2048
    bytes: int = 32 << 20

    @property
    def hashes(self) -> int:
        return self.bands * self.rows


def shingles(text: str | None, k: int = 5) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the k-word shingles of the whole text.

    A-Z is lower-cased and words end at ASCII white space only.  With fewer words the whole sequence
    is the one shingle; without words the set is empty.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and white space only
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    k = min(k, w.size)
    h = np.full(w.size - k + 1, k, np.uint64)
    for j in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[j : j + h.size]
        h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return np.unique(h ^ (h >> np.uint64(29)))


def digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits that depend on the set alone."""
    a = (s ^ (s >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    b = (s ^ (s >> np.uint64(31))) * np.uint64(0xC4CEB9FE1A85EC53)
    return tuple(int(x.sum(dtype=np.uint64).view(np.int64)) for x in (a ^ (a >> np.uint64(33)), b ^ (b >> np.uint64(33))))


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20_240_501)
    return r.integers(1, MASK, n, np.uint64, True) | np.uint64(1), r.integers(0, MASK, n, np.uint64, True)


def signatures(sets: list[np.ndarray], n: int) -> np.ndarray:
    """(sets, n) uint16 MinHash values; the sets must not be empty."""
    a, b = _coefficients(n)
    out = np.empty((len(sets), n), np.uint16)
    first, held = 0, 0
    for i, s in enumerate(sets):
        held += s.size
        if held < 50_000 and i + 1 < len(sets):
            continue
        x = np.concatenate(sets[first : i + 1])
        at = np.cumsum([0] + [y.size for y in sets[first:i]])
        for j in range(n):
            low = np.minimum.reduceat(x * a[j] + b[j], at)
            out[first : i + 1, j] = ((low ^ (low >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(48)
        first, held = i + 1, 0
    return out


def least_matches(p: NearDup) -> np.ndarray:
    """For each n of matches seen, the fewest that keep a pair.

    With a uniform prior the posterior of the similarity after m matches of n is Beta(m + 1, n - m + 1);
    its mass at t or more is the chance of at most m successes of n + 1 at t.
    """
    t, out = p.num / p.den, []
    for n in range(p.batch, p.hashes + 1, p.batch):
        mass, m = 0.0, -1
        while mass < p.miss:
            m += 1
            mass += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return np.array(out)


def keeps(x: np.ndarray, y: np.ndarray, p: NearDup) -> tuple[np.ndarray, np.ndarray]:
    """(rows that no batch drops, their matches) for two (pairs, hashes) arrays of signatures."""
    rows, seen = np.arange(len(x)), np.zeros(len(x), np.int64)
    for k, least in enumerate(least_matches(p)):
        cut = slice(k * p.batch, (k + 1) * p.batch)
        seen = seen + (x[rows, cut] == y[rows, cut]).sum(1)
        ok = seen >= least
        rows, seen = rows[ok], seen[ok]
    return rows, seen


def linked(a: np.ndarray, b: np.ndarray, p: NearDup) -> bool:
    """num / den of the union or more is shared, on full sets."""
    if not a.size or not b.size or p.den * min(a.size, b.size) < p.num * max(a.size, b.size):
        return False
    both = np.intersect1d(a, b, assume_unique=True).size
    return p.den * both >= p.num * (a.size + b.size - both)


#: A class goes by its least row: the doc_id and a hash of the text, which tells texts of a repeated doc_id apart.
NODE = "struct<id: bigint, body: bigint>"
SETS = "doc_id bigint, body bigint, n_shingles bigint, d1 bigint, d2 bigint, sig binary"


def _sets(p: NearDup):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                sets = [shingles(t, p.words) for t in part.column("text").to_pylist()]
                full = [i for i, s in enumerate(sets) if s.size]
                sig: list = [None] * len(sets)
                for i, row in zip(full, signatures([sets[i] for i in full], p.hashes) if full else (), strict=True):
                    sig[i] = row.tobytes()
                d = [digest(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("body"), pa.array([s.size for s in sets], pa.int64()), pa.array([x for x, _ in d], pa.int64()), pa.array([y for _, y in d], pa.int64()), pa.array(sig, pa.binary())],
                    ["doc_id", "body", "n_shingles", "d1", "d2", "sig"],
                )
        release_memory()

    return run


def _full(p: NearDup):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t, p.words) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([s.size for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "n_shingles", "set"])
        release_memory()

    return run


def _sig(column: pa.Array, p: NearDup) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, p.hashes)


def _prune(p: NearDup):
    """Of rows (a, b, sig_a, sig_b), the pairs that the posterior keeps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                rows, _ = keeps(_sig(b.column("sig_a"), p), _sig(b.column("sig_b"), p), p)
                yield b.select(["a", "b"]).take(pa.array(rows))

    return run


def _verify(p: NearDup):
    """Of rows (a, b, set_a, set_b), the linked pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            last: tuple = (None, None)
            ok = []
            for x, y in zip(b.column("set_a"), b.column("set_b"), strict=True):
                raw = x.as_buffer()
                if last[0] is None or not raw.equals(last[0]):
                    last = raw, np.frombuffer(raw, np.uint64)
                ok.append(linked(last[1], np.frombuffer(y.as_buffer(), np.uint64), p))
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))
        release_memory()

    return run


def shared(one: np.ndarray, many: list[np.ndarray]) -> np.ndarray:
    """How many members each of the sets shares with one; none may be empty."""
    x = np.concatenate(many)
    at = np.minimum(np.searchsorted(one, x), one.size - 1)
    return np.add.reduceat((one[at] == x).astype(np.int64), np.cumsum([0] + [y.size for y in many[:-1]]))


def _links_in_block(p: NearDup):
    """Links between components within one block, or between two blocks, of one bucket; they form a forest.

    A pair is tried in the first band in which both sit in one bucket, and not with the bucket's leader, which
    the star has tried.
    """

    def run(g: pa.Table) -> pa.Table:
        g = g.sort_by([("id", "ascending"), ("body", "ascending")]).combine_chunks()
        number = lambda *names: np.unique(np.stack([g.column(c).to_numpy() for c in names], 1), axis=0, return_inverse=True)[1].ravel()
        side, band, p1, p2, lead = (g.column(c).to_numpy(zero_copy_only=False) for c in ("side", "band", "p1", "p2", "lead"))
        comp, sig = number("comp_id", "comp_body"), _sig(g.column("sig"), p)
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in g.column("set")]
        size, same, bands = np.array([x.size for x in sets]), p1[0] == p2[0], sig.view(np.uint64).reshape(len(sig), -1)
        a: list[int] = []
        b: list[int] = []
        for i in range(len(sig)):
            if lead[i] or not same and side[i]:
                continue
            there = np.arange(len(sig)) > i if same else side > 0
            near = p.den * np.minimum(size, size[i]) >= p.num * np.maximum(size, size[i])
            js = np.flatnonzero(there & near & (comp != comp[i]) & ~lead)
            if band[0] and js.size:
                width = p.rows // 4 if p.rows % 4 == 0 else 0
                if width:
                    js = js[~(bands[js, : band[0] * width] == bands[i, : band[0] * width]).reshape(js.size, -1, width).all(2).any(1)]
            if not js.size:
                continue
            rows, seen = keeps(np.broadcast_to(sig[i], (js.size, p.hashes)), sig[js], p)
            js = js[rows][np.argsort(-seen, kind="stable")]
            step = 4
            while js.size:
                part, js = js[:step], js[step:]
                both = shared(sets[i], [sets[j] for j in part])
                for j in part[p.den * both >= p.num * (size[i] + size[part] - both)]:
                    if comp[j] != comp[i]:
                        a.append(min(i, int(j)))
                        b.append(max(i, int(j)))
                        comp[comp == comp[j]] = comp[i]
                js, step = js[comp[js] != comp[i]], min(4 * step, 256)
        key = g.select(["id", "body"])
        ends = (key.take(pa.array(x, pa.int64())).combine_chunks() for x in (a, b))
        return pa.table({n: pa.StructArray.from_arrays([c.combine_chunks() for c in e.columns], ["id", "body"]) for n, e in zip("ab", ends, strict=True)})

    return run


def body_of(text: F.Column) -> F.Column:
    return F.xxhash64(text.cast("string"))


#: Stands for a null doc_id inside: it comes after all others, so a group with ids is named by one of these.
NO_ID = (1 << 63) - 1


def judged(docs: DataFrame, p: NearDup = NearDup()) -> DataFrame:
    """near_duplicates with ``body``, a hash of the row's text, and ``chosen``: whether the row is its component's least by doc_id and body (or in none)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "neardup")
    docs = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"), body_of(F.col("text")).alias("body"))
    own = F.struct(F.col("doc_id").alias("id"), "body")
    sets = scratch.write(docs.mapInArrow(_sets(p), SETS), "sets")
    # Equal sets are counted before the shuffle: a class of any size is one row from each task.
    full_rows = "n_shingles > 0"
    classes = sets.where(full_rows).groupBy("d1", "d2").agg(F.min(own).alias("first"), F.count(F.lit(1)).alias("m"))
    # Written, so that the join below has plain exchanges on both sides and a hot class can be split.
    classes = scratch.write(classes.where("m > 1").select("d1", "d2", "first"), "classes")
    rep = F.when(F.expr(full_rows), F.coalesce("first", own))
    members = scratch.write(
        sets.join(classes, ["d1", "d2"], "left").withColumn("rep", rep).select("doc_id", "body", "n_shingles", "rep", F.when(own == F.col("rep"), F.col("sig")).alias("sig")),
        "members",
    )
    scratch.drop("sets")
    scratch.drop("classes")
    reps = members.where("sig is not null").select(F.col("rep").alias("node"), "sig")
    # Rows with one doc_id and one text are one node.
    repeated = reps.groupBy("node").agg(F.count(F.lit(1)).alias("m")).where("m > 1").limit(1).count()
    one_each = lambda df: df.dropDuplicates(["node"]) if repeated else df
    reps = scratch.write(one_each(reps), "reps")
    # A bucket: 4 values of 2 bytes at the band's place of the signature.
    width = 2 * p.rows
    banded = reps.select("node", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(p.bands - 1)), lambda i: F.substring(F.col("sig"), i * width + 1, F.lit(width)))).alias("band", "key"))
    banded = scratch.write(banded.select("node", "band", F.xxhash64("band", "key").alias("bk")), "banded")
    buckets = banded.groupBy("bk").agg(F.count(F.lit(1)).alias("m"), F.min("node").alias("leader")).where("m > 1")
    buckets = scratch.write(buckets, "buckets")  # here and below, so that a hot bucket is split by the join
    rows = scratch.write(banded.join(buckets, "bk").select("bk", "band", "node", "leader", "m"), "rows")
    scratch.drop("banded")
    scratch.drop("buckets")
    # The full sets of all that sit in some bucket, once.
    wanted = rows.select("node").distinct()
    full = one_each(docs.select(own.alias("node"), "text").join(wanted, "node", "left_semi"))
    full = scratch.write(full.mapInArrow(_full(p), f"node {NODE}, n_shingles bigint, set binary"), "full")
    sig = reps
    pair = f"a {NODE}, b {NODE}"

    def prune(pairs: DataFrame) -> DataFrame:
        pairs = pairs.join(sig.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), "a").join(sig.select(F.col("node").alias("b"), F.col("sig").alias("sig_b")), "b")
        return pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(_prune(p), pair)

    def verify(pairs: DataFrame, name: str) -> DataFrame:
        one, two = (full.select(F.col("node").alias(c), F.col("set").alias(f"set_{c}"), F.col("n_shingles").alias(f"n_{c}")) for c in "ab")
        near = pairs.join(two, "b").join(one, "a").where(f"{p.den} * least(n_a, n_b) >= {p.num} * greatest(n_a, n_b)")
        return scratch.write(near.select("a", "b", "set_a", "set_b").mapInArrow(_verify(p), pair).distinct(), name)

    star = rows.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    links = verify(scratch.write(prune(star), "star"), "links0")
    scratch.drop("star")
    labels = connected_components(spark, links, scratch, "stars")
    named = rows.where("m > 2").join(labels, "node", "left").withColumn("comp", F.coalesce("label", "node")).drop("label")
    named = scratch.write(named, "named")
    scratch.drop("rows")
    several = named.groupBy("bk").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("bk")
    apart = named.join(scratch.write(several, "several"), "bk", "left_semi").join(full.join(sig, "node").select("node", "sig", "set", "n_shingles"), "node")
    # A bucket over the block size, in members or in bytes, is cut into parts by a hash; every two parts meet in one task.
    apart = scratch.write(apart, "apart")
    for table_name in ("named", "full", "reps"):
        scratch.drop(table_name)
    weigh = apart.groupBy("bk").agg(F.greatest(F.ceil(F.count(F.lit(1)) / p.block), F.ceil(F.sum("n_shingles") / (p.bytes / 8))).cast("int").alias("parts"))
    apart = apart.join(scratch.write(weigh, "weigh"), "bk").withColumn("mine", F.pmod(F.xxhash64("node", "bk"), F.col("parts")).cast("int"))
    met = apart.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.select(
        "bk", "band", "node.id", "node.body", F.col("comp.id").alias("comp_id"), F.col("comp.body").alias("comp_body"), (F.col("node") == F.col("leader")).alias("lead"), "sig", "set",
        F.least("mine", "other").alias("p1"), F.greatest("mine", "other").alias("p2"), F.when(F.col("mine") > F.col("other"), 1).otherwise(0).alias("side"),
    )
    found = scratch.write(met.groupBy("bk", "p1", "p2").applyInArrow(_links_in_block(p), pair).distinct(), "found")
    scratch.drop("apart")
    labels = connected_components(spark, links.union(found), scratch, "last")
    out = members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    component = F.coalesce("label.id", "doc_id")
    chosen = F.coalesce(own == F.col("label"), F.lit(True))
    id_ = lambda c: F.nullif(c, F.lit(NO_ID))
    return out.select(
        id_(F.col("doc_id")).alias("doc_id"), "body", "n_shingles", id_(F.coalesce("rep.id", "doc_id")).alias("class_id"), id_(component).alias("component_id"),
        F.when(component == NO_ID, chosen).otherwise(F.col("doc_id") == component).alias("kept"), chosen.alias("chosen"),
    )


def near_duplicates(docs: DataFrame, p: NearDup = NearDup()) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_shingles, class_id, component_id, kept.

    class_id is the smallest doc_id with the same shingle set, component_id the smallest reachable over links.
    Null or empty text: no shingles, linked with nothing.  A row with a null doc_id is linked by its text like others and names no
    group that holds an id; in a group without any, component_id is null and one of its texts is kept.  Repeated rows: each is judged by its own text, so equal ones share a class and
    each carries the smallest id; where an id repeats with several texts, each of them is linked with the copies of its
    own, and the id links none.  Other columns are not read.
    """
    return judged(docs, p).select("doc_id", "n_shingles", "class_id", "component_id", "kept")


def deduplicate(docs: DataFrame, p: NearDup = NearDup()) -> DataFrame:
    """docs with one row of each group of near duplicates: that of the smallest doc_id, and of several of its texts that of the least hash.

    Of rows with one doc_id and one text one stays, also of those with a null, empty or blank text, which are else
    all kept.  A null doc_id is an id that comes after all others.  Where an id repeats with several texts, no text goes but those whose copy stays.  All columns stay.
    """
    scratch = Scratch(docs.sparkSession, "deduplicate")
    key = [F.col("doc_id").alias("_gl_i"), F.col("body").alias("_gl_b")]
    verdicts = scratch.write(judged(docs, p).select("doc_id", "body", "chosen"), "verdicts")
    marks = verdicts.groupBy(*key).agg(F.min("chosen").alias("_gl_chosen"), (F.count(F.lit(1)) > 1).alias("_gl_again"))
    marks = scratch.write(marks.where("not _gl_chosen or _gl_again"), "marks")
    keyed = docs.withColumn("_gl_id", F.col("doc_id").cast("bigint")).withColumn("_gl_body", body_of(F.col("text")))
    marked = keyed.join(if_small(marks), F.col("_gl_id").eqNullSafe(F.col("_gl_i")) & (F.col("_gl_body") == F.col("_gl_b")), "left")
    once = marked.where("_gl_chosen is null").select(*docs.columns)
    if not marks.where("_gl_chosen").limit(1).count():
        return once
    # Only repeated rows are shuffled with their texts.
    return once.union(marked.where("_gl_chosen").dropDuplicates(["_gl_id", "_gl_body"]).select(*docs.columns))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents: doc_id, n_shingles, component_id, kept, class_id; see near_duplicates for odd rows."""
    return near_duplicates(table(spark, sf_dir, "documents", ["doc_id", "text"])).select("doc_id", "n_shingles", "component_id", "kept", "class_id")


#: Pairs by shared shingles and a transitive closure: quick only where components are small.
OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
         ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END) AS sh FROM w
), n AS (SELECT doc_id, count(*) AS n, md5(string_agg(sh, chr(10) ORDER BY sh)) AS d FROM s GROUP BY doc_id),
k AS (SELECT d, min(doc_id) AS class_id FROM n GROUP BY d),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other),
m AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT documents.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, documents.doc_id = component_id AS kept, coalesce(class_id, documents.doc_id) AS class_id
FROM documents JOIN m ON m.doc_id = documents.doc_id LEFT JOIN n ON n.doc_id = documents.doc_id LEFT JOIN k ON k.d = n.d
"""
