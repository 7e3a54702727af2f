"""Exact clustering, repeated lines and hard negatives against brute force and SQL, with odd rows."""

import hashlib
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from graphlake.llm import kmeans, lines, negatives

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("run", "sql", "name"), [(kmeans.op11_yinyang, kmeans.OP11_SQL, "embeddings"), (lines.op12_line_bitmaps, lines.OP12_SQL, "documents"), (negatives.op13_vantage_tree, negatives.OP13_SQL, "embeddings")])
def test_matches_sql(spark, run, sql, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    cur = con.execute(sql)
    want = [d[0] for d in cur.description], sorted(cur.fetchall())
    df = run(spark, SF)
    assert (df.columns, sorted(map(tuple, df.collect()))) == want


# Clustering

VECTORS = "vec_id bigint, vector array<double>, label int, cluster string, x int"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, 1, "c", 2) for i, v in rows], VECTORS)


def lloyd(rows, p):
    """(vec_id, cluster, distance) and the centroids, by full scans."""
    kept = [(i, [int(np.floor(p.scale * c)) for c in v]) for i, v in rows if v is not None and len(v) == p.dim and all(c is not None and np.isfinite(c) and abs(c) * p.scale < p.limit for c in v)]
    first = sorted((hashlib.sha256(f"{p.salt}{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[: p.k]
    c = [v for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c))
    for _ in range(p.rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[near(v)[1]].append(v)
        c = [[sum(col) // len(own[j]) for col in zip(*own[j])] if own[j] else m for j, m in enumerate(c)]
    return sorted((repr(i), near(v)[1], near(v)[0]) for i, v in kept), c


@pytest.mark.parametrize(("k", "groups", "rounds"), [(16, None, 3), (7, 7, 5), (12, 1, 4), (100, 5, 2)])
def test_yinyang_equals_full_scans(spark, k, groups, rounds):
    r = random.Random(k)
    p = kmeans.Yinyang(k=k, rounds=rounds, groups=groups, dim=3, scale=8, step=200)
    rows = [(i, [r.gauss(5 * (i % 6), 0.5), r.gauss(i % 4, 0.3), -r.random()]) for i in range(90)]
    rows += [(200, None), (201, [1.0, 2.0]), (202, [1.0, None, 2.0]), (203, [float("nan"), 0.0, 0.0]), (204, [float("inf"), 0.0, 0.0]), (205, [1e300, 0.0, 0.0]), (None, [0.5, 0.5, 0.5])]
    rows += [(3, rows[3][1])] * 20 + [(3, rows[4][1]), (206, [0.0, 0.0, 0.0]), (207, [-0.0, 0.0, 0.0])]  # repeated rows and ids, ties
    got = kmeans.cluster(vectors_of(spark, rows), p)
    want, centroids = lloyd(rows, p)
    assert sorted((repr(x.vec_id), x.cluster, x.distance) for x in got.rows.collect()) == want
    assert got.centroids.tolist() == centroids
    for j, total in enumerate(got.inertia):
        assert total == sum(d for _, c, d in want if c == j)


def test_yinyang_filters_spare_distances(spark):
    r = random.Random(1)
    rows = [(i, [r.gauss(20 * (i % 20), 0.3), r.gauss(0, 0.3)]) for i in range(2000)]
    p = kmeans.Yinyang(k=20, rounds=6, dim=2)
    got = kmeans.cluster(vectors_of(spark, rows), p)
    assert got.measured[0] == 2000 * 20
    assert got.measured[-1] < 2000 * 5


def test_yinyang_without_vectors(spark):
    assert kmeans.cluster(vectors_of(spark, [])) is None
    assert kmeans.cluster(vectors_of(spark, [(1, None)])) is None
    with pytest.raises(ValueError):
        kmeans.cluster(vectors_of(spark, [(None, [1.0])]), kmeans.Yinyang(dim=1))


# Lines

DOCS = "doc_id bigint, text string, n_lines int, th string, keep int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, 1, "t", 2) for i, t in rows], DOCS)


def kept_of(rows, p):
    """{(doc_id, text): (n_lines, kept text)} by the definition."""
    docs = sorted({(i, t or "") for i, t in rows}, key=lambda d: (d[0] is not None, d[0] or 0, lines_key(d[1])))
    held = defaultdict(set)
    for d in docs:
        for line in d[1].split("\n"):
            k = line.strip(" \t\n\x0b\x0c\r")
            k = "".join(c.lower() if "A" <= c <= "Z" else c for c in k)
            if len(k) >= p.chars:
                held[k].add(d)
    out, met = {}, set()
    for d in docs:
        keep = []
        for line in d[1].split("\n"):
            k = line.strip(" \t\n\x0b\x0c\r")
            k = "".join(c.lower() if "A" <= c <= "Z" else c for c in k)
            if len(held.get(k, ())) < p.least or (p.keep_first and k not in met):
                keep.append(line)
            met.add(k)
        out[d] = (len(d[1].split("\n")), "\n".join(keep))
    return out


_KEYS = {}


def lines_key(text):
    return _KEYS[text]


def line_rows():
    r = random.Random(5)
    pool = [f"  Line {i} É" if i % 3 else f"line {i} é\t" for i in range(40)]
    rows = [(i, "\n".join(r.choice(pool + ["", " ", "hot"]) for _ in range(r.randrange(1, 12)))) for i in range(150)]
    rows += [(None, None), (None, "hot\nhot\nown"), (500, ""), (501, None), (502, "\n\n"), (503, "HOT\r\n\x0bhot \nx"), (504, "\n".join(["hot"] * 3000 + [f"only {i}" for i in range(3000)]))]
    rows += [(7, rows[8][1]), (7, "hot\nother")] + [(600, "copy\ncopy\nhot")] * 30 + [(700 + i, "rare ten") for i in range(10)] + [(800 + i, "rare nine") for i in range(9)]
    return rows


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize(("least", "chars", "parts", "batch"), [(10, 1, 4, 10_000), (10, 1, 61, 7), (3, 6, 13, 2), (2, 1, 1, 5), (1, 0, 9, 3)])
def test_repeated_lines(spark, keep_first, least, chars, parts, batch):
    rows = line_rows()
    p = lines.Lines(least, chars, keep_first)
    df = docs_of(spark, rows)
    _KEYS.update({t or "": h for t, h in df.select("text", lines._text_key(F.col("text"))).distinct().collect()})
    names = {"spark.sql.shuffle.partitions": str(parts), "spark.sql.execution.arrow.maxRecordsPerBatch": str(batch), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {n: spark.conf.get(n) for n in names}
    try:
        for n, v in names.items():
            spark.conf.set(n, v)
        got = lines.without_lines(df, lines.keep_bitmaps(df, p)).collect()
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
    want = kept_of(rows, p)
    assert len(got) == len(rows)
    assert set(got[0].asDict()) == {"doc_id", "text", "n_lines", "th", "keep", "n_dropped"}
    left = sorted(((repr(i), *want[i, t or ""]) for i, t in rows))
    assert sorted((repr(x.doc_id), x.n_lines, x.text or "") for x in got) == left
    assert all(x.n_lines - x.n_dropped == (len(x.text.split("\n")) if x.text else 0) or not x.text for x in got)


def test_bitmaps_say_which_lines_stay(spark):
    df = docs_of(spark, [(i, f"same\nown {i}\n\nsame") for i in range(12)])
    for b in lines.keep_bitmaps(df).collect():
        assert (b.n_lines, b.n_dropped, lines.unpack(b.keep, b.n_lines).tolist()) == (4, 2, [False, True, True, False])
    assert lines.keep_bitmaps(docs_of(spark, [])).count() == 0
    assert lines.without_lines(docs_of(spark, []), lines.keep_bitmaps(docs_of(spark, []))).count() == 0


# Hard negatives

LABELLED = "vec_id bigint, vector array<double>, label int, row string, shard int, rank int"


def labelled(spark, rows):
    return spark.createDataFrame([(*r, "r", 1, 2) for r in rows], LABELLED)


def mined(rows, p, anchor):
    ok = [(i, [int(np.floor(p.scale * c)) for c in v], y) for i, v, y in rows if i is not None and y is not None and v is not None and len(v) == 4 and all(c is not None and np.isfinite(c) for c in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, v, y in ok:
        if not anchor(i):
            continue
        pos = sorted((-dot(v, w), j) for j, w, z in ok if z == y and j != i)[: p.positives]
        for s, j in pos:
            neg = sorted((-dot(v, w), h) for h, w, z in ok if z != y and p.low * -s <= 100 * dot(v, w) <= p.high * -s)[: p.k]
            out += [(i, j, r, h, -s, -t) for r, (t, h) in enumerate(neg, 1)]
    return sorted(out)


@pytest.mark.parametrize(("shard", "leaf", "scale"), [(10_000, 8, 256), (37, 4, 256), (50, 1000, 2.0**20), (64, 2, 2.0**26)])
def test_hard_negatives(spark, shard, leaf, scale):
    r = random.Random(2)
    rows = [(i, [r.gauss(i % 3, 1), r.gauss(1, 1), r.choice([0.0, 1.0]), r.random()], i % 5) for i in range(240)]
    rows += [(300, [0.0] * 4, 1), (301, None, 1), (302, [1.0, None, 1.0, 1.0], 2), (303, [1.0] * 3, 1), (304, [float("nan")] * 4, 1), (305, [1.0] * 4, None), (None, [1.0] * 4, 1), (306, [], 1)]
    rows += [(i + 400, rows[i][1], rows[i][2]) for i in range(20)] + [(i + 500, rows[i][1], (rows[i][2] + 1) % 5) for i in range(20)]  # ties
    rows += [(10, rows[11][1], 0), (450, [-1.0, -1.0, -1.0, -1.0], 9)]  # a repeated id, an anchor alone in its label
    p = negatives.Mining(shard=shard, queries=16, leaf=leaf, scale=scale)
    got = sorted(map(tuple, negatives.mine(labelled(spark, rows), F.col("vec_id") % 10 == 0, p).collect()))
    assert got == mined(rows, p, lambda i: i % 10 == 0)


def test_tree_opens_few_leaves():
    r = np.random.default_rng(3)
    x = np.floor(r.normal(size=(4096, 2)) * 1000)
    labels = r.integers(0, 3, 4096)
    q = x[:50]
    tree = negatives.build(x, 32)
    wide = np.full(50, 1 << 62)
    at, rows, scores, opened = negatives.search(tree, x, np.arange(4096), labels, q, np.arange(50), labels[:50], -wide, wide, 3, False)
    for i in range(50):
        s = np.where(labels == labels[i], -np.inf, x @ q[i])
        assert scores[at == i].tolist() == sorted(s)[::-1][:3]
    assert opened < 50 * 128 / 3


def test_no_vectors_no_negatives(spark):
    assert negatives.mine(labelled(spark, [])).count() == 0
    assert negatives.mine(labelled(spark, [(1, None, 1)])).count() == 0
