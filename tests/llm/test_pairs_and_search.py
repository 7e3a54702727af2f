"""Near duplicates, tiling, nearest neighbours and URL rules against brute force, with odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphlake.llm import ann, decontaminate, neardup, urlrules

DOCS = "doc_id bigint, text string, label string, node string, rep int"


def docs_of(spark, rows):
    """Columns that clash with names inside the operators come along."""
    return spark.createDataFrame([(i, t, "x", "y", 7) for i, t in rows], DOCS)


def words(r, n, kinds=400):
    return [f"w{r.randrange(kinds)}" for _ in range(n)]


def components(rows):
    sets = {i: set(neardup.shingles(t).tolist()) for i, t in rows if i is not None}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (len(sets[i]), min(j for j in sets if root(j) == root(i))) for i in sets}


def corpus():
    r = random.Random(3)
    base = words(r, 120)
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one two"), (4, "ONE  two"), (5, "one two three"), (6, " ".join(words(r, 30_000)))]
    for i in range(7, 60):  # near copies of one text, at all distances
        t = list(base)
        for _ in range(r.randrange(12)):
            t[r.randrange(len(t))] = f"n{r.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    rows += [(i, " ".join(words(r, 80))) for i in range(60, 80)]
    rows += [(80 + i, " ".join(base[:60] + words(r, 60))) for i in range(15)]  # a shared passage only
    rows.append((99, rows[10][1].upper().replace("N", "n")))
    return rows


def test_near_duplicates(spark):
    rows = corpus()
    got = {r.doc_id: r for r in neardup.near_duplicates(docs_of(spark, rows)).collect()}
    want = components(rows)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    assert len({r.component_id for r in got.values()}) < len(got)


def test_near_duplicates_in_cut_blocks(spark):
    """Buckets over the block size are cut, and nothing is lost."""
    rows = corpus()
    for p in (neardup.NearDup(block=7), neardup.NearDup(bytes=4000)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs_of(spark, rows), p).collect()}
        assert got == components(rows)


def test_near_duplicates_odd_rows(spark):
    text = "a b c d e f g h"
    rows = [(None, text), (5, text), (5, text), (3, text), (9, "other words stand here now and then"), (9, text)]
    got = sorted(((r.doc_id or -1), r.component_id, r.kept) for r in neardup.near_duplicates(docs_of(spark, rows)).collect())
    assert got == [(-1, 3, False), (3, 3, True), (5, 3, False), (5, 3, False), (9, 3, False), (9, 9, True)]
    assert neardup.near_duplicates(docs_of(spark, [])).count() == 0
    alone = neardup.near_duplicates(docs_of(spark, [(None, text), (None, f"{text} i"), (None, None)])).collect()
    assert sorted((r.n_shingles, r.component_id, r.kept) for r in alone)[0] == (0, None, True)
    assert sorted((r.component_id is None, r.kept) for r in alone if r.n_shingles) == [(True, False), (True, True)]


def test_near_duplicates_of_repeated_ids(spark):
    """Every text of an id is linked with the near copies of its own, and no text without a copy that stays is dropped."""
    r = random.Random(4)
    a, b, c = ([f"{x}{i}" for i in range(60)] for x in "abc")
    near = lambda t, k: " ".join(t[:k] + ["new"] + t[k + 1 :])
    rows = [(1, " ".join(a)), (2, near(a, 3)), (2, " ".join(b)), (3, near(b, 50)), (3, near(b, 50)), (4, near(b, 2)), (4, " ".join(c)), (5, " ".join(c).upper()), (5, near(c, 55)), (6, None), (6, ""), (None, " ".join(a)), (None, " ".join(a))]
    r.shuffle(rows)
    got = {(x.doc_id, x.body): x for x in neardup.judged(docs_of(spark, rows)).collect()}
    ids = {(x.doc_id, x.text): x.body for x in docs_of(spark, rows).select("doc_id", "text", neardup.body_of(F.col("text")).alias("body")).collect()}
    want = {1: [1], 2: [1, 2], 3: [2], 4: [2, 4], 5: [4]}
    for i, comps in want.items():
        assert sorted({got[i, ids[i, t]].component_id for j, t in rows if j == i}) == comps
    kept = sorted(((x.doc_id or 0), x.text) for x in neardup.deduplicate(docs_of(spark, rows)).where("text <> ''").collect())
    assert kept == [(1, " ".join(a)), (2, " ".join(b)), (4, " ".join(c))]
    assert neardup.deduplicate(docs_of(spark, rows)).count() == 5 and neardup.deduplicate(docs_of(spark, [])).count() == 0


def test_deduplicate_near_copies_under_one_id(spark):
    text = [f"a{i}" for i in range(60)]
    rows = [(1, " ".join(text)), (1, " ".join(text[:-1])), (1, "  ".join(text)), (2, "b c")]
    assert sorted(x.doc_id for x in neardup.deduplicate(docs_of(spark, rows)).collect()) == [1, 2]


def test_posterior_bounds():
    """The least match counts follow the posterior, checked by integration."""
    p = neardup.NearDup(miss=1e-3)
    grid = np.linspace(0, 1, 20_001)
    for n, m in zip(range(p.batch, p.hashes + 1, p.batch), neardup.least_matches(p), strict=True):
        for k, kept in ((m, True), (m - 1, False)):
            f = grid**k * (1 - grid) ** (n - k)
            assert (f[grid >= 0.75].sum() / f.sum() >= 1e-3) == kept


def naive_tiles(p, t, least):
    pm, tm, total = [0] * len(p), [0] * len(t), 0
    while True:
        best, where = 0, []
        for i in range(len(p)):
            for j in range(len(t)):
                k = 0
                while i + k < len(p) and j + k < len(t) and p[i + k] == t[j + k] and not pm[i + k] and not tm[j + k]:
                    k += 1
                if k > best:
                    best, where = k, []
                if k == best and k:
                    where.append((i, j))
        if best < least:
            return total
        for i, j in where:
            if not any(pm[i : i + best]) and not any(tm[j : j + best]):
                pm[i : i + best] = tm[j : j + best] = [1] * best
                total += best


def test_tiles_equal_naive_tiling():
    r = random.Random(5)
    for _ in range(150):
        kinds, least = r.randint(2, 6), r.randint(2, 5)
        p, t = ([r.randrange(kinds) for _ in range(r.randint(0, 50))] for _ in range(2))
        got = decontaminate.tile(np.array(p, np.uint64), np.array(t, np.uint64), least, r.choice([3, 20]))
        assert sum(k for *_, k in got) == naive_tiles(p, t, least)
        assert all(p[i : i + k] == t[j : j + k] and k >= least for i, j, k in got)


def test_tiling_of_long_repetitive_texts():
    """One token, or a period of few, thousands of times on both sides: no walk over all pairs of places."""
    for period in ([1], [1, 2], [1, 2, 3, 1, 2]):
        p, t = (np.array((period * n)[:n], np.uint64) for n in (1000, 20_000))
        assert sum(k for *_, k in decontaminate.tile(p, t)) == 1000


def test_tokens_of_scripts_without_blanks():
    assert decontaminate.tokens("日本語テスト abc").size == 7 and decontaminate.tokens("naïve über 12_x").size == 4


def test_contamination(spark):
    r = random.Random(1)
    item = words(r, 40, 10_000)
    moved = item[20:40] + words(r, 30, 10_000) + item[:20]
    texts = {
        1: " ".join(words(r, 100, 10_000) + item + words(r, 100, 10_000)),
        2: " ".join(moved).upper(),
        3: " ".join(item[:12] + words(r, 100, 10_000)),  # too little of it
        4: " ".join(words(r, 20_000, 10_000)),
        5: None,
        6: "",
        None: " ".join(item),
    }
    rows = [*texts.items(), (1, texts[1])]
    bench = spark.createDataFrame([(7, " ".join(item)), (7, " ".join(item)), (8, "too short"), (9, None), (None, " ".join(item)), (10, " ".join(words(r, 30, 10_000)))], "item_id bigint, text string")
    got = {(x.doc_id, x.item_id): x for x in decontaminate.contaminated(docs_of(spark, rows), bench.withColumn("tokens", F.lit(1))).collect()}
    assert set(got) == {(1, 7), (2, 7), (None, 7)}
    assert got[1, 7].tiles == 1 and got[1, 7].coverage == 1.0
    assert got[2, 7].tiles == 2 and got[2, 7].matched_tokens == 40
    assert decontaminate.contaminated(docs_of(spark, rows), bench.limit(0)).count() == 0
    assert decontaminate.contaminated(docs_of(spark, []), bench).count() == 0


def test_contamination_with_common_seeds(spark):
    """Passages that most documents and many items share: the pairs are those of brute force, at any coverage."""
    r = random.Random(7)
    common = words(r, 12, 10_000)
    items = [words(r, r.randrange(5, 25), 10_000) for _ in range(20)]
    items = [common + i if k % 2 else i for k, i in enumerate(items)]
    docs = []
    for i in range(120):
        t = words(r, r.randrange(5, 60), 10_000)
        for _ in range(r.randrange(3)):
            x = r.choice(items)
            a, b = sorted(r.sample(range(len(x) + 1), 2))
            at = r.randrange(len(t) + 1)
            t = t[:at] + x[a:b] + t[at:]
        docs.append((i, " ".join(t + common if r.random() < 0.7 else t)))
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id bigint, text string")
    for coverage in (0.3, 0.5, 0.9):
        want = set()
        for i, t in docs:
            tok = decontaminate.tokens(t)
            for k, x in enumerate(items):
                got = sum(n for *_, n in decontaminate.tile(decontaminate.tokens(" ".join(x)), tok))
                if got >= coverage * len(x):
                    want.add((i, k))
        got = {(x.doc_id, x.item_id) for x in decontaminate.contaminated(docs_of(spark, docs), bench, decontaminate.Tiling(coverage=coverage)).collect()}
        assert got == want and len(want) > 3


def test_nearest(spark):
    g = np.random.default_rng(2)
    x = g.standard_normal((400, 24)) * g.uniform(0.2, 3, (400, 1))
    x[50:60] = x[40]  # ties
    rows = [(i, v.tolist(), 1.0) for i, v in enumerate(x)]
    odd = [(1000, None, 1.0), (1001, [0.0] * 24, 1.0), (1002, [None] + [1.0] * 23, 1.0), (1003, [float("nan")] + [1.0] * 23, 1.0), (1004, [float("inf")] + [1.0] * 23, 1.0), (1005, [1.0] * 5, 1.0), (None, [9.0] * 24, 1.0), (3, x[3].tolist(), 1.0)]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, vector array<double>, score double")
    asked = df.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    got = ann.search(df, asked, 7, ann.OneBit(bits=256, shard=64, queries=8, step=32)).toPandas()
    hit = 0
    for q in range(0, 400, 20):
        s = (x * x[q]).sum(1)
        ids = np.array([i for i in range(400) if i != q])
        want = ids[np.lexsort((ids, -s[ids]))][:7]
        mine = got[got.query_id == q].sort_values("rank")
        assert np.array_equal(mine.score.to_numpy(), s[mine.vec_id.to_numpy()])
        hit += len(set(want) & set(mine.vec_id))
    assert hit >= 0.98 * 140
    assert set(got["rank"]) == set(range(1, 8)) and not set(got.query_id) & {1000, 1002}
    few = ann.search(df.where("vec_id < 3"), asked.where("query_id = 0"), 7).collect()
    assert [r.vec_id for r in sorted(few, key=lambda r: r["rank"])] == sorted((1, 2), key=lambda i: -(x[i] @ x[0]))
    assert ann.search(df.limit(0), asked, 7).count() == 0 and ann.search(df, asked.limit(0), 7).count() == 0


def test_nearest_of_repeated_ids(spark):
    """Every row is a candidate, whatever its id, and every row of queries is answered; a query's own id is none."""
    rows = [(i // 2, [float(i), 1.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id bigint, vector array<float>")
    p = ann.OneBit(bits=64, shard=8, queries=4, step=4)
    asked = df.where("vec_id = 19").withColumnRenamed("vec_id", "query_id")
    got = sorted((r["rank"], r.score, r.vec_id) for r in ann.search(df, asked.union(asked.where("vector[0] = 39")), 5, p).collect())
    want = [(k + 1, float(x * i + 1), i // 2) for x in (38, 39, 39) for k, i in enumerate((37, 36, 35, 34, 33))]
    assert got == sorted(want)


def test_nearest_of_copies(spark):
    """Many copies of one vector, ids with several rows and vectors: all ties go to the smaller id, row by row."""
    g = np.random.default_rng(5)
    x = [g.standard_normal(8).tolist() for _ in range(30)]
    rows = [(i, x[0]) for i in range(200, 260)] + [(7, x[0])] * 2 + [(7, [2 * v for v in x[0]]), (7, [3 * v for v in x[0]]), (8, [2 * v for v in x[0]]), (8, x[0])]
    rows += [(i, x[i % 30]) for i in range(100, 200)]
    df = spark.createDataFrame(rows, "vec_id bigint, vector array<double>")
    asked = spark.createDataFrame([(7, x[0]), (210, x[0]), (500, x[1])], "query_id bigint, vector array<double>")
    got = ann.search(df, asked, 12, ann.OneBit(bits=64, error=9.0, shard=16, queries=2, step=4)).collect()
    for i, q in ((7, x[0]), (210, x[0]), (500, x[1])):
        want = sorted((-float((np.array(q) * np.array(v)).sum()), j) for j, v in rows if j != i)[:12]
        assert [(-r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == i), key=lambda r: r["rank"])] == want


def test_codes_alone_meet_the_queries(spark):
    """Half of what raw vectors take in the scan, and recall of 0.95 at 256 bits, of unclustered vectors, too."""
    g = np.random.default_rng(9)
    x = g.standard_normal((3000, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, vector array<float>")
    got = ann.search(df, df.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), 20, ann.OneBit(error=2.0, shard=1000, queries=32)).toPandas()
    x, hit = x.astype(float), 0
    for i, mine in got.groupby("query_id"):
        s = x @ x[i]
        s[i] = -np.inf
        hit += len(set(np.argsort(-s)[:20]) & set(mine.vec_id))
    assert len(got) == 1200 and hit >= 0.95 * 1200
    codes, factor, margin = ann.encode(x, ann.rotation(64, ann.OneBit()), x.mean(0), 2.0)
    assert codes.nbytes + factor.nbytes + margin.nbytes == 48 * 3000


def test_one_bit_bounds_hold():
    """Estimates of inner products are within their bounds."""
    g = np.random.default_rng(0)
    p = ann.OneBit(bits=256)
    turn = ann.rotation(32, p)
    assert np.allclose(turn @ turn.T, np.eye(32))
    x, q = g.standard_normal((2000, 32)), g.standard_normal(32)
    r = x @ turn
    norm = np.linalg.norm(r, axis=1)
    signs = np.abs(r / norm[:, None]).sum(1) / 16
    estimate = norm * (np.where(r > 0, 1, -1) @ (q @ turn)) / 16 / signs
    bound = np.linalg.norm(q) * norm * np.sqrt(1 - signs**2) / signs * p.error / np.sqrt(255)
    assert (np.abs(estimate - x @ q) <= bound).mean() > 0.99
    shard = ann.Codes(*ann.encode(x, turn, np.zeros(32), p.error), turn, np.zeros(32), 300)
    scan = lambda upper: np.hstack([u[0] for _, u in shard.scan(q[None], upper)])
    assert np.allclose(scan(False), estimate, atol=1e-3) and np.allclose(scan(True), estimate + bound, atol=1e-3)


RULES = [("com", "/en/", "block"), ("a.com", "/en/7", "allow"), ("b.a.com", "", "block"), ("x.org", "/", "allow"), ("x.org", "/", "block"), ("", "/", "block"), (None, "/", "block"), ("net", None, "allow")]


def verdict(host, path):
    fits = [(len(h + (p or "")), len(h), v == "block", h + (p or ""), v) for h, p, v in RULES if h and (host == h or host.endswith("." + h)) and path.startswith(p or "")]
    return max(fits)[3:] if fits else (None, "allow")


@pytest.mark.parametrize("p", [urlrules.Sweep(), urlrules.Sweep(rows=3, least_parts=9)])
def test_url_rules(spark, p):
    urls = ["http://a.com/en/71", "https://B.A.com/en/7?x", "http://a.com/fr", "http://xa.com/en/", "ftp://x.org", "x.org/", None, "", "http://", "http://evil,a.com/en/7", "http://net#f", "http://y.net/?q", "http://a.com:80/en/7", "http://a.com/en/\n7", "://com/en/x://y"]
    urls += [f"http://h{i % 3}.a.com/en/{i}" for i in range(60)] + ["http://a.com/en/71"] * 40
    rows = [(i if i % 7 else None, u, "z") for i, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "id bigint, url string, key string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = sorted(map(repr, (tuple(r) for r in urlrules.judge(pages, rules, p).collect())))
    want = []
    for i, u, _ in rows:
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        n = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = rest[:n].translate({c: c + 32 for c in range(65, 91)})
        path = rest[n : min((rest.find(c, n) for c in "?#" if rest.find(c, n) >= 0), default=len(rest))]
        want.append(repr((i, host, path, *verdict(host, path))))
    assert got == sorted(want)
    assert {r.verdict for r in urlrules.judge(pages, rules.limit(0), p).collect()} == {"allow"}
    assert urlrules.judge(pages.limit(0), rules, p).count() == 0
