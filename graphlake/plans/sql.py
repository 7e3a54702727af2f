"""The queries in DuckDB SQL, written apart from the DataFrame code: windows and self-joins in place of its two-level sums."""

from __future__ import annotations

_GRAPH = """
nc AS (SELECT count(*) AS n FROM customer),
raw AS (SELECT o_custkey AS u, l_partkey + nc.n AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey CROSS JOIN nc),
und AS (SELECT DISTINCT u, v FROM raw),
edges AS (SELECT u AS src, v AS dst FROM und UNION ALL SELECT v, u FROM und),
nodes AS (
  SELECT c_custkey AS id, 0 AS kind, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS label,
         CASE WHEN c_custkey % 10 <= 5 THEN 'train' WHEN c_custkey % 10 <= 7 THEN 'valid' ELSE 'test' END AS split
  FROM customer
  UNION ALL SELECT p_partkey + nc.n, 1, NULL, NULL FROM part CROSS JOIN nc
),
train AS (SELECT id FROM nodes WHERE split = 'train'),
nv AS (SELECT count(*) AS n FROM embeddings),
feat AS (SELECT id, embedding AS x FROM nodes CROSS JOIN nv JOIN embeddings ON vec_id = id % nv.n),
assign AS (SELECT id, CAST(((id % 2147483648) * 2654435761) % 4294967296 // 65536 % 16 AS INTEGER) AS part FROM nodes),
ids16 AS (SELECT CAST(range AS INTEGER) AS part FROM range(16)),
psize AS (SELECT i.part, count(a.id) AS n FROM ids16 i LEFT JOIN assign a ON a.part = i.part GROUP BY i.part),
parts AS (SELECT part, CAST(sum(n) OVER (ORDER BY part) - n AS BIGINT) AS s, CAST(sum(n) OVER (ORDER BY part) AS BIGINT) AS e FROM psize),
node_map AS (SELECT id AS old_id, part, row_number() OVER (ORDER BY part, id) - 1 AS new_id FROM assign),
ep AS (
  SELECT a.new_id AS src, b.new_id AS dst, a.part AS sp, b.part AS dp, a.part * 16 + b.part AS block
  FROM edges JOIN node_map a ON edges.src = a.old_id JOIN node_map b ON edges.dst = b.old_id
),
indeg AS (SELECT n.id, count(e.src) AS deg FROM nodes n LEFT JOIN edges e ON e.dst = n.id GROUP BY n.id),
deg1 AS (SELECT id, CAST(greatest(deg, 1) AS DOUBLE) AS deg FROM indeg),
batch AS (SELECT * FROM (VALUES (11, 0), (3, 1), (7, 2)) t(part, seq)),
bases AS (
  SELECT b.part, seq, p.s, p.e - p.s AS n, coalesce(sum(p.e - p.s) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base
  FROM batch b JOIN parts p ON p.part = b.part
),
w0 AS (SELECT n.id, CASE WHEN split = 'train' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS s FROM nodes n),
w1 AS (
  SELECT w.id, w.s * 0.5::DOUBLE + coalesce(a.s, 0) * 0.5::DOUBLE AS s FROM w0 w
  LEFT JOIN (SELECT e.dst AS id, sum(x.s / d.deg) AS s FROM edges e JOIN w0 x ON x.id = e.src JOIN deg1 d ON d.id = e.src GROUP BY e.dst) a ON a.id = w.id
),
w2 AS (
  SELECT w.id, w.s * 0.5::DOUBLE + coalesce(a.s, 0) * 0.5::DOUBLE AS s FROM w1 w
  LEFT JOIN (SELECT e.dst AS id, sum(x.s / d.deg) AS s FROM edges e JOIN w1 x ON x.id = e.src JOIN deg1 d ON d.id = e.src GROUP BY e.dst) a ON a.id = w.id
),
w3 AS (
  SELECT w.id, w.s * 0.5::DOUBLE + coalesce(a.s, 0) * 0.5::DOUBLE AS s FROM w2 w
  LEFT JOIN (SELECT e.dst AS id, sum(x.s / d.deg) AS s FROM edges e JOIN w2 x ON x.id = e.src JOIN deg1 d ON d.id = e.src GROUP BY e.dst) a ON a.id = w.id
),
nt AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM train),
revisit AS (SELECT e.dst AS id, sum(1 / d.deg) / any_value(m.deg) AS r FROM edges e JOIN deg1 d ON d.id = e.src JOIN deg1 m ON m.id = e.dst GROUP BY e.dst),
imp1 AS (SELECT w0.id, (w0.s * 0.5::DOUBLE + w1.s) / nt.n AS s FROM w0 JOIN w1 ON w0.id = w1.id CROSS JOIN nt),
imp2 AS (
  SELECT w0.id, (w0.s * 0.5::DOUBLE + w1.s * 0.5::DOUBLE + w2.s - 0.25::DOUBLE * w0.s * coalesce(r.r, 0)) / nt.n AS s
  FROM w0 JOIN w1 ON w0.id = w1.id JOIN w2 ON w0.id = w2.id LEFT JOIN revisit r ON r.id = w0.id CROSS JOIN nt
),
pvt AS (SELECT id, round(s, 12) AS s FROM (SELECT id, s, row_number() OVER (ORDER BY round(s, 12) DESC, id) AS k, count(*) OVER () AS n FROM w1) WHERE k <= floor(n * 0.05::DOUBLE)),
bydeg AS (SELECT id, row_number() OVER (ORDER BY deg DESC, id) AS k, count(*) OVER () AS n FROM indeg),
popular AS (SELECT id FROM bydeg WHERE k <= floor(n * 0.1::DOUBLE)),
popular5 AS (SELECT id FROM bydeg WHERE k <= floor(n * 0.05::DOUBLE))
"""


def _chunk(pos: str, n: str, size: str) -> str:
    """Even chunk of a position, by listing the chunk sizes."""
    return f"(SELECT count(*) FROM range(({n}) // ({size})) q WHERE q.range > 0 AND q.range * {size} + least(q.range * ceil((({n}) % ({size})) / (({n}) // ({size}))), ({n}) % ({size})) <= {pos})"


_SEEDS = """
seq AS (SELECT id, row_number() OVER (ORDER BY md5(concat_ws(',', id, 0, 3)), id) - 1 AS pos, count(*) OVER () AS n FROM train),
gb AS (SELECT id, pos, {even} AS batch FROM seq)
""".format(even=_chunk("pos", "n", "100"))

#: Two hops from gb(batch, id), with fanouts 5 and 3; edges and the seed are put in.
_HOPS = """
f1 AS (
  SELECT batch, src, dst FROM (
    SELECT g.batch, e.src, e.dst, row_number() OVER (PARTITION BY g.batch, e.dst ORDER BY md5(concat_ws(',', e.src, e.dst, 0, {seed})), e.src) AS r
    FROM gb g JOIN {edges} e ON e.dst = g.id) WHERE r <= 5
),
n1 AS (SELECT DISTINCT batch, src AS id FROM f1 EXCEPT SELECT batch, id FROM gb),
f2 AS (
  SELECT batch, src, dst FROM (
    SELECT g.batch, e.src, e.dst, row_number() OVER (PARTITION BY g.batch, e.dst ORDER BY md5(concat_ws(',', e.src, e.dst, 1, {seed})), e.src) AS r
    FROM n1 g JOIN {edges} e ON e.dst = g.id) WHERE r <= 3
),
n2 AS (SELECT DISTINCT batch, src AS id FROM f2 EXCEPT SELECT batch, id FROM gb EXCEPT SELECT batch, id FROM n1),
sn AS (SELECT batch, 0 AS hop, id FROM gb UNION ALL SELECT batch, 1, id FROM n1 UNION ALL SELECT batch, 2, id FROM n2),
se AS (SELECT batch, 0 AS hop, src, dst FROM f1 UNION ALL SELECT batch, 1, src, dst FROM f2)
"""

_SAMPLE = _SEEDS + "," + _HOPS.format(edges="edges", seed=17)

_SUPER = """
so AS (SELECT part, (row_number() OVER (ORDER BY md5(concat_ws(',', part, 1, 2)), part) - 1) // 4 AS superblock FROM (SELECT DISTINCT part FROM {source}))
"""

_INFLUENCE = """
i1 AS (
  SELECT seed, id, sum(s) AS s FROM (
    SELECT id AS seed, id, 0.5::DOUBLE AS s FROM train
    UNION ALL SELECT t.id, e.dst, 0.5::DOUBLE / d.deg FROM train t JOIN edges e ON e.src = t.id JOIN deg1 d ON d.id = t.id) GROUP BY seed, id
),
i2 AS (
  SELECT seed, id, sum(s) AS s FROM (
    SELECT seed, id, s * 0.5::DOUBLE AS s FROM i1
    UNION ALL SELECT i.seed, e.dst, i.s * 0.5::DOUBLE / d.deg FROM i1 i JOIN edges e ON e.src = i.id JOIN deg1 d ON d.id = i.id) GROUP BY seed, id
),
inf AS (SELECT * FROM (SELECT seed, id, s, row_number() OVER (PARTITION BY seed ORDER BY round(s, 12) DESC, id) AS rank FROM i2) WHERE rank <= 100)
"""

_PIVOTS = """
pv AS (SELECT row_number() OVER (ORDER BY p.id) - 1 AS pvt, p.id AS old_id, a.part FROM pvt p JOIN assign a ON a.id = p.id),
sb AS (SELECT b.part, p.s, p.e - p.s AS n, coalesce(sum(p.e - p.s) OVER (ORDER BY b.part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM batch b JOIN parts p ON p.part = b.part),
nm AS (SELECT sum(n) AS n FROM sb),
main AS (SELECT m.new_id, m.old_id, m.part, sb.base + m.new_id - sb.s AS lid FROM node_map m JOIN sb ON sb.part = m.part)
"""

_RUNS = """
rl AS (
  SELECT CAST(o_orderkey % 6 AS INTEGER) AS run, CAST(o_orderkey // 6 % 40 AS INTEGER) AS iter, count(*) FILTER (o_orderstatus = 'F') / count(*) AS val, count(*) FILTER (o_totalprice > 150000) / count(*) AS test
  FROM orders GROUP BY 1, 2
),
be AS (SELECT run, iter, val, test FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY val DESC, iter) AS k FROM rl) WHERE k = 1)
"""

_LABELS = _SEEDS + """,
cls AS (SELECT CAST(range AS INTEGER) AS class FROM range(5)),
bl AS (
  SELECT b.batch, c.class, count(n.id) / sum(count(n.id)) OVER (PARTITION BY b.batch) AS mass
  FROM (SELECT DISTINCT batch FROM gb) b CROSS JOIN cls c
  LEFT JOIN (SELECT gb.batch, gb.id, nodes.label FROM gb JOIN nodes ON nodes.id = gb.id) n ON n.batch = b.batch AND n.label = c.class
  GROUP BY b.batch, c.class
),
tl AS (SELECT c.class, count(n.id) / sum(count(n.id)) OVER () AS mass FROM cls c LEFT JOIN (SELECT * FROM nodes WHERE split = 'train') n ON n.label = c.class GROUP BY c.class),
emd AS (
  SELECT a.batch, avg(abs(a.mass - b.mass)) AS d
  FROM (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY mass) AS k FROM bl) a
  JOIN (SELECT *, row_number() OVER (ORDER BY mass) AS k FROM tl) b ON a.k = b.k GROUP BY a.batch
)
"""


#: Without half of the nodes beyond the first hop of sn.
_FAR = """
fs AS (SELECT batch, hop, id FROM (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY md5(concat_ws(',', batch, id, 6))) AS k, count(*) OVER (PARTITION BY batch) AS n FROM sn WHERE hop > 1) WHERE k > floor(n * 0.5::DOUBLE)
  UNION ALL SELECT batch, hop, id FROM sn WHERE hop <= 1)
"""

#: Features as (id, i, v).
_X = " x AS MATERIALIZED (SELECT id, unnest(range(64)) AS i, unnest(list_transform(x, lambda v: CAST(v AS DOUBLE))) AS v FROM feat)"


def _dense(name: str, own: str, near: str | None, width: int, shift: int = 0) -> str:
    """name(id, i, v): own by the rule's weights and, if given, near by those of one row further."""
    part = lambda table, s: f"SELECT id, j.range AS j, v * ((7 * (i + {s}) + 3 * j.range) % 5 - 2) / 8 AS v FROM {table} CROSS JOIN range({width}) j"
    both = part(own, shift) + (f" UNION ALL {part(near, shift + 1)}" if near else "")
    return f" {name} AS MATERIALIZED (SELECT id, j AS i, sum(v) AS v FROM ({both}) GROUP BY id, j)"


_SAGE = [
    " m1 AS MATERIALIZED (SELECT dst AS id, i, avg(v) AS v FROM edges JOIN x ON x.id = src GROUP BY dst, i)",
    _dense("y1", "x", "m1", 8),
    " r1 AS MATERIALIZED (SELECT id, i, greatest(v, 0) AS v FROM y1), m2 AS MATERIALIZED (SELECT dst AS id, i, avg(v) AS v FROM edges JOIN r1 ON r1.id = src GROUP BY dst, i)",
    _dense("y2", "r1", "m2", 4),
]


_LEAKY = "CASE WHEN v > 0 THEN v ELSE 0.01::DOUBLE * v END"
#: Two residual layers, whose outputs and the input all reach the head.
_RESIDUAL = [
    " m1 AS MATERIALIZED (SELECT dst AS id, i, avg(v) AS v FROM edges JOIN x ON x.id = src GROUP BY dst, i)",
    _dense("a1", "x", "m1", 8),
    _dense("s1", "x", None, 8),
    f" y1 AS MATERIALIZED (SELECT id, i, {_LEAKY} AS v FROM a1), x2 AS MATERIALIZED (SELECT id, i, sum(v) AS v FROM (SELECT * FROM y1 UNION ALL SELECT * FROM s1) GROUP BY id, i)",
    " m2 AS MATERIALIZED (SELECT dst AS id, i, avg(v) AS v FROM edges JOIN x2 ON x2.id = src GROUP BY dst, i)",
    _dense("a2", "x2", "m2", 8),
    f" held AS MATERIALIZED (SELECT id, i, v FROM x UNION ALL SELECT id, i + 64, v FROM y1 UNION ALL SELECT id, i + 72, {_LEAKY} FROM a2)",
    _dense("h1", "held", None, 8),
    _dense("h2", "h1", None, 4),
    " z2 AS (SELECT id, i, v - max(v) OVER (PARTITION BY id) - ln(sum(exp(v)) OVER (PARTITION BY id) / exp(max(v) OVER (PARTITION BY id))) AS v FROM h2)",
]


def _attend(shift: int, edges: str) -> list[str]:
    """o<shift>(id, v): what one head gives over some edges."""
    k = shift
    return [
        _dense(f"h{k}", "x", None, 8, k),
        f" lr{k} AS MATERIALIZED (SELECT id, sum(v * ((i + {k}) % 3 - 1) / 4) AS l, sum(v * ((i + {k}) % 4 - 1) / 4) AS r FROM h{k} GROUP BY id)",
        f" s{k} AS (SELECT src, dst, CASE WHEN a.l + b.r > 0 THEN a.l + b.r ELSE (a.l + b.r) * 0.2::DOUBLE END AS e FROM {edges} JOIN lr{k} a ON a.id = src JOIN lr{k} b ON b.id = dst)",
        f" a{k} AS MATERIALIZED (SELECT src, dst, exp(e) / sum(exp(e)) OVER (PARTITION BY dst) AS a FROM s{k})",
        f" o{k} AS (SELECT dst AS id, sum(a * t.v) AS v FROM a{k} JOIN (SELECT id, sum(v) AS v FROM h{k} GROUP BY id) t ON t.id = src GROUP BY dst)",
    ]


#: Edges by position, lists of targets, and two hops of 40 and 3 draws from them.
_DRAWS = """
el AS MATERIALIZED (SELECT src, dst, row_number() OVER (ORDER BY dst, src) - 1 AS eid FROM edges),
ls AS MATERIALIZED (SELECT dst, min(eid) AS s, count(*) AS n FROM el GROUP BY dst),
d1 AS MATERIALIZED (SELECT g.batch, l.s + CAST('0x' || substr(md5(concat_ws(',', g.id, 0, j.range, 17)), 1, 8) AS BIGINT) % l.n AS eid FROM gb g JOIN ls l ON l.dst = g.id CROSS JOIN range(40) j),
r1 AS MATERIALIZED (SELECT batch, src, dst, el.eid FROM d1 JOIN el ON el.eid = d1.eid),
o1 AS (SELECT DISTINCT batch, src AS id FROM r1 EXCEPT SELECT batch, id FROM gb),
d2 AS MATERIALIZED (SELECT g.batch, l.s + CAST('0x' || substr(md5(concat_ws(',', g.id, 1, j.range, 17)), 1, 8) AS BIGINT) % l.n AS eid FROM o1 g JOIN ls l ON l.dst = g.id CROSS JOIN range(3) j),
r2 AS MATERIALIZED (SELECT batch, src, dst, el.eid FROM d2 JOIN el ON el.eid = d2.eid)
"""


def _dropped(share: str) -> str:
    """SQL of sn without a share of all but the seeds, those beyond hop 1 first."""
    return f"SELECT CAST(batch AS BIGINT) AS batch, hop, id FROM (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY hop <= 1, md5(concat_ws(',', batch, id, 6))) AS k, count(*) OVER (PARTITION BY batch) AS n FROM sn WHERE hop > 0) WHERE k > floor(n * {share}::DOUBLE) UNION ALL SELECT batch, hop, id FROM sn WHERE hop = 0"


def _layers(n: int) -> str:
    """per(batch, layers, id, s) for 2 to n layers over sn and se."""
    out = [" sd AS MATERIALIZED (SELECT batch, dst AS id, count(*)::DOUBLE AS deg FROM se GROUP BY batch, dst), k0 AS (SELECT batch, id, 1.0::DOUBLE AS s FROM sn WHERE hop = 0)"]
    for i in range(n):
        out.append(f" k{i + 1} AS MATERIALIZED (SELECT se.batch, se.src AS id, sum(k.s / sd.deg) AS s FROM k{i} k JOIN sd ON sd.batch = k.batch AND sd.id = k.id JOIN se ON se.batch = k.batch AND se.dst = k.id GROUP BY se.batch, se.src)")
    steps = " UNION ALL ".join(f"SELECT {layers} AS layers, batch, id, s FROM k{i}" for layers in range(2, n + 1) for i in range(1, layers + 1))
    out.append(f" per AS MATERIALIZED (SELECT layers, batch, id, sum(s) AS s FROM ({steps}) GROUP BY 1, 2, 3)")
    return ",".join(out)


#: Three rounds of handshakes: mates(id, mate).
_MATES = ",".join(
    [" t0 AS (SELECT CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS mate WHERE false)"]
    + [
        f""" n{r} AS MATERIALIZED (SELECT src AS id, arg_max(dst, md5(concat_ws(',', least(src, dst), greatest(src, dst), {r}, 0))) AS too FROM edges
  ANTI JOIN t{r} a ON a.id = src ANTI JOIN t{r} b ON b.id = dst WHERE src <> dst GROUP BY src),
 t{r + 1} AS MATERIALIZED (SELECT * FROM t{r} UNION ALL SELECT a.id, a.too FROM n{r} a JOIN n{r} b ON b.id = a.too AND b.too = a.id)"""
        for r in range(3)
    ]
)


def _pushes(steps: int) -> str:
    """p<steps>(seed, id, p, r, due): so many supersteps of pushing, more than there is anything left to push."""
    out = [" p0 AS (SELECT t.id AS seed, t.id, CAST(0 AS BIGINT) AS p, CAST(250000000000000 AS BIGINT) AS r, d.deg, true AS due FROM train t JOIN indeg d ON d.id = t.id)"]
    for k in range(steps):
        out.append(
            f""" p{k + 1} AS MATERIALIZED (
  SELECT g.seed, g.id, p, r, d.deg, r > 0 AND r >= 0.25::DOUBLE * 1e-4::DOUBLE * 1e15::DOUBLE * d.deg AS due FROM (
    SELECT seed, id, CAST(sum(p) AS BIGINT) AS p, CAST(sum(r) AS BIGINT) AS r FROM (
      SELECT seed, id, CASE WHEN due THEN p + r ELSE p END AS p, CASE WHEN due THEN 0 ELSE r END AS r FROM p{k}
      UNION ALL SELECT seed, e.dst, 0, CAST(floor(0.75::DOUBLE * r / deg) AS BIGINT) FROM p{k} JOIN edges e ON e.src = p{k}.id WHERE due) GROUP BY seed, id) g JOIN indeg d ON d.id = g.id)"""
        )
    return ",".join(out)


_PUSH = _pushes(9)


def _r9(x: str, step: str = "1e9") -> str:
    """x in steps of 1e-13 and these in steps of 1e-9, as the queries have it: what the order of sums changes does not reach a tie."""
    return f"floor(floor(({x}) * 1e13::DOUBLE + 0.5::DOUBLE) / 1e13::DOUBLE * {step}::DOUBLE + 0.5::DOUBLE) / {step}::DOUBLE"


def _q(body: str, *more: str) -> str:
    return "WITH " + ",".join((_GRAPH, *more)) + body


SQL: dict[str, str] = {
    "graph_nodes": _q("SELECT id, kind, label, split FROM nodes"),
    "graph_edges_symmetric": _q("SELECT src, dst FROM edges"),
    "graph_edges_selfloop": _q("SELECT src, dst FROM edges UNION SELECT id, id FROM nodes"),
    "graph_edges_multiset": _q("SELECT u AS src, v AS dst FROM raw UNION ALL SELECT v, u FROM raw"),
    "hetero_homogenize": """
WITH z AS (SELECT (SELECT count(*) FROM supplier) AS s, (SELECT count(*) FROM nation) AS n, (SELECT count(*) FROM part) AS p),
r AS (
  SELECT l_suppkey AS src, l_partkey + s + n AS dst FROM lineitem, z
  UNION ALL SELECT s_suppkey, s_nationkey + s FROM supplier, z
  UNION ALL SELECT c_custkey + s + n + p, c_nationkey + s FROM customer, z
) SELECT src, dst FROM r UNION ALL SELECT dst, src FROM r""",
    "split_counts": _q("SELECT split, count(*) AS n FROM nodes WHERE split IS NOT NULL GROUP BY split"),
    "split_ids_train": _q("SELECT id FROM train"),
    "split_resampled": _q("SELECT id, CASE WHEN h < 20 THEN 'train' WHEN h < 60 THEN 'valid' ELSE 'test' END AS split FROM (SELECT id, ((id % 2147483648) * 2654435761) % 4294967296 // 65536 % 100 AS h FROM nodes)"),
    "split_sequential": _q("SELECT id, CASE WHEN id < CAST(floor(n * 0.6::DOUBLE) AS BIGINT) THEN 'train' WHEN id < CAST(floor(n * 0.8::DOUBLE) AS BIGINT) THEN 'valid' WHEN id < n THEN 'test' END AS split FROM nodes CROSS JOIN nc"),
    "features_lookup": _q("SELECT id, round(CAST(x[1] AS DOUBLE), 6) + 0.0::DOUBLE AS x0, round(list_sum(list_transform(x, lambda v: CAST(v AS DOUBLE))), 6) + 0.0::DOUBLE AS total FROM feat"),
    "degree": _q("SELECT id, deg FROM indeg"),
    "degree_histogram": _q("SELECT deg, count(*) AS n FROM indeg GROUP BY deg"),
    "degree_order": _q("SELECT id, deg, row_number() OVER (ORDER BY deg DESC, id) - 1 AS pos FROM indeg"),
    "csc_rowptr": _q("SELECT id, CAST(sum(deg) OVER (ORDER BY id) - deg AS BIGINT) AS start, deg AS len FROM indeg"),
    "csr_rowptr": _q("SELECT id, CAST(sum(d) OVER (ORDER BY id) - d AS BIGINT) AS start, d AS len FROM (SELECT n.id, count(e.dst) AS d FROM nodes n LEFT JOIN edges e ON e.src = n.id GROUP BY n.id)"),
    "csc_neighbors_str": _q("SELECT dst, string_agg(CAST(src AS VARCHAR), ',' ORDER BY src) AS nbrs FROM edges GROUP BY dst"),
    "degree_ratio_export": _q("SELECT coalesce(o.id, i.id) AS id, round((coalesce(o.d, 0) + 1e-8::DOUBLE) / (coalesce(i.d, 0) + 1e-8::DOUBLE), 9) AS score FROM (SELECT src AS id, count(*) AS d FROM edges GROUP BY src) o FULL JOIN (SELECT dst AS id, count(*) AS d FROM edges GROUP BY dst) i ON o.id = i.id"),
    "split_masks_export": _q("SELECT id, coalesce(split = 'train', false) AS train_mask, coalesce(split = 'valid', false) AS valid_mask, coalesce(split = 'test', false) AS test_mask FROM nodes"),
    "index_mask": _q("SELECT id, coalesce(split = 'train', false) AS mask FROM nodes"),
    "mask_index": _q("SELECT id FROM nodes WHERE split = 'train'"),
    "part_hash": _q("SELECT id, part FROM assign"),
    "part_sizes": _q("SELECT part, n FROM psize"),
    "part_size_stats": _q("SELECT round(avg(n), 6) AS mean, min(n) AS least, max(n) AS most FROM psize"),
    "train_per_part": _q("SELECT i.part, count(t.id) AS n FROM ids16 i LEFT JOIN (SELECT a.* FROM assign a SEMI JOIN train t ON a.id = t.id) t ON t.part = i.part GROUP BY i.part"),
    "part_offsets": _q('SELECT part, s AS start, e AS "end" FROM parts'),
    "scatter_positions": _q("SELECT old_id AS id, part, new_id FROM node_map"),
    "node_map_inverse": _q("SELECT new_id, old_id, part FROM node_map"),
    "relabelled_edges": _q("SELECT src, dst, sp, dp, block FROM ep"),
    "edge_blocks": _q("SELECT b.block, count(ep.src) AS n FROM (SELECT CAST(range AS INTEGER) AS block FROM range(256)) b LEFT JOIN ep ON ep.block = b.block GROUP BY b.block"),
    "block_offsets": _q('SELECT block, CAST(sum(n) OVER (ORDER BY block) - n AS BIGINT) AS start, CAST(sum(n) OVER (ORDER BY block) AS BIGINT) AS "end" FROM (SELECT b.block, count(ep.src) AS n FROM (SELECT CAST(range AS INTEGER) AS block FROM range(256)) b LEFT JOIN ep ON ep.block = b.block GROUP BY b.block)'),
    "intervals": _q("SELECT part, s AS lo, e AS hi FROM parts"),
    "complement_runs": _q("SELECT CAST(min(part) AS BIGINT) AS lo, CAST(max(part) AS BIGINT) AS hi FROM (SELECT part, part - row_number() OVER (ORDER BY part) AS g FROM ids16 WHERE part NOT IN (SELECT part FROM (SELECT part, row_number() OVER (ORDER BY n DESC, part) AS k FROM psize) WHERE k <= 6)) GROUP BY g"),
    "block_pairs": _q("SELECT CAST((a.k - 1) * 3 + b.k - 1 AS INTEGER) AS pos, CAST(a.part * 16 + b.part AS INTEGER) AS block FROM big a CROSS JOIN big b", " big AS (SELECT * FROM (SELECT part, row_number() OVER (ORDER BY n DESC, part) AS k FROM psize) WHERE k <= 3)"),
    "composite_keys": _q("SELECT src, dst, CAST(src * (SELECT count(*) FROM nodes) + dst AS BIGINT) AS key FROM edges"),
    "ranges_gather_nodes": _q("SELECT CAST(base + new_id - s AS BIGINT) AS out_pos, new_id, old_id FROM node_map m JOIN bases b ON b.part = m.part"),
    "ranges_add_shift": _q("SELECT new_id, CAST(new_id + coalesce((b.seq + 1) * 1000, 0) AS BIGINT) AS v FROM node_map m LEFT JOIN batch b ON b.part = m.part"),
    "coo_merge_degree": _q("SELECT dst, count(*) AS n, string_agg(CAST(src AS VARCHAR), ',' ORDER BY src) AS nbrs FROM (SELECT src, dst FROM edges UNION ALL SELECT src, dst FROM edges WHERE src % 3 = 0) GROUP BY dst"),
    "row_slice_edges": _q("SELECT src, dst FROM edges WHERE dst IN (SELECT id FROM train)"),
    "edges_sorted": _q("SELECT src, dst, row_number() OVER (ORDER BY dst, src) - 1 AS pos FROM edges"),
    "edge_cuts": _q("SELECT CAST(sum(CASE WHEN sp <> dp THEN 1 ELSE 0 END) AS BIGINT) AS cuts, count(*) AS edges FROM ep"),
    "weighted_edge_cuts": _q("SELECT round(CAST(sum(CASE WHEN a.part <> b.part THEN 1 + (src + dst) % 5 ELSE 0 END) AS DOUBLE), 6) AS cuts, round(CAST(sum(1 + (src + dst) % 5) AS DOUBLE), 6) AS edges FROM edges JOIN assign a ON a.id = src JOIN assign b ON b.id = dst"),
    "cut_matrix": _q("SELECT dp, sp, count(*) AS n FROM ep GROUP BY dp, sp"),
    "train_cut_matrix": _q("SELECT b.part AS dp, a.part AS sp, count(*) AS n FROM edges JOIN assign a ON a.id = src JOIN assign b ON b.id = dst WHERE src IN (SELECT id FROM train) GROUP BY 1, 2"),
    "cut_flags": _q("SELECT src, dst, a.part <> b.part AND pop.id IS NULL AS cut FROM edges JOIN assign a ON a.id = src JOIN assign b ON b.id = dst LEFT JOIN pop ON pop.id = src", " pop AS MATERIALIZED (SELECT id FROM popular)"),
    "load_ratio": _q("SELECT floor(max(n * 16 / t) * 1000) / 1000 AS most, floor(stddev_samp(n * 16 / t) * 1000) / 1000 AS spread FROM (SELECT n, sum(n) OVER () AS t FROM psize)"),
    "label_load_ratio": _q("SELECT label, floor(max(r) * 1000) / 1000 AS most, floor(stddev_samp(r) * 1000) / 1000 AS spread FROM (SELECT l.label, count(n.id) * 16 / sum(count(n.id)) OVER (PARTITION BY l.label) AS r FROM (SELECT DISTINCT label FROM nodes WHERE label IS NOT NULL) l CROSS JOIN ids16 i LEFT JOIN (SELECT nodes.id, label, part FROM nodes JOIN assign ON assign.id = nodes.id) n ON n.label = l.label AND n.part = i.part GROUP BY l.label, i.part) GROUP BY label"),
    "label_hist": _q("SELECT CAST(c.range AS INTEGER) AS class, round(count(n.id) / sum(count(n.id)) OVER (), 9) AS mass FROM range(5) c LEFT JOIN nodes n ON n.label = c.range GROUP BY c.range"),
    "label_emd_per_batch": _q("SELECT batch, round(d, 9) AS distance FROM emd", _LABELS),
    "label_kl_per_batch": _q("SELECT b.batch, round(sum((t.mass + 1e-9::DOUBLE) * (ln(t.mass + 1e-9::DOUBLE) - ln(b.mass + 1e-9::DOUBLE))) / 5, 9) AS kl FROM bl b JOIN tl t ON t.class = b.class GROUP BY b.batch", _LABELS),
    "distance_summary": _q("SELECT round(avg(d), 9) AS mean, round(stddev_samp(d), 9) AS std FROM emd", _LABELS),
    "simulated_distance": _q(
        "SELECT round(avg(d), 9) AS mean, round(stddev_samp(d), 9) AS std FROM sd",
        _LABELS,
        """ hi AS MATERIALIZED (SELECT class, sum(mass) OVER (ORDER BY class) AS hi FROM tl),
dr AS MATERIALIZED (SELECT i // 100 AS batch, coalesce((SELECT min(class) FROM hi WHERE (((i % 2147483648) * 2654435761) % 4294967296) / 4294967296.0::DOUBLE < hi.hi AND class < 4), 4) AS label FROM (SELECT range AS i FROM range((SELECT CAST(count(*) * 10 AS BIGINT) FROM train)))),
db AS (SELECT b.batch, c.class, count(dr.label) / sum(count(dr.label)) OVER (PARTITION BY b.batch) AS mass FROM (SELECT DISTINCT batch FROM dr) b CROSS JOIN cls c LEFT JOIN dr ON dr.batch = b.batch AND dr.label = c.class GROUP BY b.batch, c.class),
sd AS (SELECT a.batch, avg(abs(a.mass - b.mass)) AS d FROM (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY mass) AS k FROM db) a JOIN (SELECT *, row_number() OVER (ORDER BY mass) AS k FROM tl) b ON a.k = b.k GROUP BY a.batch)""",
    ),
    "distinct_ends": _q("SELECT count(DISTINCT src) AS src, count(DISTINCT dst) AS dst, count(*) AS nnz FROM edges"),
    "lazy_rw_k1": _q(f"SELECT id, {_r9('s')} AS s FROM w1"),
    "lazy_rw_k3": _q(f"SELECT id, {_r9('s')} AS s FROM w3"),
    "node_importance_k0": _q(f"SELECT id, {_r9('s / n')} AS s FROM w0 CROSS JOIN nt"),
    "node_importance_k1": _q(f"SELECT id, {_r9('s')} AS s FROM imp1"),
    "node_importance_k2": _q(f"SELECT id, {_r9('s')} AS s FROM imp2"),
    "edge_importance_k3": _q(f"SELECT e.src, e.dst, {_r9('a.s * 0.5::DOUBLE / c.deg + b.s * 0.5::DOUBLE / d.deg')} AS w FROM edges e JOIN imp2 a ON a.id = e.src JOIN imp2 b ON b.id = e.dst JOIN deg1 c ON c.id = e.src JOIN deg1 d ON d.id = e.dst"),
    "walk_sum_influence": _q(f"SELECT w1.id, {_r9('w1.s + w2.s')} AS s FROM w1 JOIN w2 ON w1.id = w2.id"),
    "pivots_topk": _q(f"SELECT id, {_r9('s')} AS s FROM pvt"),
    "popular_nodes": _q("SELECT id FROM popular"),
    "pivot_inter_edges": _q("SELECT src, dst FROM edges WHERE dst IN (SELECT id FROM pvt)"),
    "pivot_intra_edges": _q("SELECT src, dst FROM edges WHERE dst IN (SELECT id FROM pvt) AND src IN (SELECT id FROM pvt)"),
    "seed_topk_influence": _q(f"SELECT seed, id, {_r9('s', '1e11')} AS s, CAST(rank AS INTEGER) AS rank FROM inf", _INFLUENCE),
    "coverage": _q(
        f"""
SELECT h.part, {_r9('coalesce(g.got, 0) / h.n')} AS covered, {_r9('coalesce(b.best, 0) / h.n')} AS best
FROM (SELECT a.part, count(*) AS n FROM train t JOIN assign a ON a.id = t.id GROUP BY a.part) h
LEFT JOIN (SELECT home.part, sum(CASE WHEN there.part = home.part OR i.id IN (SELECT id FROM pvt) THEN i.s ELSE 0 END) AS got FROM inf i JOIN assign home ON home.id = i.seed JOIN assign there ON there.id = i.id GROUP BY home.part) g ON g.part = h.part
LEFT JOIN (SELECT part, sum(s) AS best FROM (SELECT a.part, i.id, sum(i.s) AS s, row_number() OVER (PARTITION BY a.part ORDER BY round(sum(i.s), 12) DESC, i.id) AS k FROM inf i JOIN assign a ON a.id = i.seed GROUP BY a.part, i.id) x JOIN psize USING (part) WHERE k <= n GROUP BY part) b ON b.part = h.part""",
        _INFLUENCE,
    ),
    "revisit_probability": _q(f"SELECT id, {_r9('r')} AS r FROM revisit"),
    "collate_nodes": _q("SELECT 0 AS batch, CAST(base + new_id - s AS BIGINT) AS local_id, new_id, old_id, label FROM node_map m JOIN bases b ON b.part = m.part JOIN nodes ON nodes.id = old_id"),
    "collate_targets": _q("SELECT 0 AS batch, CAST(base + new_id - s AS BIGINT) AS local_id FROM node_map m JOIN bases b ON b.part = m.part WHERE old_id IN (SELECT id FROM train)"),
    "collate_edges": _q("SELECT 0 AS batch, CAST(src - a.s + a.base AS BIGINT) AS src, CAST(dst - b.s + b.base AS BIGINT) AS dst FROM ep JOIN bases a ON a.part = sp JOIN bases b ON b.part = dp"),
    "pivot_tables": _q("SELECT pvt, old_id, part FROM pv", _PIVOTS),
    "collate_pivot_nodes": _q(
        """
SELECT 0 AS batch, CAST(lid AS BIGINT) AS local_id, old_id, label, coalesce(split = 'train', false) AS is_target FROM main JOIN nodes ON nodes.id = old_id
UNION ALL SELECT 0, CAST(nm.n + pvt AS BIGINT), old_id, 0, false FROM pv CROSS JOIN nm""",
        _PIVOTS,
    ),
    "collate_pivot_edges": _q(
        """
SELECT 0 AS batch, CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst FROM (
  SELECT a.lid AS src, b.lid AS dst FROM edges e JOIN main a ON a.old_id = e.src JOIN main b ON b.old_id = e.dst
  UNION ALL SELECT a.lid, nm.n + p.pvt FROM edges e JOIN main a ON a.old_id = e.src JOIN pv p ON p.old_id = e.dst CROSS JOIN nm WHERE p.part NOT IN (SELECT part FROM batch)
  UNION ALL SELECT nm.n + p.pvt, a.lid FROM edges e JOIN main a ON a.old_id = e.src JOIN pv p ON p.old_id = e.dst CROSS JOIN nm WHERE p.part NOT IN (SELECT part FROM batch)
  UNION ALL SELECT nm.n + p.pvt, nm.n + q.pvt FROM edges e JOIN pv p ON p.old_id = e.src JOIN pv q ON q.old_id = e.dst CROSS JOIN nm WHERE p.part NOT IN (SELECT part FROM batch)
)""",
        _PIVOTS,
    ),
    "layout_check": """SELECT * FROM (VALUES ('new id outside its part', CAST(0 AS BIGINT)), ('new id used twice', 0), ('id out of range', 0), ('part differs from the assignment', 0), ('block differs from its parts', 0), ('edge lost or changed', 0)) t("check", bad)""",
    "cluster_batch_nodes": _q("SELECT n.id, CASE WHEN split = 'train' THEN 'train' ELSE 'helper' END AS role FROM nodes n JOIN assign a ON a.id = n.id WHERE part IN (SELECT part FROM batch) UNION ALL SELECT p.id, 'cache' FROM popular5 p JOIN assign a ON a.id = p.id WHERE part NOT IN (SELECT part FROM batch)"),
    "cluster_batch_edges": _q("SELECT src, dst FROM edges SEMI JOIN c a ON a.id = src SEMI JOIN c b ON b.id = dst", " c AS MATERIALIZED (SELECT assign.id FROM assign SEMI JOIN batch ON batch.part = assign.part UNION SELECT id FROM popular5)"),
    "cached_batch_edges": _q(
        "SELECT a.lid AS src, b.lid AS dst FROM ep JOIN l a ON a.new_id = src JOIN l b ON b.new_id = dst",
        """ hot AS MATERIALIZED (SELECT id FROM popular5), nmap AS MATERIALIZED (SELECT * FROM node_map),
l AS MATERIALIZED (SELECT new_id, row_number() OVER (ORDER BY side, new_id) - 1 AS lid FROM (
  SELECT new_id, 0 AS side FROM nmap SEMI JOIN hot ON hot.id = old_id
  UNION ALL SELECT new_id, 1 FROM nmap SEMI JOIN batch ON batch.part = nmap.part ANTI JOIN hot ON hot.id = old_id))""",
    ),
    "epoch_part_batches": _q(
        f"SELECT CAST({_chunk('seq', 'm', '5')} AS BIGINT) AS batch, q.part, seq, t.n FROM q JOIN t ON t.part = q.part",
        " q AS (SELECT CAST(range AS INTEGER) AS part, row_number() OVER (ORDER BY md5(concat_ws(',', range, 1, 9))) - 1 AS seq, 16 AS m FROM range(16)), t AS (SELECT i.part, count(t.id) AS n FROM ids16 i LEFT JOIN (SELECT a.* FROM assign a SEMI JOIN train t ON a.id = t.id) t ON t.part = i.part GROUP BY i.part)",
    ),
    "epoch_collate_edges": _q(
        """
SELECT a.batch, count(*) AS n, CAST(sum(src - a.s + a.base) AS BIGINT) AS src, CAST(sum(dst - b.s + b.base) AS BIGINT) AS dst
FROM ep JOIN eb a ON a.part = sp JOIN eb b ON b.part = dp AND a.batch = b.batch GROUP BY a.batch""",
        f""" eq AS (SELECT CAST(range AS INTEGER) AS part, row_number() OVER (ORDER BY md5(concat_ws(',', range, 1, 9))) - 1 AS seq, 16 AS n FROM range(16)),
ez AS (SELECT part, seq, CAST({_chunk("seq", "n", "5")} AS BIGINT) AS batch FROM eq),
eb AS (SELECT ez.part, batch, p.s, coalesce(sum(p.e - p.s) OVER (PARTITION BY batch ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM ez JOIN parts p ON p.part = ez.part)""",
    ),
    "partition_loader_nodes": _q(
        "SELECT ez.batch, count(*) AS n, count(*) FILTER (n.split = 'train') AS targets, count(*) - 1 AS last FROM ez JOIN assign a ON a.part = ez.part JOIN nodes n ON n.id = a.id GROUP BY ez.batch",
        f""" eq AS (SELECT CAST(range AS INTEGER) AS part, row_number() OVER (ORDER BY md5(concat_ws(',', range, 1, 9))) - 1 AS seq, 16 AS n FROM range(16)),
ez AS (SELECT part, seq, CAST({_chunk("seq", "n", "5")} AS BIGINT) AS batch FROM eq)""",
    ),
    "node_loader_edges": _q("SELECT CAST(batch AS BIGINT) AS batch, hop, src, dst FROM se", _SEEDS, _HOPS.format(edges="edges", seed=3)),
    "hier_loader_edges": _q(
        "SELECT batch // 4294967296 AS superblock, batch % 4294967296 AS batch, hop, src, dst FROM se",
        _SUPER.format(source="assign"),
        " hs AS (SELECT so.superblock, a.id, row_number() OVER (PARTITION BY so.superblock ORDER BY md5(concat_ws(',', a.id, 1, 2))) - 1 AS pos, count(*) OVER (PARTITION BY so.superblock) AS n FROM assign a SEMI JOIN train t ON a.id = t.id JOIN so ON so.part = a.part)",
        f" gb AS (SELECT superblock * 4294967296 + CAST({_chunk('pos', 'n', '50')} AS BIGINT) AS batch, id FROM hs)",
        " ie AS (SELECT src, dst FROM edges JOIN assign a ON a.id = src JOIN assign b ON b.id = dst JOIN so x ON x.part = a.part JOIN so y ON y.part = b.part AND x.superblock = y.superblock)",
        _HOPS.format(edges="ie", seed=2),
    ),
    "shuffled_seeds": _q("SELECT id, row_number() OVER (ORDER BY md5(concat_ws(',', id, 2, 5))) - 1 AS pos FROM train"),
    "split_chunks": _q("SELECT id, pos, CASE WHEN pos // 64 = n // 64 AND n % 64 < 32 THEN NULL ELSE pos // 64 END AS chunk FROM (SELECT id, row_number() OVER (ORDER BY md5(concat_ws(',', id, 2, 5))) - 1 AS pos, count(*) OVER () AS n FROM train)"),
    "chained_chunks": _q("""SELECT a.id, b.id AS other, a.pos, a.pos // 64 AS chunk, CAST(r.range AS INTEGER) AS "repeat"
        FROM (SELECT id, row_number() OVER (ORDER BY md5(concat_ws(',', id, 2, 5))) - 1 AS pos, count(*) OVER () AS n FROM train) a
        JOIN (SELECT id, row_number() OVER (ORDER BY md5(concat_ws(',', id, 2, 5))) - 1 AS pos FROM nodes WHERE split = 'valid') b ON a.pos = b.pos
        CROSS JOIN range(2) r WHERE NOT (a.pos // 64 = a.n // 64 AND a.n % 64 < 32)"""),
    "even_split_chunks": _q(f"SELECT id, pos, CAST({_chunk('pos', 'n', '64')} AS BIGINT) AS chunk FROM (SELECT id, row_number() OVER (ORDER BY md5(concat_ws(',', id, 2, 5))) - 1 AS pos, count(*) OVER () AS n FROM train)"),
    "tensor_batch_chunks": _q("SELECT id, pos, pos // 50 AS chunk, CASE WHEN pos // 50 = (n - 1) // 50 AND n % 50 <> 0 THEN NULL ELSE pos // 50 END AS dropped, CASE WHEN pos // 50 = (n - 1) // 50 THEN NULL ELSE pos // 50 END AS quirk FROM (SELECT id, row_number() OVER (ORDER BY md5(concat_ws(',', id, 2, 5))) - 1 AS pos, count(*) OVER () AS n FROM train)"),
    "repeat_targets": _q('SELECT id, CAST(r.range AS INTEGER) AS "repeat" FROM train CROSS JOIN range(3) r'),
    "zip_positions": _q("SELECT a.pos, a.id AS a, b.id AS b FROM (SELECT id, row_number() OVER (ORDER BY md5(concat_ws(',', id, 0, 1))) - 1 AS pos FROM train) a JOIN (SELECT id, row_number() OVER (ORDER BY md5(concat_ws(',', id, 0, 1))) - 1 AS pos FROM nodes WHERE split = 'valid') b ON a.pos = b.pos"),
    "batch_unbatch": _q('SELECT pos // 32 AS batch, CAST(pos % 32 AS INTEGER) AS "at", id FROM (SELECT id, row_number() OVER (ORDER BY md5(concat_ws(\',\', id, 2, 5))) - 1 AS pos, count(*) OVER () AS n FROM train) WHERE pos // 32 < n // 32'),
    "flatmap_copies": _q("SELECT n.id, n.label, r.range AS m FROM nodes n JOIN range(3) r ON r.range <= n.id % 3 WHERE kind = 0"),
    "global_batches": _q("SELECT CAST(batch AS BIGINT) AS batch, pos, id FROM gb", _SEEDS),
    "hier_batches": _q(
        f"SELECT superblock, CAST({_chunk('pos', 'n', '50')} AS BIGINT) AS batch, pos, id FROM h",
        _SUPER.format(source="(SELECT a.part FROM assign a SEMI JOIN train t ON a.id = t.id)"),
        " h AS (SELECT so.superblock, a.id, row_number() OVER (PARTITION BY so.superblock ORDER BY md5(concat_ws(',', a.id, 1, 2))) - 1 AS pos, count(*) OVER (PARTITION BY so.superblock) AS n FROM assign a SEMI JOIN train t ON a.id = t.id JOIN so ON so.part = a.part)",
    ),
    "hier_subgraph": _q(
        "SELECT x.superblock, count(*) AS n, CAST(sum(src) AS BIGINT) AS src, CAST(sum(dst) AS BIGINT) AS dst FROM edges JOIN assign a ON a.id = src JOIN assign b ON b.id = dst JOIN so x ON x.part = a.part JOIN so y ON y.part = b.part AND x.superblock = y.superblock GROUP BY x.superblock",
        _SUPER.format(source="assign"),
    ),
    "training_blocks": _q("SELECT a.id, a.part AS block, row_number() OVER (ORDER BY a.part, a.id) - 1 AS pos FROM assign a SEMI JOIN train t ON a.id = t.id"),
    "sample_hop1": _q("SELECT CAST(batch AS BIGINT) AS batch, 0 AS hop, src, dst FROM f1", _SAMPLE),
    "sample_hop2": _q("SELECT CAST(batch AS BIGINT) AS batch, hop, src, dst FROM se", _SAMPLE),
    "sample_nodes": _q("SELECT CAST(batch AS BIGINT) AS batch, hop, id FROM sn", _SAMPLE),
    "mfg_hop_counts": _q("SELECT CAST(n.batch AS BIGINT) AS batch, n.hop, n.c AS nodes, coalesce(e.c, 0) AS edges FROM (SELECT batch, hop, count(*) AS c FROM sn GROUP BY 1, 2) n LEFT JOIN (SELECT batch, hop + 1 AS hop, count(*) AS c FROM se GROUP BY 1, 2) e ON e.batch = n.batch AND e.hop = n.hop", _SAMPLE),
    "mfg_trimmed": _q("SELECT CAST(batch AS BIGINT) AS batch, hop, count(*) AS n FROM se WHERE hop < 1 GROUP BY 1, 2", _SAMPLE),
    "mfg_features_sum": _q("SELECT CAST(batch AS BIGINT) AS batch, count(*) AS n, round(sum(CAST(x[1] AS DOUBLE)), 6) + 0.0::DOUBLE AS total FROM sn JOIN feat ON feat.id = sn.id GROUP BY batch", _SAMPLE),
    "drop_random_alive": _q("SELECT CAST(batch AS BIGINT) AS batch, hop, id FROM (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY md5(concat_ws(',', batch, id, 4))) AS k, count(*) OVER (PARTITION BY batch) AS n FROM sn WHERE hop > 0) WHERE k > floor(n * 0.3::DOUBLE) UNION ALL SELECT batch, hop, id FROM sn WHERE hop = 0", _SAMPLE),
    "drop_influence_alive": _q("SELECT CAST(batch AS BIGINT) AS batch, hop, id FROM (SELECT sn.*, row_number() OVER (PARTITION BY batch ORDER BY deg, sn.id DESC) AS k, count(*) OVER (PARTITION BY batch) AS n FROM sn JOIN indeg ON indeg.id = sn.id WHERE hop > 0) WHERE k > floor(n * 0.3::DOUBLE) UNION ALL SELECT batch, hop, id FROM sn WHERE hop = 0", _SAMPLE),
    "drop_hop_alive": _q("SELECT CAST(batch AS BIGINT) AS batch, hop, id FROM sn WHERE hop <= 1", _SAMPLE),
    "lossy_edges": _q("SELECT CAST(e.batch AS BIGINT) AS batch, e.hop, e.src, e.dst FROM se e SEMI JOIN (SELECT * FROM sn WHERE hop <= 1) a ON a.batch = e.batch AND a.id = e.src SEMI JOIN (SELECT * FROM sn WHERE hop <= 1) b ON b.batch = e.batch AND b.id = e.dst", _SAMPLE),
    "batch_influence": _q(
        f"SELECT id, {_r9('sum(s)')} AS s FROM (SELECT id, s FROM b0 UNION ALL SELECT id, s FROM b1 UNION ALL SELECT id, s FROM b2) GROUP BY id",
        _SAMPLE,
        """ bk AS (SELECT DISTINCT dst AS src, src AS dst FROM se), bd AS (SELECT src AS id, count(*)::DOUBLE AS deg FROM bk GROUP BY src),
b0 AS (SELECT id, CASE WHEN id IN (SELECT id FROM train) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS s FROM (SELECT src AS id FROM bk UNION SELECT dst FROM bk UNION SELECT id FROM train)),
b1 AS (SELECT bk.dst AS id, sum(b0.s / bd.deg) AS s FROM bk JOIN b0 ON b0.id = bk.src JOIN bd ON bd.id = bk.src GROUP BY bk.dst),
b2 AS (SELECT bk.dst AS id, sum(b1.s / bd.deg) AS s FROM bk JOIN b1 ON b1.id = bk.src JOIN bd ON bd.id = bk.src GROUP BY bk.dst)""",
    ),
    "neighbor_sum": _q("SELECT id, CAST(pos - 1 AS INTEGER) AS pos, round(sum(v), 6) + 0.0::DOUBLE AS v FROM ex GROUP BY id, pos", " ex AS (SELECT e.dst AS id, unnest(range(1, 65)) AS pos, unnest(list_transform(x, lambda v: CAST(v AS DOUBLE))) AS v FROM edges e JOIN feat f ON f.id = e.src)"),
    "neighbor_mean": _q("SELECT id, CAST(pos - 1 AS INTEGER) AS pos, round(avg(v), 6) + 0.0::DOUBLE AS v FROM ex GROUP BY id, pos", " ex AS (SELECT e.dst AS id, unnest(range(1, 65)) AS pos, unnest(list_transform(x, lambda v: CAST(v AS DOUBLE))) AS v FROM edges e JOIN feat f ON f.id = e.src)"),
    "edge_norm_weight": _q("SELECT src, dst, round(w * count(*) OVER (PARTITION BY dst) / sum(w) OVER (PARTITION BY dst), 9) AS w FROM (SELECT src, dst, CASE WHEN a.part <> b.part THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM edges JOIN assign a ON a.id = src JOIN assign b ON b.id = dst)"),
    "attention_softmax": _q(f"SELECT src, dst, {_r9('exp(e) / sum(exp(e)) OVER (PARTITION BY dst)')} AS a FROM (SELECT src, dst, ((src * 7 + dst * 3) % 11) / 5.0::DOUBLE AS e FROM edges)"),
    "scatter_add_labels": _q("SELECT e.dst AS id, CAST(sum(coalesce(n.label, 0)) AS BIGINT) AS total FROM edges e JOIN nodes n ON n.id = e.src GROUP BY e.dst"),
    "acc_per_epoch": "SELECT CAST(o_orderkey % 10 AS INTEGER) AS epoch, round(sum(o_totalprice / 1000 * 32) / (count(*) * 32), 6) AS loss, round(sum(o_orderkey % 32) / (count(*) * 32), 6) AS acc, round(avg(o_custkey % 500), 6) AS nodes, round(avg(o_custkey % 2000), 6) AS edges FROM orders GROUP BY 1",
    "eval_full": _q("SELECT split, count(*) AS n, round(avg(CASE WHEN guess = label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS acc, round(avg(nll), 9) AS nll FROM (SELECT split, label, (SELECT arg_min(k.range, ((id * 13 + k.range * 7) % 17) * 100 + k.range) FROM range(5) k) AS guess, ((id * 13 + label * 7) % 17) / 4.0::DOUBLE AS nll FROM nodes WHERE label IS NOT NULL AND split IS NOT NULL) GROUP BY split"),
    "best_epoch": f"WITH {_RUNS} SELECT run, iter, round(val, 9) AS val, round(test, 9) AS test FROM be",
    "run_stdmean": f"WITH {_RUNS} SELECT round(avg(val * 100), 6) AS val_mean, round(stddev_samp(val * 100), 6) AS val_std, round(avg(test * 100), 6) AS test_mean, round(stddev_samp(test * 100), 6) AS test_std FROM be",
    "acc_curve": f"WITH {_RUNS} SELECT iter, round(avg(val), 9) AS mean, round(stddev_samp(val), 9) AS std, count(*) AS runs FROM rl GROUP BY iter",
    "log_select": """SELECT CAST(o_custkey % 60 AS INTEGER) AS run, CAST(CAST(max(o_orderdate) AS DATE) AS VARCHAR) AS day FROM orders WHERE o_custkey % 60 % 4 = 1 AND o_custkey % 60 % 3 = 2 AND o_custkey % 5 <> 0 GROUP BY 1 HAVING max(o_orderdate) < TIMESTAMP '2001-07-30'""",
    "sample_replace_edges": _q("SELECT CAST(batch AS BIGINT) AS batch, hop, src, dst, eid, count(*) AS n FROM (SELECT batch, 0 AS hop, src, dst, eid FROM r1 UNION ALL SELECT batch, 1, src, dst, eid FROM r2) GROUP BY ALL", _SEEDS, _DRAWS),
    "sample_edge_ids": _q("SELECT CAST(batch AS BIGINT) AS batch, hop, se.src, se.dst, eid FROM se JOIN el ON el.src = se.src AND el.dst = se.dst", _SAMPLE, " el AS (SELECT src, dst, row_number() OVER (ORDER BY dst, src) - 1 AS eid FROM edges)"),
    "sample_undirected": _q("SELECT CAST(a.batch AS BIGINT) AS batch, count(*) AS n, CAST(sum(src) AS BIGINT) AS src, CAST(sum(dst) AS BIGINT) AS dst FROM edges JOIN sn a ON a.id = src JOIN sn b ON b.id = dst AND b.batch = a.batch GROUP BY a.batch", _SAMPLE),
    "drop_hop_share_alive": _q(_dropped("0.5"), _SAMPLE),
    "drop_hop_near_alive": _q(_dropped("0.9"), _SAMPLE),
    "drop_seed_influence_alive": _q(
        """SELECT CAST(batch AS BIGINT) AS batch, hop, id FROM (
  SELECT sn.*, row_number() OVER (PARTITION BY sn.batch ORDER BY round(coalesce(g.s, 0), 12) DESC, sn.id) AS k, count(*) OVER (PARTITION BY sn.batch) AS n, count(*) FILTER (hop > 0) OVER (PARTITION BY sn.batch) AS rest
  FROM sn LEFT JOIN (SELECT gb.batch, inf.id, sum(s) AS s FROM inf JOIN gb ON gb.id = inf.seed GROUP BY 1, 2) g ON g.batch = sn.batch AND g.id = sn.id) WHERE k <= n - floor(rest * 0.3::DOUBLE)""",
        _SAMPLE,
        _INFLUENCE,
    ),
    "influence_by_layers": _q(
        f"""SELECT CAST(batch AS BIGINT) AS batch, CAST(layers AS INTEGER) AS layers, count(*) FILTER (k <= 4 * seeds) AS top, count(*) FILTER (k <= 4 * seeds AND hop = 1) AS near, {_r9("sum(CASE WHEN k <= 4 * seeds THEN s ELSE 0 END)")} AS top_sum, {_r9("sum(s)")} AS all_sum FROM (
  SELECT sn.batch, l.range AS layers, sn.hop, coalesce(p.s, 0) AS s, c.seeds, row_number() OVER (PARTITION BY sn.batch, l.range ORDER BY round(coalesce(p.s, 0), 12) DESC, sn.id) AS k
  FROM sn CROSS JOIN range(2, 5) l LEFT JOIN per p ON p.batch = sn.batch AND p.layers = l.range AND p.id = sn.id JOIN (SELECT batch, count(*) AS seeds FROM gb GROUP BY batch) c ON c.batch = sn.batch WHERE hop > 0) GROUP BY batch, layers""",
        _SAMPLE,
        _layers(4),
    ),
    "edge_matching": _q("SELECT id, mate FROM t3", _MATES),
    "contracted_edges": _q("SELECT a.up AS src, b.up AS dst, count(*) AS w FROM edges JOIN u a ON a.id = src JOIN u b ON b.id = dst WHERE a.up <> b.up GROUP BY 1, 2", _MATES, " u AS MATERIALIZED (SELECT n.id, least(n.id, coalesce(mate, n.id)) AS up FROM nodes n LEFT JOIN t3 ON t3.id = n.id)"),
    "moved_nodes": _q("SELECT count(*) FILTER (part <> least(id * 16 // n, 15)) AS moved, count(*) AS nodes FROM assign CROSS JOIN (SELECT count(*) AS n FROM nodes)"),
    "partition_store_blocks": _q("SELECT sp, dp, count(*) AS n, CAST(sum(src) AS BIGINT) AS src, CAST(sum(dst) AS BIGINT) AS dst FROM ep WHERE sp IN (SELECT part FROM batch) AND dp IN (SELECT part FROM batch) GROUP BY sp, dp"),
    "epoch_plateaus": f"""WITH {_RUNS}, pk AS (SELECT run, iter, val FROM (SELECT *, max(val) OVER (PARTITION BY run ORDER BY iter ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM rl) WHERE before IS NULL OR val > before)
SELECT run, iter, {_r9("val")} AS best, iter - coalesce(lag(iter) OVER (PARTITION BY run ORDER BY iter), iter) AS waited FROM pk""",
    "epoch_spread": "SELECT CAST(o_orderkey % 10 AS INTEGER) AS epoch, count(*) AS n, round(avg(o_custkey % 500), 6) AS mean, round(stddev_samp(o_custkey % 500), 6) AS std FROM orders GROUP BY 1",
    "sage_ri_forward": _q(
        "SELECT id, round(sum(v), 5) AS total FROM z2 GROUP BY id",
        _X,
        *_RESIDUAL,
    ),
    "fennel_alpha_table": _q("SELECT label, round(m.n / k.k * sqrt(16.0::DOUBLE) / pow(c.n, 1.5::DOUBLE), 9) AS alpha FROM (SELECT CASE WHEN split = 'train' THEN coalesce(label, 5) ELSE 5 END AS label, count(*)::DOUBLE AS n FROM nodes GROUP BY 1) c CROSS JOIN (SELECT count(*)::DOUBLE AS n FROM edges) m CROSS JOIN (SELECT count(DISTINCT CASE WHEN split = 'train' THEN coalesce(label, 5) ELSE 5 END)::DOUBLE AS k FROM nodes) k"),
    "weight_rescale": _q("SELECT id, CAST(round((w - lo + step) / step) AS BIGINT) AS rescaled FROM (SELECT id, deg * 0.5::DOUBLE AS w, min(deg * 0.5::DOUBLE) OVER () AS lo FROM indeg) x CROSS JOIN (SELECT min(deg) * 0.5::DOUBLE - (SELECT min(deg) * 0.5::DOUBLE FROM indeg) AS step FROM indeg WHERE deg > (SELECT min(deg) FROM indeg)) y"),
    **dict.fromkeys(
        ("fennel_invariants", "restream_invariants", "bsp_invariants", "block_stream_invariants", "multilevel_invariants", "concurrent_invariants"),
        _q(
            """SELECT n AS rows, n AS nodes, 0 AS first, 15 AS last, greatest(CAST(floor(n / 16 * 1.1::DOUBLE) AS BIGINT), CAST(ceil(n / 16) AS BIGINT)) AS cap, CAST(0 AS BIGINT) AS over,
 (SELECT count(*) FROM edges JOIN assign a ON a.id = src JOIN assign b ON b.id = dst WHERE a.part <> b.part) AS hash_cuts, true AS fewer_cuts FROM (SELECT count(*) AS n FROM nodes)"""
        ),
    ),
    **dict.fromkeys(
        ("metis_tb_balance", "fennel_lb_balance"),
        _q("SELECT train, n, greatest(CAST(floor(n / 16 * 1.1::DOUBLE) AS BIGINT), CAST(ceil(n / 16) AS BIGINT)) AS cap, CAST(0 AS BIGINT) AS over FROM (SELECT CAST(coalesce(split = 'train', false) AS INTEGER) AS train, count(*) AS n FROM nodes GROUP BY 1)"),
    ),
    "ppr_push": _q(f"SELECT seed, id, {_r9('p / 1e15::DOUBLE')} AS p FROM p9 WHERE p > 0", _PUSH),
    "ppr_mass": _q("SELECT id AS seed, 0.25::DOUBLE AS mass, CAST(0 AS BIGINT) AS due FROM train"),
    "ranges_merge_degree": _q(
        """SELECT dst, count(*) AS n, string_agg(CAST(src AS VARCHAR), ',' ORDER BY src) AS nbrs FROM (
  SELECT src, dst FROM fr WHERE src % 2 = 0 AND pos < n // 8
  UNION ALL SELECT src, dst FROM fr WHERE src % 2 = 1 AND pos >= n // 8 AND pos < n // 8 + n // 4
  UNION ALL SELECT src, dst FROM fr WHERE src % 2 = 0 AND pos < n // 16) GROUP BY dst""",
        " fr AS MATERIALIZED (SELECT src, dst, (row_number() OVER (ORDER BY dst, src) - 1) // 2 AS pos, count(*) OVER () AS n FROM edges)",
    ),
    "row_col_slice": _q("SELECT dst AS src, src AS dst FROM edges SEMI JOIN train ON train.id = src SEMI JOIN nodes ON nodes.id = dst AND kind = 1"),
    "split_first": _q("SELECT id FROM train ORDER BY id LIMIT 100"),
    "split_test_is_valid": _q("SELECT id FROM nodes WHERE split = 'valid'"),
    "largest_parts": _q("SELECT part, n AS size FROM psize ORDER BY n DESC, part LIMIT 6"),
    "popular_pivots": _q("SELECT id FROM pvt INTERSECT SELECT id FROM popular"),
    "pivot_layout_check": """SELECT * FROM (VALUES ('edge into a pivot is in another part than its source', CAST(0 AS BIGINT)), ('edge between pivots is in another part than its source', 0), ('in-degree of a pivot differs from the graph''s', 0), ('pivot number used twice', 0)) t("check", bad)""",
    "drop_walk_alive": _q("SELECT CAST(batch AS BIGINT) AS batch, hop, id FROM (SELECT sn.*, row_number() OVER (PARTITION BY batch ORDER BY round(s, 9), sn.id DESC) AS k, count(*) OVER (PARTITION BY batch) AS n FROM sn JOIN w1 ON w1.id = sn.id WHERE hop > 0) WHERE k > floor(n * 0.3::DOUBLE) UNION ALL SELECT batch, hop, id FROM sn WHERE hop = 0", _SAMPLE),
    "drop_far_share_alive": _q("SELECT CAST(batch AS BIGINT) AS batch, hop, id FROM fs", _SAMPLE, _FAR),
    "retained_score": _q(
        "SELECT CAST(sn.batch AS BIGINT) AS batch, count(*) AS nodes, count(fs.id) AS alive, round(sum(CASE WHEN fs.id IS NOT NULL THEN round(s, 9) ELSE 0 END) / sum(round(s, 9)), 6) AS score FROM sn JOIN w1 ON w1.id = sn.id LEFT JOIN fs ON fs.batch = sn.batch AND fs.id = sn.id GROUP BY sn.batch",
        _SAMPLE,
        _FAR,
    ),
    "seed_loader_edges": _q(
        "SELECT CAST(batch AS BIGINT) AS batch, hop, src, dst FROM se",
        f" vs AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE split = 'valid'), gb AS (SELECT id, {_chunk('pos', 'n', '100')} AS batch FROM vs)",
        _HOPS.format(edges="edges", seed=17),
    ),
    "best_epoch_upto": f"WITH {_RUNS.replace('FROM rl)', 'FROM rl WHERE iter <= 19)')} SELECT run, iter, round(val, 9) AS val, round(test, 9) AS test FROM be",
    "sage_forward": _q("SELECT id, round(sum(v), 5) AS total FROM y2 GROUP BY id", _X, *_SAGE),
    "jk_forward": _q("SELECT id, round(sum(greatest(v, 0)), 5) AS total FROM (SELECT id, v FROM y1 UNION ALL SELECT id, v FROM y2) GROUP BY id", _X, *_SAGE),
    "weighted_sage_forward": _q(
        "SELECT id, round(sum(v), 5) AS total FROM y GROUP BY id",
        _X,
        " ew AS MATERIALIZED (SELECT src, dst, CASE WHEN a.part <> b.part THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM edges JOIN assign a ON a.id = src JOIN assign b ON b.id = dst)",
        " m AS MATERIALIZED (SELECT dst AS id, i, sum(w * v) / sum(w) AS v FROM ew JOIN x ON x.id = src GROUP BY dst, i)",
        _dense("y", "x", "m", 8),
    ),
    "gcn_forward": _q(
        "SELECT id, round(sum(v), 5) AS total FROM y2 GROUP BY id",
        _X,
        " lp AS (SELECT src, dst FROM edges UNION ALL SELECT id, id FROM nodes), ld AS (SELECT dst AS id, count(*)::DOUBLE AS d FROM lp GROUP BY dst), lw AS MATERIALIZED (SELECT src, dst, 1 / sqrt(a.d * b.d) AS w FROM lp JOIN ld a ON a.id = src JOIN ld b ON b.id = dst)",
        " m1 AS MATERIALIZED (SELECT dst AS id, i, sum(w * v) AS v FROM lw JOIN x ON x.id = src GROUP BY dst, i)",
        _dense("y1", "m1", None, 8),
        " r1 AS MATERIALIZED (SELECT id, i, greatest(v, 0) AS v FROM y1), m2 AS MATERIALIZED (SELECT dst AS id, i, sum(w * v) AS v FROM lw JOIN r1 ON r1.id = src GROUP BY dst, i)",
        _dense("y2", "m2", None, 4),
    ),
    "gin_forward": _q(
        "SELECT id, round(sum(v), 5) AS total FROM y GROUP BY id",
        _X,
        " m AS (SELECT dst AS id, i, sum(v) AS v FROM edges JOIN x ON x.id = src GROUP BY dst, i), s AS MATERIALIZED (SELECT x.id, x.i, 1.125::DOUBLE * x.v + coalesce(m.v, 0) AS v FROM x LEFT JOIN m ON m.id = x.id AND m.i = x.i)",
        _dense("y", "s", None, 8),
    ),
    "gat_forward": _q("SELECT id, round(sum(v) / 2, 5) AS total FROM (SELECT * FROM o0 UNION ALL SELECT * FROM o1) GROUP BY id", _X, " lp AS (SELECT src, dst FROM edges UNION ALL SELECT id, id FROM nodes)", *_attend(0, "lp"), *_attend(1, "lp")),
    "rgat_forward": _q(
        "SELECT id, round(sum(v), 5) AS total FROM (SELECT * FROM o0 UNION ALL SELECT * FROM o1 UNION ALL SELECT id, v FROM y) GROUP BY id",
        _X,
        " e0 AS (SELECT src, dst FROM edges WHERE src <= dst), e1 AS (SELECT src, dst FROM edges WHERE src > dst)",
        *_attend(0, "e0"),
        *_attend(1, "e1"),
        _dense("y", "x", None, 8, 2),
    ),
    "stream_event_counts": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2",
    "stream_assign": "SELECT event_id, user_id, CAST(((user_id % 2147483648) * 2654435761) % 4294967296 // 65536 % 16 AS INTEGER) AS part FROM events",
}

SQL["pivot_store_edges"] = SQL["collate_pivot_edges"]
SQL["block_neighbor_mean"] = SQL["neighbor_mean"]
