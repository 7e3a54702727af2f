"""The registered queries against their SQL, on the smallest tables."""

import os

import duckdb
import pytest

from graphlake.plans import roster

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUICK = ["graph_nodes", "cut_matrix", "relabelled_edges", "block_offsets", "lazy_rw_k3", "node_importance_k2", "collate_edges", "collate_pivot_edges", "even_split_chunks", "hier_batches", "sample_hop2", "neighbor_mean", "label_emd_per_batch", "best_epoch", "stream_assign", "layout_check", "hier_loader_edges", "partition_loader_nodes",
         "degree_order", "edges_sorted", "ranges_merge_degree", "pivot_store_edges", "cut_flags", "cached_batch_edges", "retained_score", "simulated_distance", "gat_forward", "jk_forward", "ppr_push", "bsp_invariants", "fennel_invariants", "metis_tb_balance",
         "sample_replace_edges", "influence_by_layers", "drop_hop_near_alive", "drop_seed_influence_alive", "edge_matching", "contracted_edges", "concurrent_invariants", "block_neighbor_mean", "epoch_plateaus", "epoch_spread", "log_select", "partition_store_blocks", "coverage", "popular_nodes", "moved_nodes", "sage_ri_forward", "chained_chunks"]


def rows_of(result):
    names = sorted(range(len(result[0])), key=lambda i: result[0][i])
    return [result[0][i] for i in names], sorted(repr(tuple(r[i] for i in names)) for r in result[1])


@pytest.mark.parametrize("name", sorted(roster.ORACLE_SQL) if os.environ.get("ALL_QUERIES") else QUICK)
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(roster.ORACLE_SQL[name])
    want = rows_of(([d[0] for d in cur.description], cur.fetchall()))
    df = roster.QUERIES[name](spark, SF)
    assert rows_of((df.columns, [tuple(r) for r in df.collect()])) == want


def test_every_sql_has_its_query():
    assert set(roster.ORACLE_SQL) <= set(roster.QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
