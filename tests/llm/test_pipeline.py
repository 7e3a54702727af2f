"""The pipeline's stages against brute force, on the smallest tables and on odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from graphlake.llm import common, decontaminate, langid, neardup, pii
from graphlake.llm.common import Scratch

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, scratch, out = spark.read.parquet(f"{SF}/documents.parquet"), Scratch(spark, "test-pipeline"), []
    out.append(docs)
    for name, stage in pipeline.STAGES:
        out.append(scratch.write(stage(spark, out[-1], SF), name))
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages(steps):
    docs, languages, unique, clean, redacted, mixed = steps
    model = langid.fit(docs)
    assert ids(languages) == sorted(r.doc_id for r in docs.collect() if langid.classify(model, r.text)[0] != "und" and langid.classify(model, r.text)[1] >= pipeline.LEAST_SCORE)
    sets = {r.doc_id: set(neardup.shingles(r.text).tolist()) for r in languages.collect()}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    assert ids(unique) == sorted({root(i) for i in sets})
    items = [decontaminate.tokens(r.text) for r in unique.sparkSession.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def held(text):
        t = decontaminate.tokens(text)
        return any(sum(k for *_, k in decontaminate.tile(p, t)) >= 0.5 * p.size for p in items if p.size >= 5 and np.isin(decontaminate.window_hashes(p, 5), decontaminate.window_hashes(t, 5)).any())

    assert ids(clean) == sorted(r.doc_id for r in unique.collect() if not held(r.text))
    before = {r.doc_id: r for r in clean.collect()}
    for r in redacted.collect():
        assert not any(pii.base_spans(r.text).values()) and r.n_chars == len(r.text)
        if not any(pii.base_spans(before[r.doc_id].text).values()):
            assert r.text == before[r.doc_id].text
    assert redacted.columns == docs.columns
    assert set(ids(mixed)) == set(ids(redacted))
    texts = {(r.doc_id, r.text) for r in redacted.collect()}
    assert {(r.doc_id, r.text) for r in mixed.select("doc_id", "text").collect()} == texts


def test_odd_rows_pass(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    odd = spark.createDataFrame([(None, "the with of and to", None, None, None), (7777, None, "en", "s", 0), (7778, "", None, None, 0), (7779, "the of and " * 30_000, "en", None, 5)], docs.schema)
    rows = docs.union(odd).union(docs.limit(3)).withColumn("score", F.lit(1)).withColumn("rid", F.lit(2)).withColumn("_gl", F.lit(3))
    n = {}
    for name, stage in pipeline.STAGES:
        rows = stage(spark, rows, SF)
        if name != "mixture":
            assert rows.columns[-3:] == ["score", "rid", "_gl"]
        n[name] = rows.count()
    assert n["language_id"] >= 30 and n["near_duplicates"] <= 32


def test_stages_that_shuffle_give_the_same(spark, monkeypatch):
    """What a stage drops or redacts does not depend on whether its table is small enough to be sent to all executors."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, "call +1 234 567 8901", None, None, None), (7777, None, "en", "s", 0), (7777, None, "en", "s", 0)], docs.schema)
    docs = docs.union(odd).union(docs.limit(3))
    rows = lambda df: sorted(map(repr, df.collect()))
    for stage in (pipeline.near_duplicates, pipeline.decontamination, pipeline.personal_data):
        small = rows(stage(spark, docs, SF))
        monkeypatch.setattr(common, "SMALL", -1)
        assert rows(stage(spark, docs, SF)) == small
        monkeypatch.undo()


def test_repeated_ids_with_several_texts(spark):
    """Stages decide by row, so no text vanishes with another one of its id."""
    one, two, three = (" ".join(f"{w}{i}" for i in range(20)) for w in "abc")
    docs = spark.createDataFrame([(1, one), (2, one), (2, two), (3, two), (3, two)], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.text) for r in pipeline.near_duplicates(spark, docs, SF).collect()) == [(1, one), (2, two)]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    docs = spark.createDataFrame([(1, one), (1, f"{two} {item}"), (1, three), (None, item)], "doc_id bigint, text string")
    assert sorted((r.doc_id or 0, r.text) for r in pipeline.decontamination(spark, docs.union(docs.sparkSession.createDataFrame([(None, three)], docs.schema)), SF).collect()) == [(0, three), (1, one), (1, three)]


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0
