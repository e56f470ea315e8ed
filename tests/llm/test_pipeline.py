"""The pipeline's stages on small tables: each keeps the columns of documents, works on all rows and takes effect."""

from pathlib import Path

import pytest

import corpus_pipeline
from tallyframe.llm.catalog import ORACLE, QUERIES

from .test_dedup import linked_by_hand, removed_by_hand

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).is_dir(), reason="no test tables")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["language_id", "near_dedup", "substring_dedup", "mixing", "packing"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{name}")
        seen[name] = (docs, spark.read.parquet(f"{tmp_path}/{name}"))
        docs = seen[name][1]
        if name != "packing":
            assert docs.dtypes == seen[name][0].dtypes
    before, after = (x.collect() for x in seen["near_dedup"])
    assert {r.doc_id for r in after} == {d for d, (_, c) in linked_by_hand(before).items() if d == c}
    before, after = (x.collect() for x in seen["substring_dedup"])
    lost = removed_by_hand(before, 13)
    assert {r.doc_id for r in after} == {d for d, (n, gone, _) in lost.items() if not n or gone < n}
    texts = {r.doc_id: r.text for r in before}
    for r in after:
        assert len(r.text.encode().split()) == lost[r.doc_id][0] - lost[r.doc_id][1] and r.n_chars == len(r.text)
        assert lost[r.doc_id][1] or r.text == texts[r.doc_id]
    before, after = (x.collect() for x in seen["mixing"])
    assert 0 < len(after) <= len(before) and set(after) <= set(before)
    pieces = seen["packing"][1].collect()
    assert {p.doc_id for p in pieces} == {r.doc_id for r in after}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    got, want = QUERIES[name](spark, DATA), con.sql(ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(tuple(r) for r in got.select(*want.columns).collect()) == sorted(want.fetchall())
