"""The subpackage's queries in the entry point, and the pipeline."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import duckdb  # noqa: E402
import pytest  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline  # noqa: E402
from honeyframe import llm  # noqa: E402

pytest.importorskip("public_tokenizers")


def test_registered():
    names = entry.queries()
    assert {f"op{n}_" for n in range(1, 14)} == {n.split("_")[0] + "_" for n in names if n.startswith("op") and n[2].isdigit()}
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_same_as_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cur = con.execute(llm.ORACLES[name])
    cols = [c[0] for c in cur.description]
    got = llm.QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(cols)
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, cur.fetchall()))


def test_pipeline_keeps_one_of_each_near_group(spark, sf):
    from test_documents import check_packing, near_groups

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    best = {}
    for d, t in docs.items():
        best[t] = max(d, best.get(t, d))
    kept = {d for d, t in docs.items() if best[t] == d and t and any(c.isalpha() for c in t)}
    kept = {d for d, _, c, k in near_groups([(d, docs[d]) for d in sorted(kept)], percent=80) if k}
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in got} == kept
    n, least = check_packing(got, [(d, docs[d]) for d in kept], 4096)
    assert n <= least + 1
