"""The registered pipeline on the smallest tables, and the queries' SQL."""

import hashlib
import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't there")


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, SF)
        assert out.columns == docs.columns, name
        at = out.cache()
        assert 0 < at.count()
    last = corpus_pipeline.STAGES[-1][1](spark, at, SF)
    want = sorted(map(tuple, last.collect()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == want


def test_pipeline_on_odd_rows(spark, docs, none, tmp_path):
    """Nulls everywhere, repeated rows, clashing names and an empty table; what each stage drops is accounted for."""
    import corpus_pipeline

    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(60)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    for name, table in (("full", plain), ("empty", plain.limit(0))):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and (out.count() > 0) == (name == "full")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for table in (docs, none):
            out = stage(spark, table, f"{tmp_path}/full")
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
            assert (out.count() > 0) == (table is docs)


def test_stages_by_brute_force(spark, tmp_path):
    """On a small table: groups of similar texts, removed windows and tokens straight from their definitions."""
    import corpus_pipeline
    from tessera.llm import bpe, queries
    from tests.llm.test_text_operators import jaccard, removed_by_hand

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {r["doc_id"] for r in corpus_pipeline.simhash_stage(spark, docs, SF).collect()}
    ids = sorted(rows)
    root = {i: i for i in ids}
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if root[i] != root[j] and jaccard(rows[i], rows[j]) >= 0.8:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = {x: new if r == old else r for x, r in root.items()}
    assert kept == {i for i in ids if root[i] == i}
    left = docs.where(docs["doc_id"].isin(*kept))
    want = {i: h for i, _, n, h in removed_by_hand([(i, rows[i]) for i in sorted(kept)], 50) if n}
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.substring_stage(spark, left, SF).collect()}
    assert {i for i in kept if got[i] != rows[i]} == set(want)
    assert all(hashlib.sha256(got[i].encode()).hexdigest() == h for i, h in want.items())
    enc = bpe.encoding(bpe.read_ranks(queries.RANKS), queries.PATTERN)
    for r in corpus_pipeline.bpe_stage(spark, left, SF).collect():
        tokens = enc.encode_ordinary(rows[r["doc_id"]] or "")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(tokens), hashlib.sha256(" ".join(map(str, tokens)).encode()).hexdigest())


@pytest.mark.parametrize("name", ["op8_url_filter", "op9_substring_dedup", "op10_vector_neardup"])
def test_sql(spark, name):
    import __spark_entry__ as e

    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = e.queries()[name](spark, SF).toPandas(), con.sql(e.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cell = lambda x: None if x is None or x != x else x.item() if hasattr(x, "item") else x
    rows = lambda df: sorted((tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)
    assert rows(got) == rows(want)
