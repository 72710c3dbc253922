"""The registered queries: SQL where there is some, and the pipeline stage by stage."""

import glob
import hashlib
import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def test_sql_agrees(spark, db):
    from quire.llm.queries import ORACLE_SQL, QUERIES

    for name, sql in ORACLE_SQL.items():
        df = QUERIES[name](spark, SF)
        cols = sorted(df.columns)
        want = db.sql(sql)
        at = [want.columns.index(c) for c in cols]
        assert sorted(repr(tuple(r[c] for c in cols)) for r in df.collect()) == sorted(repr(tuple(r[k] for k in at)) for r in want.fetchall()), name


def test_ten_operators_and_pipeline_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


def test_pipeline_stages_against_brute_force(spark, db):
    import corpus_pipeline
    from test_llm_operators import brute_hits, near_groups

    from quire.llm.bpe import Encoder
    from quire.llm.queries import tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = dict(db.sql("SELECT doc_id, quality FROM labels").fetchall())
    items = [(str(i), t) for i, t in db.sql("SELECT item_id, text FROM benchmark").fetchall()]
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, SF).toArrow())
        after = {r.doc_id: r for r in docs.collect()}
        if name == "quality":
            assert all(i in after for i in before if labels.get(i) == 1)
        elif name == "near_dedup":
            assert set(after) == set(near_groups({i: r.text for i, r in before.items()}).values())
        elif name == "decontamination":
            hits = {i: brute_hits(r.text, items, 13) for i, r in before.items()}
            assert set(after) == {i for i, (n, h, _) in hits.items() if not h or 20 * h < n}
        elif name == "pii":
            assert set(after) == set(before) and all(r.n_chars == len(r.text) for r in after.values())
        else:
            coder = Encoder(tokenizer("byte_bpe_50k.json"))
            for i, r in after.items():
                ids = coder.encode([before[i].text])[0]
                assert (r.n_tokens, r.ids_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
                assert r.decoded_sha256 == hashlib.sha256(before[i].text.encode()).hexdigest()
        before = after


def test_pipeline_near_dedup_of_hub_and_spokes(spark):
    import random

    import corpus_pipeline
    from test_llm_operators import hub_and_spokes, near_groups

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(100)
    own, _ = hub_and_spokes(200, random.Random(3))
    more = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in own.items()], "doc_id long, text string, lang string, source string, n_chars long")
    docs = spark.createDataFrame(docs.unionByName(more.select(*docs.columns)).toArrow())
    want = set(near_groups({r.doc_id: r.text for r in docs.collect()}).values())
    assert len(want & set(own)) == 1
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()} == want
