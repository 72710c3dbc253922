"""Every operator and stage on nulls, empty and long texts, ties, repeated rows, an empty table,
and extra columns whose names clash with outputs."""

import pytest
from pyspark.sql import types as T

CLASH = "ids n_tokens decoded group_id copy_of kept id hash bands rep size shard slot _a _b _part _base entity_kinds _m score n_words n_hit items spans contaminated blob_id _one _text media page width height samples bits compression predictor tiled data error b a t near worded file block ends pieces".split()
LONG = "lorem ipsum dolor sit amet consectetur " * 6000
ROWS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"),
    (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"),
    (3, None),
    (4, ""),
    (5, LONG),
    (6, " \n\t "),
    (None, "a row without an id, mail x.y@mail.example.com"),
    (7, "token = \"abcdefgh12345678\" +1 (212) 555-0100 10.1.2.3 \u0000 \U0001f600 ́"),
    (8, "x"),
    (8, "x"),
]


def frame(spark, rows, clash=True):
    names = CLASH if clash else []
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())] + [T.StructField(n, T.StringType()) for n in names])
    return spark.createDataFrame([(i, t, None, "s", None, *(["kept"] * len(names))) for i, t in rows], schema).coalesce(2)


@pytest.fixture(scope="module", params=["edge", "empty"])
def docs(request, spark):
    return frame(spark, ROWS if request.param == "edge" else [])


def count(docs):
    return docs.count()


@pytest.fixture(scope="module")
def tokenizer():
    from quire.llm.queries import tokenizer

    return tokenizer


def test_bpe(docs, tokenizer):
    from quire.llm.bpe import bpe_decode, bpe_encode, bpe_round_trip

    path = tokenizer("byte_bpe_50k.json")
    rows = bpe_decode(bpe_encode(docs, path), path).collect()
    assert len(rows) == count(docs)
    assert all(r.decoded == (r.text or "") and r.n_tokens == len(r.ids) // 4 for r in rows)
    assert sorted((bytes(r.ids), r.decoded) for r in bpe_round_trip(docs, path).collect()) == sorted((bytes(r.ids), r.decoded) for r in rows)


def test_near_dedup(docs):
    from quire.llm.icws import deduplicate, near_duplicates

    rows = near_duplicates(docs).collect()
    assert len(rows) == count(docs)
    if rows:
        by = {r.doc_id: r for r in rows}
        assert by[2].group_id == by[1].group_id == 1 and by[1].kept and not by[2].kept
        assert all(by[k].kept and by[k].group_id == k for k in (3, 4, 5, 6, 7)) and by[8].group_id == 8
        kept = deduplicate(docs)
        assert set(kept.columns) == set(docs.columns)
        assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 6, 7, 8]
        assert sorted(r.kept for r in rows if r.doc_id == 8) == [False, True]


def test_shards(docs):
    from quire.llm.shard import shard_documents

    rows = shard_documents(docs, 4).collect()
    assert len(rows) == count(docs)
    assert {r.lang for r in rows} <= {None} and {r.source for r in rows} <= {"s"}
    for s in range(4):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))


def test_pii(docs):
    from quire.llm.surrogates import replace_pii

    rows = replace_pii(docs, "k").collect()
    assert len(rows) == count(docs)
    if rows:
        by = {r.doc_id: r for r in rows}
        assert by[3].text is None and by[4].text == "" and by[5].text == LONG
        assert by[7].entity_kinds == ["phone", "ip"] and "555-0100" not in by[7].text
        assert "x.y@" not in by[None].text


def test_quality(spark, docs):
    from quire.llm.quality import fit, score

    labels = spark.createDataFrame([(1, 1), (5, 0), (8, 1), (9, 0), (3, None), (None, 1)], "doc_id long, quality int")
    model = fit(docs, labels)
    rows = score(docs, model).collect()
    assert len(rows) == count(docs) and all(0 <= r.score <= 1 for r in rows)


def test_secrets(spark, docs, tmp_path):
    from quire.llm.secret_ledger import scan_secrets

    rows = scan_secrets(docs, str(tmp_path / "ledger"), "one").collect()
    assert len(rows) == count(docs)
    if rows:
        assert [[s.kind for s in r.spans] for r in rows if r.doc_id == 7] == [["assign"]]


def test_decontamination(spark, docs):
    from quire.llm.fm_decon import decontaminate

    bench = spark.createDataFrame([("i", ROWS[0][1]), (None, "x"), ("n", None), ("e", ""), ("i", ROWS[0][1])], "item_id string, text string")
    rows = decontaminate(docs, bench).collect()
    assert len(rows) == count(docs)
    if rows:
        by = {r.doc_id: r for r in rows}
        assert by[1]["items"] == ["i"] and by[1].contaminated and by[1].n_hit == 14
        assert by[8].contaminated and by[8]["items"] == [] and not by[3].contaminated and by[3].n_words == 0
    none = decontaminate(docs, bench.where("false")).collect()
    assert len(none) == len(rows) and not any(r.contaminated for r in none)


def test_token_files(spark, docs, tokenizer, tmp_path):
    from quire.llm.bpe import PATTERN
    from quire.llm.token_files import part_of, read_index, token_counts, write_token_files

    out = str(tmp_path / "flat")
    write_token_files(docs, out, tokenizer("byte_bpe_50k.tiktoken"), PATTERN, 50256)
    rows = token_counts(spark, f"{out}/kind=ids", 50256, block_bytes=64)
    assert rows.count() == count(docs) and all(r.ended for r in rows.collect())
    named = rows.withColumn("part", part_of(rows["file"])).join(read_index(spark, out, 50256), ["part", "document"]).collect()
    if not count(docs):
        assert not named and not rows.collect()
        return
    assert sorted((r.key or "") for r in named) == sorted("" if i is None else str(i) for i, _ in ROWS)
    assert {r.key: r.n_tokens for r in named}["3"] == 0 and {r.key: r.n_tokens for r in named}["8"] == 1


def test_html(docs):
    from quire.llm.text_density import extract_main_text

    rows = extract_main_text(docs.withColumnRenamed("text", "html")).collect()
    assert len(rows) == count(docs) and all(r.text is not None for r in rows)


def test_tiff(docs):
    from quire.llm.tiff import read_pages, store_texts

    rows = read_pages(store_texts(docs)).collect()
    assert len(rows) == count(docs)
    assert all(bytes(r.data).rstrip(b" ") == (r.text or "").encode().rstrip(b" ") for r in rows)


def test_stages(spark, tmp_path):
    import corpus_pipeline

    sf = tmp_path / "sf"
    spark.createDataFrame([(1, 1, 0), (5, 0, 0), (None, 1, None)], "doc_id long, quality int, toxic int").write.parquet(str(sf / "labels.parquet"))
    spark.createDataFrame([(1, "x y z"), (None, None)], "item_id long, text string").write.parquet(str(sf / "benchmark.parquet"))
    for rows in (ROWS, []):
        docs = frame(spark, rows, clash=False)
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(sf))
            if k + 1 < len(corpus_pipeline.STAGES):
                assert out.columns == docs.columns, name
            out.collect()
