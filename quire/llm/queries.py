"""The registered queries: each applies one operator to its whole table and derives the
columns that its contract names. ORACLE_SQL holds DuckDB SQL where SQL can express a query."""

from __future__ import annotations

import importlib.util
import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import remove, scratch, settled, table


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file."""
    if importlib.util.find_spec("public_tokenizers"):
        import public_tokenizers

        return public_tokenizers.path(name)
    return os.path.join("/opt/tokenizers", name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.bpe import bpe_round_trip

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe_round_trip(docs, tokenizer("byte_bpe_50k.json"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op2_icws_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.icws import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.shard import shard_documents

    out = shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=8)
    crc = F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32")
    return out.select("doc_id", "size", crc, F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "group_cut")


#: The key of surrogates; a real run passes its own.
SECRET = "quire surrogates"


def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.surrogates import replace_pii

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = replace_pii(docs, SECRET)
    return out.select("doc_id", "text", F.size("entity_kinds").cast("long").alias("n_entities"), F.array_join("entity_kinds", ",").alias("entity_kinds"))


def held_out(key: str = "doc_id") -> Column:
    """Rows that no model may learn from."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def op5_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.quality import fit, score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    out = score(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.bpe import PATTERN
    from quire.llm.token_files import part_of, read_index, token_counts, write_token_files

    flat = scratch(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents").select("doc_id", "text"), flat, tokenizer("byte_bpe_50k.tiktoken"), PATTERN, end=50256)
    counts = token_counts(spark, f"{flat}/kind=ids", end=50256).withColumn("part", part_of(F.col("file")))
    out = read_index(spark, flat, end=50256).join(counts, ["part", "document"], "left")
    out = settled(out.select(F.col("key").cast("long").alias("doc_id"), "n_tokens", "ended"))
    remove(spark, flat)
    return out


def op7_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.secret_ledger import add_to_ledger, scan_secrets

    # Two versions of a history: what came first, about half of the rows, then all of them. The
    # second run scans the texts that the first hasn't seen, and joins all findings to all rows.
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = scratch(spark, "secret-ledger")
    add_to_ledger(docs.where(F.xxhash64("doc_id") < 0), ledger, run="1")
    out = scan_secrets(docs, ledger, run="2")
    listed = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = [F.expr(f"CAST(size(filter(spans, s -> s.kind = '{kind}')) AS BIGINT) AS n_{kind}") for kind in ("assign", "access", "hex")]
    return out.select("doc_id", *count, F.sha2(listed, 256).alias("base_sha256"), listed.alias("spans"))


def op8_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.text_density import extract_main_text

    out = extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op9_fm_decon(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.fm_decon import decontaminate

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op10_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.tiff import page_feature, read_pages, store_texts

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stored = store_texts(docs).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    page = read_pages(stored)
    return page.select(
        "doc_id",
        "n_bytes",
        F.octet_length("data").cast("long").alias("payload_bytes"),
        F.sha2("data", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(data, -16, 16)")).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        page_feature(F.col("data"), F.col("width"), F.col("height"), F.col("samples")).alias("feature"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_icws_dedup": op2_icws_dedup,
    "op3_histogram_shards": op3_histogram_shards,
    "op4_surrogates": op4_surrogates,
    "op5_subword_quality": op5_subword_quality,
    "op6_token_files": op6_token_files,
    "op7_secret_ledger": op7_secret_ledger,
    "op8_text_density": op8_text_density,
    "op9_fm_decon": op9_fm_decon,
    "op10_tiff_pages": op10_tiff_pages,
}

_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

_ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_SECRETS = " UNION ALL ".join(
    f"SELECT doc_id, '{kind}' AS kind, {k} AS r, {least} AS least, regexp_extract_all(t, '{p}') AS w, regexp_extract_all(t, '{p}', {group}) AS v, string_split_regex(t, '{p}') AS g FROM d"
    for k, (kind, p, group, least) in enumerate([("assign", _ASSIGN, 2, 8), ("access", "AKIA[A-Z0-9]+", 0, 16), ("hex", "[0-9a-f]+", 0, 32)])
)

_UNESCAPED = "s"
for _name, _char in [("quot", "'\"'"), ("middot", "chr(183)"), ("copy", "chr(169)"), ("lt", "'<'"), ("gt", "'>'"), ("amp", "'&'")]:
    _UNESCAPED = f"replace({_UNESCAPED}, '&{_name};', {_char})"

ORACLE_SQL: dict[str, str] = {
    # These pages hold their text in one article of headings and paragraphs.
    "op8_text_density": f"""
WITH a AS (SELECT page_id, url, regexp_extract(html, '<article>(.*?)(</article>|<footer>|$)', 1, 's') AS t FROM pages),
b AS (SELECT page_id, url, [trim(regexp_replace({_UNESCAPED}, '\\s+', ' ', 'g')) FOR s IN [regexp_replace(x, '<[^>]*>', ' ', 'g') FOR x IN string_split_regex(t, '</?(p|h1)>')]] AS parts FROM a)
SELECT page_id, url, array_to_string([x FOR x IN parts IF x <> ''], chr(10) || chr(10)) AS text,
       CAST(length(array_to_string([x FOR x IN parts IF x <> ''], chr(10) || chr(10))) AS BIGINT) AS n_chars FROM b""",
    "op7_secret_ledger": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({_SECRETS}),
u AS (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM m),
s AS (SELECT doc_id, kind, r, length(w[i]) AS n,
             list_sum([length(x) FOR x IN g[1:i]]) + coalesce(list_sum([length(x) FOR x IN w[1:i - 1]]), 0) AS a
      FROM u WHERE length(v[i]) >= least),
o AS (SELECT doc_id, string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(a + n AS BIGINT), ',' ORDER BY a, r) AS spans,
             count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
             count(*) FILTER (kind = 'hex') AS n_hex FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN o USING (doc_id)""",
    "op9_fm_decon": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
n AS (SELECT item_id, w, least(len(w), 13) AS n FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS s
        FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS k FROM n)),
occ AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS s
        FROM (SELECT d.*, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM win))),
hit AS (SELECT doc_id, n, k, item_id FROM occ JOIN win USING (n, s)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit
            FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
          FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)""",
}
