"""Secret scans with an incremental blob ledger, in DataFrame operations only.

Every version of a text is a blob, addressed by the SHA-256 of its bytes. The ledger is a
table of (blob_id, rule_version, spans); a run scans the blobs that other runs' parts lack at
the present rule version, one row for each blob, adds them, and joins the findings back to all
rows that hold a blob. The ledger is partitioned by rule version and run.

A pattern's matches and the pieces between them come from two passes of the same regular
expression; their lengths give starts and ends in code points, so no position is searched for.
The patterns of the rules have no look-around, so this is exact. The lengths are summed in
blocks of about the square root of their number, so that a text of very many matches costs
little more than its length.

Defined results: a null text is an empty blob without findings; equal texts are one blob and
are scanned once, whatever their keys; rows with a null or repeated key are all kept; spans of
equal start stand in the order of RULES; texts are scanned whole, of any length; an empty table
leaves the ledger as it is. Rows keep all columns; a column named as an output is replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import exists, settled


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of pattern whose group has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int
    least: int


#: In the order in which spans of equal start are listed. The limits of access and hex stand
#: in the pattern: a run of either alphabet is one match, so shorter runs needn't be matched.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
#: Changes whenever RULES do; older findings stay in the ledger under their version.
RULE_VERSION = "1"
SPAN = "struct<start:bigint,rank:int,kind:string,end:bigint>"
LEDGER = f"blob_id string, spans array<{SPAN}>"


def named(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def rule_spans(text: Column, rule: Rule, rank: int) -> Column:
    """The spans of one rule, in order."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    gaps = F.split(text, rule.pattern, -1)
    none = F.array().cast(f"array<{SPAN}>")
    size = F.transform(F.arrays_zip(gaps.alias("g"), whole.alias("w"), value.alias("v")), lambda x: F.struct(F.char_length(x["g"]).cast("long").alias("g"), F.coalesce(F.char_length(x["w"]), F.lit(0)).cast("long").alias("w"), F.char_length(x["v"]).alias("v")))

    def blocks(pieces: Column) -> Column:
        return named(F.ceil(F.sqrt(F.size(pieces))).cast("int"), lambda n: F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / n).cast("int")), lambda k: F.slice(pieces, k * n + 1, n)))

    def starts(parts: Column) -> Column:
        sums = F.transform(parts, lambda p: F.aggregate(p, F.lit(0).cast("long"), lambda a, x: a + x["g"] + x["w"]))
        begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(sums, begin, lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + x["g"]
        end = begin + x["w"]
        found = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), end.alias("end")).cast(SPAN)
        return F.struct(end.alias("at"), F.when(x["v"] >= rule.least, F.concat(state["out"], F.array(found))).otherwise(state["out"]).alias("out"))

    def spans(parts: Column) -> Column:
        own = lambda p, at: F.aggregate(p, F.struct(at.alias("at"), none.alias("out")), step, lambda s: s["out"])
        return F.flatten(F.zip_with(parts, starts(parts), own))

    return F.when(text.rlike(rule.pattern), named(size, lambda x: named(blocks(x), spans))).otherwise(none)


def spans_of(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All rules' spans by start, then by the rules' order."""
    return F.array_sort(F.concat(*(rule_spans(text, r, k) for k, r in enumerate(rules))))


def read_ledger(spark: SparkSession, path: str, version: str, without: str | None = None) -> DataFrame:
    """The blobs that are scanned at a rule version; ``without`` leaves out a run. A blob may
    stand there more than once, if runs were at work at the same time."""
    at = f"{path}/rule_version={version}"
    if not exists(spark, at):
        return spark.createDataFrame([], LEDGER)
    found = spark.read.option("basePath", at).schema(f"{LEDGER}, run string").parquet(at)
    return found.where(F.col("run") != without if without else F.lit(True)).drop("run")


def with_blobs(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("blob_id", F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


def add_to_ledger(df: DataFrame, ledger: str, run: str, text: str = "text", key: str = "doc_id", rules: tuple[Rule, ...] = RULES, version: str = RULE_VERSION) -> None:
    """Scans the texts of df that the ledger lacks at the rule version, and adds their findings
    as the part ``run``; the same name again replaces that part, so that a run can be repeated
    after a failure."""
    name = F.coalesce(F.col(key).cast("string"), F.lit("")).alias("__quire_one")
    rows = with_blobs(df, text).select("blob_id", name, F.col(text).alias("__quire_text"))
    seen = read_ledger(df.sparkSession, ledger, version, without=run)
    unseen = rows.groupBy("blob_id").agg(F.min("__quire_one").alias("__quire_one")).join(seen, "blob_id", "left_anti")
    blobs = rows.join(unseen.hint("shuffle_hash"), ["blob_id", "__quire_one"], "left_semi")
    found = blobs.select("blob_id", spans_of(F.coalesce("__quire_text", F.lit("")), rules).alias("spans"))
    found.dropDuplicates(["blob_id"]).write.mode("overwrite").parquet(f"{ledger}/rule_version={version}/run={run}")


def scan_secrets(df: DataFrame, ledger: str, run: str, text: str = "text", key: str = "doc_id", rules: tuple[Rule, ...] = RULES, version: str = RULE_VERSION) -> DataFrame:
    """df with blob_id and spans (array of start, rank, kind, end), without text; texts that
    the ledger lacks are scanned and added first, as the part ``run``."""
    add_to_ledger(df, ledger, run, text, key, rules, version)
    rows = with_blobs(df, text)
    held = rows.select(*(c for c in rows.columns if c not in (text, "spans")))
    # Settled, so that the copies of one text, which have one key, can be dealt to several tasks.
    findings = settled(read_ledger(df.sparkSession, ledger, version).where(F.size("spans") > 0).dropDuplicates(["blob_id"]))
    out = held.join(findings, "blob_id", "left")
    return out.withColumn("spans", F.coalesce("spans", F.array().cast(f"array<{SPAN}>")))
