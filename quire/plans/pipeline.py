"""Whole plans: convert and render, and documents with their folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.kernels.model import EMPTY_DOCUMENT
from quire.operators.convert import convert
from quire.operators.registry import Registry
from quire.operators.render import exported_content, render
from quire.plans.schema import FAILED, PARSED
from quire.sources.files import fetch, read_files


def export(df: DataFrame, format: str = "markdown", registry: Registry | None = None, **options) -> DataFrame:
    """Documents (doc_key, content, hints) converted and rendered."""
    return render(convert(df, registry, **options), format)


def parse_documents(df: DataFrame, format: str = "markdown", registry: Registry | None = None, **options) -> DataFrame:
    """Fetched documents (doc_key, parent_key, content, ...) with exported_content, status and
    error_code. A row without content is parsed, with no sections, if other rows are its
    children, else an empty document; one that failed before stays failed, and one document's
    failure isn't another's."""
    parents = df.select(F.col("parent_key").alias("doc_key")).where("doc_key is not null").distinct()
    marked = df.join(parents.withColumn("_container", F.lit(True)), "doc_key", "left")
    earlier = F.col("error_code") if "error_code" in df.columns else F.lit(None).cast("string")
    marked = marked.withColumn("_earlier", earlier).withColumn("_bare", F.col("content").isNull())
    out = exported_content(convert(marked, registry, **options), format)
    bare = F.col("_bare") & F.col("_earlier").isNull()
    holds = bare & F.coalesce("_container", F.lit(False))
    code = F.when(F.col("_earlier").isNotNull(), F.col("_earlier")).when(holds, F.lit(None)).when(bare, EMPTY_DOCUMENT).otherwise(F.col("error_code"))
    out = out.withColumn("error_code", code)
    return out.withColumn("status", F.when(F.col("error_code").isNull(), PARSED).otherwise(FAILED)).drop("_earlier", "_bare", "_container")


def documents(spark: SparkSession, addresses: list[str], format: str = "markdown", registry: Registry | None = None, **options) -> DataFrame:
    """Addresses of files, folders and web pages, fetched by their scheme, converted and
    rendered, with the status of each; folders come with what they hold."""
    return parse_documents(fetch(spark, addresses), format, registry, **options)


def convert_folder(spark: SparkSession, path: str, format: str = "markdown", registry: Registry | None = None, **options) -> DataFrame:
    """All files below a folder, converted and rendered."""
    files = read_files(spark, path).drop("status", "error_code")
    return export(files, format, registry, **options)


def write_exports(df: DataFrame, path: str) -> None:
    """Rendered documents as Parquet, a folder a format."""
    df.select("doc_key", "title", "author", "status", "error_code", "format", "output").write.partitionBy("format").mode("overwrite").parquet(path)
