"""Files and web addresses as input rows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.text import file_extension
from quire.functions.types import is_supported
from quire.kernels.model import DOCUMENT_TYPE_NOT_SUPPORTED, INVALID_URL, NO_ACCESS, TOO_LARGE
from quire.operators.convert import LARGEST_FILE
from quire.plans.schema import AWAITING, DOWNLOADED, FAILED

#: Seconds that one request may take.
TIMEOUT = 30


def parent_of(key: Column) -> Column:
    return F.nullif(F.regexp_replace(key, "/[^/]*/?$", ""), F.lit(""))


def read_files(spark: SparkSession, path: str, recursive: bool = True, largest: int = LARGEST_FILE) -> DataFrame:
    """The files at a path or below a folder, hidden ones left out: doc_key, parent_key,
    filename, url, content (null above ``largest`` bytes), length, modified, fetched_at,
    status, error_code. A file's bytes are read only by tasks that need them."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    small = F.col("length") <= largest
    return found.select(
        F.col("path").alias("doc_key"),
        parent_of(F.col("path")).alias("parent_key"),
        F.element_at(F.split("path", "/"), -1).alias("filename"),
        F.col("path").alias("url"),
        F.when(small, F.col("content")).alias("content"),
        "length",
        F.col("modificationTime").alias("modified"),
        F.current_timestamp().alias("fetched_at"),
        F.lit(DOWNLOADED).alias("status"),
        F.lit(None).cast("string").alias("error_code"),
    )


def new_documents(df: DataFrame, url: str = "url", images: bool = False) -> DataFrame:
    """Rows of addresses as documents that await their fetch; a type that isn't supported fails
    at once (folders, which have no extension, are taken)."""
    ext = file_extension(F.lit(None).cast("string"), F.col(url))
    bad = F.col(url).isNull() | (F.trim(F.col(url)) == "")
    known = ext.isNull() | is_supported(ext, images)
    out = df.withColumn("doc_key", F.col(url)).withColumn("parent_key", parent_of(F.col(url)))
    code = F.when(bad, INVALID_URL).when(~known, DOCUMENT_TYPE_NOT_SUPPORTED)
    return out.withColumn("error_code", code).withColumn("status", F.when(code.isNull(), AWAITING).otherwise(FAILED))


def fetch_urls(df: DataFrame, url: str = "url", timeout: int = TIMEOUT, largest: int = LARGEST_FILE) -> DataFrame:
    """df with content, mime_type, status and error_code from one GET for each http(s) address;
    an answer outside of 2xx is badServerResponse, one of more than ``largest`` bytes tooLarge.
    Redirects stay on the web. A task sends one request at a time. Files are read by
    read_files()."""
    added = T.StructType.fromDDL("content binary, mime_type string, status string, error_code string")
    kept = [f for f in df.schema.fields if f.name not in added.names]

    def one(address: str | None) -> tuple[bytes | None, str | None, str, str | None]:
        import urllib.error
        import urllib.request

        if not address or not address.lower().startswith(("http://", "https://")):
            return None, None, FAILED, INVALID_URL
        web = urllib.request.OpenerDirector()
        for handler in (urllib.request.ProxyHandler, urllib.request.HTTPHandler, urllib.request.HTTPSHandler, urllib.request.HTTPDefaultErrorHandler, urllib.request.HTTPRedirectHandler, urllib.request.HTTPErrorProcessor):
            web.add_handler(handler())
        try:
            with web.open(address, timeout=timeout) as answer:
                content = answer.read(largest + 1)
                if len(content) > largest:
                    return None, answer.headers.get("Content-Type"), FAILED, TOO_LARGE
                return content, answer.headers.get("Content-Type"), DOWNLOADED, None
        except urllib.error.HTTPError:
            return None, None, FAILED, "badServerResponse"
        except (OSError, ValueError):
            return None, None, FAILED, NO_ACCESS

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(len(b)):
                content, mime, status, error = one(b.column(url)[k].as_py())
                own = b.slice(k, 1).select([f.name for f in kept]).columns
                yield pa.RecordBatch.from_arrays([*own, pa.array([content], pa.binary()), *(pa.array([x], pa.string()) for x in (mime, status, error))], names=[*(f.name for f in kept), *added.names])

    return df.mapInArrow(fetch, T.StructType(kept + added.fields))


FETCHED = "doc_key string, parent_key string, filename string, url string, content binary, mime_type string, status string, error_code string"


def fetch(spark: SparkSession, addresses: list[str], recursive: bool = True, timeout: int = TIMEOUT, largest: int = LARGEST_FILE) -> DataFrame:
    """Documents (FETCHED) of addresses by their scheme: web addresses by one request each, all
    others, with or without a scheme, as files and folders of any store that Spark reads, with
    what is below folders. A folder's files have its address as parent_key, and the folder is a
    row without content. An address that can't be reached is a failed row; the others go on.
    For tables of web addresses see fetch_urls()."""
    columns = [f.name for f in T.StructType.fromDDL(FETCHED).fields]
    web = [a for a in dict.fromkeys(addresses) if a.lower().startswith(("http://", "https://"))]
    found, bad = [], []
    for a in dict.fromkeys(addresses):
        if a in web:
            continue
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(a)
            store = at.getFileSystem(spark._jsc.hadoopConfiguration())
            if not store.exists(at):
                raise FileNotFoundError(a)
            folder = store.getFileStatus(at).isDirectory()
        except Exception as e:  # the JVM's errors: no such scheme, or no access
            bad.append((a, INVALID_URL if "IllegalArgument" in str(e) or "UnsupportedFileSystem" in str(e) or "No FileSystem" in str(e) else NO_ACCESS))
            continue
        files = read_files(spark, a, recursive, largest).withColumn("mime_type", F.lit(None).cast("string"))
        code = F.when(F.col("length") > largest, TOO_LARGE)
        files = files.withColumn("error_code", code).withColumn("status", F.when(code.isNull(), DOWNLOADED).otherwise(FAILED))
        if folder:
            files = files.withColumn("parent_key", F.lit(a))
            bad.append((a, None))
        found.append(files.select(*columns))
    rows = [(a, None, a.rstrip("/").rpartition("/")[2], a, None, None, FAILED if code else DOWNLOADED, code) for a, code in bad]
    found.append(spark.createDataFrame(rows, FETCHED))
    if web:
        asked = new_documents(spark.createDataFrame([(a,) for a in web], "url string")).drop("status", "error_code")
        got = fetch_urls(asked, timeout=timeout, largest=largest).withColumn("filename", F.lit(None).cast("string"))
        found.append(got.select(*columns))
    return reduce(DataFrame.unionByName, found)
