"""Token counts of flat token files by a separator scan.

A flat token file holds ids of a fixed width and nothing else; documents end in an
end-of-document id and there is no index. Files are read in blocks; a vectorised search finds
the ends in a block, which gives the sizes of the documents inside it, and the tokens before
its first and after its last end. A prefix sum of the ends over a file's blocks numbers the
documents, and pieces of one document that lie in several blocks are added up.

The files are written with an index beside them, a line for each document with its place and
key, by the same tasks: of each row the writer makes two, one for either folder, and both
folders' files have the task's number. No later read has to meet the same rows again.

Defined results: null and empty texts are documents of 0 tokens; rows with a null or repeated
key are documents of their own; an empty table gives no rows; long texts are encoded whole;
columns of df other than key and text aren't read. An empty file has no documents; two ends in a row are a document of 0 tokens;
tokens after the last end are a document that isn't ended (``ended`` false); a file whose size
isn't whole tokens has its last bytes dropped and ``ragged`` true on its rows. Files above
RANGED bytes are read by ranges in many tasks, which needs a store that Arrow can open (local
or mounted folders, hdfs, s3, gs); smaller ones come through Spark's reader, from any store.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import bounded_batches, exists

BLOCK_BYTES = 1 << 20
#: Larger files are read by ranges.
RANGED = 256 << 20
#: Hexadecimal digits of the index, and others for ends that begin with one of them.
DIGITS = "0123456789ABCDEF", "ghijklmnopqrstuv"
#: Characters of a path that stand for themselves in a URI.
SAFE = "/:@!$&'()*+,;=~"
KINDS = {2: "<u2", 4: "<u4"}
_coders: dict[tuple[str, str], object] = {}


def file_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def coder(path: str, pattern: str, data: bytes | None = None):
    """One tiktoken encoding a worker process; data is the file's content, if it was sent."""
    if (path, pattern) not in _coders:
        import tiktoken

        lines = (file_bytes(path) if data is None else data).splitlines()
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _coders[path, pattern] = tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _coders[path, pattern]


def write_token_files(df: DataFrame, out: str, path: str, pattern: str, end: int, text: str = "text", key: str = "doc_id", width: int = 2) -> None:
    """Writes the ids of ``text`` as flat files in out/kind=ids, each document followed by
    ``end``, and the index in out/kind=index.

    Spark's text sink writes a row's bytes as they are and its line separator after each row;
    the separator here is the end id's bytes. A null text has no ids. Files follow df's
    partitions, and documents their rows: the two folders' writers stay open together, so that
    no task sorts its rows."""
    spark = df.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(file_bytes(path))  # of the vocabulary's size

    @F.arrow_udf("binary")
    def ids(column: pa.Array) -> pa.Array:
        encode = coder(path, pattern, shared.value).encode_ordinary
        return pa.array([np.array(encode(t or ""), KINDS[width]).tobytes() for t in column.to_pylist()], pa.binary())

    mark = int(end).to_bytes(width, "little").decode("latin-1")
    digits = digits_of(mark)
    place = F.lpad(F.hex(F.expr(f"monotonically_increasing_id() & {(1 << 33) - 1}")), 9, "0")
    name = F.concat(place, F.when(F.col(key).isNull(), "0").otherwise(F.concat(F.lit("1"), F.hex(F.col(key).cast("string").cast("binary")))))
    rows = df.select(F.translate(name, DIGITS[0], digits).alias("name"), ids(F.col(text)).alias("ids"))
    both = F.array(F.struct(F.lit("ids").alias("kind"), F.col("ids").cast("string").alias("value")), F.struct(F.lit("index").alias("kind"), F.col("name").alias("value")))
    writers = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(writers)
    spark.conf.set(writers, "4")
    try:
        rows.select(F.explode(both).alias("row")).select("row.*").write.option("encoding", "ISO-8859-1").option("lineSep", mark).partitionBy("kind").text(out)
    finally:
        spark.conf.set(writers, before)


def digits_of(mark: str) -> str:
    """Digits that no separator begins with, so that none is found inside an index line."""
    return DIGITS[mark[0] in DIGITS[0]]


def read_index(spark: SparkSession, out: str, end: int, width: int = 2) -> DataFrame:
    """The index of files by write_token_files: part (a file's number), document (its place in
    the file, from 0) and key, as text."""
    mark = int(end).to_bytes(width, "little").decode("latin-1")
    schema = "value string"
    if not exists(spark, f"{out}/kind=index"):  # of an empty table
        return spark.createDataFrame([], "part long, document long, key string")
    lines = spark.read.schema(schema).option("encoding", "ISO-8859-1").option("lineSep", mark).text(f"{out}/kind=index")
    value = F.translate("value", digits_of(mark), DIGITS[0])
    key = F.when(F.substring(value, 10, 1) == "1", F.unhex(F.substring(value, 11, 1 << 30)).cast("string"))
    return lines.select(part_of(F.col("_metadata.file_path")).alias("part"), F.conv(F.substring(value, 1, 9), 16, 10).cast("long").alias("document"), key.alias("key"))


def part_of(file: Column) -> Column:
    """The number of the task that wrote a file."""
    return F.regexp_extract(file, r"part-(\d+)[^/]*$", 1).cast("long")


def scan_blocks(blocks: DataFrame, end: int, width: int = 2) -> DataFrame:
    """blocks (file, block, bytes) as file, block, ends, pieces: the sizes before the first
    end, between ends, and after the last one (ends + 1 numbers)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends, pieces = [], []
            for raw in b.column("bytes"):
                ids = np.frombuffer(raw.as_buffer(), KINDS[width])
                at = np.flatnonzero(ids == end)
                ends.append(len(at))
                pieces.append(np.diff(at, prepend=-1, append=len(ids)) - 1)
            yield pa.RecordBatch.from_arrays([b.column("file"), b.column("block"), pa.array(ends, pa.int64()), pa.array(pieces, pa.list_(pa.int64()))], names=["file", "block", "ends", "pieces"])

    return blocks.select("file", "block", "bytes").mapInArrow(scan, "file string, block long, ends long, pieces array<long>")


def read_blocks(spark: SparkSession, path: str, width: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The blocks (file, block, bytes) of all files in a folder, without a ragged end."""
    step = block_bytes // width * width
    whole = (F.col("length") - F.col("length") % width).alias("whole")
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("whole") - 1) / step)))
    at = F.col("block") * step
    size = F.least(F.lit(step).cast("long"), F.col("whole") - at).cast("int")
    files = spark.read.format("binaryFile").load(path)
    small = files.where(F.col("length") <= RANGED).select(F.col("path").alias("file"), "content", whole).where("whole > 0").withColumn("block", block)
    small = small.select("file", "block", F.substring(F.col("content"), (at + 1).cast("int"), size).alias("bytes"))
    large = files.where(F.col("length") > RANGED).select(F.col("path").alias("file"), whole)
    if large.isEmpty():
        return small
    ranges = large.withColumn("block", block).select("file", "block", at.alias("at"), size.alias("size"))
    ranges = ranges.repartition(F.col("file"), F.floor(F.col("block") * step / RANGED))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from urllib.parse import quote

        from pyarrow import fs

        for b in batches:
            for file, k, begin, n in zip(*(c.to_pylist() for c in b.columns)):
                # Spark's paths are plain text: Arrow takes a URI, in which some characters are escaped
                scheme, _, path = file.partition(":") if "://" in file else ("file", "", "//" + file.removeprefix("file:"))
                store, name = fs.FileSystem.from_uri(f"{scheme}:{quote(path, safe=SAFE)}")
                with store.open_input_file(name) as f:
                    yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([k], pa.int64()), pa.array([f.read_at(n, begin)], pa.binary())], names=["file", "block", "bytes"])

    return small.unionByName(ranges.mapInArrow(read, "file string, block long, bytes binary"))


def token_counts(spark: SparkSession, path: str, end: int, width: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each document of the files in a folder: file, document (its number in the
    file, from 0), n_tokens, ended, ragged."""
    bounded_batches(spark)
    if not exists(spark, path):  # of an empty table
        return spark.createDataFrame([], "file string, document long, n_tokens long, ended boolean, ragged boolean")
    found = scan_blocks(read_blocks(spark, path, width, block_bytes), end, width)
    before = Window.partitionBy("file").orderBy("block")
    numbered = found.withColumn("first", F.sum("ends").over(before.rowsBetween(Window.unboundedPreceding, -1)))
    pieces = numbered.select("file", F.coalesce("first", F.lit(0)).alias("first"), "ends", F.posexplode("pieces").alias("k", "n"))
    docs = pieces.groupBy("file", (F.col("first") + F.col("k")).alias("document")).agg(F.sum("n").alias("n_tokens"), F.max(F.col("k") < F.col("ends")).alias("ended"))
    ragged = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), (F.col("length") % width > 0).alias("ragged"))
    return docs.where("ended or n_tokens > 0").join(ragged, "file")
