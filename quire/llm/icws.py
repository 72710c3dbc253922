"""MinHash near-dedup by improved consistent weighted sampling (ICWS).

A document is a weighted set of shingles of five words. A shingle's weight is TF-IDF: (1 + ln
count) * idf, where idf = 1 + IDF_SHARE * ln(N / df) / ln(N / floor) runs from 1 (in all
documents) to 1 + IDF_SHARE (rare). df counts documents over the whole corpus in COUNTERS
hashed counters less their median load; floor is what can't be told from the noise of other
shingles in a counter (four deviations, 1 in a small corpus). Shingles rarer than floor have
one weight, so that a weight never follows chance collisions, and memory is the same for a
corpus of any size. The IDF term is kept to IDF_SHARE: with a free logarithm the shingles of a
group of thousands of near copies would weigh almost nothing against their few changed words,
and copies of plain similarity above 0.8 would fall below it (README gives figures).

ICWS draws HASHES samples (shingle, step) a document; two documents share a sample with the
probability of their weighted Jaccard similarity. BANDS bands of ROWS samples give buckets.
In a bucket the document of least hash is the centre, and every other member is compared with
it on whole texts (exact weighted Jaccard of 0.8 or more makes a link). The centre has then met
all others and leaves; the rest stay, whether they matched or not, and texts that the links so far
join get one label. A bucket is settled once its members have one label. Buckets of more than
LARGE members that aren't get up to ROUNDS centres in all, those with the most links first, so
that the middle of a large group is soon found. What is then unsettled is compared exactly,
each pair of texts of different labels, in blocks of BLOCK members. No link between texts that
share a bucket is thus missed; texts that aren't near but share a large bucket cost all their
pairs, as nothing else shows that none is near. Copies of one text count once: texts are
collapsed by hash before anything is paired. Components of the links are the groups.

Defined results: words are runs between white space; a text of fewer than five words is one
shingle; null and texts without words are never near anything but are kept as they are (equal
ones are not grouped); a group's name is its least id. Of rows that repeat an id with the same
text one is kept; an id must not have several texts. Rows with a null id pass with a null group
and are kept. An empty table gives no rows; very long texts are compared whole; texts of equal
hash count as equal. Columns of df with an output's name are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quire.llm.common import bounded_batches, compact, give_back, mixed, remove, run_hashes, runs, scratch, segment_positions, settled, texts_to_bytes
from quire.llm.components import components

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 20, 4
HASHES = BANDS * ROWS
#: Centres that a bucket of more than LARGE members may have before all its pairs are compared.
ROUNDS, LARGE = 4, 4096
#: Members, and about how many bytes of text, of one side of a block of comparisons.
BLOCK, BLOCK_BYTES = 256, 4 << 20
IDF_SHARE = 0.5
#: Document frequencies are counted in this many hashed counters.
COUNTERS = 1 << 20
#: The random numbers of ICWS come from tables of this many entries.
TABLE_BITS = 14
GROUP = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's distinct shingle hashes in order, their counts, and each text's first."""
    starts, ends, first = runs(~_SPACE[data], offsets)
    words = run_hashes(data, starts, ends)
    n = np.diff(first)
    size = np.maximum(n - WORDS + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(n)), size)
    begin = np.repeat(first[:-1] - (np.cumsum(size) - size), size) + np.arange(len(doc))
    code = np.zeros(len(doc), np.uint64)
    last = np.repeat(first[1:], size)
    for j in range(WORDS):
        at = begin + j
        word = np.where(at < last, words[np.minimum(at, max(len(words) - 1, 0))] if len(words) else np.uint64(0), np.uint64(0))
        code = code * np.uint64(0x9E3779B97F4A7C15) + word
    code = mixed(code)
    order = np.lexsort((code, doc))
    code, doc = code[order], doc[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return code[at], np.diff(np.append(at, len(code))), np.searchsorted(doc[at], np.arange(len(n) + 1))


def counter_of(code: np.ndarray) -> np.ndarray:
    return (mixed(code ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(64 - COUNTERS.bit_length() + 1)).astype(np.intp)


def grouped(text: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of about GROUP bytes: first and last row, bytes and offsets."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    k = 0
    while k < len(text):
        j = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + GROUP, "right")))
        yield k, j, *texts_to_bytes(text.slice(k, j - k))
        k = j


class Weights:
    """TF-IDF weights from hashed document counts."""

    def __init__(self, counts: np.ndarray, documents: int, share: float = IDF_SHARE) -> None:
        load = float(np.median(counts))
        self.floor = max(1.0, 4 * 1.4826 * float(np.median(np.abs(counts - load))))
        df = np.maximum(counts - load, self.floor)
        span = math.log(max(documents / self.floor, math.e))
        self.idf = (1 + share * np.maximum(math.log(max(documents, 1)) - np.log(df), 0) / span).astype(np.float32)

    def of(self, code: np.ndarray, count: np.ndarray) -> np.ndarray:
        return ((1 + np.log(count)) * self.idf[counter_of(code)]).astype(np.float32)


class Sampler:
    """ICWS: for each of HASHES draws the table gives r and c (gamma of shape 2) and beta
    (uniform); of all shingles the one of least c / (y e^r) is the sample, with its step t,
    where t = floor(ln weight / r + beta) and ln y = r (t - beta)."""

    def __init__(self, hashes: int = HASHES, seed: int = 7) -> None:
        random = np.random.default_rng(seed)
        n = 1 << TABLE_BITS
        self.r = random.gamma(2, 1, n).astype(np.float32)
        self.log_c = np.log(random.gamma(2, 1, n)).astype(np.float32)
        self.beta = random.uniform(0, 1, n).astype(np.float32)
        self.keys = random.integers(1, 1 << 63, (hashes, 2), np.uint64) | np.uint64(1)
        self.inverse = (1 / self.r).astype(np.float32)

    def samples(self, code: np.ndarray, weight: np.ndarray, first: np.ndarray) -> np.ndarray:
        """(documents, hashes) sample hashes; documents must have shingles."""
        log_w = np.log(weight).astype(np.float32)
        out = np.empty((len(first) - 1, len(self.keys)), np.uint64)
        shift, low = np.uint64(64 - TABLE_BITS), np.uint64((1 << TABLE_BITS) - 1)
        size = np.diff(first)
        for k, (mul, add) in enumerate(self.keys):
            z = (code ^ add) * mul
            a = (z >> shift).astype(np.intp)
            b = (z >> np.uint64(24) & low).astype(np.intp)
            r, beta = self.r[a], self.beta[b]
            t = np.floor(log_w * self.inverse[a] + beta)
            value = self.log_c[(z >> np.uint64(38) & low).astype(np.intp)] - r * (t - beta + 1)
            least = np.minimum.reduceat(value, first[:-1])
            at = np.flatnonzero(value == np.repeat(least, size))
            doc = np.searchsorted(first, at, "right") - 1
            one = np.ones(len(at), bool)
            if len(at) > len(least):  # ties: the least code
                by = np.lexsort((code[at], doc))
                at, doc = at[by], doc[by]
                one[1:] = doc[1:] != doc[:-1]
            chosen = at[one]
            out[:, k] = mixed(code[chosen] + t[chosen].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return out

    def bands(self, text: pa.Array, weights: Weights) -> list[bytes | None]:
        """Each text's band keys as BANDS 64-bit numbers; None for a text without words."""
        out: list[bytes | None] = [None] * len(text)
        for k, _, data, offsets in grouped(text):
            code, count, first = shingles(data, offsets)
            has = np.flatnonzero(np.diff(first))
            if not len(has):
                continue
            drawn = self.samples(code, weights.of(code, count), np.append(first[has], first[-1]))
            key = np.zeros((len(has), BANDS), np.uint64)
            for j in range(ROWS):
                key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + drawn[:, j::ROWS])
            for d, row in zip(has.tolist(), key):
                out[k + d] = row.tobytes()
        return out


def document_counts(df: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """Documents with words, and how many hold each counter's shingles (at most COUNTERS
    rows reach the driver)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, documents = np.zeros(COUNTERS, np.int64), 0
        for b in batches:
            for _, _, data, offsets in grouped(b.column(0)):
                code, _, first = shingles(data, offsets)
                documents += int((np.diff(first) > 0).sum())
                total += np.bincount(counter_of(code), minlength=COUNTERS)
        has = np.flatnonzero(total)
        # a task's counters are sent as rows of (part, packed counts), so that few rows move
        for k in range(0, len(has), 1 << 16):
            part = has[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], names=["at", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([documents], pa.int64())], names=["at", "n"])
        total = has = None
        give_back()

    found = df.select(text).mapInArrow(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    at, n = found.column("at").to_numpy(), found.column("n").to_numpy()
    counts = np.zeros(COUNTERS, np.int64)
    counts[at[at >= 0]] = n[at >= 0]
    return counts, int(n[at < 0].sum())


def similarity(a: str | None, b: str | None, weights: Weights) -> float:
    """Weighted Jaccard similarity of two texts."""
    data, offsets = texts_to_bytes(pa.array([a, b], pa.large_string()))
    code, count, first = shingles(data, offsets)
    weight = weights.of(code, count).astype(np.float64)
    x, y = slice(0, first[1]), slice(first[1], first[2])
    _, i, j = np.intersect1d(code[x], code[y], assume_unique=True, return_indices=True)
    both = np.minimum(weight[x][i], weight[y][j]).sum()
    either = weight.sum() - both  # maxima add up to both sides less the minima
    return float(both / either) if either else 0.0


def block_links(text: pa.Array, keys: np.ndarray, label: np.ndarray, side: np.ndarray, band: int, weights: Weights, threshold: float) -> list[tuple[int, int]]:
    """Rows of a bucket's block that are near, one link for each two labels that it joins. Rows
    of one label needn't meet, nor rows of one side where there are two, nor such as have met in
    the bucket of an earlier band; all others are compared, earlier rows first."""
    label = label.copy()
    codes, loads, sizes = [], [], []
    for _, _, data, offsets in grouped(text):
        code, count, first = shingles(data, offsets)
        codes.append(code)
        loads.append(weights.of(code, count).astype(np.float64))
        sizes.append(np.diff(first))
    names, code = np.unique(np.concatenate(codes), return_inverse=True)
    load, size = np.concatenate(loads), np.concatenate(sizes)
    first = np.append(0, np.cumsum(size))
    whole = np.add.reduceat(load, first[:-1])
    two = side.min() != side.max()
    own, out = np.zeros(len(names)), []
    for a in range(len(text) - 1):
        may = label[a + 1 :] != label[a]
        if two:
            may &= side[a + 1 :] != side[a]
        may &= np.minimum(whole[a + 1 :], whole[a]) >= (threshold - 1e-6) * np.maximum(whole[a + 1 :], whole[a])
        may &= ~(keys[a + 1 :, :band] == keys[a, :band]).any(axis=1)
        others = a + 1 + np.flatnonzero(may)
        if not len(others):
            continue
        mine = slice(first[a], first[a + 1])
        own[code[mine]] = load[mine]
        n = size[others]
        at = np.repeat(first[others], n) + segment_positions(n)
        both = np.add.reduceat(np.minimum(own[code[at]], load[at]), np.cumsum(n) - n)
        own[code[mine]] = 0
        value = both / (whole[a] + whole[others] - both)
        near = value >= threshold
        for k in np.flatnonzero(np.abs(value - threshold) < 1e-6):  # sums in another order: as pairs elsewhere are decided
            x, y = sorted((text[a].as_py(), text[int(others[k])].as_py()))
            near[k] = similarity(x, y, weights) >= threshold
        for b in others[near].tolist():
            if label[b] != label[a]:
                out.append((a, b))
                label[label == label[b]] = label[a]
    return out


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """(key, group_id, copy_of, kept) for each row of df: the least id of its group, the least
    id of equal texts, and whether the row is its group's one to keep."""
    spark = df.sparkSession
    bounded_batches(spark)
    counts, documents = document_counts(df, text)
    shared = spark.sparkContext.broadcast((Weights(counts, documents), Sampler()))  # COUNTERS numbers

    @F.arrow_udf("binary")
    def bands(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weights, sampler = shared.value
        for column in batches:
            yield pa.array(sampler.bands(column, weights), pa.binary())
        give_back()

    t = F.col(text)
    signed = settled(df.select(F.col(key).alias("id"), F.sha2(t.cast("binary"), 256).alias("hash"), F.octet_length(t).cast("long").alias("bytes"), bands(t).alias("bands")))
    texts = settled(signed.where("bands is not null and id is not null").groupBy("hash").agg(F.min("id").alias("rep"), F.first("bytes").alias("bytes"), F.first("bands").alias("bands")))
    place = F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.struct(k.cast("byte").alias("band"), F.substring(F.col("bands"), (k * 8 + 1).cast("int"), F.lit(8)).alias("bucket"))))
    members = settled(texts.select("rep", place.alias("p")).select("rep", "p.band", "p.bucket"))

    # Only texts that share a bucket with another one can be in a pair: these are kept apart,
    # so that the rounds below don't shuffle the whole table. Tables of a row a bucket are
    # settled before they are joined, so that a bucket of very many members can be split.
    shared_buckets = members.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "bucket")
    paired = settled(members.join(compact(shared_buckets), ["band", "bucket"], "left_semi"))
    texts_at = scratch(spark, "paired-texts")
    whole = df.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), t.alias("text"))
    whole.join(paired.select(F.col("rep").alias("id")).distinct().hint("shuffle_hash"), "id", "left_semi").write.parquet(texts_at)
    whole = spark.read.parquet(texts_at)

    @F.arrow_udf("boolean")
    def near(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        weights, _ = shared.value
        for a, b in batches:
            yield pa.array([similarity(x.as_py(), y.as_py(), weights) >= threshold for x, y in zip(a, b)], pa.bool_())
        give_back()

    def verified(pairs: DataFrame) -> DataFrame:
        """pairs (a, b) with whether they are near; texts meet their pairs by two joins."""
        one = pairs.hint("shuffle_hash").join(whole.withColumnsRenamed({"id": "a", "text": "_a"}), "a")
        two = one.join(whole.withColumnsRenamed({"id": "b", "text": "_b"}), "b")
        return settled(two.select("a", "b", near("_a", "_b").alias("near")))

    def unsettled(rows: DataFrame) -> DataFrame:
        """The rows of buckets with several labels, with label and the bucket's rows n. A label
        is the least text within two links, so that texts of one label are of one component."""
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        one = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("one"))
        two = both.join(one.withColumnsRenamed({"a": "b"}), "b").groupBy(F.col("a").alias("rep")).agg(F.min("one").alias("two"))
        rows = settled(rows.join(two, "rep", "left").withColumn("label", F.least("rep", "two")).drop("two"))
        many = rows.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
        return settled(rows.join(compact(many.select("band", "bucket", "n")), ["band", "bucket"]))

    def with_degree(rows: DataFrame) -> DataFrame:
        degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("degree"))
        return rows.join(degree, "rep", "left").fillna(0, "degree")

    links = paired.select(F.col("rep").alias("a"), F.col("rep").alias("b")).where("false")
    left, rest = paired.withColumns({"label": F.col("rep"), "degree": F.lit(0)}), []
    for k in range(ROUNDS):
        # the middle of a group is near to the centres that its other members failed against
        hashed = F.xxhash64("rep") if not k else F.xxhash64("rep", "band", F.lit(k))
        order = F.struct(-F.col("degree"), hashed, F.col("rep").alias("r"), F.col("label").alias("l"))
        ends = left.groupBy("band", "bucket").agg(F.min(order).alias("e")).select("band", "bucket", F.col("e.r").alias("centre"), F.col("e.l").alias("_l"))
        placed = settled(left.join(compact(ends), ["band", "bucket"]).where("rep <> centre"))
        pairs = placed.where("label <> _l").select(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b")).distinct()
        links = compact(links.unionByName(verified(compact(pairs)).where("near").select("a", "b")))
        left = unsettled(placed.select("rep", "band", "bucket"))
        last = k + 1 == ROUNDS or left.where(F.col("n") > LARGE).isEmpty()
        rest.append(left if last else left.where(F.col("n") <= LARGE))
        if last:
            break
        left = with_degree(left.where(F.col("n") > LARGE))

    # What the centres left open: all pairs of different components, in blocks.
    open_ = rest[0] if len(rest) == 1 else unsettled(reduce(DataFrame.unionByName, rest).select("rep", "band", "bucket"))
    if not open_.isEmpty():
        open_ = settled(with_degree(open_.join(texts.select("rep", "bytes", "bands"), "rep")))
        blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("bytes") / BLOCK_BYTES)).cast("int")
        sized = compact(open_.groupBy("band", "bucket").agg(blocks.alias("blocks")))
        own = open_.join(sized, ["band", "bucket"]).withColumn("side", F.pmod(F.xxhash64("rep", "band"), F.col("blocks")).cast("int"))
        dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("side", "other"), "j": F.greatest("side", "other")})
        dealt = dealt.hint("shuffle_hash").join(whole.withColumnRenamed("id", "rep"), "rep").select("band", "bucket", "i", "j", "side", "rep", "label", "degree", "bands", "text")
        kind = pa.schema([("a", to_arrow_type(members.schema["rep"].dataType)), ("b", to_arrow_type(members.schema["rep"].dataType))])

        def compare(block: pa.Table) -> pa.Table:
            weights, _ = shared.value
            block = block.sort_by([("degree", "descending"), ("rep", "ascending")])
            side = block["side"].to_numpy()
            band, i, j = (block[c][0].as_py() for c in ("band", "i", "j"))
            near: list[tuple[int, int]] = []
            if i == j or side.min() != side.max():  # else a block that met an empty one
                keys = np.frombuffer(b"".join(block["bands"].to_pylist()), np.uint64).reshape(-1, BANDS)
                label = pc.dictionary_encode(block["label"].combine_chunks()).indices.to_numpy()
                near = block_links(block["text"].combine_chunks(), keys, label, side, band, weights, threshold)
            rep = block["rep"].combine_chunks()
            a, b = (rep.take(pa.array([x[e] for x in near], pa.int64())) for e in (0, 1))
            return pa.Table.from_arrays([a.cast(kind.field(0).type), b.cast(kind.field(1).type)], schema=kind)

        found = dealt.groupBy("band", "bucket", "i", "j").applyInArrow(compare, links.schema)
        links = settled(links.unionByName(found))
    remove(spark, texts_at)
    group = components(links).withColumnsRenamed({"node": "rep", "component": "group_id"})
    named = compact(texts.select("hash", "rep").join(group, "rep", "left").select("hash", F.col("rep").alias("copy_of"), F.coalesce("group_id", "rep").alias("group_id")))
    out = signed.select("id", "hash", F.col("bands").isNotNull().alias("worded")).join(named, "hash", "left")
    own = F.when(F.col("worded") & F.col("id").isNotNull(), F.col("group_id")).otherwise(F.col("id"))
    copy = F.when(F.col("worded") & F.col("id").isNotNull(), F.col("copy_of")).otherwise(F.col("id"))
    out = out.select(F.col("id").alias(key), own.alias("group_id"), copy.alias("copy_of"))
    out = out.withColumn("kept", F.col(key).eqNullSafe(F.col("group_id")))
    again = repeats(signed)
    if again is None:
        return out
    # Of rows that repeat an id and text, the first is kept.
    out = out.join(again.withColumnsRenamed({"id": key}), key, "left")
    order = Window.partitionBy(key, "_again").orderBy("group_id")
    some = out.where("_again").withColumn("kept", F.col("kept") & (F.row_number().over(order) == 1))
    return out.where("_again is null").unionByName(some).drop("_again")


def repeats(rows: DataFrame) -> DataFrame | None:
    """The ids that stand in several rows (id, _again), or None if there's none."""
    found = compact(rows.where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", F.lit(True).alias("_again")))
    return None if found.isEmpty() else found


def deduplicate(df: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """df with one row of each group of near duplicates, that of the least id; rows without an
    id stay. Of rows that repeat an id, one stays."""
    drop = near_duplicates(df, text, key, threshold).where("not kept").select(F.col(key).alias("__quire_drop"), (F.col(key) == F.col("group_id")).alias("__quire_same"))
    drop = compact(drop.distinct())
    out = df.join(drop.where("not __quire_same").select("__quire_drop"), df[key] == F.col("__quire_drop"), "left_anti")
    again = drop.where("__quire_same").select("__quire_drop")
    if again.isEmpty():
        return out
    hit = out[key] == F.col("__quire_drop")
    return out.join(again, hit, "left_anti").unionByName(out.join(again, hit, "left_semi").dropDuplicates([key]))
