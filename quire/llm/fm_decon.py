"""Benchmark decontamination with FM-indexes.

Each block of training documents gets an FM-index over its words: the suffix array of the word
sequence, its Burrows-Wheeler transform in a wavelet tree (by levels, one bit vector with
counts a level), and every eighth suffix position. All windows of the benchmark are searched
backwards at once by wavelet-tree ranks; occurrences are located from the sampled positions by
LF steps, and the words they cover are merged into removal spans.

Words outside the benchmark's vocabulary can't be part of a window. They become separators and
runs of known words shorter than the shortest window are left out of the index, so its size
follows the text that could match. Nothing is shuffled; a task holds one block of text at a
time, and searches its index for one block of the benchmark after another, each of bounded size.

Defined results: null and empty texts have no words, no hits and aren't contaminated; a null
or empty benchmark item has no windows; items of equal id count once; an item with a null id
makes hits but isn't listed. Rows that repeat have equal results; long texts are searched whole,
in an index of their own; an empty table gives no rows. Columns of df with an output's name are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import bounded_batches, give_back, run_hashes, runs, segment_positions, texts_to_bytes

#: Lower-case bytes, and which of them belong to a word: digits, letters and all of non-ASCII.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
IN_WORD = np.zeros(256, bool)
IN_WORD[0x30:0x3A] = IN_WORD[0x61:0x7B] = IN_WORD[0x80:] = True
#: Bytes of text that get one index, and every how many positions are sampled.
BLOCK = 4 << 20
SAMPLE = 8
#: Benchmark bytes of a block of items, of which a worker holds one at a time.
QUERY_BLOCK = 2 << 20
OUTPUT = {"n_words": "long", "n_hit": "long", "items": "array<string>", "spans": "array<struct<start:bigint,end:bigint>>"}


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word, and the first word of each text."""
    data = LOWER[data]
    starts, ends, first = runs(IN_WORD[data], offsets)
    return run_hashes(data, starts, ends), starts, ends, first


@dataclass
class Block:
    """The windows of some benchmark items. ``text`` has the items' words as symbols, places in
    the vocabulary plus 2; windows are given by their first words."""

    text: np.ndarray
    windows: dict[int, np.ndarray]  # by length
    owners: dict[int, tuple[np.ndarray, np.ndarray]]  # by length: bounds in, and item numbers
    items: list[str | None]


@dataclass
class Phrases:
    """A benchmark: the hashes of its words, in order, its shortest window, and its blocks, or
    shared variables that hold them."""

    vocabulary: np.ndarray
    shortest: int
    blocks: list

    def each(self) -> Iterator[Block]:
        for b in self.blocks:
            if isinstance(b, Block):
                yield b
                continue
            yield b.value
            if len(self.blocks) > 1:  # a worker keeps one block only; the next use loads it again
                b.__dict__.pop("_value", None)


def words_in(items: list[tuple[str | None, str | None]]) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = texts_to_bytes(pa.array([t for _, t in items], pa.large_string()))
    hashes, _, _, first = words_of(data, offsets)
    return hashes, first


def block_of(items: list[str | None], hashes: np.ndarray, first: np.ndarray, vocabulary: np.ndarray, width: int) -> Block:
    text = (np.searchsorted(vocabulary, hashes) + 2).astype(np.int32)
    size = np.minimum(np.diff(first), width)
    windows, owners = {}, {}
    for n in np.unique(size[size > 0]).tolist():
        of = np.flatnonzero(size == n)
        count = first[of + 1] - first[of] - n + 1
        at = np.repeat(first[of], count) + segment_positions(count)
        rows = np.lib.stride_tricks.sliding_window_view(text, n)[at]
        _, one, which = np.unique(rows, axis=0, return_index=True, return_inverse=True)
        windows[n] = at[one]
        pairs = np.unique(np.stack([which.ravel(), np.repeat(of, count)], 1), axis=0)
        owners[n] = np.searchsorted(pairs[:, 0], np.arange(len(one) + 1)), pairs[:, 1]
    return Block(text, windows, owners, items)


def phrases(items: list[tuple[str | None, str | None]], width: int) -> Phrases:
    """A benchmark of one block."""
    hashes, first = words_in(items)
    vocabulary = np.unique(hashes)
    block = block_of([i for i, _ in items], hashes, first, vocabulary, width)
    return Phrases(vocabulary, min(block.windows, default=0), [block])


def suffix_array(text: np.ndarray, bits: int) -> np.ndarray:
    """Suffixes in order, by prefix doubling; after the first round only suffixes that still
    tie are sorted again. A suffix that ends comes before one that goes on."""
    n = len(text)
    depth = max(1, 62 // (bits + 1))
    padded = np.zeros(n + depth, np.int64)
    padded[:n] = text + 1
    key = np.zeros(n, np.int64)
    for j in range(depth):
        key = key << (bits + 1) | padded[j : j + n]
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.ones(n, bool)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    group = np.flatnonzero(new)[np.cumsum(new) - 1]  # rank: place of the group's first
    rank = np.empty(n + 1, np.int64)
    rank[order], rank[n] = group, -1
    while True:
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            return order
        who, g = order[at], group[at]
        following = rank[np.minimum(who + depth, n)]
        by = np.lexsort((following, g))
        order[at] = who = who[by]
        following = following[by]
        fresh = np.ones(len(at), bool)
        fresh[1:] = (g[1:] != g[:-1]) | (following[1:] != following[:-1])
        new[at] = fresh
        group[at] = at[fresh][np.cumsum(fresh) - 1]
        rank[who] = group[at]
        depth *= 2


class WaveletTree:
    """Symbols by the levels of their bits, each level with counts of zeros."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.bits, self.zeros = bits, []
        for level in range(bits - 1, -1, -1):
            bit = (symbols >> level & 1).astype(bool)
            count = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(~bit, out=count[1:])
            self.zeros.append(count)
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, count in enumerate(self.zeros):
            z = count[at]
            at = np.where(symbol >> (self.bits - 1 - k) & 1, count[-1] + at - z, z)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many of the first ``at`` symbols equal ``symbol``."""
        return self.down(symbol, at) - self.down(symbol, np.zeros_like(at))


class FMIndex:
    def __init__(self, text: np.ndarray, top: int) -> None:
        bits = max(1, int(top).bit_length())
        order = suffix_array(text, bits)
        self.bwt = text[order - 1]
        self.before = np.zeros(top + 2, np.int64)
        np.cumsum(np.bincount(text, minlength=top + 1), out=self.before[1:])
        self.tree = WaveletTree(self.bwt, bits)
        marked = order % SAMPLE == 0
        self.marked = marked
        self.mark_rank = np.cumsum(marked) - 1
        self.sampled = order[marked]
        self.n = len(text)

    def search(self, text: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which windows (runs of n symbols of ``text``) occur, and the interval of suffixes of
        each."""
        alive = np.arange(len(starts))
        lo, hi = np.zeros(len(starts), np.int64), np.full(len(starts), self.n, np.int64)
        for j in range(n - 1, -1, -1):
            c = text[starts[alive] + j].astype(np.int64)
            lo, hi = (self.before[c] + self.tree.rank(c, x) for x in (lo, hi))
            left = lo < hi
            alive, lo, hi = alive[left], lo[left], hi[left]
            if not len(alive):
                break
        return alive, lo, hi

    def locate(self, at: np.ndarray) -> np.ndarray:
        """The text position of each suffix, by LF steps to a sampled one."""
        at = at.copy()
        steps = np.zeros(len(at), np.int64)
        open_ = np.flatnonzero(~self.marked[at])
        while len(open_):
            c = self.bwt[at[open_]]
            at[open_] = self.before[c] + self.tree.rank(c, at[open_])
            steps[open_] += 1
            open_ = open_[~self.marked[at[open_]]]
        return self.sampled[self.mark_rank[at]] + steps


def occurrences(hashes: np.ndarray, first: np.ndarray, find: Phrases) -> Iterator[tuple[Block, int, np.ndarray, np.ndarray]]:
    """For each block and window length: windows (by number) and the words at which they occur."""
    if not len(find.vocabulary) or not len(hashes):
        return
    at = np.minimum(np.searchsorted(find.vocabulary, hashes), len(find.vocabulary) - 1)
    symbol = np.where(find.vocabulary[at] == hashes, at + 1, 0)
    starts, ends, _ = runs(symbol > 0, first)
    long = ends - starts >= find.shortest
    starts, ends = starts[long], ends[long]
    if not len(starts):
        return
    size = ends - starts + 1  # with a separator after each run
    place = np.repeat(starts, size) + segment_positions(size)
    closing = np.cumsum(size) - 1
    text = np.append(symbol[np.minimum(place, len(symbol) - 1)] + 1, 0)  # 0 ends the text, 1 separates runs
    text[closing] = 1
    index = FMIndex(text, len(find.vocabulary) + 1)
    for block in find.each():
        for n, windows in block.windows.items():
            which, lo, hi = index.search(block.text, windows, n)
            if len(which):
                count = hi - lo
                suffix = np.repeat(lo, count) + segment_positions(count)
                yield block, n, np.repeat(which, count), place[index.locate(suffix)]


def scan_block(text: pa.Array, find: Phrases) -> tuple[np.ndarray, np.ndarray, list[list[str]], list[list[dict]]]:
    data, offsets = texts_to_bytes(text)
    hashes, starts, ends, first = words_of(data, offsets)
    docs, covered = len(text), np.zeros(len(hashes) + 1, np.int64)
    items_of: list[set[str]] = [set() for _ in range(docs)]
    for block, n, which, at in occurrences(hashes, first, find):
        np.add.at(covered, at, 1)
        np.add.at(covered, at + n, -1)
        doc = np.searchsorted(first, at, "right") - 1
        pairs = np.unique(np.stack([doc, which], 1), axis=0)
        bounds, items = block.owners[n]
        count = bounds[pairs[:, 1] + 1] - bounds[pairs[:, 1]]
        found = np.stack([np.repeat(pairs[:, 0], count), items[np.repeat(bounds[pairs[:, 1]], count) + segment_positions(count)]], 1)
        for d, i in np.unique(found, axis=0).tolist():
            if block.items[i] is not None:
                items_of[d].add(block.items[i])
    hit = np.cumsum(covered)[:-1] > 0
    total = np.concatenate([[0], np.cumsum(hit)])
    n_hit = total[first[1:]] - total[first[:-1]]
    spans: list[list[dict]] = [[] for _ in range(docs)]
    a, b, of = runs(hit, first)
    for d in np.flatnonzero(n_hit).tolist():
        raw = data[offsets[d] : offsets[d + 1]]
        chars = np.concatenate([[0], np.cumsum(raw & 0xC0 != 0x80)])
        k = slice(of[d], of[d + 1])
        lo, hi = chars[starts[a[k]] - offsets[d]], chars[ends[b[k] - 1] - offsets[d]]
        spans[d] = [{"start": s, "end": e} for s, e in zip(lo.tolist(), hi.tolist())]
    return np.diff(first), n_hit, [sorted(x) for x in items_of], spans


def scanned(df: DataFrame, text: str, vocabulary: np.ndarray, shortest: int, blocks: list) -> DataFrame:
    """df with the outputs; blocks are shared variables."""
    kept = [f for f in df.schema.fields if f.name not in OUTPUT]
    schema = T.StructType(kept + T.StructType.fromDDL(", ".join(f"{k} {v}" for k, v in OUTPUT.items())).fields)
    shared = df.sparkSession.sparkContext.broadcast((vocabulary, shortest))  # the distinct words' hashes
    names = [f.name for f in kept]
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Phrases(*shared.value, blocks)
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            k = 0
            while k < len(batch):
                j = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + BLOCK, "right")))
                part = batch.slice(k, j - k)
                n_words, n_hit, items, spans = scan_block(part.column(text), find)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(n) for n in names), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, span_type)],
                    names=[*names, *OUTPUT],
                )
                k = j
        give_back()

    return df.mapInArrow(scan, schema)


def decontaminate(df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 13, share: int = 20) -> DataFrame:
    """df with n_words, n_hit, items (ids with occurring windows, sorted as strings), spans
    (merged, in code points) and contaminated (n_hit > 0 and share * n_hit >= n_words).

    The benchmark is the stated query set; it is fetched in blocks of about QUERY_BLOCK bytes
    and shared block by block, and df is scanned once for all of them.
    """
    spark = df.sparkSession
    bounded_batches(spark, BLOCK)
    asked = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).where("t is not null")
    size = int(asked.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0])
    blocks = max(1, -(-size // QUERY_BLOCK))
    parts = []
    for k in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k) if blocks > 1 else asked
        items = [(r.i, r.t) for r in part.distinct().collect()]
        parts.append(([i for i, _ in items], *words_in(items)))
    vocabulary = np.unique(np.concatenate([h for _, h, _ in parts]))
    made = [block_of(*p, vocabulary, width) for p in parts]
    shortest = min((n for b in made for n in b.windows), default=0)
    df = scanned(df, text, vocabulary, shortest, [spark.sparkContext.broadcast(b) for b in made])
    return df.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


def without_spans(text: Column, spans: Column) -> Column:
    """The text with its removal spans taken out."""
    start = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["end"]))
    end = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.char_length(text).cast("long")))
    return F.array_join(F.zip_with(start, end, lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int"))), "")
