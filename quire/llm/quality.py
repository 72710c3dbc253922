"""Quality classifier: supervised subword embeddings.

A document's features are its words, pairs of neighbouring words, and the n-grams of its
characters, each hashed into a table of learned vectors. Their average goes through a linear layer
and softmax; vectors and layer are trained by numpy stochastic gradient descent. As the layer
is linear, a trained model is folded into one number a bucket (the difference of the two
logits), so that scoring sums one gather a feature.

A pair of words is hashed by the exclusive or of its words' hashes; a word after itself thus
has one bucket of its own, which shows repetition.

Only whole texts are features. Training takes a bounded sample (``max_docs``, of each label
up to half, by a hash of the id); each sampled document is reduced on the executors to its
buckets' weights, at most one for each bucket. Defined results: null and empty texts have no
features and get the score of the bias alone; with no labelled rows every score is 0.5; rows
with a null label or id aren't learned from, an id labelled twice counts by its least label, and
of many rows ties in the sample's order go by id. Equal texts have equal scores; texts are
scored whole, whatever their length; an empty table gives no rows. Columns of df with an
output's name are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import bounded_batches, give_back, mixed, run_hashes, runs, texts_to_bytes

BITS = 16
BUCKETS = 1 << BITS
GRAMS = (3, 4)
#: Texts are featurised in groups of about this many bytes.
GROUP = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each kind of feature: the buckets of all texts, joined, and each text's first."""
    starts, ends, first = runs(~_SPACE[data], offsets)
    words = run_hashes(data, starts, ends)
    shift = np.uint64(64 - BITS)
    yield (mixed(words + np.uint64(1)) >> shift).astype(np.intp), first
    pair = mixed((words[1:] ^ words[:-1]) + np.uint64(2)) >> shift
    last = np.zeros(len(words), bool)
    at = first[1:] - 1
    last[at[at >= 0]] = True
    inside = ~last[:-1] if len(words) else last
    before = np.concatenate([[0], np.cumsum(inside)])
    yield pair[inside].astype(np.intp), before[np.minimum(first, len(before) - 1)]
    wide, offsets = characters(data, offsets)
    for n in GRAMS:
        if len(wide) < n:
            yield np.zeros(0, np.intp), np.zeros(len(offsets), np.int64)
            continue
        code = np.zeros(len(wide) - n + 1, np.uint32)
        for j in range(n):
            code = code * np.uint32(0x01000193) + wide[j : len(wide) - n + 1 + j]
        code = (code ^ np.uint32(n)) * np.uint32(0x9E3779B1)
        # n-grams that would run into the next text are left out
        ok = np.ones(len(code), bool)
        for j in range(1, n):
            edge = offsets[1:-1] - j
            ok[edge[(edge >= 0) & (edge < len(code))]] = False
        before = np.concatenate([[0], np.cumsum(ok)])
        yield (code[ok] >> np.uint32(32 - BITS)).astype(np.intp), before[np.minimum(offsets, len(code))]


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each character of UTF-8 texts, its bytes, and each text's first."""
    begin = (data & 0xC0) != 0x80
    if begin.all():
        return data.astype(np.uint32), offsets
    at = np.flatnonzero(begin)
    size = np.diff(at, append=len(data))
    out = data[at].astype(np.uint32)
    for j in range(1, 4):
        more = np.flatnonzero(size > j)
        out[more] = out[more] << np.uint32(8) | data[at[more] + j]
    before = np.concatenate([[0], np.cumsum(begin)])
    return out, before[offsets]


def sums_between(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]


@dataclass
class Model:
    weight: np.ndarray  # of each bucket: the difference of logits
    bias: float

    def scores(self, text: pa.Array) -> np.ndarray:
        out = np.empty(len(text))
        sizes = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
        ends, k = np.cumsum(sizes, dtype=np.int64), 0
        while k < len(text):
            j = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + GROUP, "right")))
            data, offsets = texts_to_bytes(text.slice(k, j - k))
            logit, n = np.zeros(j - k), np.zeros(j - k)
            for buckets, first in features(data, offsets):
                logit += sums_between(self.weight[buckets], first)
                n += np.diff(first)
            out[k:j] = 1 / (1 + np.exp(-np.clip(logit / np.maximum(n, 1) + self.bias, -30, 30)))
            k = j
        return out


def sparse(text: pa.Array) -> list[tuple[bytes, bytes]]:
    """Each text's buckets (uint16) and their shares (float32), as bytes."""
    out = []
    for k in range(len(text)):
        data, offsets = texts_to_bytes(text.slice(k, 1))
        count = np.zeros(BUCKETS)
        for buckets, _ in features(data, offsets):
            count += np.bincount(buckets, minlength=BUCKETS)
        has = np.flatnonzero(count)
        out.append((has.astype(np.uint16).tobytes(), (count[has] / max(count.sum(), 1)).astype(np.float32).tobytes()))
    return out


def train(rows: list[tuple[bytes, bytes, int]], dim: int = 8, updates: int = 1200, rate: float = 40.0, batch: int = 32, seed: int = 1) -> Model:
    """Stochastic gradient descent on softmax cross-entropy, in epochs of at least ``updates``
    steps together; the rate falls to zero in a line. Both labels weigh alike in all."""
    random = np.random.default_rng(seed)
    vectors = random.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    layer, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    label = np.array([y for _, _, y in rows], np.intp)
    share = np.bincount(label, minlength=2) / max(1, len(rows))
    if not len(rows):
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    if not share.all():
        return Model(np.zeros(BUCKETS, np.float32), 30.0 if share[1] else -30.0)
    importance = (0.5 / share[label]).astype(np.float32)
    index = [np.frombuffer(a, np.uint16).astype(np.intp) for a, _, _ in rows]
    value = [np.frombuffer(b, np.float32) for _, b, _ in rows]
    each = -(-len(rows) // batch)
    epochs = max(3, -(-updates // each))
    steps, done = epochs * each, 0
    for _ in range(epochs):
        order = random.permutation(len(rows))
        for k in range(0, len(rows), batch):
            chosen = order[k : k + batch]
            lr = np.float32(rate * (1 - done / steps))
            done += 1
            size = np.array([len(index[c]) for c in chosen])
            at, v = np.concatenate([index[c] for c in chosen]), np.concatenate([value[c] for c in chosen])
            row = np.repeat(np.arange(len(chosen)), size)
            part = vectors[at] * v[:, None]
            hidden = np.stack([np.bincount(row, part[:, d], len(chosen)) for d in range(dim)], 1).astype(np.float32)
            logits = hidden @ layer + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(chosen)), label[chosen]] -= 1
            p *= (importance[chosen] / len(chosen))[:, None]
            back = p @ layer.T
            layer -= lr * 0.05 * hidden.T @ p
            bias -= lr * 0.001 * p.sum(0)
            step = lr * v[:, None] * back[row]
            one, where = np.unique(at, return_inverse=True)
            for d in range(dim):
                vectors[one, d] -= np.bincount(where, step[:, d], len(one)).astype(np.float32)
    flat = vectors @ (layer[:, 1] - layer[:, 0])
    return Model(flat.astype(np.float32), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", key: str = "doc_id", max_docs: int = 3000) -> Model:
    """A model from at most max_docs rows of docs that have a label of 0 or 1 in labels."""
    bounded_batches(docs.sparkSession)
    ids = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(key).alias("_k")).agg(F.min(label).cast("int").alias("_y"))
    ids = ids.join(docs.select(F.col(key).alias("_k")), "_k", "left_semi")
    halves = [ids.where(F.col("_y") == y).orderBy(F.xxhash64("_k"), "_k").limit(max_docs // 2) for y in (0, 1)]
    chosen = halves[0].unionByName(halves[1])  # at most max_docs rows: broadcast below
    rows = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")).join(F.broadcast(chosen), "_k").select("_k", "_t", "_y")

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = sparse(b.column("_t"))
            yield pa.RecordBatch.from_arrays([b.column("_k"), b.column("_y"), pa.array([x for x, _ in both], pa.binary()), pa.array([x for _, x in both], pa.binary())], names=["_k", "_y", "_i", "_v"])

    kind = docs.schema[key].dataType.simpleString()
    found = rows.mapInArrow(reduce, f"_k {kind}, _y int, _i binary, _v binary").collect()
    found.sort(key=lambda r: (r["_k"], r["_y"]))
    return train([(bytes(r["_i"]), bytes(r["_v"]), r["_y"]) for r in found])


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """df with the probability of label 1."""
    bounded_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)  # 2**BITS numbers

    @F.arrow_udf("double")
    def probability(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array(shared.value.scores(column))
        give_back()

    return df.withColumn(out, probability(F.col(text)))
