"""Byte-level BPE encoding and decoding.

The merges of a word are chosen by a segment tree over the ranks of its adjacent pairs: a leaf
holds ``rank * width + position``, a node the least of its children, so that the root is the
leftmost pair of lowest rank. A merge changes three leaves and the nodes above them, and the
root is asked again until no pair can merge. Short words, whose trees have one width, are
merged in step as rows of one numpy array; a long word has a tree of its own, so that a run of
n symbols without a break costs n log n.

Defined results: a null or empty text has no ids and decodes to ''; equal texts have equal ids,
whatever rows they stand in; texts and words may have any length. In decoding, ids outside the
vocabulary stand for nothing, as in the library, bytes that aren't UTF-8 become U+FFFD, and a
column value that isn't whole 32-bit words gives null (Encoder.decode raises ValueError). An
empty table gives no rows. Other columns pass through; an output name that is already taken is
replaced. The vocabulary's file is read on the driver and sent to the workers.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import bounded_batches, give_back

#: The pre-tokeniser's pattern (fixed values of the format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words are kept with their ids while they take fewer bytes than this; then the store is emptied.
CACHE_BYTES = 64 << 20
#: About what a word in the store takes beside its characters and ids.
ENTRY = 150
#: Long texts are cut before white space into pieces of about this many characters.
PIECE = 1 << 15
#: Words of more symbols have a tree of their own.
WIDEST = 64
NONE = np.int64(1) << np.int64(62)


def byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for the 256 bytes in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class PairTree:
    """A segment tree over the pair ranks of one word; NONE stands for no merge. Nodes are
    packed integers, so that even a word of megabytes takes 16 bytes a symbol."""

    def __init__(self, ranks: np.ndarray) -> None:
        n = len(ranks)
        self.width = max(2, 1 << max(0, n - 1).bit_length())
        node = np.full(2 * self.width, NONE, np.int64)
        node[self.width : self.width + n] = np.where(ranks < NONE, ranks * self.width + np.arange(n), NONE)
        level = self.width
        while level > 1:
            half = level >> 1
            node[half:level] = np.minimum(node[level : 2 * level : 2], node[level + 1 : 2 * level : 2])
            level = half
        self.node = array("q", node.tobytes())

    def root(self) -> tuple[int, int] | None:
        """The lowest rank and its leftmost place."""
        least = self.node[1]
        return None if least >= NONE else divmod(least, self.width)

    def put(self, i: int, rank: int | None) -> None:
        k, node = i + self.width, self.node
        node[k] = int(NONE) if rank is None else rank * self.width + i
        while k > 1:
            k >>= 1
            node[k] = min(node[2 * k], node[2 * k + 1])


def file_text(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


class Encoder:
    """A vocabulary with merges, read from a tokenizers JSON file of byte-level BPE."""

    def __init__(self, path: str, text: str | None = None) -> None:
        spec = json.loads(file_text(path) if text is None else text)
        model, alphabet = spec["model"], byte_alphabet()
        vocab: dict[str, int] = model["vocab"]
        added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.special = {k: np.array([v], "<u4").tobytes() for k, v in added.items()}
        self.cut = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        top = max([*vocab.values(), *added.values()]) + 1
        self.piece = [b""] * top
        for token, i in vocab.items():
            self.piece[i] = bytes(alphabet[c] for c in token)
        for token, i in added.items():
            self.piece[i] = token.encode()
        self.first = np.zeros(256, np.int64)
        for c, b in alphabet.items():
            self.first[b] = vocab[c]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.rank = {(a, b): k for k, (a, b) in enumerate(zip(left.tolist(), right.tolist(), strict=True))}
        keys = left << 32 | right
        order = np.argsort(keys)
        self.keys, self.key_rank = keys[order], order.astype(np.int64)
        pair = np.arange(1 << 16)
        self.byte_rank = self.ranks(self.first[pair >> 8], self.first[pair & 255])
        self.words = regex.compile(PATTERN)
        self.cache: dict[str, bytes] = {}
        self.held = 0

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.key_rank[at], NONE)

    def merge_long(self, word: bytes) -> bytes:
        first = self.first[np.frombuffer(word, np.uint8)]
        n = len(first)
        tree = PairTree(self.ranks(first[:-1], first[1:]))
        sym, after, before = (array("q", x.tobytes()) for x in (first, np.arange(1, n + 1), np.arange(-1, n - 1)))
        while (least := tree.root()) is not None:
            rank, i = least
            j = after[i]
            sym[i], sym[j] = int(self.merged[rank]), -1
            k = after[i] = after[j]
            if j < n - 1:
                tree.put(j, None)
            if k < n:
                before[k] = i
            tree.put(i, self.rank.get((sym[i], sym[k])) if k < n else None)
            if (p := before[i]) >= 0:
                tree.put(p, self.rank.get((sym[p], sym[i])))
        left = np.frombuffer(sym, np.int64)
        return left[left >= 0].astype("<u4").tobytes()

    def merge_many(self, words: list[bytes], width: int) -> list[bytes]:
        """Words of 1 to ``width`` bytes, whose trees are merged in step."""
        n, lengths = len(words), np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        row = np.repeat(np.arange(n), lengths)
        col = np.arange(len(data)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        sym = np.full((n, width + 1), -1, np.int64)
        sym[row, col] = self.first[data]
        after = np.broadcast_to(np.arange(1, width + 2), (n, width + 1)).copy()
        before = np.broadcast_to(np.arange(-1, width), (n, width + 1)).copy()
        tree = np.full((n, 2 * width), NONE, np.int64)
        paired = col[:-1] + 1 < lengths[row[:-1]]
        r, c = row[:-1][paired], col[:-1][paired]
        rank = self.byte_rank[data[:-1][paired] << 8 | data[1:][paired]]
        tree[r, width + c] = np.where(rank < NONE, rank * width + c, NONE)
        level = width
        while level > 1:
            half = level >> 1
            tree[:, half:level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level = half
        live = np.arange(n)
        while True:
            least = tree[live, 1]
            left = least < NONE
            live, least = live[left], least[left]
            if not len(live):
                break
            i, new = least % width, self.merged[least // width]
            j = after[live, i]
            k = after[live, j]
            sym[live, i], sym[live, j] = new, -1
            after[live, i] = k
            end = k >= lengths[live]
            before[live, np.where(end, width, k)] = i
            right = self.ranks(new, sym[live, np.where(end, width, k)])
            p = before[live, i]
            head = p < 0
            at = np.where(head, width, p)
            prior = self.ranks(sym[live, at], new)
            tree[live, width + j % width] = NONE
            tree[live, width + i] = np.where((right < NONE) & ~end, right * width + i, NONE)
            q = np.where(head, i, p)
            tree[live, width + q] = np.where(head, tree[live, width + q], np.where(prior < NONE, prior * width + q, NONE))
            for leaf in (j % width, i, q):
                node = (leaf + width) >> 1
                for _ in range(width.bit_length() - 1):
                    tree[live, node] = np.minimum(tree[live, 2 * node], tree[live, 2 * node + 1])
                    node >>= 1
        kept = sym[:, :width] >= 0
        flat = sym[:, :width][kept].astype("<u4").tobytes()
        ends = np.cumsum(kept.sum(1)) * 4
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def learn(self, words: list[str]) -> None:
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for w in words:
            raw = w.encode("utf-8", "replace")
            self.held += 6 * len(raw) + ENTRY
            if len(raw) > WIDEST:
                self.cache[w] = self.merge_long(raw)
            else:
                by_width.setdefault(max(2, 1 << (len(raw) - 1).bit_length()), []).append((w, raw))
        for width, group in by_width.items():
            step = max(1, (1 << 19) // width)
            for k in range(0, len(group), step):
                part = group[k : k + step]
                self.cache.update(zip([w for w, _ in part], self.merge_many([b for _, b in part], width)))

    def pieces(self, text: str) -> Iterator[str | bytes]:
        """Parts of a text that no word crosses; a special token's ids come as bytes."""
        at = 0
        for m in self.cut.finditer(text) if self.cut else ():
            yield from self.plain(text, at, m.start())
            yield self.special[m[0]]
            at = m.end()
        yield from self.plain(text, at, len(text))

    @staticmethod
    def plain(text: str, at: int, end: int) -> Iterator[str]:
        while at < end:
            to = min(end, at + PIECE)
            while to < end and not (text[to] in " \n" and not text[to - 1].isspace()):
                to += 1
            yield text[at:to]
            at = to

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        k = 0
        while k < len(texts):
            group, size = [], 0
            while k < len(texts) and (not group or size + len(texts[k] or "") < 1 << 20):
                size += len(texts[k] or "")
                group.append(texts[k] or "")
                k += 1
            if len(group) == 1 and size > 1 << 20:
                out.append(b"".join(self.joined([x])[0] for x in self.pieces(group[0])))
            else:
                out += self.joined_texts(group)
        return out

    def joined(self, parts: list[str | bytes]) -> list[bytes]:
        if self.held > CACHE_BYTES:
            self.cache.clear()
            self.held = 0
        words = [p if isinstance(p, bytes) else self.words.findall(p) for p in parts]
        new: set[str] = set()
        for w in words:
            if not isinstance(w, bytes):
                new.update(w)
        if missing := new.difference(self.cache):
            self.learn(list(missing))
        get = self.cache.__getitem__
        return [w if isinstance(w, bytes) else b"".join(map(get, w)) for w in words]

    def joined_texts(self, texts: list[str]) -> list[bytes]:
        parts = [list(self.pieces(t)) for t in texts]
        flat = iter(self.joined([p for x in parts for p in x]))
        return [b"".join(next(flat) for _ in x) for x in parts]

    def decode(self, ids: bytes) -> str:
        piece, step, top = self.piece, 1 << 18, len(self.piece)
        if len(ids) % 4:
            raise ValueError("ids aren't whole 32-bit words")
        parts = (np.frombuffer(ids[k : k + 4 * step], "<u4") for k in range(0, len(ids), 4 * step))
        return b"".join(b"".join([piece[i] for i in p[p < top].tolist()]) for p in parts).decode("utf-8", "replace")


def sent(path: str) -> Callable[[], Encoder]:
    """What makes an encoder in a worker. It lives, with its words, for a task only: the worker
    stays for the tasks of later stages, which need the memory."""
    shared = SparkSession.active().sparkContext.broadcast(file_text(path))  # of the vocabulary's size
    return lambda: Encoder(path, shared.value)


def encode_column(text: Column, path: str) -> Column:
    """The ids of a text column as binary (little-endian unsigned 32-bit integers)."""
    encoder = sent(path)

    @F.arrow_udf("binary")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = encoder()
        for batch in batches:
            yield pa.array(coder.encode(batch.to_pylist()), pa.binary())
        coder = None
        give_back()

    return ids(text)


def decode_column(ids: Column, path: str) -> Column:
    """The text of an ids column; null for a value that isn't whole 32-bit words."""
    encoder = sent(path)

    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = encoder()
        for batch in batches:
            yield pa.array([None if len(x or b"") % 4 else coder.decode(x or b"") for x in batch.to_pylist()], pa.string())
        coder = None
        give_back()

    return text(ids)


def bpe_encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", count: str = "n_tokens") -> DataFrame:
    """df with the ids of ``text`` (binary) and their number (long)."""
    bounded_batches(df.sparkSession)
    out = df.withColumn(ids, encode_column(F.col(text), path))
    return out.withColumn(count, (F.octet_length(ids) / 4).cast("long"))


def bpe_decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with the text that ``ids`` stand for."""
    bounded_batches(df.sparkSession)
    return df.withColumn(text, decode_column(F.col(ids), path))


def bpe_round_trip(df: DataFrame, path: str, text: str = "text", ids: str = "ids", count: str = "n_tokens", decoded: str = "decoded") -> DataFrame:
    """df with the ids of ``text``, their number, and the text that they decode to. Both are
    made in one worker, which then holds the only copy of the vocabulary and the word store."""
    bounded_batches(df.sparkSession)
    encoder = sent(path)

    @F.arrow_udf("struct<ids:binary,decoded:string>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = encoder()
        for batch in batches:
            found = coder.encode(batch.to_pylist())
            back = pa.array([coder.decode(x) for x in found], pa.string())
            yield pa.StructArray.from_arrays([pa.array(found, pa.binary()), back], names=["ids", "decoded"])
        coder = found = back = None
        give_back()

    out = df.withColumn("__quire_both", both(F.col(text)))
    out = out.withColumn(ids, F.col("__quire_both.ids")).withColumn(decoded, F.col("__quire_both.decoded")).drop("__quire_both")
    return out.withColumn(count, (F.octet_length(ids) / 4).cast("long"))
