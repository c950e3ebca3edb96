"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Pre-tokens that are whole entries of the rank table take one id. All other new pre-tokens of a batch share one linked
list of byte positions (no pair spans two of them): each mergeable neighbour pair sits in the bucket of its merge rank, a
three-level bitmap over the ranks gives the next rank by find-first-set, that bucket's positions are merged from the left,
and entries whose pair has changed since are skipped as stale. A merge costs a bucket append and a table lookup whatever
the pre-token's length, so pre-tokens of megabytes stay near-linear. Work is per document, without a shuffle; a bounded
per-task table remembers pre-tokens.

Defined results: a null text encodes as an empty text does, to no ids; special-token strings are ordinary text; repeated
rows are encoded each; a null `ids` decodes to no bytes; input columns named like an output column are replaced. Ids are
packed as little-endian unsigned 32-bit integers.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterable, Iterator
from itertools import islice
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyweave.llm.common import append_columns, table

#: Pre-tokens remembered by a task, pre-tokens of text handled at a time, and bytes merged at a time.
MEMORY, CHUNK, BYTES = 400_000, 200_000, 500_000
_LOW = 63


class RankQueue:
    """Ranks below `size` with a bucket of positions each; first() is the lowest rank that has one."""

    def __init__(self, size: int):
        self.buckets: dict[int, list[int]] = {}
        self.leaves, self.middle, self.top = [0] * ((size >> 6) + 1), [0] * ((size >> 12) + 1), 0

    def open(self, rank: int, positions: list[int]) -> None:
        """Start a bucket for a rank that has none."""
        self.buckets[rank] = positions
        self.leaves[rank >> 6] |= 1 << (rank & _LOW)
        self.middle[rank >> 12] |= 1 << ((rank >> 6) & _LOW)
        self.top |= 1 << (rank >> 12)

    def first(self) -> int:
        """The lowest rank held, or -1."""
        if not self.top:
            return -1
        a = (self.top & -self.top).bit_length() - 1
        word = self.middle[a]
        b = (a << 6) | ((word & -word).bit_length() - 1)
        word = self.leaves[b]
        return (b << 6) | ((word & -word).bit_length() - 1)

    def take(self, rank: int) -> list[int]:
        """A rank's bucket, from the left; the rank leaves the bitmap."""
        b, a = rank >> 6, rank >> 12
        self.leaves[b] &= ~(1 << (rank & _LOW))
        if not self.leaves[b]:
            self.middle[a] &= ~(1 << (b & _LOW))
            if not self.middle[a]:
                self.top &= ~(1 << a)
        return sorted(self.buckets.pop(rank))


class Codec:
    """A rank table with its pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memory: int = MEMORY, chunk: int = CHUNK):
        self.memory, self.chunk = memory, chunk
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.queue = RankQueue(max(ranks.values(), default=0) + 1)
        self.pieces = {r: b for b, r in ranks.items()}
        self.two = np.full(1 << 16, -1, dtype=np.int64)
        for b, r in ranks.items():
            if len(b) == 2:
                self.two[b[0] << 8 | b[1]] = r
        self.longest = max(map(len, ranks), default=0)
        self.known: dict[str, bytes] = {}

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each pre-token, all merged through one queue."""
        data, get, queue, buckets, longest = b"".join(pieces), self.ranks.get, self.queue, self.queue.buckets, self.longest
        n, raw = len(data), np.frombuffer(data, dtype=np.uint8).astype(np.int64)
        ends = np.cumsum([len(p) for p in pieces])
        first = np.full(n, -1, dtype=np.int64)  # the rank of each neighbour pair; none across two pre-tokens
        first[:-1] = self.two[raw[:-1] << 8 | raw[1:]]
        first[ends - 1] = -1
        order = np.argsort(first, kind="stable")
        order = order[np.searchsorted(first[order], 0) :]
        if len(order):
            cuts = np.flatnonzero(np.r_[True, np.diff(first[order]) != 0])
            for some in np.split(order, cuts[1:]):
                queue.open(int(first[some[0]]), some.tolist())
        rank_at = first.tolist()
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        last = np.zeros(n + 1, dtype=bool)  # places where a pre-token starts (or all end)
        last[ends] = True
        before[last[:-1]] = -1
        if n:
            before[0] = -1
        after, before, edge = after.tolist(), before.tolist(), last.tolist()
        while (rank := queue.first()) >= 0:
            held = queue.take(rank)
            for k, i in enumerate(held):
                if rank_at[i] != rank:
                    continue  # stale
                gone = after[i]
                end = after[gone]
                after[i] = end
                rank_at[gone] = -1
                lower = False
                if edge[end]:
                    rank_at[i] = -1
                else:
                    before[end] = i
                    stop = after[end]
                    new = get(data[i:stop], -1) if stop - i <= longest else -1
                    rank_at[i] = new
                    if new >= 0:
                        if new in buckets:
                            buckets[new].append(i)
                        else:
                            queue.open(new, [i])
                        lower = new < rank
                p = before[i]
                if p >= 0:
                    new = get(data[p:end], -1) if end - p <= longest else -1
                    rank_at[p] = new
                    if new >= 0:
                        if new in buckets:
                            buckets[new].append(p)
                        else:
                            queue.open(new, [p])
                        lower = lower or new < rank
                if lower and k + 1 < len(held):  # a lower rank goes first; what is left of this one waits
                    if rank in buckets:
                        buckets[rank] += held[k + 1 :]
                    else:
                        queue.open(rank, held[k + 1 :])
                    break
        out, i = [], 0
        for end in ends.tolist():
            ids = []
            while i < end:
                stop = after[i]
                ids.append(get(data[i:stop]))
                i = stop
            out.append(ids)
        return out

    def learn(self, tokens: Iterable[str]) -> None:
        """Remember the ids of pre-tokens that aren't known yet."""
        whole, some, held = self.ranks.get, [], 0
        for t in tokens:
            piece = t.encode()
            if (rank := whole(piece)) is not None:
                self.known[t] = rank.to_bytes(4, "little")
                continue
            some.append((t, piece))
            held += len(piece)
            if held >= BYTES:
                self._learn(some)
                some, held = [], 0
        if some:
            self._learn(some)

    def _learn(self, some: list[tuple[str, bytes]]) -> None:
        for (t, _), ids in zip(some, self.merge([p for _, p in some]), strict=True):
            self.known[t] = struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of whole texts."""
        out, waiting, held = [bytearray() for _ in texts], [], 0

        def settle() -> None:
            if len(self.known) > self.memory:
                self.known.clear()
            known = self.known
            self.learn({t for _, some in waiting for t in some if t not in known})
            for n, some in waiting:
                out[n] += b"".join(map(known.__getitem__, some))
            waiting.clear()

        for n, t in enumerate(texts):
            for some in [self.pattern.findall(t)] if len(t) <= self.chunk else _chunks((m.group() for m in self.pattern.finditer(t)), self.chunk):
                waiting.append((n, some))
                held += len(some)
                if held >= self.chunk:
                    settle()
                    held = 0
        settle()
        return list(map(bytes, out))

    def decode(self, ids: bytes) -> bytes:
        """The bytes that packed ids stand for."""
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def _chunks(tokens: Iterator[str], size: int) -> Iterator[list[str]]:
    while some := list(islice(tokens, size)):
        yield some


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """A rank file's entries: base64 bytes and rank, one a line."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}


def _shared(docs: DataFrame, ranks_path: str, pattern: str):
    """The rank file's bytes (a vocabulary, so of fixed size) for all tasks."""
    return docs.sparkSession.sparkContext.broadcast((Path(ranks_path).read_bytes(), pattern))


_CODECS: dict[int, Codec] = {}


def _codec(shared, memory: int = MEMORY, chunk: int = CHUNK) -> Codec:
    """A worker builds a vocabulary's codec once."""
    raw, pattern = shared.value
    key = hash((len(raw), raw, pattern, memory, chunk))
    if key not in _CODECS:
        _CODECS[key] = Codec(read_ranks(raw), pattern, memory, chunk)
    return _CODECS[key]


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """`docs` with `ids`, packed."""
    shared = _shared(docs, ranks_path, pattern)

    def make():
        codec = _codec(shared)
        return lambda col: [pa.array(codec.encode([t or "" for t in col.to_pylist()]), pa.binary())]

    return append_columns(docs, [text], [T.StructField("ids", T.BinaryType())], make)


def decode(encoded: DataFrame, ranks_path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """`encoded` with `decoded`, the bytes that its packed ids stand for."""
    shared = _shared(encoded, ranks_path, pattern)

    def make():
        codec = _codec(shared)
        return lambda col: [pa.array((codec.decode(i or b"") for i in map(pa.BinaryScalar.as_py, col)), pa.binary())]

    return append_columns(encoded, [ids], [T.StructField("decoded", T.BinaryType())], make)


def recode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", memory: int = MEMORY, chunk: int = CHUNK) -> DataFrame:
    """`docs` with `ids` and `decoded`, as decode(encode(docs)) gives them, by one Python worker a task instead of two."""
    shared = _shared(docs, ranks_path, pattern)

    def make():
        codec = _codec(shared, memory, chunk)

        def run(col: pa.Array) -> list[pa.Array]:
            ids = codec.encode([t or "" for t in col.to_pylist()])
            return [pa.array(ids, pa.binary()), pa.array(map(codec.decode, ids), pa.binary())]

        return run

    return append_columns(docs, [text], [T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())], make)


def digest(decoded: DataFrame) -> DataFrame:
    """Counts and digests of `ids` and `decoded`."""
    return decoded.select("doc_id", F.expr("length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, and its ids decoded."""
    import public_tokenizers

    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digest(recode(docs, ranks, pattern))
