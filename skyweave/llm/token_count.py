"""Token counts by rank-synchronous array merging.

A text, normalised as the vocabulary's library normalises it, is cut into pre-tokens at places that no vocabulary piece
spans. The distinct pre-tokens of a batch become one ragged numpy array of symbols; in each round every pre-token's
lowest-rank pair is found by a segmented minimum and all its occurrences are merged at once, in every pre-token
together; what survives is counted (a symbol outside the vocabulary counts its UTF-8 bytes). Merging all occurrences at
once equals the library's one-at-a-time order unless a merge creates a pair of the same or a lower rank; pre-tokens where
that would happen merge their leftmost occurrence alone in that round. Counting is per document, without a shuffle.

Defined results: a null or empty text has 0 bytes and 0 tokens; strings of special tokens are ordinary text; repeated
rows are counted each; input columns named like an output column are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import islice
from pathlib import Path

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from skyweave.llm.common import append_columns, table

LIMIT = 4096
#: Pre-tokens remembered by a task, pre-tokens handled at a time, and characters merged at a time.
MEMORY, CHUNK, CHARACTERS = 400_000, 300_000, 400_000
SPACE = "▁"
_NONE = np.int64(1 << 40)

FIELDS = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]


class Vocabulary:
    """Symbols, merge ranks and pre-token rule of a BPE piece model."""

    def __init__(self, model: bytes):
        self.library = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
        self.symbols = {c: n for n, c in enumerate(sorted({*pieces, *(c for p in pieces for c in p)}))}
        self.size = len(self.symbols) + 1
        self.cost = np.array([1 if s in pieces else len(s.encode()) for s in self.symbols], dtype=np.int64)
        order = {s: n for n, s in enumerate(sorted(set(pieces.values()), reverse=True))}
        merges = sorted((self.symbols[p[:k]] * self.size + self.symbols[p[k:]], order[score], self.symbols[p]) for p, score in pieces.items() for k in range(1, len(p)) if p[:k] in self.symbols and p[k:] in self.symbols)
        self.keys, self.ranks, self.made = (np.array(x, dtype=np.int64) for x in zip(*merges, strict=True))
        # A character of no longer piece stands alone; a space run starts a pre-token unless a piece has one inside.
        joined = {c for p in pieces if len(p) > 1 for c in p}
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("pieces with inner spaces need another pre-token rule")
        alone = "".join(re.escape(c) for c in "\n\t" if c not in joined)
        # Space runs merge last and from the left, so all but the last blocks of the longest such piece are settled.
        block = max(len(p) for p in pieces if not p.strip(SPACE))
        cut = f"{SPACE}{{{block}}}(?={SPACE}{{{2 * block}}})|" if block > 1 and len({s for p, s in pieces.items() if len(p) > 1 and not p.strip(SPACE)}) == 1 else ""
        self.pattern = re.compile(f"{cut}{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + (f"|[{alone}]" if alone else ""))
        self.known: dict[str, int] = {}

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index into the merges of each pair, or -1."""
        key = left * self.size + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, at, -1)

    def count(self, tokens: list[str]) -> list[int]:
        """Tokens of each pre-token, all merged together."""
        total, get = np.zeros(len(tokens), dtype=np.int64), self.symbols.get
        sym = np.array([get(c, -len(c.encode())) for t in tokens for c in t], dtype=np.int64)
        seq = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
        np.add.at(total, seq[sym < 0], -sym[sym < 0])  # outside every piece: bytes, never merged
        lone = sym < 0
        sym[lone] = self.size - 1
        pair = self._pairs(sym, seq)
        while len(sym):
            rank = np.where(pair >= 0, self.ranks[pair], _NONE)
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            lowest = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(seq)])
            live = np.repeat(lowest < _NONE, sizes)
            if not live.all():
                done = ~live & (sym < self.size - 1)
                np.add.at(total, seq[done], self.cost[sym[done]])
                sym, seq, pair, rank = sym[live], seq[live], pair[live], rank[live]
                sizes, lowest = sizes[lowest < _NONE], lowest[lowest < _NONE]
                if not len(sym):
                    break
            best = np.repeat(lowest, sizes)
            chosen = _alternate(np.flatnonzero(rank == best), seq)
            merged = self._merge(sym, seq, pair, chosen)
            new = np.where(merged[2] >= 0, self.ranks[merged[2]], _NONE)
            unsafe = np.unique(merged[1][merged[3] & (new <= best[merged[4]])])
            if len(unsafe):
                first = np.r_[True, seq[chosen][1:] != seq[chosen][:-1]]
                merged = self._merge(sym, seq, pair, chosen[first | ~np.isin(seq[chosen], unsafe)])
            sym, seq, pair = merged[:3]
        return total.tolist()

    def _pairs(self, sym: np.ndarray, seq: np.ndarray) -> np.ndarray:
        out = np.full(len(sym), -1, dtype=np.int64)
        same = np.flatnonzero(seq[1:] == seq[:-1])
        out[same] = self.lookup(sym[same], sym[same + 1])
        return out

    def _merge(self, sym, seq, pair, chosen):
        """Arrays after merging the chosen pairs, which pairs are new, and each kept symbol's old place."""
        sym, fresh, keep = sym.copy(), np.zeros(len(sym), dtype=bool), np.ones(len(sym), dtype=bool)
        sym[chosen] = self.made[pair[chosen]]
        keep[chosen + 1] = False
        fresh[chosen] = True
        place = np.flatnonzero(keep)
        sym, seq, pair, fresh = sym[place], seq[place], pair[place], fresh[place]
        fresh[:-1] |= fresh[1:] & (seq[1:] == seq[:-1])
        at = np.flatnonzero(fresh)
        inner = at[(at + 1 < len(sym))]
        inner = inner[seq[inner] == seq[inner + 1]]
        pair[at] = -1
        pair[inner] = self.lookup(sym[inner], sym[inner + 1])
        return sym, seq, pair, fresh, place

    def learn(self, tokens: Iterable[str]) -> None:
        """Count pre-tokens that aren't known yet."""
        some, held = [], 0
        for t in tokens:
            some.append(t)
            held += len(t)
            if held >= CHARACTERS:
                self.known.update(zip(some, self.count(some), strict=True))
                some, held = [], 0
        if some:
            self.known.update(zip(some, self.count(some), strict=True))


def _alternate(at: np.ndarray, seq: np.ndarray) -> np.ndarray:
    """Of each run of neighbouring places (overlapping pairs), every other one from the left."""
    breaks = np.flatnonzero(np.r_[True, (np.diff(at) != 1) | (seq[at][1:] != seq[at][:-1])])
    return at[(np.arange(len(at)) - np.repeat(breaks, np.diff(np.r_[breaks, len(at)]))) % 2 == 0]


_VOCABULARIES: dict[bytes, Vocabulary] = {}


def _pieces(texts: Iterable[str], v: Vocabulary) -> Iterator[tuple[int, list[str]]]:
    """(text number, some of its pre-tokens), long texts in several parts."""
    for n, t in enumerate(texts):
        found = (m.group() for m in v.pattern.finditer(v.library.normalize(t)))
        while some := list(islice(found, CHUNK)):
            yield n, some


def count_tokens(docs: DataFrame, model_path: str, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """`docs` with n_bytes, n_tokens, over_limit. The model's bytes, of a vocabulary's fixed size, go to every task."""
    shared = docs.sparkSession.sparkContext.broadcast(Path(model_path).read_bytes())

    def make():
        model = shared.value
        v = _VOCABULARIES.get(model) or _VOCABULARIES.setdefault(model, Vocabulary(model))

        def run(col: pa.Array) -> list[pa.Array]:
            texts = [t or "" for t in col.to_pylist()]
            counts, waiting, held = [0] * len(texts), [], 0

            def settle() -> None:
                if len(v.known) > MEMORY:
                    v.known.clear()
                v.learn({t for _, some in waiting for t in some if t not in v.known})
                for n, some in waiting:
                    counts[n] += sum(map(v.known.__getitem__, some))
                waiting.clear()

            for n, some in _pieces(texts, v):
                waiting.append((n, some))
                held += len(some)
                if held >= CHUNK:
                    settle()
                    held = 0
            settle()
            return [pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())]

        return run

    return append_columns(docs, [text], FIELDS, make)


def op5_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model")).drop("text")
