"""Benchmark decontamination with one Aho-Corasick automaton over normalised benchmark windows.

Benchmark words are numbered, and a number is written as three characters of three alphabets, so the automaton's nodes
stay narrow and no vocabulary is too large. Every window is such a string; a document, mapped likewise, is scanned once;
a match's end is a word index, which maps back to character offsets in the original text.

The automaton is the only thing broadcast, and its size is checked: beyond `max_window_words` window words the windows
are dealt into shards of about that size. The shards are scanned one after another, each over what the one before wrote,
and word ranges and items merge row by row, so one automaton at a time is in memory (on the driver too), the result
doesn't depend on the number of shards, and nothing is shuffled.

Defined results: a null or empty text (or one without words) has no words and no hits; an item without words is never
found; repeated items each count by their own id; a null item id is skipped in `item_ids`; repeated documents are judged
row by row; an empty benchmark leaves every document clean; input columns named like an output column are replaced.
"""

from __future__ import annotations

import hashlib
import math
import re
import uuid

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyweave.llm.common import FOLD_WORDS, append_columns, as_bytes, discard, materialize, table

WINDOW, MIN_SHARE_INVERSE = 13, 20
#: Window words of an automaton (three nodes each at most), and windows of a piece of a long item.
MOST, PIECE = 2_000_000, 10_000
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_DIGITS, _OTHER = 3, "\0\0\0"

_RANGES = T.ArrayType(T.StructType([T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType())]))
_ITEMS = T.ArrayType(T.StructType([T.StructField("k", T.LongType()), T.StructField("id", T.StringType())]))
FIELDS = [
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()),
    T.StructField("item_ids", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType()),
]
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string(), pa.bool_()]
_STATE_TYPES = [pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])), pa.list_(pa.struct([("k", pa.int64()), ("id", pa.string())]))]


def _coded(n: int) -> str:
    """Word number n in characters."""
    return chr(1 + (n >> 16)) + chr(257 + (n >> 8) % 256) + chr(513 + n % 256)


def build_automaton(items: list[Row], window: int = WINDOW) -> tuple[dict[bytes, str], ahocorasick.Automaton]:
    """Vocabulary and automaton of item pieces (k, id, words). A value is (words in the window, owners as (k, id))."""
    vocabulary: dict[bytes, str] = {}
    found: dict[str, set[tuple[int, str]]] = {}
    for r in items:
        codes = [vocabulary.setdefault(w, _coded(len(vocabulary))) for w in r.words.encode().split()]
        for i in range(max(1, len(codes) - window + 1) if codes else 0):
            found.setdefault("".join(codes[i : i + window]), set()).add((r.k, r.id))
    automaton = ahocorasick.Automaton()
    for key, owners in found.items():
        automaton.add_word(key, (len(key) // _DIGITS, tuple(owners)))
    if found:
        automaton.make_automaton()
    return vocabulary, automaton


def _pieces(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(k, id, words, size): items by row number, long ones cut into pieces that hold every window once."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = F.regexp_extract_all(F.translate(F.col("t"), upper, lower), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))
    rows = benchmark.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("t")).select("id", words.alias("w"), F.monotonically_increasing_id().alias("k")).where("size(w) > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)), F.lit(PIECE))
    cut = rows.select("k", "id", "w", F.explode(starts).alias("at")).select("k", "id", "at", F.slice("w", F.col("at") + 1, PIECE + window - 1).alias("w"))
    size = F.greatest(F.size("w") - window + 1, F.lit(1)) * F.least(F.size("w"), F.lit(window))
    return materialize(cut.select("k", "id", "at", F.array_join("w", " ").alias("words"), size.cast("long").alias("size")), "windows")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, max_window_words: int = MOST) -> DataFrame:
    """`docs` with n_words, n_hit, n_items, item_ids, spans (character ranges of hit word runs), items_sha256, contaminated."""
    pieces = _pieces(benchmark, item_id, item_text, window)
    total = pieces.agg(F.sum("size").alias("n")).first().n or 0
    # Hashing deals unevenly, hence half-full shards.
    shards = 1 if total <= max_window_words else math.ceil(2 * total / max_window_words)
    own = uuid.uuid4().hex
    state = [f"ranges_{own}", f"items_{own}"]
    out = docs.withColumns({state[0]: F.array().cast(_RANGES), state[1]: F.array().cast(_ITEMS)})
    for k in range(shards):
        items = pieces.where(F.pmod(F.xxhash64("k", "at"), F.lit(shards)) == k).select("k", "id", "words").collect()
        shared = docs.sparkSession.sparkContext.broadcast(build_automaton(items, window))
        if k == shards - 1:
            return _scan(out, text, shared, state, last=True).drop(*state)
        after = materialize(_scan(out, text, shared, state, last=False), "scanned")
        shared.unpersist()
        discard(out)
        out = after
    raise AssertionError("there is always a shard")


def _joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges in order, overlapping and touching ones merged."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def _scan(docs: DataFrame, text: str, shared, state: list[str], last: bool) -> DataFrame:
    """One scan: word ranges and items found so far go on to the next, or give the columns of FIELDS."""

    def make():
        vocabulary, automaton = shared.value
        get, live = vocabulary.get, len(automaton) > 0

        def run(col: pa.Array, ranges: pa.Array, items: pa.Array) -> list[pa.Array]:
            rows = []
            for raw, before, owned in zip(as_bytes(col), ranges.to_pylist(), items.to_pylist(), strict=True):
                words = raw.translate(FOLD_WORDS).split()
                hits = list(automaton.iter("".join([get(w, _OTHER) for w in words]))) if live and words else []
                runs, found = [(r["lo"], r["hi"]) for r in before], {(x["k"], x["id"]) for x in owned}
                if hits:
                    ends = [((end + 1) // _DIGITS, n) for end, (n, _) in hits]
                    runs = _joined(runs + [(end - n, end) for end, n in ends])
                    found.update(x for _, (_, owners) in hits for x in owners)
                rows.append(_result(raw, len(words), runs, found) if last else ([{"lo": lo, "hi": hi} for lo, hi in runs], [{"k": k, "id": i} for k, i in sorted(found, key=lambda x: x[0])]))
            return [pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES if last else _STATE_TYPES)]

        return run

    fields = FIELDS if last else [T.StructField(state[0], _RANGES), T.StructField(state[1], _ITEMS)]
    return append_columns(docs, [text, *state], fields, make)


def _result(raw: bytes, n_words: int, runs: list[tuple[int, int]], found: set[tuple[int, str]]) -> tuple:
    named = sorted(i for _, i in found if i is not None)
    n_hit = sum(hi - lo for lo, hi in runs)
    sha = hashlib.sha256(",".join(named).encode()).hexdigest()
    return n_words, n_hit, len(found), named, _spans(raw, runs), sha, n_hit > 0 and MIN_SHARE_INVERSE * n_hit >= n_words


def _spans(raw: bytes, runs: list[tuple[int, int]]) -> list[dict]:
    """Character offsets, in the original text, of runs of word indexes."""
    if not runs:
        return []
    at = [m.span() for m in _WORD.finditer(raw.lower())]
    out, chars, place = [], 0, 0
    for lo, hi in runs:
        ends = []
        for b in (at[lo][0], at[hi - 1][1]):
            chars, place = chars + len(raw[place:b].decode()), b
            ends.append(chars)
        out.append({"start": ends[0], "end": ends[1]})
    return out


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "item_ids", "spans")
