"""MinHash near-duplicate groups by min-max hashing, with every link confirmed on full shingle sets.

Every permutation gives a set two signature values, its minimum and its maximum, so a signature takes half the hash
evaluations; values are banded into buckets. Documents of equal sets are one class, so copies cost nothing further:

1. Shingle sets are kept for classes that share a bucket. A shingle that one class alone has can't be shared, so
   with u such shingles, a set of n can reach a similarity of at most (n - u) / (n - u + u + u'), which proves most
   edited copies unlinked without any comparison.
2. In every bucket the class with the smallest share of such shingles (nearest to what all were copied from) is the hub;
   the others are compared with their hubs on full sets, and links give components.
3. In buckets that still hold several components, the classes outside the largest one meet all classes of other
   components, and those pairs are compared on full sets that the bound of 1 and a parity sketch admit. (Two sets differ
   in at least as many shingles as their sketches, the parities of their counts in 1024 hash classes, have different
   bits.) The links of 2 and 3 give the final components.

So a link between two classes that share a bucket is lost only inside one component, where it changes nothing. With 36
bands of 5 values, two sets of similarity 0.8 share none with probability 6e-7. Step 3 tests pairs of sketches in number
up to the square of a bucket, if its classes are alike by less than the threshold and by no shared hub: nothing proves
such pairs unlinked otherwise. That work, as every join on a hot bucket, hub, component or set, is dealt into slices of
bounded size, so it spreads over all tasks.

Defined results: a null text, or one without words, has no set and stands alone; a text of fewer words than `width` is
one shingle; a null id stands alone with a null component and is kept; repeated rows share a class and so a component;
rows of one id with different texts are one document: they share a component, and each text's links count;
input columns beyond id and text are not carried (join on the id).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyweave.llm.common import append_columns, as_bytes, materialize, salted_join, table
from skyweave.llm.components import components

WIDTH, BANDS, ROWS, PERCENT = 5, 36, 5, 80
#: Ids broadcast at most (8 bytes each); beyond, the texts are joined by a shuffle.
MOST_IDS = 500_000
#: Hash classes of the parity sketch, and classes of a bucket that meet in one task.
SKETCH, SLICE = 1024, 512
#: Words remembered by a task, and words hashed at a time.
MEMORY, WORDS = 400_000, 400_000
FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, over an array."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class WordHashes:
    """64-bit hashes of words, remembered."""

    def __init__(self, memory: int = MEMORY):
        self.memory = memory
        self.known: dict[bytes, int] = {}

    def of(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > self.memory:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` words (of the whole, if shorter)."""
    n, width = len(words), min(width, len(words))
    if not n:
        return words
    out = np.zeros(n - width + 1, dtype=np.uint64)
    for k in range(width):
        out = mix(out * _A + words[k : n - width + 1 + k] + np.uint64(k + 1))
    return out


def _groups(col: pa.Array, hashes: WordHashes, width: int):
    """Shingle sets (sorted) of a batch's texts, some documents at a time."""
    some, held = [], 0
    for raw in as_bytes(col):
        words = raw.translate(FOLD).split()
        some.append(np.unique(shingles(hashes.of(words), width)))
        held += len(words)
        if held >= WORDS:
            yield some
            some, held = [], 0
    if some:
        yield some


def _signatures(docs: DataFrame, text: str, width: int, bands: int, rows: int, memory: int) -> DataFrame:
    """n, the set's key (k1, k2) and its buckets."""
    fields = [T.StructField("n", T.LongType()), T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField("buckets", T.ArrayType(T.LongType()))]

    def make():
        hashes = WordHashes(memory)
        draw = np.random.Generator(np.random.PCG64(20))
        turns = -(-bands * rows // 2)
        odd = draw.integers(1, 1 << 63, turns, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        off = draw.integers(0, 1 << 63, turns, dtype=np.uint64)
        names = mix(np.arange(1, bands + 1, dtype=np.uint64))

        def sign(sets: list[np.ndarray]):
            sizes = np.array([len(s) for s in sets])
            full = np.flatnonzero(sizes)
            n = len(sets)
            k1, k2, buckets = np.zeros(n, np.uint64), np.zeros(n, np.uint64), [[] for _ in sets]
            if len(full):
                flat = np.concatenate([sets[i] for i in full])
                starts = np.r_[0, np.cumsum(sizes[full])[:-1]]
                k1[full], k2[full] = np.add.reduceat(mix(flat ^ _A), starts), np.add.reduceat(mix(flat ^ _B), starts)
                values = np.empty((2 * turns, len(full)), dtype=np.uint64)
                for t in range(turns):
                    turned = (flat ^ off[t]) * odd[t]
                    values[2 * t], values[2 * t + 1] = np.minimum.reduceat(turned, starts), np.maximum.reduceat(turned, starts)
                banded = np.zeros((bands, len(full)), dtype=np.uint64)
                # A band takes values of different permutations: value k of band b is number b + k * bands.
                for k in range(rows):
                    banded = mix(banded * _A + values[np.arange(bands) + k * bands])
                banded = mix(banded ^ names[:, None]).view(np.int64).T
                for i, b in zip(full, banded.tolist(), strict=True):
                    buckets[i] = b
            return sizes, k1.view(np.int64), k2.view(np.int64), buckets

        def run(col: pa.Array) -> list[pa.Array]:
            parts = [sign(s) for s in _groups(col, hashes, width)]
            if not parts:
                return [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))]
            return [*(pa.array(np.concatenate([p[k] for p in parts]).astype(np.int64)) for k in range(3)), pa.array([b for p in parts for b in p[3]], pa.list_(pa.int64()))]

        return run

    return append_columns(docs, [text], fields, make).drop(text)


def _sets(docs: DataFrame, text: str, width: int, memory: int) -> DataFrame:
    """The whole shingle set of each text, its key (k1, k2) and its parity sketch."""
    longs = T.ArrayType(T.LongType())

    def sketch(s: np.ndarray) -> np.ndarray:
        odd = np.bincount((s & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1
        return np.packbits(odd.astype(np.uint8)).view(np.int64)

    def make():
        hashes = WordHashes(memory)

        def run(col: pa.Array) -> list[pa.Array]:
            sets = [s for some in _groups(col, hashes, width) for s in some]
            keys = np.array([(mix(s ^ _A).sum(dtype=np.uint64), mix(s ^ _B).sum(dtype=np.uint64)) for s in sets], dtype=np.uint64).reshape(-1, 2).view(np.int64)
            return [pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array([sketch(s) for s in sets], pa.list_(pa.int64()))]

        return run

    fields = [T.StructField("shingles", longs), T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField("sketch", longs)]
    return append_columns(docs, [text], fields, make).drop(text)


def _fits(n: Column, u: Column, n2: Column, u2: Column, percent: int) -> Column:
    """Whether two sets' sizes and unshared shingles leave room for the similarity."""
    most = F.least(n - u, n2 - u2)
    return 100 * most >= percent * (n + n2 - most)


def _sketches_fit(n: Column, a: Column, n2: Column, b: Column, percent: int) -> Column:
    """Whether two sets' sketches leave room for the similarity: with d shingles apart, it is (n + n2 - d) / (n + n2 + d)."""
    apart = sum(F.bit_count(a[k].bitwiseXOR(b[k])) for k in range(SKETCH // 64))
    return 100 * (n + n2 - apart) >= percent * (n + n2 + apart)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH, bands: int = BANDS, rows: int = ROWS, percent: int = PERCENT, memory: int = MEMORY) -> DataFrame:
    """(id, n_shingles, component_id, kept): groups of documents linked by a similarity of `percent` hundredths or more."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    signed = materialize(_signatures(base, "text", width, bands, rows, memory), "signatures")
    usable = signed.where("n > 0 and id is not null")
    classes = usable.groupBy("k1", "k2").agg(F.min("id").alias("id"), F.min("n").alias("n"), F.count("*").alias("rows"), F.first("buckets").alias("buckets"))
    classes = materialize(classes.withColumn("v", F.monotonically_increasing_id()), "classes")
    several = not usable.groupBy("id").count().where("count > 1").isEmpty()
    links = _links(base, classes, several, width, percent, memory)
    if several:
        links = links.union(_same_id(usable, classes))
    found = components(links)
    # A component's name is the smallest id of its classes.
    ids = classes.select("v", "id")
    least = found.join(ids, "v").groupBy("component").agg(F.min("id").alias("other")).join(ids.withColumnRenamed("v", "component"), "component").select("component", F.least("id", "other").alias("name"))
    least = materialize(least, "names")
    placed = salted_join(found, least, ["component"], "v").select("v", "name").union(least.select(F.col("component").alias("v"), "name"))
    named = classes.join(placed, "v", "left").select("k1", "k2", F.coalesce("name", "id").alias("component"))
    out = salted_join(usable.select("id", "n", "k1", "k2"), named, ["k1", "k2"], "id", counts=classes.select("k1", "k2", "rows")).select("id", "n", "component")
    out = out.union(signed.where("n = 0 or id is null").select("id", "n", F.col("id").alias("component")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), (F.col("id").isNull() | (F.col("id") == F.col("component"))).alias("kept"))


def _same_id(usable: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of rows of one id."""
    held = salted_join(usable.select("id", "k1", "k2"), classes.select("k1", "k2", "v"), ["k1", "k2"], "id", counts=classes.select("k1", "k2", "rows"))
    held = materialize(held.select("id", "v").distinct(), "held")
    firsts = held.groupBy("id").agg(F.min("v").alias("a"), F.max("v").alias("last")).where("a < last").select("id", "a")
    return salted_join(held, firsts, ["id"], "v").where("a < v").select("a", F.col("v").alias("b"))


def _links(base: DataFrame, classes: DataFrame, several: bool, width: int, percent: int, memory: int) -> DataFrame:
    """Confirmed links (a, b) between classes, enough of them to give all components. `several`: an id may repeat."""
    one = classes.select("v", "n", F.explode("buckets").alias("bucket"))
    full = materialize(one.groupBy("bucket").agg(F.count("*").alias("rows")).where("rows > 1"), "full")
    members = materialize(salted_join(one, full.select("bucket"), ["bucket"], "v", counts=full), "buckets")
    ids = members.select("v", "n").distinct()
    wanted = materialize(classes.join(ids.select("v"), "v", "left_semi").select("v", "id", "k1", "k2"), "wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= MOST_IDS else wanted
    texts = base.where("id is not null").join(wanted, "id").select("v", F.col("k1").alias("w1"), F.col("k2").alias("w2"), "text")
    sets = _sets(texts, "text", width, memory).where("k1 = w1 and k2 = w2").select("v", "shingles", "sketch")
    sets = materialize(sets.groupBy("v").agg(F.first(F.struct("shingles", "sketch")).alias("s")).select("v", "s.*") if several else sets, "sets")
    alone = sets.select("v", F.explode("shingles").alias("s")).groupBy("s").agg(F.max("v").alias("v"), F.count("*").alias("c")).where("c = 1").groupBy("v").agg(F.count("*").alias("u"))
    rated = materialize(ids.join(alone, "v", "left").select("v", "n", F.coalesce("u", F.lit(0)).alias("u")).where(f"100 * (n - u) >= {percent} * n"), "rated")
    members = members.select("bucket", "v").join(rated, "v")
    hubs = members.groupBy("bucket").agg(F.min(F.struct((F.col("u") / F.col("n")).alias("r"), "v", "n", "u")).alias("h")).select("bucket", F.col("h.v").alias("hub"), F.col("h.n").alias("hn"), F.col("h.u").alias("hu"))
    met = salted_join(members, hubs, ["bucket"], "v", counts=full).where((F.col("v") != F.col("hub")) & _fits(F.col("n"), F.col("u"), F.col("hn"), F.col("hu"), percent))
    first = materialize(_confirm(met.select(F.col("v").alias("a"), F.col("hub").alias("b")).distinct(), sets, percent), "links-1")
    near = components(first)
    placed = members.join(near, "v", "left").withColumn("component", F.coalesce("component", "v"))
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("bucket")
    left = materialize(salted_join(placed, mixed, ["bucket"], "v", counts=full), "mixed")
    sizes = left.groupBy("bucket", "component").count()
    largest = materialize(sizes.groupBy("bucket").agg(F.max_by("component", F.struct("count", "component")).alias("largest"), F.sum("count").alias("rows")), "largest")
    left = salted_join(left, largest, ["bucket"], "v", counts=largest.select("bucket", "rows")).join(sets.select("v", "sketch"), "v")
    slices = F.ceil(F.col("rows") / SLICE)
    x = left.where("component != largest").select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), slices - 1)).alias("slice"), *[F.col(c).alias(f"x_{c}") for c in ("v", "n", "u", "component", "sketch")])
    left = left.withColumn("slice", F.pmod(F.xxhash64("v"), slices))
    cross = (F.col("component") != F.col("x_component")) & _fits(F.col("n"), F.col("u"), F.col("x_n"), F.col("x_u"), percent) & _sketches_fit(F.col("n"), F.col("sketch"), F.col("x_n"), F.col("x_sketch"), percent)
    rest = left.join(x, (left["bucket"] == x["bucket"]) & (left["slice"] == x["slice"]) & cross).select(F.least("v", "x_v").alias("a"), F.greatest("v", "x_v").alias("b")).distinct()
    second = _confirm(rest, sets, percent)
    return first.union(second)


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole sets are similar enough."""
    pairs = materialize(pairs, "pairs")
    a = sets.select(F.col("v").alias("a"), F.col("shingles").alias("s"))
    b = sets.select(F.col("v").alias("b"), F.col("shingles").alias("t"))
    both = salted_join(salted_join(pairs, b, ["b"], "a"), a, ["a"], "b", counts=pairs.groupBy("a").agg(F.count("*").alias("rows")))
    both = both.select("a", "b", (F.size("s") + F.size("t")).alias("n"), F.size(F.array_intersect("s", "t")).alias("i"))
    return both.where(100 * F.col("i") >= percent * (F.col("n") - F.col("i"))).select("a", "b")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, by two-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=2)


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS a, generate_subscripts(w, 1) AS i, len(w) AS n FROM d),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, n, a, lead(a) OVER (PARTITION BY doc_id ORDER BY i) AS b, CASE WHEN n = 1 THEN a ELSE a || ' ' || b END AS sh FROM u) WHERE sh IS NOT NULL),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN z p ON p.doc_id = a JOIN z q ON q.doc_id = b WHERE 100 * i >= 80 * (p.n + q.n - i)),
g AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(v, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT g.b, r.c FROM r JOIN g ON g.a = r.v AND r.c < g.b)
SELECT d.doc_id, CAST(coalesce(z.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id, m.c = d.doc_id AS kept
FROM d LEFT JOIN z USING (doc_id) JOIN (SELECT v, min(c) AS c FROM r GROUP BY v) m ON m.v = d.doc_id"""
