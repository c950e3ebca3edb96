"""The pipeline against a brute-force version, and its stages on awkward rows."""

import hashlib
import random
import struct

import duckdb
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tiktoken

import corpus_pipeline
from skyweave.llm import bpe_codec, pii, quality_rules
from tests.llm.test_corpus_operators import _groups
from tests.llm.test_text_operators import WORD, fold
from tests.oracle import SMALL


def _plain_contaminated(text, windows):
    words = WORD.findall(fold(text))
    hit = {i + k for n in {len(w) for w in windows} for i in range(len(words) - n + 1) if tuple(words[i : i + n]) in windows for k in range(n)}
    return bool(hit) and 20 * len(hit) >= len(words)


def _brute_force(folder, rows):
    """{doc_id: digest of ids} by plain loops over the rows (doc_id, text)."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    good = {r[0] for r in con.execute(f"SELECT doc_id FROM ({quality_rules.ORACLE_SQL}) WHERE kept").fetchall()}
    rows = [r for r in rows if r[0] in good]
    groups = _groups([t for _, t in rows], [i for i, _ in rows], width=5)
    keep = {i for i, _, _, kept in groups if kept}
    windows = set()
    for (item,) in con.execute(f"SELECT text FROM '{folder}/benchmark.parquet'").fetchall():
        words = WORD.findall(fold(item or ""))
        windows |= {tuple(words[i : i + 13]) for i in range(max(1, len(words) - 12))} if words else set()
    ranks = bpe_codec.read_ranks(open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    feistel, out = pii.Feistel(pii.DEMO_KEY), {}
    for i, text in rows:
        if i in keep and not _plain_contaminated(text, windows):
            new = pii.swap(text, feistel)[0]
            ids = library.encode_ordinary(new)
            out[i] = (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(new.encode()).hexdigest())
    return out


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """The small documents, with near copies at and below the threshold, and its benchmark."""
    at = tmp_path_factory.mktemp("corpus")
    docs = pq.read_table(f"{SMALL}/documents.parquet")
    rnd = random.Random(3)
    extra = []
    for k, text in enumerate(docs["text"].to_pylist()[:40]):
        words = (text or "").split(" ")
        for n in (1, len(words) // 60, len(words) // 30):
            for _ in range(n):
                words[rnd.randrange(len(words))] = f"edit{rnd.randrange(10**6)}"
            extra.append({"doc_id": 10_000 + 10 * k + n % 10, "text": " ".join(words), "lang": "en", "source": "s", "n_chars": 0})
    extra = list({e["doc_id"]: e for e in extra}.values())
    pq.write_table(pa.concat_tables([docs, pa.Table.from_pylist(extra, schema=docs.schema)]), at / "documents.parquet")
    pq.write_table(pq.read_table(f"{SMALL}/benchmark.parquet"), at / "benchmark.parquet")
    return str(at)


def test_pipeline_against_brute_force(spark, folder):
    rows = pq.read_table(f"{folder}/documents.parquet")
    rows = list(zip(rows["doc_id"].to_pylist(), rows["text"].to_pylist(), strict=True))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, folder).collect()}
    want = _brute_force(folder, rows)
    assert got == want and 20 < len(want) < len(rows)


def test_stages_on_awkward_rows(spark, folder):
    """Nulls, empty and very long texts, repeated rows and ids, an empty table, and columns named like outputs."""
    rnd = random.Random(4)
    prose = lambda n: " ".join(rnd.choice(["the", "of", "and", "to", "that", "have", "with", "be"]) + f" w{rnd.randrange(10**6)}" for _ in range(n)) + "."
    a, b, c = prose(60), prose(60), prose(60) + " Mail ann@x.org"
    rows = [(1, a, "mine"), (1, a, "mine"), (2, a, None), (3, b, "k"), (3, c, "k"), (4, None, "k"), (5, "", "k"), (None, c, "k"), (None, c, "k"), (None, prose(70), "k"), (6, prose(20_000), "k")]
    docs = spark.createDataFrame([(i, t, "en", 0, k, i, k) for i, t, k in rows], "doc_id long, text string, lang string, n_chars long, kinds string, n_found long, kept string")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).collect() == []
        columns = docs.columns
        docs = stage(spark, docs, folder)
        seen[name] = docs.collect()
        docs = spark.createDataFrame(seen[name], docs.schema)
        assert name == "byte-level BPE" or docs.columns == columns
    assert sorted(str(r.doc_id) for r in seen["quality rules"]) == sorted(map(str, [1, 1, 2, 3, 3, None, None, None, 6]))
    kept = seen["MinHash near-dedup"]
    assert sorted(str(r.doc_id) for r in kept) == sorted(map(str, [1, 3, 3, None, None, 6]))
    after = {(r.doc_id, r.kinds, r.n_found, r.kept) for r in seen["PII"]}
    assert after == {(r.doc_id, r.kinds, r.n_found, r.kept) for r in kept} and (1, "mine", 1, "mine") in after
    assert all(r.n_chars == len(r.text) and "ann@x.org" not in r.text for r in seen["PII"])
    assert len(seen["byte-level BPE"]) == len(kept)


def test_key_setting(spark):
    with pytest.warns(UserWarning, match="public key"):
        assert pii.key_of(spark) == pii.DEMO_KEY
    spark.conf.set(pii.KEY_SETTING, "own")
    assert pii.key_of(spark) == b"own"
    spark.conf.unset(pii.KEY_SETTING)
