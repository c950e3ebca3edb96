"""License scan, decontamination, pseudonyms, quality rules, token counts and the codec on small tables."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken

from skyweave.llm import bpe_codec, decontaminate, license_scan, pii, quality_rules, token_count

ROWS = [(1, None, "a"), (2, "", None), (3, "one", "b"), (3, "one", "b"), (None, "  \n\t ", "c"), (5, "word " * 3000, "d")]
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


@pytest.fixture
def docs(spark):
    """Nulls, empty and long texts, repeated rows, and columns named like outputs."""
    return spark.createDataFrame(ROWS, "doc_id long, text string, n_words string").withColumnRenamed("n_words", "N_Words")


def test_license_edges(spark, docs):
    rows = {(r.doc_id, r.n_words): r for r in license_scan.scan(docs).collect()}
    assert rows[(5, 3000)].labels == "" and rows[(1, 0)].first_word is None
    assert license_scan.scan(docs.limit(0)).collect() == []


def test_license_blocks_and_phrases(spark):
    texts = ["Released under the MIT license!\nother", "all rights reserved, CC-BY; cc  by", "the under of released", "ccby cc bye"]
    got = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id").collect()
    assert [r.labels for r in got] == ["mit", "cc-by,reserved", "", ""]
    assert (got[1].n_base, got[1].first_word, got[1].last_word) == (3, 0, 5)
    assert [(m.word, m.containment) for m in got[0].matches] == [(0, 1.0)]


def _judge(text, items):
    """Every column of the operator, by trying each window at each word."""
    at = [m.span() for m in WORD.finditer(fold(text or ""))]
    words, hit, found = [fold(text)[a:b] for a, b in at], set(), []
    for i, item in items:
        own, seen = WORD.findall(fold(item or "")), False
        for k in range(max(1, len(own) - 12) if own else 0):
            piece = own[k : k + 13]
            for p in range(len(words) - len(piece) + 1):
                if words[p : p + len(piece)] == piece:
                    hit.update(range(p, p + len(piece)))
                    seen = True
        found += [str(i)] if seen else []
    runs = [[k, k + 1] for k in sorted(hit) if k - 1 not in hit]
    for r in runs:
        while r[1] in hit:
            r[1] += 1
    named = sorted(found)
    sha = hashlib.sha256(",".join(named).encode()).hexdigest()
    return len(words), len(hit), len(found), named, [(at[a][0], at[b - 1][1]) for a, b in runs], sha, bool(hit) and 20 * len(hit) >= len(words)


@pytest.mark.parametrize(("most", "piece"), [(decontaminate.MOST, decontaminate.PIECE), (decontaminate.MOST, 3), (400, 3)])
def test_decontaminate_against_brute_force(spark, monkeypatch, most, piece):
    monkeypatch.setattr(decontaminate, "PIECE", piece)
    rnd = random.Random(3)
    words = ["a", "B", "Ünï", "d4", "e"]
    text = lambda n: " ".join(rnd.choices(words, k=n))
    items = [(k, text(n)) for k, n in enumerate([3, 13, 14, 20, 40, 1])] + [(9, None), (10, "--")]
    items += [items[4], items[3]]  # repeated items count each
    rows = [(k, text(rnd.randint(0, 60)) + rnd.choice(["", " " + items[rnd.randrange(5)][1], ", " + items[4][1].upper(), " zz " + items[2][1] + " 😀 " + items[0][1]])) for k in range(60)] + [(99, None), (100, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.item_ids, [tuple(s) for s in r.spans], r.items_sha256, r.contaminated) for r in decontaminate.decontaminate(docs, bench, max_window_words=most).collect()}
    assert got == {i: _judge(t, items) for i, t in rows}


def test_decontaminate_codes_any_vocabulary():
    codes = {decontaminate._coded(n) for n in (*range(70_000), 1_112_063, 2_000_000, 16_777_215)}
    assert len(codes) == 70_003 and all(len(c) == 3 and "\0" not in c for c in codes)


def test_decontaminate_spans_and_edges(spark, docs):
    bench = spark.createDataFrame([(1, "Über alles hier")], "item_id long, text string")
    r = decontaminate.decontaminate(spark.createDataFrame([(1, "– Über  ALLES, hier!")], "doc_id long, text string"), bench).first()
    assert "– Über  ALLES, hier!"[r.spans[0].start : r.spans[0].end] == "Über  ALLES, hier"
    assert decontaminate.decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.decontaminate(docs.limit(0), bench).count() == 0


def test_license_notices_wrapped_over_lines(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal"
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:"
    texts = [mit, " * X\n *\n * " + mit.replace("\n", "\n * ") + "\n *\n", "# " + bsd.replace("\n", "\n# "), mit.replace("\n", "\n\n"), mit.replace("\n", " ") + "\nother", ""]
    rows = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.labels, [m.word for m in r.matches]) for r in rows] == [("mit", [0]), ("mit", [1]), ("bsd", [0]), ("mit", [0]), ("mit", [0]), ("", [])]


def test_license_words_in_prose_are_no_notice(spark):
    german = "Wir fahren mit dem Zug under the bridge, sagt der Text, und eine License liegt bei; " + "viele Worte stehen hier und da " * 9 + "bis er released wird"
    cases = {
        "Released under the Apache License": "",
        "Licensed under the GNU General Public License version 2.0": "gpl",
        "Licensed under CC BY 4.0": "cc-by",
        "Licensed under CC BY-SA 4.0": "cc-by",
        "the license was released under protest": "",
        german: "",
        german.replace(", ", "\n"): "",
        "Released under the " + "very " * 6 + "MIT License": "",
        "Released under the plain old MIT License": "mit",
        "# Licensed under the Apache\n# License, Version\n# 2.0": "apache-2.0",
        "to the terms of the Eclipse Public License, v. 2.0: This Source Code Form is subject": "",
        "This Source Code Form is subject to the terms of the Mozilla Public License": "mpl-2.0",
        ("x " * 5000 + "Released under the MIT License\n") * 3: "mit",
    }
    texts = list(cases)
    rows = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.labels for r in rows] == list(cases.values())
    assert [m.word for m in rows[-1].matches] == [5000, 10005, 15010]


def test_pii_links_validates_and_inverts(spark):
    f = pii.Feistel(b"k")
    values = ["ann.b7@x.org", "token = \"0123456789abcdef0123\"", "DE89370400440532013000", "10.0.200.3", "2024-02-29", "31/12/1999", "12/31/1999", "078-05-1120", "4111 1111 1111 1111", "+1 (499) 555-6503", "(415) 555-2671"]
    for v in values:
        new, kinds = pii.swap(f"see {v}, ok", f)
        assert len(kinds) == 1 and v not in new
        assert pii.swap(new, f, back=True)[0] == f"see {v}, ok"
        assert pii.swap(f"{v} and {v}", f)[0].count(new[4:-4]) == 2
    assert pii.luhn(re.sub(r"\D", "", pii.swap("4111 1111 1111 1111", f)[0]))
    assert re.sub(r"\D", "", pii.swap("+1 499 555 6503", f)[0]) == re.sub(r"\D", "", pii.swap("+1 (499) 555-6503", f)[0])
    clean = "Version 1.2.3, 4111 1111 1111 1112, 2024-02-30, 999.1.1.1 and 12 apples"
    assert pii.swap(clean, f) == (clean, [])


def test_pii_values_beside_others():
    card, iban = "4111 1111 1111 1111", "BE68 5390 0754 7034"
    for value, text in (
        (card, f"{card} 12/27"), ("4111111111111111", "4111111111111111 123"), ("4111111111111111", "2 4111111111111111"), (card, f"{card} 123"), ("4111-1111-1111-1111", "4111-1111-1111-1111-123"),
        ("3782 822463 10005", "7 3782 822463 10005 1234"), (iban, f"{iban} THIS"), (iban, f"{iban} BIC"), (iban, f"AB12 IBAN {iban} PAID"),
    ):
        at = text.index(value)
        assert [x[:2] for x in pii.find(text)] == [(at, at + len(value))], text
    two = f"{card} 5500 0000 0000 0004 3 4111111111111111 77 {iban} NOW {card} 99 4000-0000-0000-0002 10 30569309025904 1234 5678 9012 345"
    for key in range(300):
        f = pii.Feistel(b"%d" % key)
        for text in (two, f"{card} 123", "12 4222222222222 4111 1111 1111 1111", f"{iban} THIS", "11 22 33 4444 55555 66666 4111 111 1"):
            new, _ = pii.swap(text, f)
            assert [x[:2] for x in pii.find(new)] == [x[:2] for x in pii.find(text)] and pii.swap(new, f, back=True)[0] == text
    assert pii.swap(f"{card} 123", f)[0][:19] == pii.swap(card, f)[0]
    assert len(pii.find(f"{card} " * 20_000)) == 20_000


def test_pii_edges(spark, docs):
    rows = pii.pseudonymize(docs.withColumnRenamed("N_Words", "kinds"), b"k").collect()
    assert sorted("null" if r.text is None else r.text[:4] for r in rows) == ["", "  \n\t", "null", "one", "one", "word"]
    assert pii.pseudonymize(docs.limit(0), b"k").collect() == []


def test_feistel_is_a_permutation():
    f = pii.Feistel(b"k")
    for n in (1, 2, 7, 100):
        image = [f.permute(x, n, b"t") for x in range(n)]
        assert sorted(image) == list(range(n)) and [f.permute(y, n, b"t", back=True) for y in image] == list(range(n))


def test_quality_edges(spark, docs):
    rows = {(r.doc_id, r.n_words): r for r in quality_rules.judge(docs).collect()}
    assert rows[(5, 3000)].n_repeat_words == 3000 and rows[(5, 3000)].base_failed and not rows[(1, 0)].kept
    assert quality_rules.judge(docs.limit(0)).collect() == []


def test_quality_repeats_and_lines(spark):
    text = "a b c x a b c y c y\n\nL one\nL one\n \nL one"
    r = quality_rules.judge(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r.n_dup_lines, r.n_lines, r.n_words) == (2, 4, 16)
    words = text.split()
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    assert r.n_repeat_words == len({i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)})


@pytest.fixture(scope="module")
def codec():
    ranks = bpe_codec.read_ranks(open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read())
    return bpe_codec.Codec(ranks, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _fuzz(seed, n):
    rnd = random.Random(seed)
    letters = "abc  \n\t\r'sÅé中文😀\x1c\x85​　﻿0١²▁<s>|endoftext|"
    return ["".join(rnd.choices(letters, k=rnd.randint(0, 60))) for _ in range(n)]


def test_codec_equals_library(codec):
    own, library = codec
    texts = [*_fuzz(1, 400), "a" * 3000, "ab" * 2000, "的" * 300, " " * 300 + "x", "<|endoftext|>", "".join(random.Random(2).choices("abcdefgh", k=5000))]
    for t, ids in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(t)
        assert own.decode(ids) == t.encode()


def test_codec_edges(spark, docs):
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    rows = bpe_codec.decode(bpe_codec.encode(docs, path, pattern), path, pattern).collect()
    assert sorted(bytes(r.decoded).decode() for r in rows) == sorted(t or "" for _, t, _ in ROWS)
    assert bpe_codec.recode(docs, path, pattern).select(rows[0].__fields__).collect() == rows
    assert bpe_codec.encode(docs.limit(0), path, pattern).collect() == []


def test_token_counts_equal_library(spark, docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [*_fuzz(4, 400), *("q" * (n % 2) + " " * n + tail for n in range(0, 120, 7) for tail in ("", "the end", "\n  y")), "▁▁ ▁a", "的" * 500]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_count.count_tokens(rows, path, limit=100).collect()}
    assert got == {k: (len(t.encode()), n := len(library.encode(t)), n > 100) for k, t in enumerate(texts)}
    assert sorted(r.n_tokens for r in token_count.count_tokens(docs, path).collect())[:2] == [0, 0]
    assert token_count.count_tokens(docs.limit(0), path).collect() == []
