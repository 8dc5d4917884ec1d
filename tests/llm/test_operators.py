"""Operators against plain versions, round trips and held-out rows; odd inputs of each."""

from __future__ import annotations

import hashlib
import math
import random
import re
import textwrap
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemospark.llm import (
    decontamination, jaccard_join, lang_id, licence_scan, pii, piece_sampling, spot_signatures, suffix_dedup, token_files, toxicity,
)
from mnemospark.llm.common import components, new_path, tokenizer_file
from tests.llm import brute_force as brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, items string"
LONG = " ".join(f"w{i}" for i in range(20_000))
ODD = [
    (0, None, None, None, None, 0.5, "x"), (1, "", "en", "s", 0, None, None), (2, " \t\n", "en", "s", 3, None, None),
    (3, "the cat sat on the mat and the dog ran", "en", None, None, None, None),
    (4, "the cat sat on the mat and the dog ran", "en", "s", 38, None, None),
    (4, "the cat sat on the mat and the dog ran", "en", "s", 38, None, None),
    (None, "der Hund und die Katze sind im Haus", None, None, None, None, None), (5, LONG, "en", "s", len(LONG), None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, None) for i in range(6)], "doc_id long, toxic int, text string")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa", 1), (2, "too short", 2), (3, None, 3)], "item_id long, text string, doc_id long")


def runs(odd, labels, benchmark, spark):
    """Each operator, applied to a table of documents."""
    pieces, words = tokenizer_file("piece_bpe_32k.model"), tokenizer_file("word_bpe_49k.json")

    def files(df):
        path = new_path(spark)
        token_files.write_tokens(df, path, words)
        return token_files.read_tokens(spark, path, digests=True)

    return {
        "dedup": suffix_dedup.digests, "language": lang_id.languages,
        "decontamination": lambda df: decontamination.contamination(df, benchmark),
        "files": files, "licence": licence_scan.scan, "pieces": lambda df: piece_sampling.report(df, pieces, k=1),
        "spots": spot_signatures.edited, "pii": pii.report, "toxicity": lambda df: toxicity.toxicity(df, labels),
        "jaccard": jaccard_join.jaccard_components,
    }


def test_odd_rows_keep_their_number_and_empty_tables_stay_empty(spark, odd, empty, labels, benchmark):
    for name, run in runs(odd, labels, benchmark, spark).items():
        assert run(odd).count() == len(ODD), name
        assert run(empty).count() == 0, name


def test_filters_keep_clean_rows_and_all_columns(spark, odd, labels, benchmark):
    for out in (
        decontamination.without_contaminated(odd, benchmark), pii.without_pii(odd),
        toxicity.without_toxic(odd, labels.where("toxic = 0")),
    ):
        assert out.columns == odd.columns and out.count() == len(ODD)
    kept = jaccard_join.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.select("doc_id").collect()) == [
        (False, 0), (False, 1), (False, 2), (False, 3), (False, 5), (True, 0)
    ]


def passages(n: int, seed: int) -> list[tuple[int, str]]:
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    base = [rng.choice(words) for _ in range(60)]
    rows = []
    for i in range(n):
        if i % 4 == 0:
            w = [rng.choice(words) for _ in range(rng.randint(0, 12))]
        elif i % 4 == 1:
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(words)
        elif i % 4 == 2:
            w = base[:27] + [rng.choice(words) for _ in range(rng.randint(0, 6))]
        else:
            w = base[: rng.randint(1, 60)]
        rows.append((i, " ".join(w)))
    return [*rows, (n + 1, None), (n + 2, ""), (n + 3, "  ")]


@pytest.mark.parametrize("n, percent", [(4, 85), (5, 80)])
def test_jaccard_components_equal_all_pairs(spark, monkeypatch, n, percent):
    monkeypatch.setattr(jaccard_join, "SMALL_GROUP", 4)
    rows = passages(160, n)
    got = {r[0]: (r[1], r[2]) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), n, percent).collect()}
    assert got == brute.groups(rows, n, percent)


def test_jaccard_components_of_a_large_family(spark):
    """500 near copies of one text that lack some of its lines and share others that it lacks."""
    rng = random.Random(11)
    base = [" ".join(f"b{i}x{k}" for k in range(8)) for i in range(30)]
    extra = [" ".join(f"e{i}x{k}" for k in range(8)) for i in range(12)]
    rows = []
    for i in range(500):
        lines = [line for line in base if rng.random() > rng.choice([0.02, 0.1])]
        lines += [line for line in extra if rng.random() < rng.choice([0.05, 0.25])]
        rows.append((i, " ".join(lines)))
    got = {r[0]: (r[1], r[2]) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()}
    want = brute.groups(rows, 4, 85)
    assert got == want and 1 < len({c for _, c in want.values()}) < 500


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(0, 30) if i != 12]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 if i <= 12 else 13 for i in range(31)}


def test_repeated_strings_equal_plain_search(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "ANCHOR_SEGMENTS", 3)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 20_000)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 3000)
    rng = random.Random(4)
    line = "".join(rng.choice("abcdefgh ") for _ in range(90))
    passage = "".join(rng.choice("äbcdefgh ") for _ in range(400))
    rows = []
    for i in range(60):
        body = "".join(rng.choice("abcdefgh \n") for _ in range(rng.randint(0, 700)))
        rows.append((i, (line if i % 2 else "") + body + (passage if i % 3 == 0 else "") + body[:50]))
    rows += [(100, rows[3][1]), (101, None), (102, "a" * 500), (103, "")]
    got = {r[0]: tuple(r[1:]) for r in suffix_dedup.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.repeats(rows, suffix_dedup.WIDTH)


def test_language_of_held_out_rows(spark):
    rng = random.Random(2)
    said = {"en": "the house and this water that thing with those", "de": "das haus und dieses wasser der ding mit jenen schön", "fr": "la maison et cette eau que chose avec ceux été"}
    rows = []
    for i in range(240):
        lang = list(said)[i % 3]
        rows.append((i, " ".join(rng.choice(said[lang].split()) for _ in range(20)), lang))
    rows += [(900, "12 34 !", "en"), (901, None, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in lang_id.languages(df).collect()}
    want = {i: lang for i, _, lang in rows[:-2]}
    assert all(got[i]["lang_pred"] == lang for i, lang in want.items())
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901))


def test_toxic_words_are_found_in_held_out_rows_and_misspelt(spark):
    rng = random.Random(9)
    calm = [f"{a}{b}{c}" for a in ("ta", "mo", "ri", "se") for b in ("lon", "ver", "dak", "pim") for c in ("en", "or", "is")]
    bad = ["grumblewort", "snarkfiend", "blightwretch"]
    rows, marks = [], []
    for i in range(400):
        words = [rng.choice(calm) for _ in range(rng.randint(20, 60))]
        if i % 4 == 0:
            words[rng.randrange(len(words))] = rng.choice(bad)
        rows.append((i, " ".join(words)))
        marks.append((i, int(i % 4 == 0)))
    rows.append((1000, " ".join([*calm[:20], "grumblewortt", *calm[20:40]])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.toxicity(df, spark.createDataFrame(marks, "doc_id long, toxic int")).collect()}
    held = [i for i, _ in marks if got[i]["held_out"]]
    right = sum(got[i]["predicted"] == int(i % 4 == 0) for i in held)
    assert right >= 0.95 * len(held) and got[1000]["predicted"] == 1


def test_benchmark_passages_are_found_with_edits(spark, benchmark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    noise = "one two three four five six seven"
    rows = [(1, f"{noise} {item} {noise}"), (2, f"{noise} Alpha, beta gamma: delta epsilon zeta eta theta iota kappa!"), (3, noise), (4, "alpha beta gamma delta epsilon"), (5, None)]
    got = {r["doc_id"]: r for r in decontamination.contamination(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect()}
    assert {i for i, r in got.items() if r["contaminated"]} == {1, 2} and got[1]["items"] == [1]
    assert got[1]["similarity"] == 1.0


def test_licences(spark):
    rows = [
        (1, "words\nReleased under the MIT License.\nmore"), (2, "Licensed under the Apache License, Version 2.0."),
        (3, "This work is licensed under the GNU General Public License, version 3."), (4, "she has a licence to drive in the general public area"),
        (5, "Licensed under CC BY-NC 4.0."), (6, None),
    ]
    got = {r["doc_id"]: r["licences"] for r in licence_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ["MIT"], 2: ["Apache"], 3: ["GPL"], 4: [], 5: ["CC-BY-NC"], 6: []}


def test_hashes_of_training_equal_those_of_the_scan(spark):
    row = spark.range(1).select(F.xxhash64(F.lit("straße")), F.xxhash64(F.lit("a"), F.lit("b"))).first()
    assert tuple(row) == (licence_scan._hash("straße"), licence_scan._hash("a", "b"))


def test_edited_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(spot_signatures, "BUCKET_ROWS", 7)
    rng = random.Random(1)
    words = ["the", "of", "und", "cat", "dog", "haus", "très", "blue"]
    rows = [(i * i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for i in range(60)]
    got = {r["doc_id"]: r for r in spot_signatures.edited(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    down = sorted(rows, reverse=True)
    for i, (doc_id, text) in enumerate(down):
        after = down[(i + 1) % len(down)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert got[doc_id]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[doc_id]["n_chars"] == len(text)


def test_near_fingerprints(spark):
    text = " ".join(f"the word{i} of thing{i}" for i in range(40))
    rows = [(1, text), (2, text), (3, text + " the end of it"), (4, "the other text of a kind")]
    pairs = spot_signatures.near_pairs(spark.createDataFrame(rows, "doc_id long, text string"), 0.8).collect()
    assert [(r["a"], r["b"]) for r in pairs] == [(1, 3)] and 0.9 < pairs[0]["likeness"] < 1


@pytest.mark.parametrize("text, found", [
    ("john.doe [at] mail1 [dot] example [dot] com", "john.doe [at] mail1 [dot] example [dot] com"),
    ("so jane at example dot com ok", "jane at example dot com"), ("jоhn@exаmple.com", "jоhn@exаmple.com"),
    ("call plus one five five five one two three four five six seven ok", "plus one five five five one two three four five six seven"),
    ("４１１１ １１１１ １１１１ １１１１", "４１１１ １１１１ １１１１ １１１１"), ("look at www.example.com", None), ("see you at noon. dot the i", None),
])
def test_disguised_identifiers_map_back(text, found):
    plain = pii.plain_spans(text)
    added = [text[a:b] for spans in pii.added_spans(text, plain).values() for a, b in spans]
    assert added == ([found] if found else []) and not any(plain.values())


@pytest.mark.parametrize("text", [
    "192[.]168[.]1[.]1", "192 (dot) 168 (dot) 1 (dot) 1", "192 dot 168 dot 1 dot 1", "192(.)168(.)1(.)1", "192.168.one.1", "10 [dot] zero {.} 0 point one",
    "4111 1111 1111 one one one 1", "4111 1111 1111 111one", "+1 555 five 551234", "plus 1 555 one 23 4567", "+1 dot 555 dot 123 dot 4567",
])
@pytest.mark.parametrize("frame", ["{}", "so {} ok", "12, {}, 7 of one point two"])
def test_numbers_with_few_spelled_signs(text, frame):
    whole = frame.format(text)
    assert text not in pii.masked(whole)
    added = pii.added_spans(whole, pii.plain_spans(whole))
    assert text in [whole[a:b] for spans in added.values() for a, b in spans]


@pytest.mark.parametrize("address", ["john @ example.com", "john @example.com", "john@ example.com", "john.doe\t@\tmail.example.com", "john\u00a0@\u00a0example.com"])
@pytest.mark.parametrize("rest", ["", " to the point"])
def test_loose_at_signs_need_no_other_cue(address, rest):
    assert pii.masked(f"write to {address}{rest}") == f"write to <EMAIL>{rest}"


@pytest.mark.parametrize("text", ["192 dot 168 dot 1 dot 256", "4111 1111 1111 one one one 2", "one 1999", "1999, 2000, 2001, 2002 point 5", "5 " + "1" * 200 + "x one two"])
def test_numbers_that_fail_their_check_stay(text):
    assert pii.masked(text) == text


def test_token_blocks_round_trip_and_damage():
    rng = np.random.default_rng(1)
    blocks = [rng.choice([3, 50, 49407, 7], int(rng.integers(1, 300))) if k % 2 else rng.integers(0, 65536, int(rng.integers(1, 300))) for k in range(9)]
    words = token_files.encode(blocks)
    back = token_files.decode([w.astype(np.int64) for w in words], [len(b) for b in blocks])
    assert all((a == b).all() for a, b in zip(blocks, back))
    body = bytearray(token_files.packed([5, None], [blocks[0], blocks[1]]))
    ids, documents = token_files.unpacked(bytes(body))
    assert ids == [5, None] and (documents[1] == blocks[1]).all()
    body[-3] ^= 255
    with pytest.raises(ValueError):
        token_files.unpacked(bytes(body))


def test_token_files_equal_the_tokenizer(spark):
    from tokenizers import Tokenizer

    path, model = new_path(spark), tokenizer_file("word_bpe_49k.json")
    rows = [(3, "Don't we'll  x\ty <|endoftext|>a İstanbul ΣΑΣ ﬁ é"), (1, None), (2, "hello world\n\nagain"), (7, LONG)]
    token_files.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path, model)
    got = {r["doc_id"]: r for r in token_files.read_tokens(spark, path).collect()}
    start = 0
    for doc_id, text in sorted(rows):
        ids = [*Tokenizer.from_file(model).encode(text or "", add_special_tokens=False).ids, 2]
        assert got[doc_id]["ids"] == ids and got[doc_id]["start"] == start and got[doc_id]["n_tokens"] == len(ids)
        start += len(ids)


def test_samples_follow_the_lattice_and_decode():
    vocab = piece_sampling.vocabulary(tokenizer_file("piece_bpe_32k.model"))
    n = 4000
    out = piece_sampling.sample(["the"] * n, [piece_sampling.row_key(i, 0) for i in range(n)], vocab, 3)
    counts = Counter(tuple(x[0][0].tolist()) for x in out)
    assert 2 <= len(counts) <= 8
    for ids, c in counts.items():
        p = next(math.exp(x[1]) for d in out for x in d if tuple(x[0].tolist()) == ids)
        assert abs(c / n - p) < 0.04
    assert all(len({tuple(s[0].tolist()) for s in x}) == 3 and x[0][2] >= x[1][2] >= x[2][2] for x in out)
    everything = piece_sampling.sample(["the"], [5], vocab, 50)[0]
    assert len(everything) == 8 and all(x[3] == 0.0 for x in everything)
    text = "a  b\n\nñ😀x Straße "
    for ids, *_ in piece_sampling.sample([text], [3], vocab, 4)[0]:
        assert vocab.text(ids) == text


LICENCE_NOTICES = {
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"],
    "Apache": ["Licensed under the Apache License, Version 2.0"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "EPL": ["This program is made available under the terms of the Eclipse Public License 2.0"],
    "GPL": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted"],
    None: ["Licensed under the", "a license plate was found near the river and all rights to complain", "he drove under the bridge with permission"],
}


def test_notices_read_the_same_wrapped_and_among_other_words(spark):
    prose = "the river ran past the old mill and nobody in the village spoke about it for many years"
    rows, want = [], {}
    for family, notices in LICENCE_NOTICES.items():
        for notice in notices:
            for text in (notice, *("\n".join(textwrap.wrap(notice, width)) for width in (20, 45)), f"{prose}\n{notice}\n{prose}", f"intro\n\n{notice}\n \noutro"):
                want[len(rows)] = [] if family is None else [family]
                rows.append((len(rows), text))
    found = licence_scan.scan(spark.createDataFrame(rows, "doc_id long, text string").withColumn("w", F.lit("clash"))).collect()
    assert {r["doc_id"]: r["licences"] for r in found} == want


def test_licence_windows_are_scored_by_the_formula(spark):
    """The scan's probabilities and families from the model's weights, in plain Python."""
    model = licence_scan.train(["some ordinary line of words"])
    texts = [f"she said\n{t[0]} and so on\n\nnext part" for t in licence_scan.TEMPLATES.values()] + ["all of it under the bridge", "Licensed under the moon"]
    rows = spark.createDataFrame([(k, k, t) for k, t in enumerate(texts)], "d long, t long, text string")
    found = {(r["d"], r["paragraph"], r["start"]["at"], r["start"]["size"]): r for r in licence_scan.paragraphs(rows, model).collect()}
    templates = licence_scan.template_triples()
    known = {h for _, s in templates for h in s}
    expected = set()
    for d, text in enumerate(texts):
        for number, part in enumerate(re.split(r"\n[\t\r ]*\n", text)):
            words = licence_scan.words_of(part)
            for size in licence_scan.WINDOWS:
                for at in range(0, max(0, len(words) - size // 2 - 1) + 1, size // 2):
                    window = words[at : at + size]
                    triples = {licence_scan._hash(*window[i : i + 3]) for i in range(max(1, len(window) - 2))}
                    if not triples & known:
                        continue
                    expected.add((d, number, at, size))
                    features = licence_scan.features_of(window)
                    z = (model.weights[features].sum(0) / np.sqrt(len(features)) + model.bias) / model.temperature
                    p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
                    family = licence_scan.FAMILIES[int(p.argmax())]
                    held = {f for f, s in templates if len(triples & set(s)) >= min(len(s), licence_scan.SHARED)}
                    sure = p.max() >= licence_scan.LEAST and family in held
                    row = found[d, number, at, size]
                    assert row["probability"] == (pytest.approx(p.max(), abs=1e-3) if held else None)
                    assert row["family"] == (family if sure else licence_scan.UNKNOWN)
    assert set(found) == expected
