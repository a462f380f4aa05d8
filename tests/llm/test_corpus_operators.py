"""Near-duplicates, embeddings, token files, chat windows, licences and language models."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from odd import ROWS, no_documents, odd_documents
from tokenizers import Tokenizer

from pyspark.sql import functions as F

from rawharbor.llm import brown, chat, licenses, multiindex, neardup, wavelet
from rawharbor.llm.components import connected
from rawharbor.session import fresh_dir

SF = "/root/testdata/sf0.01"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "").encode().split()


def groups(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_connected(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    links += [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(1, 400)]
    expected = groups({n for e in links for n in e if e[0] != e[1]}, links)
    found = connected(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    assert {r["node"]: r["label"] for r in found} == expected and len(found) == len(expected)
    assert connected(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# --- near-duplicates --------------------------------------------------------------


def shingles(text):
    w = lowered(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_shingle_sets():
    texts = [r[1] for r in ROWS] + ["a b c d", "a b c d e", "a b c d e f a b c d e f"]
    values, bounds = neardup.shingle_sets(pa.array(texts, pa.string()))
    assert np.diff(bounds).tolist() == [len(shingles(t)) for t in texts]
    one, two = (set(values[bounds[i] : bounds[i + 1]].tolist()) for i in (4, 5))
    assert one == two  # case is folded


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(1)
    pool = neardup.mixed(rng.integers(0, 2**63, 4000).astype(np.uint64))
    sets = [pool[:1], pool[:3], pool[:1000], pool[250:1250], pool[:0]]
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    found = neardup.sketches(np.concatenate(sets), bounds)
    assert (found[:4] != neardup.EMPTY).all() and (found[4] == neardup.EMPTY).all()
    assert abs((found[2] == found[3]).mean() - 0.6) < 0.12


def near_copies(count, length, edits, seed, prefix=""):
    rng = random.Random(seed)
    base = [f"{prefix}w{rng.randrange(9999)}" for _ in range(length)]
    out = []
    for _ in range(count):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(length)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_near_duplicates_equal_brute_force(spark):
    texts = near_copies(60, 120, 4, 1) + near_copies(25, 40, 2, 2, "q") + near_copies(20, 200, 9, 3, "z")
    texts += ["same short text"] * 300 + ["a b c d e f", "A b c d e F"] + [None, "", "  "]
    passage = " ".join(f"p{i}" for i in range(30))
    rng = random.Random(4)
    texts += [passage + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(40)) for _ in range(40)]
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    links = []
    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                links.append((a, b))
    expected = groups(sets, links)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    for row in neardup.near_duplicates(docs).collect():
        assert row["n_shingles"] == len(sets[row["doc_id"]])
        assert row["component_id"] == expected[row["doc_id"]], row
        assert row["kept"] == (expected[row["doc_id"]] == row["doc_id"])


def test_copies_that_do_not_link_are_not_paired(spark, monkeypatch):
    rng = random.Random(8)
    base = [f"w{rng.randrange(9999)}" for _ in range(150)]
    texts = []
    for copy in range(40):
        w = list(base if copy < 30 else texts[copy - 30].split())
        for at in rng.sample(range(150), 3 if copy < 30 else 1):
            w[at] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    links = [(a, b) for a in sets for b in range(a) if 7 * len(sets[a] ^ sets[b]) <= len(sets[a]) + len(sets[b])]
    assert 10 <= len(links) < 40
    found, plain = [], neardup._candidates

    def counted(*given):
        found.append(plain(*given).count())
        return plain(*given)

    monkeypatch.setattr(neardup, "_candidates", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    components = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs).collect()}
    assert components == groups(sets, links)
    assert max(found) <= 2 * len(links), found


def test_parity_maps_bound_differences():
    texts = near_copies(20, 300, 30, 5) + ["a b c", "", None]
    words = [np.asarray(m, np.int64).view(np.uint64) for m in neardup._maps(pa.array(texts, pa.string())).to_pylist()]
    for one, x in zip(texts, words):
        for other, y in zip(texts, words):
            differ = len(shingles(one) ^ shingles(other))
            assert 0.8 * differ <= np.bitwise_count(x ^ y).sum() <= differ


def test_near_duplicates_of_odd_documents(spark):
    found = neardup.near_duplicates(odd_documents(spark)).collect()
    assert len(found) == len(ROWS)
    by = defaultdict(list)
    for r in found:
        by[r["doc_id"]].append(r)
    assert by[6][0]["component_id"] == 5 and by[8][0]["component_id"] == 7
    assert [r["n_shingles"] for i in (2, 3, 4) for r in by[i]] == [0, 0, 0]
    assert all(r["component_id"] is None and r["kept"] for r in by[None])
    left = neardup.without_near_duplicates(odd_documents(spark))
    assert left.columns == odd_documents(spark).columns
    assert Counter(r["doc_id"] for r in left.collect()) == {i: 1 for i in (1, 2, 3, 4, 5, 7, 9, 10, None, -5)}
    assert neardup.near_duplicates(no_documents(spark)).count() == 0
    assert neardup.without_near_duplicates(no_documents(spark)).count() == 0


# --- embeddings -------------------------------------------------------------------


def some_vectors(seed=0):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((400, 16))
    near = base[:60] + 0.12 * rng.standard_normal((60, 16))
    hot = base[:1] + 0.02 * rng.standard_normal((300, 16))
    return np.concatenate([base, near, hot]).astype(np.float32)


@pytest.mark.parametrize(("recall", "least"), [(1.0, 1.0), (0.999, 0.97)])
def test_embedding_links_against_brute_force(spark, recall, least, monkeypatch):
    monkeypatch.setattr(multiindex, "PER_CELL", 8)
    monkeypatch.setattr(multiindex, "BLOCK", 64)
    x = some_vectors().astype(np.float64)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    rows = [(i, v.tolist()) for i, v in enumerate(some_vectors())]
    rows += [(9000, None), (9001, [0.0] * 16), (9002, [float("nan")] * 16), (9003, [1.0]), (9004, [])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    found = {r["vec_id"]: r for r in multiindex.embedding_duplicates(frame, target_recall=recall).collect()}
    assert len(found) == len(rows)
    assert all(found[i]["n_links"] == 0 and found[i]["kept"] for i in range(9000, 9005))
    counted, real = sum(found[i]["n_links"] for i in range(len(x))), int(linked.sum())
    assert least * real <= counted <= real
    assert all(found[i]["n_links"] <= int(linked[i].sum()) for i in range(len(x)))
    if recall == 1.0:
        expected = groups(range(len(x)), np.argwhere(linked).tolist())
        assert all(found[i]["component_id"] == expected[i] for i in range(len(x)))


def test_embeddings_empty_and_repeated(spark):
    schema = "vec_id bigint, embedding array<float>, label string, row_id string"
    assert multiindex.embedding_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(7, [1.0, 2.0], "a", "b")] * 3 + [(None, [2.0, 4.0], "a", "b"), (3, [-1.0, 0.5], None, None)]
    found = multiindex.embedding_duplicates(spark.createDataFrame(rows, schema)).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], r["component_id"]) for r in found) == sorted(
        [("7", 3, 7)] * 3 + [("None", 3, 7), ("3", 0, 3)]
    )


# --- token files ------------------------------------------------------------------


@pytest.mark.parametrize("size", [0, 1, 511, 512, 513, 5000])
def test_wavelet_matrix(size):
    rng = np.random.default_rng(size)
    ids = (rng.zipf(1.4, size) % 50257).astype(np.int64)
    matrix = wavelet.WaveletMatrix.build(ids, 16)
    assert matrix.tokens().tolist() == ids.tolist()
    for i in rng.integers(0, size, 40) if size else []:
        assert matrix.access(int(i)) == ids[i]
    for value in {*ids[:30].tolist(), 0, 50256, 70000}:
        places = np.flatnonzero(ids == value)
        assert matrix.count(value) == len(places)
        assert matrix.count(value, size // 3, size // 2) == ((places >= size // 3) & (places < size // 2)).sum()
        for k in (0, len(places) // 2, len(places) - 1):
            if len(places):
                assert matrix.occurrence(value, k) == places[k]
        assert matrix.occurrence(value, len(places)) is None


def test_shard_round_trip():
    ids = np.array([5, 1, 2, 7, 2], np.uint16)
    shard = wavelet.Shard(wavelet.write_shard([None, -3, 8], [3, 1, 1], ids, 16))
    assert shard.doc_ids() == [None, -3, 8] and shard.lengths().tolist() == [3, 1, 1]
    assert shard.matrix().tokens().tolist() == ids.tolist()
    with pytest.raises(ValueError, match="not a token shard"):
        wavelet.Shard(b"XXXX" + bytes(24))


def check_tokens(spark, docs, shard_tokens, monkeypatch, pattern=public_tokenizers.PATTERN):
    monkeypatch.setattr(wavelet, "SHARD_TOKENS", shard_tokens)
    path = fresh_dir(spark, "tokens")
    wavelet.write_tokens(docs, path, TOKENIZER, 2, pattern=pattern)
    library = Tokenizer.from_file(TOKENIZER)
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    expected, start = [], 0
    for r in rows:
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        expected.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    found = sorted(map(tuple, wavelet.read_tokens(spark, path).collect()), key=lambda r: r[1])
    assert found == expected


@pytest.mark.parametrize("shard_tokens", [100, 4000, 1 << 20])
def test_token_files(spark, shard_tokens, monkeypatch):
    check_tokens(spark, spark.read.parquet(f"{SF}/documents.parquet").limit(120), shard_tokens, monkeypatch)


def test_token_files_of_odd_documents(spark, monkeypatch):
    check_tokens(spark, odd_documents(spark), 50, monkeypatch)
    check_tokens(spark, odd_documents(spark), 50, monkeypatch, None)
    path = fresh_dir(spark, "tokens")
    wavelet.write_tokens(no_documents(spark), path, TOKENIZER, 2)
    assert wavelet.read_tokens(spark, path).count() == 0


def test_texts_split_as_the_library_splits_them(monkeypatch):
    library = Tokenizer.from_file(TOKENIZER)
    with open(TOKENIZER) as file:
        coder = wavelet.TextTokenizer(file.read())
    asked = []
    alone = coder.library
    monkeypatch.setattr(coder, "library", lambda texts: asked.extend(texts) or alone(texts))
    rng = random.Random(3)
    parts = ["<|endoftext|>", " ", "  ", "\n", "\t", "a", "bé", "'s", "1.", "😀", "\x1c", "\x85", "\xa0", "中", "\u200b", "\u2003", "\u3000"]
    # The last two are unassigned in some versions of Unicode and letters in others.
    parts += ["\u180e", "“", "x ", " \u0558", "\u088f"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(3000)]
    texts += [" ".join(rng.choices(["one", "two", "three"], k=400)) for _ in range(200)]
    for i in range(0, len(texts), 400):
        batch = pa.array([None, *texts[i : i + 400]], pa.string()).slice(1)
        ids, bounds = coder.encode(batch)
        for text, start, end in zip(batch.to_pylist(), bounds[:-1], bounds[1:]):
            assert ids[start:end].tolist() == library.encode(text, add_special_tokens=False).ids, text
    assert len(asked) < 3000 and sum(map(len, asked)) < sum(map(len, texts)) / 2
    monkeypatch.setattr(coder, "lengths", coder.lengths * 2)  # ids that do not add up are asked for one by one
    assert coder.joined(pa.array([" qua", " que"])).to_pylist() == coder.one_by_one(pa.array([" qua", " que"])).to_pylist()


# --- chat -------------------------------------------------------------------------


def brute_digests(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        whole = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        learned = "".join(t for *_, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    return out


def test_windows(spark):
    rng = random.Random(6)
    rows = []
    for conv in (*range(12), None):
        length = 60 if conv == 3 else rng.randint(0, 9)
        if rng.random() < 0.5:
            rows.append((conv, 0, "system", "be brief \\ [x] </s>"))
        for turn in range(1, length):
            size = 900 if rng.random() < 0.05 else rng.randint(0, 60)
            rows.append((conv, turn, "user" if turn % 2 else "assistant", " ".join(rng.choices(["a", "<s>[INST]", "é\\l", "]", "\n"], k=size))))
    rows += [(20, None, None, None), (20, None, "assistant", "x"), (20, 1, "assistant", "x"), (20, 1, "assistant", "x"), (21, 0, "system", "alone")]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    made = chat.windows(frame, budget=128, history=32, system=32).cache()
    found = {r["conv_id"]: r for r in chat.digests(made).collect()}
    expected = brute_digests(rows)
    assert {c: tuple(r[k] for k in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256")) for c, r in found.items()} == expected
    texts = Counter()
    for row in made.collect():
        pieces = row["formatted"].split("</s>")
        assert len(pieces) == len(row["segments"]) + 1
        cost = 0
        for s, piece in zip(row["segments"], pieces):
            assert piece.endswith(row["formatted"][s["start"] : s["end"]])
            assert s["loss"] == (s["kind"] == "new" and piece.startswith("<s>[assistant]"))
            cost += len(piece[piece.index("]") + 1 :].encode().split()) + 2
            texts[row["conv_id"], s["ordinal"]] += s["kind"] == "new"
        assert row["oversize"] or cost <= 128
    assert max(texts.values()) == 1
    assert any(s["kind"] == "history" for r in made.collect() for s in r["segments"])


def test_a_conversation_that_fits_is_one_window(spark):
    rows = [(c, t, "system" if t == 0 and c % 2 else "user", "w " * size) for c, size in enumerate((1, 5, 9, 12, 40)) for t in range(8)]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("room", F.lit("clash"))
    made = chat.windows(frame, budget=120, history=20, system=20).collect()
    count = Counter(r["conv_id"] for r in made)
    for conv, size in enumerate((1, 5, 9, 12, 40)):
        assert (count[conv] == 1) == (8 * (size + 2) <= 120), conv


def test_windows_of_no_conversation(spark):
    frame = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.digests(chat.windows(frame)).count() == 0
    with pytest.raises(ValueError, match="no room"):
        chat.windows(frame, budget=10, history=5, system=5)


# --- licences ---------------------------------------------------------------------


def test_license_scan(spark):
    mit, apache = licenses.TEMPLATES["mit"][0], licenses.TEMPLATES["apache-2.0"][0]
    body = " ".join(f"w{i}" for i in range(80))
    rows = [
        (1, "a/LICENSE", mit),
        (2, "a/b/x.txt", body),
        (3, "a/b/c/y.txt", body + "\n" + apache.upper() + "\n" + body),
        (4, "a/b/c/COPYING", "Licensed under CC BY-NC 4.0."),
        (5, "a/b/c/d/z.txt", body),
        (6, "q/z.txt", body),
        (7, None, body),
        (8, None, mit),
        (9, "a/b/x.txt", None),
        (10, "ab/x.txt", body + " we have a licence to speak of nothing in particular here at all"),
        (11, "r.txt", ""),
    ]
    files = spark.createDataFrame(rows, "doc_id bigint, path string, text string")
    found = {r["doc_id"]: (r["license"], r["origin"]) for r in licenses.license_scan(files, files["path"]).collect()}
    assert found == {
        1: ("mit", "own"),
        2: ("mit", "directory"),
        3: ("apache-2.0", "own"),
        4: ("cc-by-nc-4.0", "own"),
        5: ("cc-by-nc-4.0", "directory"),
        6: (None, None),
        7: (None, None),
        8: ("mit", "own"),
        9: ("mit", "directory"),
        10: (None, None),
        11: (None, None),
    }
    empty = files.limit(0)
    assert licenses.license_scan(empty, empty["path"]).count() == 0


REAL = {
    "src/a.py": ("mit", """#!/usr/bin/env python
# Copyright (c) 2019 Somebody Else
#
# Permission is hereby granted, free of charge, to any person obtaining a copy
# of this software and associated documentation files (the "Software"), to deal
# in the Software without restriction, including without limitation the rights
# to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
# copies of the Software, and to permit persons to whom the Software is
# furnished to do so, subject to the following conditions:
#
# The above copyright notice and this permission notice shall be included in all
# copies or substantial portions of the Software.
import os
"""),
    "src/b.c": ("apache-2.0", """/*
 * Copyright 2021 The Owners
 *
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 */
int main() { return 0; }
"""),
    "src/c.rs": ("apache-2.0", "// SPDX-License-Identifier: Apache-2.0\n\nfn main() {}\n"),
    "src/d.h": ("gpl-2.0", "/* SPDX-License-Identifier: GPL-2.0-or-later */\n#define X 1\n"),
    "src/e.go": ("bsd-3-clause", "// Copyright 2009 The Authors. All rights reserved.\n// Use of this source code is governed by a BSD-style\n// license that can be found in the LICENSE file.\n\npackage main\n"),
    "lib/f.cpp": ("gpl-3.0", """// This program is free software: you can redistribute it and/or modify
// it under the terms of the GNU General Public License as published by
// the Free Software Foundation, either version 3 of the License, or
// (at your option) any later version.
//
// You should have received a copy of the program.
#include <x>
"""),
    "lib/g.js": ("mpl-2.0", "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at http://mozilla.org/MPL/2.0/. */\nvar x;\n"),
    "lib/h.sql": ("isc", "-- Permission to use, copy, modify, and/or distribute this software for any\n-- purpose with or without fee is hereby granted, provided that the above\n-- copyright notice and this permission notice appear in all copies.\nselect 1;\n"),
    "p/a.txt": (None, "The town office gave out a fishing license to forty people last year, and the line for it was long on most days of the week."),
    "p/b.txt": (None, "SPDX-License-Identifier: Some-Unknown-Thing-9\n" + "filler words go on and on here " * 12),
    "p/c.txt": (None, "A copyright dispute between two publishers went to court in spring, and nobody knows how it will end, or when."),
    "p/d.txt": (None, "permission to use the pool is granted to guests who stay for more than three nights at our hotel near the lake"),
}


def test_real_headers_and_plain_mentions(spark):
    rows = [(i, path, text) for i, (path, (_, text)) in enumerate(REAL.items())]
    files = spark.createDataFrame(rows, "doc_id bigint, path string, text string")
    found = {r["path"]: r["license"] for r in licenses.license_scan(files, files["path"]).collect() if r["origin"] == "own"}
    assert found == {path: name for path, (name, _) in REAL.items() if name}


def test_license_scan_of_odd_documents(spark):
    docs = odd_documents(spark).withColumn("unit", F.lit("x")).withColumn("license", F.lit("y"))
    found = licenses.license_scan(docs, F.concat(F.lit("a/"), "source")).collect()
    assert len(found) == len(ROWS) and {r["license"] for r in found} == {None}


def test_cosines_equal_brute_force(spark):
    units = [(f"u{i}", t) for i, t in enumerate([*(t for ts in licenses.TEMPLATES.values() for t in ts), "spdx-tag-mit", "Copyright 2020 me", "MIT MIT license", "", "x"])]

    def count(text):
        return Counter(re.findall(r"[^\W_](?:[\w.-]*[^\W_])?", text.lower()))

    counted = {u: count(t) for u, t in units}
    df = Counter(t for c in counted.values() for t in c)
    n = len(units)
    weigh = lambda c: {t: f * (math.log((1 + n) / (1 + df[t])) + 1) for t, f in c.items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    named = [(k, weigh(count(t))) for k, ts in licenses.TEMPLATES.items() for t in (*ts, f"spdx-tag-{k}")]
    expected = {}
    for u, c in counted.items():
        v = weigh(c)
        scores = [(-sum(v[t] * w.get(t, 0) for t in v) / (norm(v) * norm(w)), k) for k, w in named] if v else []
        scores = [(round(s, 9), k) for s, k in scores]
        if scores and -min(scores)[0] >= 0.2:
            expected[u] = (min(scores)[1], pytest.approx(-min(scores)[0], abs=1e-8))
    found = licenses.best_templates(spark.createDataFrame(units, "unit string, text string"), licenses.TEMPLATES, 0.2)
    assert {r["unit"]: (r["license"], r["score"]) for r in found.collect()} == expected


# --- language model ---------------------------------------------------------------


def test_brown_base_scores_and_probabilities(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = {r["doc_id"]: r for r in brown.brown_scores(docs).collect()}
    texts = {r["doc_id"]: [*lowered(r["text"]), b"\n"] for r in docs.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    counts = Counter(w for i, ws in texts.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    gain = total = 0.0
    for i, ws in texts.items():
        row = found[i]
        assert (row["held_out"], row["n_tokens"], row["train_tokens"]) == (held[i], len(ws), n)
        assert row["n_known"] == sum(counts[w] > 0 for w in ws)
        assert row["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), rel=1e-9)
        if held[i]:
            gain, total = gain + row["score"] - row["base_score"], total + len(ws)
    assert gain / total > 0.05  # better than counts alone on texts that it has not seen


def test_transitions_sum_to_one():
    rng = np.random.default_rng(0)
    trained = rng.integers(0, 50, (brown.WIDE, brown.WIDE)).astype(float)
    trained[:, 3] = trained[3] = 0
    trained[brown.UNKNOWN, brown.UNKNOWN] = 0
    logs = brown.transition_logs(trained, 100.0, trained[: brown.CLASSES, : brown.CLASSES].sum())
    per_class = np.maximum(trained[: brown.CLASSES, : brown.CLASSES].sum(0), 1)
    sums = (10 ** logs[:, : brown.CLASSES] * per_class).sum(1) + 10 ** logs[:, brown.UNKNOWN]
    assert sums == pytest.approx(np.ones(brown.WIDE))


def test_brown_of_odd_documents(spark):
    found = brown.brown_scores(odd_documents(spark)).collect()
    assert len(found) == len(ROWS) and all(math.isfinite(r["score"]) for r in found)
    assert {r["n_tokens"] for r in found if r["doc_id"] in (2, 3, 4)} == {1}
    assert brown.brown_scores(no_documents(spark)).count() == 0
    lone = odd_documents(spark).filter("doc_id = -5 OR crc32(CAST(doc_id AS STRING)) % 7 = 2")
    assert all(math.isfinite(r["score"]) for r in brown.brown_scores(lone).collect())


def plain_bigrams(sequence, classes):
    out = np.zeros((brown.WIDE, brown.WIDE), np.int64)
    for a, b in zip(sequence, sequence[1:]):
        out[classes[a], classes[b]] += 1
    return out


def plain_neighbours(sequence, classes, words):
    out = np.zeros((words, 2 * brown.WIDE + 1), np.int64)
    for a, b in zip(sequence, sequence[1:]):
        out[b, classes[a]] += 1
        out[a, brown.WIDE + classes[b]] += 1
        out[a, -1] += a == b
    return out


def test_gain_is_the_change_of_likelihood():
    rng = random.Random(6)
    sequence = [rng.choice([0, 0, 1, 2, 2, 3, 4, 5, 6, 7]) for _ in range(400)] + [3, 3, 3, 5, 5]
    classes = np.array([rng.randrange(4) for _ in range(8)])
    classes[7] = brown.OTHER
    before = plain_bigrams(sequence, classes)
    found = brown.gains(before, plain_neighbours(sequence, classes, 8), classes)
    for word in range(8):
        for kind in range(6):
            moved = classes.copy()
            moved[word] = kind
            change = brown.likelihood(plain_bigrams(sequence, moved)) - brown.likelihood(before)
            assert found[word, kind] == pytest.approx(change, abs=1e-6)


def grammar(seed, count):
    rng = random.Random(seed)
    kinds = [["cat", "dog", "owl", "yak"], ["runs", "eats", "naps", "sings"], ["now", "then", "here"], ["the", "a"]]
    return [
        " ".join(w for _ in range(rng.randrange(3, 9)) for w in (rng.choice(kinds[3]), rng.choice(kinds[0]), rng.choice(kinds[1]), rng.choice(kinds[2])))
        for _ in range(count)
    ], kinds


def test_exchange_never_lowers_the_likelihood(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(80).select("doc_id", "text")
    caught, plain = [], brown.exchange

    def watched(blocks, frequent, counts):
        caught.append((frequent, *plain(blocks, frequent, counts)))
        return caught[0][1:]

    monkeypatch.setattr(brown, "exchange", watched)
    monkeypatch.setattr(brown, "MOVED", 500)
    brown._learned(docs.repartition(4), "doc_id", "text")
    frequent, classes, bigrams, history = caught[0]
    assert len(history) > 2 and all(b >= a for a, b in zip(history, history[1:]))
    # The counts that the blocks returned are those of a plain pass over the training texts.
    of = {int(h): int(c) for h, c in zip(frequent, classes)}
    end = of[int(np.array([brown.END]).view(np.uint64)[0])]
    exact = np.zeros_like(bigrams)
    for row in docs.collect():
        if zlib.crc32(str(row["doc_id"]).encode()) % 7 != 2:
            kinds = [of.get(brown.xxhash.xxh3_64_intdigest(w), brown.OTHER) for w in lowered(row["text"])]
            for a, b in zip([end, *kinds], [*kinds, end]):
                exact[a, b] += 1
    assert (exact == bigrams).all() and history[-1] == pytest.approx(brown.likelihood(exact))
    assert len(frequent) == 500 and 10 < len(set(classes.tolist())) <= brown.CLASSES


def test_most_frequent_words(spark):
    rng = random.Random(3)
    rows = [(i, int(10 ** (6 * rng.random()))) for i in range(3000)] + [(9000 + i, 77) for i in range(50)]
    df = spark.createDataFrame(rows, "word bigint, n bigint").repartition(7)
    for moved in (1, 10, 1000, 5000):
        assert [tuple(r) for r in brown._top(df, moved)] == sorted(rows, key=lambda r: (-r[1], r[0]))[:moved]
    assert brown._top(df.limit(0), 5) == []


def test_exchange_joins_words_of_one_place(monkeypatch):
    """With few classes, single moves by gain bring the words of one place together."""
    monkeypatch.setattr(brown, "CLASSES", 5)
    texts, kinds = grammar(9, 200)
    names = ["\n", *sorted({w for t in texts for w in t.split()})]
    sequence = [0] + [names.index(w) for t in texts for w in (*t.split(), "\n")]
    counts = Counter(sequence)
    classes = np.array([min(r, 4) for r in np.argsort(np.argsort([-counts[i] for i in range(len(names))], kind="stable"))])
    reached = [brown.likelihood(plain_bigrams(sequence, classes))]
    for _ in range(60):
        gain = brown.gains(plain_bigrams(sequence, classes), plain_neighbours(sequence, classes, len(names)), classes)
        word, kind = np.unravel_index(gain.argmax(), gain.shape)
        if gain[word, kind] < 1e-9:
            break
        classes[word] = kind
        reached.append(brown.likelihood(plain_bigrams(sequence, classes)))
    assert all(b > a for a, b in zip(reached, reached[1:]))
    assert sum(len({classes[names.index(w)] for w in words}) == 1 for words in kinds) >= 3


def test_small_blocks_give_the_same_scores(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    rows = {r["doc_id"]: r for r in brown.brown_scores(docs).collect()}
    monkeypatch.setattr(brown, "RANGE_BYTES", 20_000)
    again = {r["doc_id"]: r for r in brown.brown_scores(docs.repartition(5)).collect()}
    assert rows.keys() == again.keys()
    for i, r in rows.items():
        assert r["base_score"] == pytest.approx(again[i]["base_score"]) and r["score"] == pytest.approx(again[i]["score"], rel=1e-6)


def test_words_of_held_out_texts_are_known_from_other_blocks(spark):
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2][:4]
    rows = [(i, "alpha beta") for i in range(100, 110) if zlib.crc32(str(i).encode()) % 7 != 2]
    trained, rows = len(rows), [(i, "Alpha beta beta new") for i in held] + rows
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)), "doc_id bigint, text string")
    total, kinds = 3 * trained, 3
    for r in brown.brown_scores(docs).collect():
        new = r["doc_id"] in held
        counts = [trained, trained, trained, 0, trained] if new else [trained] * 3
        base = sum(math.log10((c + 1) / (total + kinds + 1)) for c in counts)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (new, 5 if new else 3, 4 if new else 3, total)
        assert r["base_score"] == pytest.approx(base)
