"""Whitening, phrases and language identification on small and odd inputs."""

import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from odd import CLASHES, ROWS, no_documents, odd_documents

from rawharbor.llm import langid, phrases, whitening
from rawharbor.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


# --- whitening --------------------------------------------------------------------


def scatter(seed, n, d, spread=300):
    x = np.random.default_rng(seed).integers(-spread, spread, (n, d)).astype(object)
    s = x.sum(0)
    return n * (x.T @ x) - np.multiply.outer(s, s)


@pytest.mark.parametrize("top", [100, 1 << 30, (1 << 63) - 1])
def test_products_are_exact(top):
    rng = np.random.default_rng(1)
    x = rng.integers(-top, top, (1300, 3))
    exact = x.astype(object).T @ x.astype(object)
    assert (whitening.exact_products(x) == exact).all()


def test_characteristic_polynomial_is_exact(spark):
    for matrix in (scatter(1, 9, 5), np.diag([3, 0, 3, 7]).astype(object), np.zeros((2, 2), object), np.array([[0, 1], [1, 0]], object)):
        found = whitening.characteristic_polynomial(spark, matrix)
        # Faddeev and LeVerrier, in fractions.
        d, m, expected = len(matrix), np.zeros((len(matrix),) * 2, object), [Fraction(1)]
        eye = np.array([[int(i == j) for j in range(d)] for i in range(d)], object)
        for k in range(1, d + 1):
            m = matrix @ m + eye * expected[-1]
            expected.append(Fraction(-1, k) * (matrix @ m).trace())
        assert found == [int(c) for c in reversed(expected)]


def test_primes():
    small = [n for n in range(2000) if whitening.is_prime(n)]
    assert small == [n for n in range(2, 2000) if all(n % k for k in range(2, n))]
    primes = whitening.primes_beyond(200)
    assert math.prod(primes).bit_length() > 200 and max(primes) < 1 << 31


@pytest.mark.parametrize("roots", [[5, 3, 2, 1], [7, 7, 7, 2, 0], [10**30, 10**30 - 1, 1], [4, 0, 0], [9]])
def test_roots_with_multiplicities(roots):
    poly = [1]
    for r in roots:
        poly = [a - r * b for a, b in zip([0, *poly], [*poly, 0])]
    for a in (0, 2, 7, 10**30):
        assert whitening.roots_above(poly, a) == sum(r > a for r in roots)
    found = whitening.greatest_roots(poly, 4)
    expected = sorted((r for r in roots if r), reverse=True)[:4]
    assert len(found) == len(expected)
    for (low, high, shift), r in zip(found, expected):
        assert low < r << shift <= high and (high - low) << whitening.ROOT_BITS <= max(high, 1 << whitening.ROOT_BITS)


def embeddings(spark, rows, more=""):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int" + more)


def by_component(rows):
    out = {}
    for r in rows:
        out.setdefault(r["component"], {})[r["vec_id"]] = r
    return out


def compare(rows, x):
    """``x`` maps ids to whole-number vectors."""
    fit = np.unique(np.array(list(x.values())), axis=0)
    n = len(fit)
    covariance = np.cov(fit.T.astype(float), bias=True).reshape(fit.shape[1], -1)
    values, vectors = np.linalg.eigh(covariance)
    found = by_component(rows)
    positive = int((values > 1e-9 * values.max()).sum())
    assert sorted(found) == list(range(1, min(4, positive) + 1))
    for k, group in found.items():
        assert set(group) == set(x)
        e, v = values[-k], vectors[:, -k]
        assert all(r["n"] == n for r in group.values())
        assert next(iter(group.values()))["explained"] == pytest.approx(e / values.sum(), rel=1e-6)
        ids = sorted(x)
        got = np.array([group[i]["whitened"] for i in ids])
        want = (np.array([x[i] for i in ids]) - fit.mean(0)) @ v / np.sqrt(e)
        assert min(abs(got - want).max(), abs(got + want).max()) < 1e-6
        for i in ids:
            assert group[i]["deviation"] == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[i], fit.sum(0)))
        assert next(iter(group.values()))["identity_error"] < 1e-9


def test_whitening_of_the_table(spark):
    rows = QUERIES["op11_whitening"](spark, SF).collect()
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x = {r["vec_id"]: [math.floor(256 * c) for c in r["embedding"]] for r in table}
    assert len(rows) == 4 * len(x)
    compare(rows, x)


def test_whitening_of_odd_rows(spark):
    rng = random.Random(3)
    vectors = {i: [rng.uniform(-9, 9) for _ in range(3)] for i in range(40)}
    vectors[7] = vectors[6]
    odd = [(100, None, 1), (101, [1.0, None, 2.0], 1), (102, [math.nan, 1.0, 1.0], 1), (103, [math.inf, 0.0, 0.0], 1), (104, [], 1)]
    rows = [(i, v, None) for i, v in vectors.items()] + odd
    clashing = embeddings(spark, [(*r, "a", 1, 2) for r in rows], ", x string, n int, component int")
    floats = {i: np.array(v, np.float32).astype(float) for i, v in vectors.items()}
    compare(whitening.whitened(clashing).collect(), {i: np.floor(256 * v).astype(int).tolist() for i, v in floats.items()})


def test_whitening_without_spread(spark):
    assert whitening.whitened(embeddings(spark, [])).collect() == []
    assert whitening.whitened(embeddings(spark, [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)])).collect() == []
    # One direction only, and another length that is a space of its own; huge entries stay exact.
    rows = [(1, [0.0, 0.0], 0), (2, [1.0, 1.0], 0), (None, [2.0, 2.0], 0), (4, [1e25], 0), (5, [-1e25], 0)]
    found = sorted(whitening.whitened(embeddings(spark, rows)).collect(), key=lambda r: (r["n"], r["vec_id"] or 0))
    assert [(r["vec_id"], r["component"], r["n"]) for r in found] == [(4, 1, 2), (5, 1, 2), (None, 1, 3), (1, 1, 3), (2, 1, 3)]
    assert [r["deviation"] for r in found] == [None, None, 2 * 768**2, 2 * 768**2, 0]
    assert [round(abs(r["whitened"]), 9) for r in found] == [1, 1, round(1.5**0.5, 9), round(1.5**0.5, 9), 0]


def test_equal_eigenvalues(spark):
    rows = [(i, [float(s * (k == j)) for j in range(4)], 0) for i, (k, s) in enumerate((k, s) for k in range(4) for s in (1, -1))]
    found = whitening.whitened(embeddings(spark, rows)).collect()
    assert len(found) == 4 * len(rows) and found[0]["identity_error"] < 1e-12
    assert {round(r["explained"], 12) for r in found} == {0.25}


# --- phrases ----------------------------------------------------------------------


def brute_phrases(docs, longest=3, least=10, inside=50, best=2000):
    n, f = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\v\f\r]", text):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    f[lang, tuple(words[i : i + size])] += 1
    rows = []
    for (lang, p), a in f.items():
        if len(p) < 2 or a < least:
            continue
        longer = [c for (other, q), c in f.items() if other == lang and len(q) > len(p) and c >= least and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if any(100 * c >= inside * a for c in longer):
            continue
        cuts = [(10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        rows.append((lang, score, a, " ".join(p), f[lang, p[:k]], f[lang, p[k:]]))
    rows.sort(key=lambda r: (r[0], -r[1], -r[2], r[3].encode()))
    out, ranks = [], Counter()
    for lang, score, a, p, left, right in rows:
        ranks[lang] += 1
        if ranks[lang] <= best:
            out.append((lang, ranks[lang], p, a, left, right, n[lang], score))
    return out


def small_texts(seed, count):
    rng = random.Random(seed)
    words = ["a", "B", "the", "é", "x-1", "Of"]
    joins = [" ", " ", " ", "\t", "  ", ", ", ".", "\n", "\x85", " "]
    made = ["".join(rng.choice(words) + rng.choice(joins) for _ in range(rng.randrange(40))) for _ in range(count)]
    return [(t, rng.choice(["en", "de", None, "und", ""])) for t in made]


def mined(spark, docs, **more):
    df = spark.createDataFrame([(i, *d) for i, d in enumerate(docs)], "doc_id bigint, text string, lang string")
    return sorted(tuple(r) for r in phrases.collocations(df.repartition(3), **more).collect())


@pytest.mark.parametrize(("longest", "best"), [(3, 2000), (4, 7)])
def test_phrases_equal_brute_force(spark, longest, best):
    docs = [*small_texts(4, 120), ("", "en"), (None, None)]
    assert mined(spark, docs, longest=longest, best=best) == sorted(brute_phrases(docs, longest, best=best))


def test_phrases_that_share_fingerprints(spark, monkeypatch):
    """With small primes most fingerprints collide, within and across blocks."""
    docs = small_texts(5, 60)
    monkeypatch.setattr(phrases, "PRIMES", (5, 3))
    monkeypatch.setattr(phrases, "BASES", (2, 2))
    words, codes, _ = phrases.tokens([(t or "").encode() for t, _ in docs])
    tags = np.zeros(len(codes), np.int64)
    prints, counts, places, sizes = phrases.entries(words, codes, tags, 3, 8)
    found = Counter()
    for n, place, size in zip(counts.tolist(), places.tolist(), sizes.tolist()):
        found[tuple(words[c] for c in codes[place : place + size])] += n
    exact = Counter()
    for text, _ in docs:
        for piece in re.split("[.,;:!?\n\v\f\r]", text.lower()):
            row = [w.encode() for w in re.findall("[^ \t]+", piece)]
            exact.update(tuple(row[i : i + k]) for k in (1, 2, 3) for i in range(len(row) - k + 1))
    assert found == exact and len(set(prints.tolist())) < len(prints) == len(exact)


def test_phrases_that_share_fingerprints_in_the_whole_job(spark, monkeypatch):
    """Fingerprints of four bits: every range holds many phrases, and texts take them apart."""
    docs = small_texts(8, 100)
    df = spark.createDataFrame([(i, *d) for i, d in enumerate(docs)], "doc_id bigint, text string, lang string").repartition(4)
    blocks = df.selectExpr("coalesce(lang, 'und') lang", "text").toPandas()
    rows = [pa.RecordBatch.from_pandas(blocks.iloc[i : i + 25], preserve_index=False) for i in range(0, 100, 25)]
    parts, made = [], []
    for number, row in enumerate(rows):
        monkeypatch.setattr(phrases, "TaskContext", type("T", (), {"get": staticmethod(lambda n=number: type("C", (), {"partitionId": lambda self: n})())}))
        made += list(phrases._blocks(iter([row])))
    for block in made:
        parts.append(pa.Table.from_batches(phrases._packed(3, 4, 3)(iter([block]))))
    packed = pa.concat_tables(parts)
    hits = pa.concat_tables([phrases._frequent(10)(packed.filter(pa.compute.equal(packed["part"], p))) for p in range(3)])
    texts = []
    for block in made:
        own = hits.filter(pa.compute.equal(hits["block"], block.column(0)[0]))
        texts.append(phrases._read(3, 4)((), pa.Table.from_batches([block]), own))
    texts = pa.concat_tables(texts)
    counts = Counter()
    for part in range(3):
        for row in phrases._added(1)(texts.filter(pa.compute.equal(texts["part"], part))).to_pylist():
            assert row["size"] == row["phrase"].count(" ") + 1
            counts[row["lang"], row["phrase"]] += row["n"]
    exact = Counter()
    for text, lang in docs:
        for piece in re.split("[.,;:!?\n\v\f\r]", text.lower()):
            row = re.findall("[^ \t]+", piece)
            exact.update(("und" if lang is None else lang, " ".join(row[i : i + k])) for k in (1, 2, 3) for i in range(len(row) - k + 1))
    frequent = {k: n for k, n in exact.items() if n >= 10}
    assert frequent and {k: n for k, n in counts.items() if n >= 10} == frequent and set(counts) <= set(exact)


def test_fingerprint_is_the_polynomial():
    prime, base, values = 101, 7, np.array([5, 0, 99, 3, 42])
    prefixes = phrases.Prefixes(values, base, prime)
    for a in range(6):
        for b in range(a, 6):
            expected = sum(int(v) * pow(base, -k, prime) for k, v in enumerate(values[a:b])) % prime
            assert prefixes.of(np.array([a]), np.array([b]))[0] == expected


def test_exact_score_beyond_64_bits(spark):
    a, left, right = 10**14 + 3, 10**14 + 7, 2 * 10**14 + 1
    row = spark.createDataFrame([(a, left, right)], "a bigint, l bigint, r bigint")
    from pyspark.sql import functions as F

    assert row.select(phrases._score(F.col("a"), F.col("l"), F.col("r"))).first()[0] == 10**6 * a * a // (left * right)


def test_phrases_of_odd_and_no_documents(spark):
    docs = [(r[1], r[2]) for r in ROWS]
    found = sorted(tuple(r) for r in phrases.collocations(odd_documents(spark)).collect())
    assert found == sorted(brute_phrases(docs)) and found
    assert phrases.collocations(no_documents(spark)).collect() == []


def test_small_blocks_give_the_same(spark, monkeypatch):
    docs = small_texts(6, 80)
    rows = [pa.record_batch([pa.array([l or "und" for _, l in docs]), pa.array([t for t, _ in docs])], names=["lang", "text"])]
    whole = Counter()
    for size in (1, 300, 1 << 22):
        monkeypatch.setattr(phrases, "BLOCK_BYTES", size)
        monkeypatch.setattr(phrases, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": lambda self: 3})())}))
        counts = Counter()
        for block in phrases._blocks(iter(rows)):
            spans = block.column(1)[0].as_py()
            words, codes = phrases._unpack(block.column(2)[0].as_py(), block.column(3)[0].as_py())
            for span, end in zip(spans, [*(s["start"] for s in spans[1:]), len(codes)]):
                inner = codes[span["start"] : end]
                assert span["words"] == (inner < len(words)).sum()
                counts.update((span["lang"], words[c]) for c in inner.tolist() if c < len(words))
        assert not whole or counts == whole
        whole = counts


# --- languages --------------------------------------------------------------------


def brute_windows(text):
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    return Counter(w[i : i + 3] for w in (f" {w} " for w in words) for i in range(len(w) - 2))


@pytest.mark.parametrize("text", ["", None, "a", "Ab c!d", "  1 2", "İstanbul ßé 日本", "x" * 70_000])
def test_windows(text):
    keys, counts = langid.windows(text)
    found = {"".join(chr(k >> s & 0x1FFFFF) for s in (42, 21, 0)): n for k, n in zip(keys.tolist(), counts.tolist())}
    assert found == brute_windows(text)


def brute_language(docs, dimensions):
    def vector(window):
        return math.prod(np.roll(langid.letter_vector(ord(c), dimensions).astype(int), 2 - i) for i, c in enumerate(window))

    def bundle(text):
        return sum((n * vector(w) for w, n in brute_windows(text).items()), np.zeros(dimensions, int))

    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 4 == 2 for i, _, _ in docs]
    learned = {}
    for (_, text, lang), out in zip(docs, held):
        if not out and lang is not None and text is not None:
            learned[lang] = learned.get(lang, 0) + bundle(text)
    learned = {k: v for k, v in sorted(learned.items()) if v.any()}
    rows = []
    for (i, text, _), out in zip(docs, held):
        b = bundle(text)
        if not b.any() or not learned:
            rows.append((i, out, "und", 0.0))
            continue
        scores = {k: v @ b / math.sqrt(float(v @ v) * float(b @ b)) for k, v in learned.items()}
        best = max(scores, key=lambda k: scores[k])
        rows.append((i, out, best, min(max(scores[best], 0.0), 1.0)))
    return rows


def test_languages_equal_brute_force(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in table] + [(r[0], r[1], r[2]) for r in ROWS if r[0] not in (7, 8)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string").repartition(3)
    found = sorted((tuple(r) for r in langid.language_ids(df, dimensions=256).collect()), key=str)
    expected = sorted(brute_language(docs, 256), key=str)
    assert [f[:3] for f in found] == [e[:3] for e in expected]
    assert [f[3] for f in found] == pytest.approx([e[3] for e in expected], abs=1e-5)


def test_held_out_accuracy(spark):
    rows = QUERIES["op13_language_id"](spark, SF).collect()
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 150 and all(0 <= r["score"] <= 1 for r in rows)
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in held) / len(held) > 0.95


def test_languages_of_odd_and_no_documents(spark):
    found = langid.language_ids(odd_documents(spark)).collect()
    assert len(found) == len(ROWS)
    assert {(r["lang_pred"], r["score"]) for r in found if r["doc_id"] in (2, 3, 4)} == {("und", 0.0)}
    assert langid.language_ids(no_documents(spark)).collect() == []
    unlabelled = odd_documents(spark).withColumn("lang", langid.F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.language_ids(unlabelled).collect()} == {"und"}
    assert len(CLASHES) > 0


def test_forgotten_windows_give_the_same(monkeypatch):
    keys = np.unique(np.random.default_rng(1).integers(97, 122, 3000) << 42 | 98 << 21 | np.random.default_rng(2).integers(97, 122, 3000))
    counts = np.arange(1, len(keys) + 1)
    whole = langid.Bound(128).bundle(keys, counts)
    monkeypatch.setattr(langid, "GRAMS_KEPT", 100)
    monkeypatch.setattr(langid, "ROWS_AT_ONCE", 64)
    small = langid.Bound(128)
    assert (small.bundle(keys, counts) == whole).all() and (small.bundle(keys, counts) == whole).all()
