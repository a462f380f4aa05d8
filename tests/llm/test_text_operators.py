"""Quality rules, mixing, personal data and BPE on small and odd inputs."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from odd import CLASHES, ROWS, no_documents, odd_documents
from pyspark.sql import functions as F

from rawharbor.llm import bpe, mixing, pii, quality
from rawharbor.llm.common import running_total

SF = "/root/testdata/sf0.01"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def words(text):
    return (text or "").encode().split()


# --- helpers ----------------------------------------------------------------------


@pytest.mark.parametrize("size", [0, 1, 255, 256, 257, 1000])
def test_running_total(spark, size):
    values = [random.Random(size).randint(-9, 9) for _ in range(size)]
    row = spark.createDataFrame([(values,)], "v array<bigint>").select(
        running_total(F.col("v"), lambda a, b: a + b).alias("sum"), running_total(F.col("v"), lambda a, b: F.greatest(a, b)).alias("max")
    ).first()
    assert row["sum"] == np.cumsum(values).tolist()
    assert row["max"] == (np.maximum.accumulate(values).tolist() if size else [])


# --- quality ----------------------------------------------------------------------


def brute_figures(text):
    w = words(text)
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i, g in enumerate(zip(w, w[1:], w[2:])) if windows[g] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return (
        len(w),
        sum(len(x.decode()) for x in w),
        len(re.findall(r"[#*$%&|<>]", text or "")),
        len(lines) - len(set(lines)),
        len(covered),
        len(lines),
    )


def test_figures(spark):
    texts = [r[1] for r in ROWS] + [r["text"] for r in documents(spark).limit(200).collect()]
    for text in texts:
        assert quality.text_figures(text) == brute_figures(text)


def test_figures_with_very_many_kinds_of_words():
    assert quality.repeated_words([b"a", b"b", b"c"] * 2) == 6
    assert quality.repeated_words([b"a"] * 4) == 4
    assert quality.repeated_words([b"a"] * 3) == 0


@pytest.mark.parametrize(("k", "n", "p"), [(0, 10, 0.1), (3, 50, 0.05), (7, 7, 0.5), (20, 400, 0.02)])
def test_binomial_tail(k, n, p):
    exact = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    assert quality.binomial_tail(k, n, p) == pytest.approx(min(1.0, exact), rel=1e-9)


def test_choice_keeps_the_guarantee_and_finds_junk():
    # 40 cutoffs; good documents have no symbols, bad ones pass 30 of them.
    good, bad = np.zeros(41, int), np.zeros(41, int)
    good[0], bad[30] = 1000, 50
    chosen = quality.choose_cutoff(good, bad, 0.0125, 0.003)
    assert chosen == 10  # the most lenient that rejects them
    good[0], good[35] = 900, 100  # a tenth of the good ones would be lost
    assert quality.choose_cutoff(good, bad, 0.0125, 0.003) is None
    assert quality.choose_cutoff(np.array([5] + [0] * 40), bad, 0.0125, 0.003) is None  # too few to be sure


def test_rules_reject_junk_and_keep_clean(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(3000)]
    rows, labels = [], []
    for i in range(1600):
        w = [rng.choice(vocabulary) for _ in range(70)]
        junk = i % 4 == 0
        if junk:
            w = [x + "###" for x in w]
        rows.append((i, " ".join(w), "en", "s"))
        if i % 2 == 0 or i % 4 == 1:
            labels.append((i, 0 if junk else 1, 0))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    found = quality.quality_verdicts(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), "q").collect()
    for row in found:
        assert row["q"]["kept"] == (row["doc_id"] % 4 != 0), row


def test_quality_of_odd_documents(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (5, None, 0)], "doc_id bigint, quality int, toxic int")
    found = quality.quality_verdicts(odd_documents(spark), labels, "quality")
    assert set(found.columns) == {"doc_id", "text", "lang", "source", *CLASHES}
    for row in found.collect():
        n, *_, repeated, _lines = brute_figures(row["text"])
        failed = n < 50 or 100 * repeated > 50 * n
        assert (row["quality"]["n_words"], row["quality"]["base_failed"], row["quality"]["kept"]) == (n, failed, not failed)
    assert found.count() == len(ROWS)
    assert quality.quality_verdicts(no_documents(spark), labels, "q").count() == 0
    assert quality.quality_verdicts(odd_documents(spark), labels.limit(0), "q").count() == len(ROWS)


# --- mixing -----------------------------------------------------------------------


def brute_fill(sizes, weights, share, most):
    """Clamp, deal out again, until nobody is above."""
    live = {s for s in sizes if sizes[s] and weights[s]}
    budget, target = share * sum(sizes.values()), dict.fromkeys(sizes, 0.0)
    while live:
        total = sum(weights[s] for s in live)
        over = [s for s in live if budget * weights[s] / total > most * sizes[s]]
        if not over:
            for s in live:
                target[s] = budget * weights[s] / total
            break
        for s in over:
            target[s] = most * sizes[s]
        budget -= sum(target[s] for s in over)
        live -= set(over)
    return target


def check_mix(rows):
    sizes, order = defaultdict(int), sorted({r["source"] for r in rows}, key=lambda s: (s is None, s or ""))
    for r in rows:
        assert r["mixed"]["size"] == len(words(r["text"]))
        sizes[r["source"]] += r["mixed"]["size"]
    target = brute_fill(sizes, {s: [3, 1, 2][i % 3] for i, s in enumerate(order)}, 1.5, 2.0)
    for source in order:
        mine = [r for r in rows if r["source"] == source]
        taken = sum(r["mixed"]["repeats"] * r["mixed"]["size"] for r in mine)
        assert all(r["mixed"]["target"] == pytest.approx(target[source]) for r in mine)
        assert all(r["mixed"]["repeats"] <= 2 for r in mine)
        largest = max(Counter((r["doc_id"], r["text"]) for r in mine).values()) * max(r["mixed"]["size"] for r in mine)
        assert abs(taken - target[source]) <= largest


def test_mix_meets_targets(spark):
    rows = mixing.mix(documents(spark), "mixed").collect()
    check_mix(rows)
    again = mixing.mix(documents(spark).repartition(13), "mixed").collect()
    assert {r["doc_id"]: r["mixed"] for r in rows} == {r["doc_id"]: r["mixed"] for r in again}


def test_mix_of_odd_documents(spark):
    mixed = mixing.mix(odd_documents(spark), "mixed")
    check_mix(mixed.collect())
    assert set(mixed.columns) == {"doc_id", "text", "lang", "source", "mixed", *CLASHES}
    out = mixing.repeated(mixed, "mixed")
    assert out.columns == odd_documents(spark).columns
    assert out.count() == sum(r["mixed"]["repeats"] for r in mixed.collect())
    assert mixing.mix(no_documents(spark), "mixed").count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_water_fill(spark, seed):
    rng = random.Random(seed)
    rows = [(f"s{i}", rng.choice([0, 1, 5, 100, 1000]), float(rng.choice([1, 2, 3, 9]))) for i in range(8)]
    found = mixing.water_fill(spark.createDataFrame(rows, "source string, source_size bigint, weight double"), 1.5, 2.0)
    expected = brute_fill({r[0]: r[1] for r in rows}, {r[0]: r[2] for r in rows}, 1.5, 2.0)
    assert {r["source"]: r["target"] for r in found.collect()} == pytest.approx(expected)


# --- personal data ----------------------------------------------------------------


def luhn_holds(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def digits(found):
    return re.sub("[^0-9]", "", found)


BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn_holds(digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
]


def brute_spans(text):
    found = []
    for order, (kind, pattern, good) in enumerate(BASE):
        found += [(m.start(), order, kind, m.end()) for m in re.finditer(pattern, text or "") if good(m.group())]
    return sorted(found)


def random_texts(count):
    rng = random.Random(3)
    pieces = ["a@b.c", "_x@d.e", "@", "1.2.3.4", ".5", "255", "4111 1111 1111 1111", "+49 170 1234567", "(0)", "é", "😀", " ", "-", "..", "x", "12", "\n"]
    return ["".join(rng.choices(pieces, k=rng.randint(1, 25))) for _ in range(count)]


def masked_by_hand(text, spans):
    stretches = []
    for s in spans:
        if stretches and s["start"] < stretches[-1][1]:
            stretches[-1][1] = max(stretches[-1][1], s["end"])
        else:
            stretches.append([s["start"], s["end"], s["kind"]])
    out, at = "", 0
    for start, end, kind in stretches:
        out, at = out + text[at:start] + f"[{kind.upper()}]", end
    return out + text[at:]


def test_spans_and_masks(spark):
    rows = [(i, t) for i, t in enumerate([r[1] for r in ROWS] + random_texts(1500))]
    rows += [(-1, "é😀 x@y.zz " * 900 + "end"), (-2, "9" * 4000), (-3, "a.b" * 3000 + "@x"), (-4, "x@y.z1.2.3.4" * 1300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)
    found = pii.with_spans(docs, "spans").collect()
    masked = {r["doc_id"]: r["text"] for r in pii.mask(pii.with_spans(docs, "spans"), "spans").collect()}
    for row in found:
        base = [(s["start"], s["kind_order"], s["kind"], s["end"]) for s in row["spans"] if s["kind_order"] < 4]
        assert base == brute_spans(row["text"])
        if row["text"] is None:
            assert masked[row["doc_id"]] is None and row["spans"] == []
        else:
            assert masked[row["doc_id"]] == masked_by_hand(row["text"], row["spans"])


def test_method_adds_confirmed_spans(spark):
    texts = [
        "iban DE89370400440532013000 ok",
        "iban DE88370400440532013000 is wrong",
        "GB82 WEST 1234 5698 7654 32",
        "ssn 123-45-6789",
        "number 123-45-6789",
        "call 555-123-4567",
        "lot 555-123-4567",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    kinds = {r["doc_id"]: [s["kind"] for s in r["spans"] if s["kind_order"] > 3] for r in pii.with_spans(docs, "spans").collect()}
    assert kinds == {0: ["iban"], 1: [], 2: ["iban"], 3: ["ssn"], 4: [], 5: ["local_phone"], 6: []}


def test_context_of_lists_and_after_spans(spark):
    texts = {
        "Call 555-123-4567 or 555-987-6543": 2,
        "SSN 123-45-6789, 234-56-7890": 2,
        "123-45-6789 is my SSN": 1,
        "Phones: 555-123-4567": 1,
        "Telephone 555-123-4567": 1,
        "phone_number=555-123-4567": 1,
        "é" * 4090 + " call 555-123-4567 " + "😀" * 4090 + "123-45-6789" + " " * 44 + "ssn": 2,
        "call" + " " * 44 + "555-123-4567": 1,
        "x call" + " " * 44 + "555-123-4567": 1,
        "call" + " " * 45 + "555-123-4567": 0,
        "555-123-4567" + " " * 44 + "call": 1,
        "555-123-4567" + " " * 45 + "call": 0,
        "555-123-4567" + " " * 44 + "ringed": 0,
        "string" + " " * 44 + "555-123-4567": 0,
        "Call 555-123-4000, 555-123-4001, 555-123-4002, 555-123-4003": 4,
        "bring lot 555-123-4567 and 555-987-6543": 0,
        "lots 555-123-4567" + " x" * 30 + " 555-987-6543 call": 1,
        "555-123-4567": 0,
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    rows = pii.mask(pii.with_spans(docs, "spans").withColumn("n", F.size("spans")), "spans").collect()
    assert {r["doc_id"]: r["n"] for r in rows} == dict(enumerate(texts.values()))
    masked = {r["doc_id"]: r["text"] for r in rows}
    assert masked[0] == "Call [LOCAL_PHONE] or [LOCAL_PHONE]" and masked[2] == "[SSN] is my SSN"


def test_spans_of_odd_documents(spark):
    found = pii.with_spans(odd_documents(spark), "_spans")
    assert sorted(found.columns) == sorted(odd_documents(spark).columns)
    assert found.count() == len(ROWS)
    masked = pii.mask(pii.with_spans(odd_documents(spark), "spans"), "spans")
    assert masked.columns == odd_documents(spark).columns
    assert "ann@" not in masked.filter("doc_id = 1").first()["text"]
    assert pii.mask(pii.with_spans(no_documents(spark), "s"), "s").count() == 0


# --- BPE --------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as file:
        ranks = bpe.read_ranks(file.read())
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks


def test_encoder_equals_the_library(spark, library):
    encoding, ranks = library
    encoder, decoder = bpe.Encoder(ranks, public_tokenizers.PATTERN), bpe.Decoder(ranks)
    rng = random.Random(9)
    texts = [r[1] or "" for r in ROWS if (r[1] or "") is not ROWS[6][1]] + [r["text"] for r in documents(spark).limit(100).collect()]
    texts += ["".join(rng.choices(" \n\tabé'1.,😀\x1c\x85\xa0中s\x1f​  ", k=rng.randint(1, 60))) for _ in range(1500)]
    texts += ["aaaa" * 50, "abab" * 40, " " * 40, "́" * 9]
    for text in texts:
        ids = np.frombuffer(b"".join(encoder.encode(text)), "<i4")
        assert ids.tolist() == encoding.encode_ordinary(text), text[:60]
        assert decoder.decode(ids) == text.encode()
        assert "".join(decoder.stream(ids.tolist())) == text


def test_forgotten_states_change_nothing(library, monkeypatch):
    encoding, ranks = library
    monkeypatch.setattr(bpe, "STATES", 3)
    monkeypatch.setattr(bpe, "PAIRS", 3)
    monkeypatch.setattr(bpe, "SEGMENTS", 2)
    encoder = bpe.Encoder(ranks, public_tokenizers.PATTERN)
    text = "It isn't the same thing, is it? Unquestionably différent texts 12345"
    assert np.frombuffer(b"".join(encoder.encode(text)), "<i4").tolist() == encoding.encode_ordinary(text)


def test_utf8_stream_holds_back_unfinished_characters():
    whole = "aé中😀".encode()
    for cut in range(len(whole) + 1):
        machine = bpe.Utf8Stream()
        assert machine.feed(whole[:cut]) + machine.feed(whole[cut:]) + machine.finish() == "aé中😀"
    machine = bpe.Utf8Stream()
    assert machine.feed(b"\xe4\xb8") == "" and machine.finish() == "�"


def test_bpe_of_odd_documents(spark, library):
    encoding, _ = library
    coded = bpe.encode(odd_documents(spark), "ids", RANKS, public_tokenizers.PATTERN)
    back = bpe.decode(bpe.decode(coded, "ids", "raw", RANKS), "ids", "again", RANKS, as_text=True)
    for row in back.collect():
        text = row["text"] or ""
        assert (row["raw"] == text.encode()) and row["again"] == text
        if len(text) < 1000:
            assert row["ids"] == encoding.encode_ordinary(text)
    assert bpe.encode(no_documents(spark), "ids", RANKS, public_tokenizers.PATTERN).count() == 0


def test_query_digests(spark, library):
    from rawharbor.llm.queries import op8_byte_bpe

    encoding, _ = library
    texts = {r["doc_id"]: r["text"] for r in documents(spark).collect()}
    for row in op8_byte_bpe(spark, SF).collect():
        ids = encoding.encode_ordinary(texts[row["doc_id"]])
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(texts[row["doc_id"]].encode()).hexdigest()


def test_the_last_byte_of_a_piece_makes_no_state(library):
    encoding, ranks = library
    machine, rng = bpe.Transducer(ranks), random.Random(5)
    first = b" eringinhe"
    assert machine.encode(first) == encoding.encode_ordinary(first.decode())
    assert len(machine.steps) == len(first) - 1 and len(machine.states) <= len(first)
    assert machine.encode(b"") == []
    pieces = ["".join(rng.choice("aehinrstéß\U0001f600") for _ in range(rng.randrange(1, 30))) for _ in range(500)]
    coder = bpe.Encoder(ranks, public_tokenizers.PATTERN)
    for text in pieces + [f" {p}" for p in pieces] + [" ".join(pieces)]:
        found = np.frombuffer(b"".join(coder.encode(text)), "<i4").tolist()
        assert found == encoding.encode_ordinary(text)


def test_moves_are_found_once_for_all_tokens_before(library, monkeypatch):
    encoding, ranks = library
    machine, rng = bpe.Transducer(ranks), random.Random(6)
    pieces = [" " + "".join(rng.choice(["er", "ion", "th", "he", "st", "ü"]) for _ in range(6)) for _ in range(400)]
    assert [machine.encode(p.encode()) for p in pieces] == [encoding.encode_ordinary(p) for p in pieces]
    assert len(machine.moves) < len(machine.steps) / 2
    assert all(len(machine.chains[state[0]]) == len(state) - 1 for state in machine.states)
    monkeypatch.setattr(bpe, "MOVES", 3)
    machine.forget()
    assert [machine.encode(p.encode()) for p in pieces[:50]] == [encoding.encode_ordinary(p) for p in pieces[:50]]


def test_kept_segments_take_few_bytes_and_are_bounded(library, monkeypatch):
    encoding, ranks = library
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefghij", k=8)) for _ in range(4000)]
    monkeypatch.setattr(bpe, "SEGMENTS", 3000)
    monkeypatch.setattr(bpe, "PIECES", 2000)
    coder = bpe.Encoder(ranks, public_tokenizers.PATTERN)
    for start in [*range(0, 4000, 500), 0, 500]:
        text = " ".join(words[start : start + 500] + ["the end"])
        assert np.frombuffer(b"".join(coder.encode(text)), "<i4").tolist() == encoding.encode_ordinary(text)
    for kept, most in ((coder.known, 3000), (coder.known_pieces, 2000)):
        assert most / 4 < len(kept.strings) == len(kept.answers) <= most
        assert kept.strings.nbytes + kept.answers.nbytes < 60 * len(kept.strings)
    assert " the" in coder.known.strings.to_pylist()  # strings asked for again outlive those met once


def test_one_python_step_encodes_and_decodes(spark, library):
    from rawharbor.llm.queries import coded

    docs = odd_documents(spark)
    both = coded(docs)
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    apart = bpe.decode(bpe.encode(docs, "ids", RANKS, public_tokenizers.PATTERN), "ids", "decoded", RANKS)
    assert both.columns == apart.columns
    assert Counter(map(str, both.collect())) == Counter(map(str, apart.collect()))
