"""Collocations from Rabin-Karp fingerprints of all n-grams.

1. *Blocks.* Documents are cut into pieces and words once, in blocks of some megabytes: the
   block's distinct words, and per token its word, with a mark after each piece.
2. *Fingerprints.* Prefix polynomials modulo two primes, over the bytes of words and then over
   the words, give every n-gram of a block a fingerprint in a few vector operations. Equal
   ones of a block become one entry: fingerprint, count, and a pointer (block and number).
3. *Aggregate.* Entries are packed by range of fingerprint and shuffled; a range adds them up
   and returns the pointers of those whose sum reaches the least count. A hot n-gram is
   one entry per block, so no range is hot.
4. *Verify.* The pointers go back to their blocks, which read the phrase there: counts are
   then added per text, so phrases that share a fingerprint come apart, and only frequent
   phrases ever become strings. Within a block, n-grams of one fingerprint but other words
   are separate entries from the start.
5. *Score.* Candidates are joined to the counts of their parts; all numbers are exact.

A phrase's parts occur at least as often as the phrase, so counts below the least count are
never needed.

Defined cases: a null text is empty; a null language is ``und`` and one with the language of
that name; repeated rows count each time; a piece never goes on in another text; a text
larger than a block is a block of its own, whole; an empty table gives an empty one; other
columns, whatever their names, are not read; ties in score and count go by the phrase's bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rawharbor.llm.common import materialize, planes, quoted, unplanes
from rawharbor.operators.joins import join_reduced
from rawharbor.session import prepare_python

LONGEST = 3  # words of a phrase
LEAST = 10  # occurrences of a phrase
INSIDE = 50  # percent of its occurrences that lie in one longer candidate
BEST = 2_000  # rows per language
UNKNOWN = "und"
SPARE_BITS = 12  # of a fingerprint, beyond those that number the bytes of all texts
BLOCK_BYTES = 4 << 20
RANGE_BYTES = 6 << 20  # text per range of fingerprints
PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (1_103_515_245, 1_664_525_013)

# Kinds of bytes: 0 in words, 1 between words, 2 between pieces.
KINDS = np.zeros(256, np.uint8)
KINDS[list(b" \t")] = 1
KINDS[list(b".,;:!?\n\v\f\r")] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


# --- blocks -----------------------------------------------------------------------


def tokens(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words, the tokens as numbers of words, and where each text's tokens begin.
    The number after the last word is a mark that ends a piece."""
    raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    kinds = KINDS[raw]
    inside = kinds == 0
    starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    ends = np.flatnonzero(inside & ~np.concatenate([inside[1:], [False]])) + 1
    packed = LOWER[raw[inside]]
    cuts = np.concatenate([[0], np.cumsum(ends - starts)])
    flat = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(packed)])
    coded = flat.dictionary_encode()
    words = coded.dictionary.to_pylist()
    # A mark stands before each word that opens a piece, and after the last one.
    breaks = np.concatenate([[0], np.cumsum(kinds == 2)])
    piece = breaks[starts] if len(starts) else np.empty(0, np.int64)
    opens = np.concatenate([[True], piece[1:] != piece[:-1]]) if len(piece) else np.empty(0, bool)
    place = np.arange(len(starts)) + np.cumsum(opens)
    out = np.full(len(starts) + int(opens.sum()) + 1, len(words), np.int32)
    out[place] = np.asarray(coded.indices)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    first = np.searchsorted(starts, np.cumsum(sizes) - sizes)
    return words, out, np.append(place, len(out))[first]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number, waiting, size = TaskContext.get().partitionId() << 32, [], 0

    def flush() -> pa.RecordBatch:
        nonlocal number, waiting, size
        waiting.sort(key=lambda row: row[0])  # texts of a language stand together
        words, codes, first = _by_frequency(*tokens([text for _, text in waiting]))
        langs = [lang for lang, _ in waiting]
        changes = [i for i, lang in enumerate(langs) if not i or lang != langs[i - 1]]
        bounds = [int(first[i]) - 1 if i else 0 for i in changes]  # the mark before a text belongs to it
        counted = np.concatenate([[0], np.cumsum(codes < len(words))])
        spans = [{"lang": langs[i], "start": a, "words": int(counted[b] - counted[a])} for i, a, b in zip(changes, bounds, [*bounds[1:], len(codes)])]
        packer = zstandard.ZstdCompressor(level=1)
        row = [number, spans, packer.compress(b" ".join(words)), packer.compress(planes(codes))]
        number, waiting, size = number + 1, [], 0
        return pa.record_batch([pa.array([v], kind) for v, kind in zip(row, kinds)], names=["block", "spans", "words", "codes"])

    kinds = [pa.int64(), pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("words", pa.int64())])), pa.binary(), pa.binary()]
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())):
            text = text.as_py()
            if waiting and size + len(text) > BLOCK_BYTES:
                yield flush()
            waiting.append((lang, text))
            size += len(text)
    if waiting:
        yield flush()


def _by_frequency(words: list[bytes], codes: np.ndarray, first: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The same tokens with the smallest numbers for the most frequent words, which pack best."""
    order = np.argsort(-np.bincount(codes, minlength=len(words) + 1)[:-1], kind="stable")
    renamed = np.full(len(words) + 1, len(words), np.int32)
    renamed[order] = np.arange(len(words))
    return [words[i] for i in order], renamed[codes], first


BLOCK_SCHEMA = "block bigint, spans array<struct<lang:string,start:bigint,words:bigint>>, words binary, codes binary"


def _unpack(words: bytes, codes: bytes) -> tuple[list[bytes], np.ndarray]:
    opener = zstandard.ZstdDecompressor()
    joined = opener.decompress(words)
    return joined.split(b" ") if joined else [], unplanes(opener.decompress(codes), np.int32)


# --- fingerprints -----------------------------------------------------------------


@lru_cache(maxsize=128)
def _powers(base: int, size: int, prime: int) -> np.ndarray:
    if size == 1:
        return np.ones(1, np.int64)
    half = powers(base, size // 2, prime)
    return np.concatenate([half, half * pow(base, size // 2, prime) % prime])


def powers(base: int, count: int, prime: int) -> np.ndarray:
    """base**i modulo the prime, by doubling."""
    size = 1 << max(count - 1, 0).bit_length()
    return _powers(base, size, prime)[:count]


class Prefixes:
    """Polynomials of all stretches of a row of values below a prime: the value at distance k
    from the first one weighs base**-k."""

    def __init__(self, values: np.ndarray, base: int, prime: int):
        self.prime = prime
        self.up = powers(base, len(values) + 1, prime)
        weighed = values * powers(pow(base, -1, prime), len(values), prime) % prime
        self.sums = np.concatenate([[0], np.cumsum(weighed)])  # below 2**63 up to 2**32 values

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) % self.prime * self.up[starts] % self.prime


def byte_values(words: list[bytes], base: int, prime: int) -> np.ndarray:
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths)
    prefixes = Prefixes(np.frombuffer(b"".join(words), np.uint8).astype(np.int64) + 1, base, prime)
    return (prefixes.of(ends - lengths, ends) * base + lengths + 1) % prime


def fingerprints(
    words: list[bytes], codes: np.ndarray, tags: np.ndarray, longest: int, bits: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per length: where its n-grams start, and their fingerprints. ``tags`` is a number per
    token that also counts, as the language does."""
    halves = []
    for base, prime in zip(BASES, PRIMES):
        values = np.append(byte_values(words, base, prime), 0)[codes]
        halves.append((Prefixes(values, base, prime), prime, base))
    marks = np.concatenate([[0], np.cumsum(codes == len(words))])  # before each token
    for size in range(1, longest + 1):
        if len(codes) < size:
            return
        starts = np.flatnonzero(marks[size:] == marks[:-size])
        high, low = ((p.of(starts, starts + size) * base + tags[starts] + size) % prime for p, prime, base in halves)
        yield starts, (high << 31 | low) & ((1 << bits) - 1)


def _order(prints: np.ndarray, bits: int) -> np.ndarray:
    """Places of the fingerprints in rising order; sorting plain numbers is much the fastest,
    so a number holds fingerprint and place where it can."""
    wide = len(prints).bit_length()
    if bits + wide > 63:
        return np.argsort(prints, kind="stable")
    return np.sort(prints << wide | np.arange(len(prints))) & ((1 << wide) - 1)


def entries(
    words: list[bytes], codes: np.ndarray, tags: np.ndarray, longest: int, bits: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprint, count, place and length of each distinct n-gram, by fingerprint and then by
    the n-gram, so that the same block always gives the same order."""
    found = list(fingerprints(words, codes, tags, longest, bits))
    if not found:
        return (np.empty(0, np.int64),) * 4
    starts = np.concatenate([s for s, _ in found])
    sizes = np.repeat(np.arange(1, len(found) + 1, dtype=np.int8), [len(s) for s, _ in found])
    prints = np.concatenate([p for _, p in found])
    order, last = _order(prints, bits), len(codes) - 1

    def columns(order: np.ndarray) -> Iterator[np.ndarray]:
        """What makes n-grams equal: length, language, words."""
        at, size = starts[order], sizes[order]
        yield size
        yield tags[at]
        for k in range(longest):
            yield np.where(size > k, codes[np.minimum(at + k, last)], -1)

    def unlike(order: np.ndarray) -> np.ndarray:
        """Whether an n-gram differs from the one before it in this order."""
        out = np.zeros(max(len(order) - 1, 0), bool)
        for column in columns(order):
            out |= column[1:] != column[:-1]
        return out

    new = np.ones(len(prints), bool)
    ordered, other = prints[order], unlike(order)
    new[1:] = ordered[1:] != ordered[:-1]
    if torn := set(ordered[1:][other & ~new[1:]].tolist()):  # one fingerprint, other words
        mixed = np.flatnonzero(np.isin(ordered, list(torn)))
        rows = order[mixed]
        order[mixed] = rows[np.lexsort([*reversed(list(columns(rows))), prints[rows]])]
        new[1:] |= unlike(order)
    at = np.flatnonzero(new)
    return ordered[at], np.diff(np.append(at, len(prints))), starts[order[at]], sizes[order[at]]


def _tags(spans: list[dict], tokens: int) -> np.ndarray:
    """Per token the Rabin-Karp value of its language's name."""
    names = [s["lang"].encode("utf-8", "surrogatepass") for s in spans]
    values = byte_values(names, BASES[0], PRIMES[1]) if names else np.empty(0, np.int64)
    return np.repeat(values, np.diff([*(s["start"] for s in spans), tokens])) if names else np.empty(0, np.int64)


def _packed(longest: int, bits: int, ranges: int):
    """Rows ``part, block, first, content``: the entries of a block by range of fingerprint.
    An entry's pointer is its number among those of its block, and ``first`` the number of
    the range's first one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        width = -(-(1 << bits) // ranges)
        for batch in batches:
            for block, spans, words, codes in zip(*(batch.column(i).to_pylist() for i in range(4))):
                words, codes = _unpack(words, codes)
                prints, counts, _, _ = entries(words, codes, _tags(spans, len(codes)), longest, bits)
                parts = prints // width
                cuts = np.flatnonzero(np.concatenate([[True], parts[1:] != parts[:-1], [True]])) if len(parts) else np.zeros(1, np.int64)
                contents = [
                    packer.compress(planes(np.diff(prints[a:b], prepend=0)) + planes(counts[a:b])) for a, b in zip(cuts[:-1], cuts[1:])
                ]
                yield pa.record_batch(
                    [
                        pa.array(parts[cuts[:-1]], pa.int64()),
                        pa.array([block] * len(contents), pa.int64()),
                        pa.array(cuts[:-1], pa.int64()),
                        pa.array(contents, pa.binary()),
                    ],
                    names=["part", "block", "first", "content"],
                )

    return run


def _frequent(least: int):
    """Of one range: per block the pointers and counts of entries whose sum over all blocks
    reaches ``least``."""

    def run(rows: pa.Table) -> pa.Table:
        opener, packer = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        prints, counts = [], []
        for content in rows["content"]:
            steps, n = _halves(opener.decompress(content.as_py()))
            prints.append(np.cumsum(steps))
            counts.append(n)
        sizes = list(map(len, counts))
        flat, order = np.concatenate(counts), np.argsort(np.concatenate(prints))
        ordered = np.concatenate(prints)[order]
        prints.clear()
        new = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        good = np.zeros(len(order), bool)
        good[order] = np.repeat(np.add.reduceat(flat[order], new) >= least, np.diff(np.append(new, len(order))))
        out, at = [], 0
        for block, first, size in zip(rows["block"].to_pylist(), rows["first"].to_pylist(), sizes):
            kept = np.flatnonzero(good[at : at + size])
            if len(kept):
                content = planes(np.diff(kept + first, prepend=0)) + planes(flat[at + kept])
                out.append((block, packer.compress(content)))
            at += size
        part = pa.array([rows["part"][0].as_py()] * len(out), pa.int64())
        return pa.table([part, pa.array([b for b, _ in out], pa.int64()), pa.array([c for _, c in out], pa.binary())], names=["part", "block", "content"])

    return run


def _halves(content: bytes) -> tuple[np.ndarray, np.ndarray]:
    half = len(content) // 2
    return unplanes(content[:half], np.int64), unplanes(content[half:], np.int64)


def _read(longest: int, bits: int):
    """The phrases of a block that the pointers name, by range: rows ``part, langs, texts, marks``.
    ``marks`` holds the number of each phrase's language, then how often it stands in the block."""

    def run(key: tuple, blocks: pa.Table, hits: pa.Table) -> pa.Table:
        opener, packer = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        spans, (words, codes) = blocks["spans"][0].as_py(), _unpack(blocks["words"][0].as_py(), blocks["codes"][0].as_py())
        _, _, places, sizes = entries(words, codes, _tags(spans, len(codes)), longest, bits)
        table, begins = pa.array([*words, b""], pa.binary()), np.array([s["start"] for s in spans])
        texts, marks = [], []
        for content in hits["content"]:
            steps, counts = _halves(opener.decompress(content.as_py()))
            pointers = np.cumsum(steps)
            at, size = places[pointers], sizes[pointers]
            # All words of these phrases in a row, with the blank or line break that follows.
            row = np.repeat(at - np.cumsum(size) + size, size) + np.arange(size.sum())
            after = np.full(len(row), b" ")
            after[np.cumsum(size) - 1] = b"\n"
            joined = pc.binary_join_element_wise(table.take(pa.array(codes[row])), pa.array(after), b"")
            texts.append(packer.compress(joined.buffers()[2].to_pybytes()[: np.asarray(pc.binary_length(joined)).sum()]))
            lang = np.searchsorted(begins, at, side="right") - 1
            marks.append(packer.compress(planes(lang.astype(np.int64)) + planes(counts)))
        langs = pa.array([[s["lang"] for s in spans]] * hits.num_rows, pa.list_(pa.string()))
        return pa.table([hits["part"], langs, pa.array(texts, pa.binary()), pa.array(marks, pa.binary())], names=["part", "langs", "texts", "marks"])

    return run


def _added(least: int):
    """Of one range: the phrases that all blocks together have ``least`` times."""

    def run(rows: pa.Table) -> pa.Table:
        opener = zstandard.ZstdDecompressor()
        texts, langs, counts = [], [], []
        for row in rows.to_batches():
            for names, text, mark in zip(row.column("langs"), row.column("texts"), row.column("marks")):
                lang, n = _halves(opener.decompress(mark.as_py()))
                raw = np.frombuffer(opener.decompress(text.as_py()), np.uint8)
                ends = np.flatnonzero(raw == ord("\n"))
                cuts = np.concatenate([[0], ends + 1]).astype(np.int32)
                texts.append(pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(cuts), pa.py_buffer(raw)]))
                langs.append(names.values.take(pa.array(lang)))
                counts.append(n)
        found = pa.table([pa.chunked_array(langs), pa.chunked_array(texts), pa.array(np.concatenate(counts))], names=["lang", "phrase", "n"])
        sums = found.group_by(["lang", "phrase"]).aggregate([("n", "sum")])
        sums = sums.filter(pc.greater_equal(sums["n_sum"], least))
        phrase = pc.binary_replace_slice(sums["phrase"], -1, 2**31 - 1, b"").cast(pa.string())  # without the line break
        size = pc.add(pc.count_substring(phrase, " "), 1).cast(pa.int32())
        return pa.table([sums["lang"], size, phrase, sums["n_sum"]], names=["lang", "size", "phrase", "n"])

    return run


def frequent_phrases(
    docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST
) -> tuple[DataFrame, DataFrame]:
    """``lang, size, phrase, n`` of all phrases met ``least`` times, and ``lang, n`` of all words."""
    spark = docs.sparkSession
    prepare_python(spark)
    narrow = docs.select(
        F.coalesce(quoted(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(quoted(text).cast("string"), F.lit("")).alias("text")
    )
    total = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, -(-total // RANGE_BYTES))
    bits = min(total.bit_length() + SPARE_BITS, 62)  # texts decide, so more would only save needless pointers
    blocks = materialize(narrow.mapInArrow(_blocks, BLOCK_SCHEMA), "phrase-blocks")
    packed = blocks.mapInArrow(_packed(longest, bits, ranges), "part bigint, block bigint, first bigint, content binary")
    hits = packed.groupBy("part").applyInArrow(_frequent(least), "part bigint, block bigint, content binary")
    read = blocks.groupBy("block").cogroup(hits.groupBy("block")).applyInArrow(
        _read(longest, bits), "part bigint, langs array<string>, texts binary, marks binary"
    )
    phrases = read.groupBy("part").applyInArrow(_added(least), "lang string, size int, phrase string, n bigint")
    words = blocks.select(F.explode("spans").alias("s")).groupBy("s.lang").agg(F.sum("s.words").alias("n"))
    return materialize(phrases, "phrases"), words


# --- scores -----------------------------------------------------------------------


def _score(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(1000000 a a / (l r)) in whole numbers of 38 digits: exact for counts below 10**15."""
    a, l, r = (c.cast("decimal(15,0)") for c in (a, l, r))  # noqa: E741
    return F.call_function("div", a * a * F.lit(1_000_000).cast("decimal(7,0)"), l * r)


def collocations(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    longest: int = LONGEST,
    least: int = LEAST,
    inside: int = INSIDE,
    best: int = BEST,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best phrases of each language, scored by
    their weakest cut, without those that mostly lie in one longer candidate."""
    phrases, totals = frequent_phrases(docs, text, lang, longest, least)
    words = F.split("phrase", " ", -1)

    def stretch(start, length):
        return F.array_join(F.slice("w", start, length), " ")

    candidates = phrases.filter("size > 1").select("lang", "size", F.col("n").alias("a"), words.alias("w"))
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")).select(
        "lang", "a", "k", stretch(F.lit(1), F.col("k")).alias("first"), stretch(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest")
    )
    counts = phrases.select("lang", F.col("phrase").alias("part"), "n")
    cuts = join_reduced(cuts, counts.select("lang", F.col("part").alias("first"), F.col("n").alias("l")), ["lang", "first"], "inner")
    cuts = join_reduced(cuts, counts.select("lang", F.col("part").alias("rest"), F.col("n").alias("r")), ["lang", "rest"], "inner")
    cut = F.struct(_score(F.col("a"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r")
    scored = cuts.select("lang", F.concat_ws(" ", "first", "rest").alias("phrase"), "a", cut.alias("cut"), F.lit(None).cast("bigint").alias("longer"))
    spans = F.explode(F.sequence(F.lit(2), F.col("size") - 1))
    longer = candidates.filter("size > 2").select("lang", "a", "w", "size", spans.alias("len"))
    longer = longer.select("lang", "a", "w", "len", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("len") + 1)).alias("at"))
    nothing = F.lit(None)
    covers = longer.select(
        "lang",
        stretch(F.col("at"), F.col("len")).alias("phrase"),
        nothing.cast("bigint").alias("a"),
        nothing.cast(scored.schema["cut"].dataType).alias("cut"),
        F.col("a").alias("longer"),
    )
    # What covers a candidate is a candidate too, so all that it covers are here as well.
    judged = scored.unionByName(covers).groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.min("cut").alias("cut"), F.max("longer").alias("longer"))
    kept = judged.filter(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * inside))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    top = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)
    return top.join(totals, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score"
    )
