"""Token ids in succinct files: one wavelet matrix per shard.

A shard holds the ids of a run of documents in ascending id order as bit planes, highest
bit first. Behind each plane the sequence is sorted stably by that bit, so a token is
read by following its position through the planes with rank queries, an id is counted
by following a range, and its k-th occurrence is found by following the planes back with
select queries. Ranks are kept per 512 bits. Planes are compressed one by one, so a
count reads no documents and an access reads no index of them.

File layout, all little-endian: magic ``WVM1``; header of 64-bit words: tokens, planes,
documents, and the compressed size of each section; then the sections: document ids (and
which are null), document lengths, and per plane its bits and running counts.

Shards are binary values of a table that Spark's Parquet sink writes to shared storage,
one value per file. That keeps Spark's commit protocol, without which a lost executor
could leave half a shard behind.

Defined cases: a null text is an empty one; an empty document holds only the end id;
null document ids come first; rows with equal ids follow one another in an order that a
hash of their tokens settles; an empty table gives no shard.
"""

from __future__ import annotations

import hashlib
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rawharbor.llm.common import quoted
from rawharbor.llm.segments import Known, before_solid, ids_array, ids_of, parts_of
from rawharbor.operators.joins import join_reduced
from rawharbor.session import prepare_python

MAGIC = b"WVM1"
SHARD_TOKENS = 1 << 20
RANK_BITS = 512
SEGMENTS = 600_000  # segments remembered per worker
JOINED = 100  # new segments handed to the library in one text
RANGES = 4096  # at most so many ranges of document ids


class WaveletMatrix:
    """Rank, select and access over a sequence of ids."""

    def __init__(self, planes: list[np.ndarray], counts: list[np.ndarray], size: int):
        self.planes, self.counts, self.size = planes, counts, size
        self.zeros = [size - int(c[-1]) for c in counts]

    @classmethod
    def build(cls, ids: np.ndarray, planes: int | None = None) -> WaveletMatrix:
        planes = planes or max(1, int(ids.max()).bit_length() if len(ids) else 1)
        sequence = ids.astype(np.uint16 if planes <= 16 else np.uint32)
        bits, counts = [], []
        for plane in range(planes - 1, -1, -1):
            one = (sequence & (1 << plane)) != 0
            packed = np.packbits(one, bitorder="little")
            padded = np.zeros(-(-max(len(packed), 1) // 64) * 64, np.uint8)
            padded[: len(packed)] = packed
            per_block = np.bitwise_count(padded.view(np.uint64)).reshape(-1, RANK_BITS // 64).sum(axis=1, dtype=np.int64)
            bits.append(padded)
            counts.append(np.concatenate([[0], np.cumsum(per_block)]))
            sequence = np.concatenate([np.compress(~one, sequence), np.compress(one, sequence)])
        return cls(bits, counts, len(ids))

    def rank(self, plane: int, position: int) -> int:
        """Ones before a position."""
        block, rest = divmod(position, RANK_BITS)
        start = block * RANK_BITS // 8
        part = np.unpackbits(self.planes[plane][start : start + -(-rest // 8)], bitorder="little")[:rest]
        return int(self.counts[plane][block]) + int(part.sum())

    def select(self, plane: int, bit: int, number: int) -> int:
        """Position of the ``number``-th (from 0) one or zero of a plane."""
        counts = self.counts[plane]
        before = counts if bit else np.arange(len(counts)) * RANK_BITS - counts
        block = int(np.searchsorted(before, number, side="right")) - 1
        start = block * RANK_BITS // 8
        part = np.unpackbits(self.planes[plane][start : start + RANK_BITS // 8], bitorder="little")
        return block * RANK_BITS + int(np.flatnonzero(part == bit)[number - int(before[block])])

    def access(self, position: int) -> int:
        value = 0
        for plane in range(len(self.planes)):
            bit = self.planes[plane][position >> 3] >> (position & 7) & 1
            ones = self.rank(plane, position)
            position = self.zeros[plane] + ones if bit else position - ones
            value = value << 1 | int(bit)
        return value

    def _range(self, value: int, start: int, end: int) -> tuple[int, int]:
        for plane in range(len(self.planes)):
            a, b = self.rank(plane, start), self.rank(plane, end)
            if value >> (len(self.planes) - 1 - plane) & 1:
                start, end = self.zeros[plane] + a, self.zeros[plane] + b
            else:
                start, end = start - a, end - b
        return start, end

    def count(self, value: int, start: int = 0, end: int | None = None) -> int:
        if value >> len(self.planes):
            return 0
        first, last = self._range(value, start, self.size if end is None else end)
        return last - first

    def occurrence(self, value: int, number: int) -> int | None:
        """Position of the ``number``-th (from 0) occurrence of an id, or None."""
        if not 0 <= number < self.count(value):
            return None
        position = self._range(value, 0, 0)[0] + number
        for plane in range(len(self.planes) - 1, -1, -1):
            bit = value >> (len(self.planes) - 1 - plane) & 1
            position = self.select(plane, bit, position - self.zeros[plane] if bit else position)
        return position

    def tokens(self) -> np.ndarray:
        """The whole sequence, by undoing the planes' sorts from the last to the first."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        sequence = np.zeros(self.size, kind)
        for plane in range(len(self.planes) - 1, -1, -1):
            one = np.unpackbits(self.planes[plane], count=self.size, bitorder="little").view(bool)
            restored = np.empty_like(sequence)
            restored[~one] = sequence[: self.zeros[plane]]
            restored[one] = sequence[self.zeros[plane] :] | kind(1 << (len(self.planes) - 1 - plane))
            sequence = restored
        return sequence


def write_shard(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, planes: int) -> bytes:
    matrix = WaveletMatrix.build(ids, planes)
    pack = zstandard.ZstdCompressor(level=1).compress
    known = np.array([i is not None for i in doc_ids], np.uint8)
    sections = [
        pack(np.array([i or 0 for i in doc_ids], "<i8").tobytes() + known.tobytes()),
        pack(np.array(lengths, "<i8").tobytes()),
    ]
    for bits, counts in zip(matrix.planes, matrix.counts):
        sections += [pack(bits.tobytes()), pack(counts.astype("<i8").tobytes())]
    head = struct.pack(f"<4s{3 + len(sections)}q", MAGIC, len(ids), planes, len(doc_ids), *map(len, sections))
    return head + b"".join(sections)


class Shard:
    """A shard file; sections are unpacked when asked for."""

    def __init__(self, content: bytes):
        magic, self.size, planes, self.documents = struct.unpack_from("<4s3q", content)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        sizes = struct.unpack_from(f"<{2 + 2 * planes}q", content, 28)
        cuts = np.concatenate([[0], np.cumsum(sizes)]) + 28 + 8 * len(sizes)
        unpack = zstandard.ZstdDecompressor().decompress
        self.section = lambda i: unpack(content[cuts[i] : cuts[i + 1]])
        self.number = planes

    def doc_ids(self) -> list[int | None]:
        raw = self.section(0)
        ids = np.frombuffer(raw, "<i8", self.documents).tolist()
        known = np.frombuffer(raw, np.uint8, self.documents, 8 * self.documents)
        return [i if k else None for i, k in zip(ids, known)]

    def lengths(self) -> np.ndarray:
        return np.frombuffer(self.section(1), "<i8")

    def matrix(self) -> WaveletMatrix:
        bits = [np.frombuffer(self.section(2 + 2 * p), np.uint8) for p in range(self.number)]
        return WaveletMatrix(bits, [np.frombuffer(self.section(3 + 2 * p), "<i8") for p in range(self.number)], self.size)


class TextTokenizer:
    """The tokenizers library, asked once per segment of text that recurs.

    New segments of a batch go to the library behind one another, some at a time, as it takes
    half the time for them that it takes one by one; how many bytes the ids stand for tells
    them apart again. Texts with the strings of added tokens are encoded whole, and so are
    all if the tokenizer is not a byte-level one without normalizer.
    """

    def __init__(self, content: str):
        # A task is the unit of parallel work; threads of the library's own would come on top.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_str(content)
        rules = self.tokenizer.pre_tokenizer
        self.cuts = (
            type(rules).__name__ == "ByteLevel" and rules.use_regex and not rules.add_prefix_space and self.tokenizer.normalizer is None
        )
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = [t.content for t in added.values()]
        # Each character of a byte-level token stands for a byte.
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.lengths = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, i in vocabulary.items():
            self.lengths[i] = len(token) if i not in added else 0
        self.known = Known(SEGMENTS, self.fresh)

    def library(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4") for e in found]

    def with_added(self, texts: pa.Array) -> np.ndarray:
        found = np.zeros(len(texts), bool)
        for token in self.added:
            found |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        return found

    def one_by_one(self, texts: pa.Array) -> pa.LargeBinaryArray:
        found = self.library(texts.to_pylist())
        return ids_array(np.concatenate([*found, np.zeros(0, "<u4")]), np.cumsum([len(f) for f in found], dtype=np.int64))

    def fresh(self, segments: pa.StringArray) -> pa.LargeBinaryArray:
        offsets, data, _ = parts_of(segments)
        join = np.zeros(len(segments), bool)
        if self.cuts:
            join = (offsets[1:] - offsets[:-1] > 1) & (data[np.minimum(offsets[:-1], len(data) - 1)] == 32)
            join[join] = before_solid(data, offsets[:-1][join])
            join &= ~self.with_added(segments)
        made = pa.concat_arrays([self.joined(segments.filter(pa.array(join))), self.one_by_one(segments.filter(pa.array(~join)))])
        return made.take(pa.array(np.argsort(np.argsort(~join, kind="stable"))))

    def joined(self, segments: pa.StringArray) -> pa.LargeBinaryArray:
        offsets, data, _ = parts_of(segments)
        bounds = [*offsets[:-1:JOINED].tolist(), int(offsets[-1])]
        found = self.library([data[a:b].tobytes().decode() for a, b in zip(bounds, bounds[1:])])
        ids = np.concatenate([*found, np.zeros(0, "<u4")])
        reached, wanted = np.cumsum(self.lengths[ids]), offsets[1:] - offsets[0]
        last = np.searchsorted(reached, wanted)
        if len(wanted) and (last[-1] >= len(ids) or (reached[last] != wanted).any()):
            return self.one_by_one(segments)  # the vocabulary lacks some bytes
        return ids_array(ids, last + 1)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts behind one another, and where each text begins and the last ends."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        whole = self.with_added(texts) if self.cuts else np.ones(len(texts), bool)
        return ids_of(texts, self.known, np.flatnonzero(whole).tolist())


_MADE: dict[bytes, TextTokenizer] = {}


def _tokenizer(content: str) -> TextTokenizer:
    key = hashlib.sha256(content.encode()).digest()
    if key not in _MADE:
        _MADE[key] = TextTokenizer(content)
    return _MADE[key]


def _ranges(docs: DataFrame, id_column: str, parts: int) -> list[int]:
    """Bounds of ranges of document ids with about as many rows each."""
    if parts < 2:
        return []
    shares = [i / parts for i in range(1, parts)]
    found = docs.select(F.percentile_approx(quoted(id_column), shares, 10 * parts).alias("q")).first()["q"]
    return sorted(set(found or []))


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    end_id: int,
    id_column: str = "doc_id",
    text: str = "text",
    pattern: str | None = None,
) -> None:
    """Encode whole texts, end each with ``end_id``, and write shards below ``path``.
    ``pattern`` is not needed any more: the library itself splits all texts."""
    spark = docs.sparkSession
    prepare_python(spark)
    with open(tokenizer_path, encoding="utf-8") as file:
        content = spark.sparkContext.broadcast(file.read())
    vocabulary = max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), end_id + 1)
    planes = max(1, (vocabulary - 1).bit_length())
    width = "<u2" if planes <= 16 else "<u4"

    def tokenize(texts: pa.Array) -> pa.Array:
        ids, bounds = _tokenizer(content.value).encode(texts)
        ids, end = ids.astype(width), np.array([end_id], width).tobytes()
        return pa.array([ids[a:b].tobytes() + end for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, names, lengths, ids = None, 0, [], [], []
        held = 0

        def flush():
            nonlocal number, names, lengths, ids, held
            made = write_shard(names, lengths, np.concatenate(ids), planes)
            row = pa.record_batch(
                [pa.array([part], pa.int64()), pa.array([number], pa.int64()), pa.array([held], pa.int64()), pa.array([made], pa.binary())],
                names=["part", "shard", "tokens", "content"],
            )
            number, names, lengths, ids, held = number + 1, [], [], [], 0
            return row

        for batch in batches:
            for p, name, code in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if names and (p != part or held >= SHARD_TOKENS):
                    yield flush()
                if p != part:
                    part, number = p, 0
                tokens = np.frombuffer(code, width)
                names.append(name)
                lengths.append(len(tokens))
                ids.append(tokens)
                held += len(tokens)
        if names:
            yield flush()

    size = docs.agg(F.sum(F.coalesce(F.length(quoted(text)), F.lit(0)))).first()[0] or 0
    parts = int(min(RANGES, max(1, size // (8 * SHARD_TOKENS))))
    bounds = _ranges(docs, id_column, parts)
    place = F.lit(0).cast("bigint")
    if bounds:
        past = F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < quoted(id_column))
        place = F.when(quoted(id_column).isNull(), 0).otherwise(F.size(past)).cast("bigint")
    code = F.arrow_udf(tokenize, "binary").asNondeterministic()
    coded = docs.select(place.alias("part"), quoted(id_column).cast("bigint").alias("doc_id"), code(quoted(text)).alias("code"))
    ordered = coded.repartition(max(1, len(bounds) + 1), "part").sortWithinPartitions(
        "part", F.col("doc_id").asc_nulls_first(), F.xxhash64("code")
    )
    made = ordered.mapInArrow(shards, "part bigint, shard bigint, tokens bigint, content binary")
    made.write.option("maxRecordsPerFile", 1).option("compression", "none").parquet(path)


def shard_starts(spark, path: str) -> DataFrame:
    """``part, shard, start``: tokens of all shards before each. The parts, which are
    few, are summed first; then the shards inside each."""
    sizes = spark.read.parquet(path).select("part", "shard", "tokens")
    whole = sizes.groupBy("part").agg(F.sum("tokens").alias("held"))
    before = F.sum("held").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = whole.select("part", F.coalesce(before, F.lit(0)).alias("offset"))
    inside = F.sum("tokens").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    return (
        sizes.withColumn("inside", F.coalesce(inside, F.lit(0)))
        .join(offsets, "part")
        .select("part", "shard", (F.col("offset") + F.col("inside")).alias("start"))
    )


def read_tokens(spark, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the shard files."""
    prepare_python(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, number, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                shard = Shard(content.as_py())
                lengths = shard.lengths()
                ends = np.cumsum(lengths)
                ids = shard.matrix().tokens().astype("<u4")
                sums = [zlib.crc32(ids[e - n : e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                yield pa.record_batch(
                    [
                        pa.array([part] * shard.documents, pa.int64()),
                        pa.array([number] * shard.documents, pa.int64()),
                        pa.array(shard.doc_ids(), pa.int64()),
                        pa.array(ends - lengths, pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array(sums, pa.int64()),
                    ],
                    names=["part", "shard", "doc_id", "inside", "n_tokens", "ids_crc32"],
                )

    schema = "part bigint, shard bigint, doc_id bigint, inside bigint, n_tokens bigint, ids_crc32 bigint"
    rows = spark.read.parquet(path).select("part", "shard", "content").mapInArrow(read, schema)
    joined = join_reduced(rows, shard_starts(spark, path), ["part", "shard"], "inner")
    return joined.select("doc_id", (F.col("start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
