"""Language-model scores from Brown classes.

Words are put into classes by exchange clustering; a text's probability is the product of
class transitions P(c|c') and word emissions P(w|c). Unknown words are a class of their
own, whose share after each class is estimated from the words that training saw once.
Over all known words and the one event "unknown", the probabilities sum to one.

How the corpus is passed:

1. *Blocks.* Documents are tokenized once into blocks of some megabytes: token codes, the
   block's distinct words as 64-bit hashes, and their training counts.
2. *Word counts.* Per block and range of hashes, one packed row; ranges are added up.
   A word has one entry per block, so no key is hot.
3. *Exchange.* The ``MOVED`` most frequent words start in ``CLASSES`` classes. Each sweep counts,
   over all blocks, the classes left and right of each of them and the class bigrams of all
   tokens. The gain in class-bigram likelihood is computed exactly for each word and class,
   and a share of the words moves to its best class at once. A sweep that lowers the
   likelihood, as moves at the same time may, is undone and taken with half the share.
4. *Other words.* They go to the class of the greatest gain, to the first order as they are rare,
   once, from the classes beside them in all blocks. Every word of the corpus gets a class.
5. *Replies.* Every block gets count and class of its words, and returns per document the
   class transitions, per block those of training documents.
6. *Scores.* The matrix of transitions (classes squared) is all that the scoring pass needs.

Everything learned covers all training documents. ``CLASSES``, ``MOVED`` and ``SWEEPS`` are
sizes of the model and do not grow with the input; tasks and driver hold ``MOVED`` times
``CLASSES`` counts. To the classes of a sweep, words outside ``MOVED`` are one more class.

Defined cases: a null text is empty and has one token, the end; without training
documents every word is unknown; repeated rows are scored alike and counted each time;
a null id counts as the empty text where documents are held out; a text larger than a block
is a block of its own, whole; an empty table gives an empty one; other columns, whatever
their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rawharbor.llm.common import materialize, planes, quoted, unplanes
from rawharbor.session import prepare_python

CLASSES = 32
MOVED = 8_192  # frequent words that are exchanged; all others are classed by their neighbours
SWEEPS = 10
SETTLED = 1e-4  # a sweep that gains a smaller part of the likelihood is followed by one of half the moves,
LEAST_SHARE = 0.02  # until these are too few
SHARE = 0.5  # of the words that gain by moving, in a sweep: all at once would hinder each other
BLOCK_BYTES = 4 << 20
RANGE_BYTES = 32 << 20  # text per range of word hashes
END = int(np.uint64(xxhash.xxh3_64_intdigest(b"\n")).astype(np.int64))  # no word holds a line break
UNKNOWN = CLASSES  # number of the class of unknown words
WIDE = CLASSES + 1
OTHER = CLASSES  # during the exchange: words that are not exchanged
SALTS = 64


def held_out(id_column: Column) -> Column:
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit(""))) % 7 == 2


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all tokens (each text's words, then the end), texts' lengths, word hashes in order."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    flat, cuts = lists.flatten(), np.asarray(lists.offsets)
    real = np.asarray(pc.greater(pc.binary_length(flat), 0)).astype(bool)
    bounds = np.concatenate([[0], np.cumsum(real)])[cuts - cuts[0]]
    coded = flat.filter(pa.array(real)).dictionary_encode()
    words = [xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()]
    hashes = np.concatenate([np.array(words, np.uint64), np.array([END]).view(np.uint64)])
    counts = np.diff(bounds)
    codes = np.full(int(bounds[-1]) + len(counts), len(hashes) - 1, np.int32)
    places = np.arange(int(bounds[-1])) + np.repeat(np.arange(len(counts)), counts)
    codes[places] = np.asarray(coded.indices)
    order = np.argsort(hashes)
    renamed = np.empty(len(order), np.int32)
    renamed[order] = np.arange(len(order))
    return renamed[codes], counts + 1, hashes[order]


BLOCK_SCHEMA = (
    "block bigint, doc_ids array<bigint>, held array<boolean>, lengths array<bigint>, codes binary, words binary, counts binary"
)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number, waiting, size = TaskContext.get().partitionId() << 32, [], 0
    packer = zstandard.ZstdCompressor(level=1)

    def flush() -> pa.RecordBatch:
        nonlocal number, waiting, size
        table = pa.Table.from_batches(waiting).combine_chunks()
        codes, lengths, hashes = _tokens(table["text"].combine_chunks())
        held = np.asarray(table["held"].combine_chunks()).astype(bool)
        counts = np.bincount(codes[np.repeat(~held, lengths)], minlength=len(hashes))
        row = [
            number,
            table["doc_id"].to_pylist(),
            held.tolist(),
            lengths,
            packer.compress(planes(codes)),
            packer.compress(planes(np.diff(hashes, prepend=np.uint64(0)))),
            packer.compress(planes(counts)),
        ]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
        names = ["block", "doc_ids", "held", "lengths", "codes", "words", "counts"]
        out = pa.record_batch([pa.array([v], k) for v, k in zip(row, kinds)], names=names)
        number, waiting, size = number + 1, [], 0
        return out

    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch["text"]), 0))
        first = 0
        for i, n in enumerate(sizes.tolist()):
            if size and size + n > BLOCK_BYTES:
                waiting.append(batch.slice(first, i - first))
                yield flush()
                first = i
            size += n + 1
        waiting.append(batch.slice(first))
    if waiting:
        yield flush()


def _unpacked(content: pa.Scalar, kind) -> np.ndarray:
    return unplanes(zstandard.ZstdDecompressor().decompress(content.as_py()), kind)


class _Block:
    """A block's columns, as arrays."""

    def __init__(self, row: dict):
        self.number = row["block"].as_py()
        self.held, self.lengths = np.array(row["held"].as_py(), bool), np.asarray(row["lengths"].values)
        self.codes = _unpacked(row["codes"], np.int32)
        self.words = np.cumsum(_unpacked(row["words"], np.uint64), dtype=np.uint64)
        self.counts = _unpacked(row["counts"], np.int64)
        self.end = int(np.searchsorted(self.words, np.array([END]).view(np.uint64))[0])

    def before(self) -> np.ndarray:
        """The code before each token; before the first of a text stands the end."""
        out = np.empty_like(self.codes)
        out[1:] = self.codes[:-1]
        out[np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64)] = self.end
        return out

    def train(self) -> np.ndarray:
        return np.repeat(~self.held, self.lengths)

    def kinds(self, frequent: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number among the exchanged words (or their count) and class of each word."""
        at = np.minimum(np.searchsorted(frequent, self.words), max(len(frequent) - 1, 0))
        known = frequent[at] == self.words if len(frequent) else np.zeros(len(self.words), bool)
        return np.where(known, at, len(frequent)), np.where(known, classes[at] if len(frequent) else 0, OTHER)


def _cuts(words: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of hashes that hold some of the sorted ``words``, and where each begins; the
    last place ends the last one."""
    parts = (words >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
    cuts = np.flatnonzero(np.concatenate([[True], parts[1:] != parts[:-1], [True]])) if len(words) else np.zeros(1, np.int64)
    return parts[cuts[:-1]].astype(np.int64), cuts


def _each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[_Block]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield _Block({name: batch.column(name)[i] for name in batch.schema.names})


PACKED = "part bigint, block bigint, content binary"


def _rows(parts: list, blocks: list, contents: list) -> pa.RecordBatch:
    return pa.record_batch([pa.array(parts, pa.int64()), pa.array(blocks, pa.int64()), pa.array(contents, pa.binary())], names=["part", "block", "content"])


# --- word counts ------------------------------------------------------------------


def _counts(ranges: int):
    """Per block and range of hashes: words met in training, as steps, and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for block in _each_block(batches):
            seen = np.flatnonzero(block.counts)
            words, counts = block.words[seen], block.counts[seen]
            parts, cuts = _cuts(words, ranges)
            contents = [
                packer.compress(planes(np.diff(words[a:b], prepend=np.uint64(0))) + planes(counts[a:b])) for a, b in zip(cuts[:-1], cuts[1:])
            ]
            yield _rows(parts.tolist(), [block.number] * len(contents), contents)

    return run


def _summed(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words, their sums, and the number of each entry's word."""
    kinds, place = np.unique(words, return_inverse=True)
    sums = np.zeros(len(kinds), np.int64)
    np.add.at(sums, place, counts)
    return kinds, sums, place


def _most(moved: int):
    """Of one range: the words with the greatest counts."""

    def run(rows: pa.Table) -> pa.Table:
        words, counts = [], []
        for content in rows["content"]:
            raw = zstandard.ZstdDecompressor().decompress(content.as_py())
            words.append(np.cumsum(unplanes(raw[: len(raw) // 2], np.uint64), dtype=np.uint64))
            counts.append(unplanes(raw[len(raw) // 2 :], np.int64))
        kinds, sums, _ = _summed(np.concatenate(words), np.concatenate(counts))
        top = np.lexsort((kinds.view(np.int64), -sums))[:moved]  # signed, as ``_top`` breaks ties
        return pa.table([pa.array(kinds[top].view(np.int64)), pa.array(sums[top])], names=["word", "n"])

    return run


def _top(counted: DataFrame, moved: int) -> list:
    """The words of the greatest counts, ties to the least hash. A histogram of at most a
    thousand steps first tells below which count none of them lies, so that what ranges
    send to the driver does not grow with their number."""
    step = F.floor(F.log2("n") * 16).cast("int")
    below, so_far = 0, 0
    for row in sorted(counted.groupBy(step.alias("step")).count().collect(), reverse=True):
        below, so_far = row["step"], so_far + row["count"]
        if so_far >= moved:
            break
    return counted.where(step >= below).orderBy(F.desc("n"), "word").limit(moved).collect()


# --- exchange ---------------------------------------------------------------------


def _neighbours(block: _Block, word: np.ndarray, kind: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Class counts left and right of words 0 to ``words`` - 1, how often each follows itself,
    and the class bigrams of all tokens, over training documents."""
    train = block.train()
    here, there = block.codes[train], block.before()[train]
    w, v, c, d = word[here], word[there], kind[here], kind[there]
    wide, inside, outside = WIDE, w < words, v < words
    left = np.bincount(w[inside] * wide + d[inside], minlength=words * wide).reshape(words, wide)
    right = np.bincount(v[outside] * wide + c[outside], minlength=words * wide).reshape(words, wide)
    twice = np.bincount(w[inside & (here == there)], minlength=words)
    bigrams = np.bincount(d * wide + c, minlength=wide * wide).reshape(wide, wide)
    return np.concatenate([left, right, twice[:, None]], axis=1), bigrams


CHUNK = 512  # exchanged words per row of counts


def _sweep(frequent: np.ndarray, classes: np.ndarray):
    """Per task, the counts of a sweep in rows of ``CHUNK`` words; bigrams are row -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        near = np.zeros((len(frequent), 2 * WIDE + 1), np.int64)
        bigrams = np.zeros((WIDE, WIDE), np.int64)
        for block in _each_block(batches):
            some, pairs = _neighbours(block, *block.kinds(frequent, classes), len(frequent))
            near += some
            bigrams += pairs
        salt = TaskContext.get().partitionId() % SALTS
        chunks = [near[i : i + CHUNK] for i in range(0, len(near), CHUNK)] if near.any() else []
        contents = [packer.compress(planes(c.ravel())) for c in [bigrams, *chunks]]
        yield _rows(list(range(-1, len(chunks))), [salt] * len(contents), contents)

    return run


def _add_rows(rows: pa.Table) -> pa.Table:
    total = 0
    for content in rows["content"]:
        total = total + _unpacked(content, np.int64)
    packed = zstandard.ZstdCompressor(level=1).compress(planes(total))
    return pa.table([rows["part"].slice(0, 1), rows["block"].slice(0, 1), pa.array([packed], pa.binary())], names=["part", "block", "content"])


def _g(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(bigrams: np.ndarray) -> float:
    """Class-bigram log likelihood, but for what no exchange changes."""
    n = bigrams.astype(float)
    return float(_g(n).sum() - _g(n.sum(0)).sum() - _g(n.sum(1)).sum())


def gains(bigrams: np.ndarray, near: np.ndarray, current: np.ndarray) -> np.ndarray:
    """What moving each word alone, from its class to each of ``CLASSES``, adds to the likelihood.

    ``near`` holds per word the class counts left and right of it and how often it follows
    itself; ``bigrams`` and the counts are those before any move.
    """
    out = np.zeros((len(near), CLASSES))
    n = bigrams.astype(float)
    rows, columns, every = n.sum(1), n.sum(0), np.arange(WIDE)
    for first in range(0, len(near), 256):
        some, a = near[first : first + 256].astype(float), current[first : first + 256]
        at, twice = np.arange(len(some)), some[:, -1]
        left, right = some[:, :WIDE].copy(), some[:, WIDE : 2 * WIDE].copy()
        as_next, as_first = left.sum(1), right.sum(1)
        left[at, a] -= twice  # the word beside itself moves with it
        right[at, a] -= twice
        # All counts without the word.
        base = np.repeat(n[None], len(some), axis=0)
        base[at, :, a] -= left
        base[at, a, :] -= right
        base[at, a, a] -= twice
        row, column = np.repeat(rows[None], len(some), axis=0), np.repeat(columns[None], len(some), axis=0)
        row[at, a] -= as_first
        column[at, a] -= as_next
        into = _g(base + left[:, :, None]) - _g(base)  # cells (c, b)
        from_ = _g(base + right[:, None, :]) - _g(base)  # cells (b, c)
        diagonal = base[:, every, every]
        both = _g(diagonal + left + right + twice[:, None]) - _g(diagonal)
        total = into.sum(1) - into[:, every, every] + from_.sum(2) - from_[:, every, every] + both
        total -= _g(row + as_first[:, None]) - _g(row) + _g(column + as_next[:, None]) - _g(column)
        out[first : first + 256] = (total - total[at, a][:, None])[:, :CLASSES]
    return out


def fit_weights(bigrams: np.ndarray) -> np.ndarray:
    """Times a word's class counts left and right of it, the gain of putting it into each class,
    to the first order: exact enough for words that are rare beside a class."""
    n = bigrams + 1.0
    left = np.log(n[:, :CLASSES]) - np.log(n.sum(0)[:CLASSES])
    right = np.log(n[:CLASSES].T) - np.log(n.sum(1)[:CLASSES])
    return np.concatenate([left, right])


def exchange(blocks: DataFrame, frequent: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Classes of the exchanged words, the class bigrams, and the likelihood after each sweep
    that was kept, which never falls."""

    def measure(classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = blocks.mapInArrow(_sweep(frequent, classes), PACKED)
        added = rows.groupBy("part", "block").applyInArrow(_add_rows, PACKED).groupBy("part").applyInArrow(_add_rows, PACKED)
        found = {r["part"]: unplanes(zstandard.ZstdDecompressor().decompress(r["content"]), np.int64) for r in added.collect()}
        bigrams = found.pop(-1, np.zeros(WIDE * WIDE, np.int64)).reshape(WIDE, WIDE)
        chunks = [found[k].reshape(-1, 2 * WIDE + 1) for k in sorted(found)]
        return bigrams, np.concatenate(chunks) if chunks else np.zeros((len(frequent), 2 * WIDE + 1), np.int64)

    rank = np.empty(len(frequent), np.int64)
    rank[np.lexsort((frequent, -counts))] = np.arange(len(frequent))
    classes = np.minimum(rank, CLASSES - 1)
    bigrams, near = measure(classes)
    history, share = [likelihood(bigrams)], SHARE
    wanted = gains(bigrams, near, classes)
    for sweep in range(SWEEPS):
        best = wanted.argmax(1)
        move = wanted[np.arange(len(best)), best] > 1e-9
        # Another share of the words each time, the same in every run.
        lot = (frequent * np.uint64(0x9E3779B97F4A7C15) + np.uint64(sweep * 0xBF58476D1CE4E5B9 % 2**64)) >> np.uint64(40)
        move &= lot < np.uint64(int(share * (1 << 24)))
        if not move.any():
            break
        proposed = np.where(move, best, classes)
        new_bigrams, new_near = measure(proposed)
        reached = likelihood(new_bigrams)
        if reached < history[-1]:
            share /= 2
            if share < LEAST_SHARE:
                break
            continue
        classes, bigrams, near = proposed, new_bigrams, new_near
        gained = reached - history[-1]
        history.append(reached)
        if gained < SETTLED * abs(reached):
            share /= 2  # fewer moves at once hinder each other less
        if share < LEAST_SHARE:
            break
        wanted = gains(bigrams, near, classes)
    return classes, bigrams, history


# --- classes of all words ---------------------------------------------------------


def _word_rows(frequent: np.ndarray, classes: np.ndarray, ranges: int):
    """Per block and range of hashes: all words, as those of held-out documents may have been
    met in training elsewhere, their training counts, and the classes beside them in
    training: cells of word, side and class, with how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, wide = zstandard.ZstdCompressor(level=1), 2 * WIDE
        for block in _each_block(batches):
            parts, cuts = _cuts(block.words, ranges)
            _, kind = block.kinds(frequent, classes)
            train = block.train()
            here, there = block.codes[train].astype(np.int64), block.before()[train].astype(np.int64)
            cells = np.sort(np.concatenate([here * wide + kind[there], there * wide + WIDE + kind[here]]))
            new = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]])) if len(cells) else np.empty(0, np.int64)
            times, cells = np.diff(np.append(new, len(cells))), cells[new]
            number = cells // wide
            edges = np.searchsorted(number, cuts)
            contents = []
            for a, b, p, q in zip(cuts[:-1], cuts[1:], edges[:-1], edges[1:]):
                words, counts = block.words[a:b], block.counts[a:b]
                sizes = np.array([b - a, q - p])
                owner, column = number[p:q] - a, cells[p:q] % wide
                columns = [planes(np.diff(words, prepend=np.uint64(0))), planes(counts), planes(np.diff(owner, prepend=0)), planes(column), planes(times[p:q])]
                contents.append(packer.compress(sizes.tobytes() + b"".join(columns)))
            yield _rows(parts.tolist(), [block.number] * len(contents), contents)

    return run


def _open(content: bytes) -> list[np.ndarray]:
    """Words, counts, and the cells' words, columns and times."""
    words, cells = np.frombuffer(content[:16], np.int64).tolist()
    out, at = [], 16
    for size, kind in ((words, np.uint64), (words, np.int64), (cells, np.int64), (cells, np.int64), (cells, np.int64)):
        out.append(unplanes(content[at : at + 8 * size], kind))
        at += 8 * size
    return [np.cumsum(out[0], dtype=np.uint64), out[1], np.cumsum(out[2]), out[3], out[4]]


def _classed(frequent: np.ndarray, classes: np.ndarray, bigrams: np.ndarray):
    """Of one range: per block its words' counts in all of training and their classes, which
    is ``UNKNOWN`` for those that training never met. The row of block -1 holds what all words of the range sum up to: tokens, words, words met once."""
    weights = fit_weights(bigrams)

    def run(rows: pa.Table) -> pa.Table:
        opener, packer, wide = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1), 2 * WIDE
        opened = [_open(opener.decompress(c.as_py())) for c in rows["content"]]
        sizes = [len(o[0]) for o in opened]
        starts = np.cumsum([0, *sizes[:-1]])
        kinds, sums, place = _summed(np.concatenate([o[0] for o in opened]), np.concatenate([o[1] for o in opened]))
        cell = np.concatenate([place[o[2] + s] * wide + o[3] for o, s in zip(opened, starts)])
        cells, at = np.unique(cell, return_inverse=True)
        times = np.zeros(len(cells), np.int64)
        np.add.at(times, at, np.concatenate([o[4] for o in opened]))
        del opened, cell, at
        owner, chosen = cells // wide, np.zeros(len(kinds), np.int8)
        for first in range(0, len(kinds), 4096):
            p, q = np.searchsorted(owner, [first, first + 4096])
            near = np.zeros((min(4096, len(kinds) - first), wide))
            near[owner[p:q] - first, cells[p:q] % wide] = times[p:q]
            chosen[first : first + 4096] = (near @ weights).argmax(1)
        if len(frequent):
            where = np.minimum(np.searchsorted(frequent, kinds), len(frequent) - 1)
            chosen = np.where(frequent[where] == kinds, classes[where], chosen).astype(np.int8)
        chosen[sums == 0] = UNKNOWN
        blocks, contents = rows["block"].to_pylist(), []
        for size, start in zip(sizes, starts):
            mine = place[start : start + size]
            contents.append(packer.compress(planes(sums[mine]) + chosen[mine].tobytes()))
        totals = np.array([sums.sum(), (sums > 0).sum(), (sums == 1).sum()], np.int64)
        part = rows["part"][0].as_py()
        return pa.Table.from_batches([_rows([part] * (len(blocks) + 1), [*blocks, -1], [*contents, totals.tobytes()])])

    return run


# --- scores -----------------------------------------------------------------------


SCORED = (
    "block bigint, doc_id bigint, held boolean, n_tokens bigint, n_known bigint, base double, emitted double,"
    " moves array<bigint>, trained array<bigint>"
)


def _moves(total: float, kinds: float):
    """Per document its base score, emissions and transitions (``from * WIDE + to << 40 | n``);
    on the first row of a block also the transitions of its training documents."""

    def packed(keys: np.ndarray, n: np.ndarray) -> np.ndarray:
        return keys.astype(np.int64) << 40 | n.astype(np.int64)

    def run(key: tuple, blocks: pa.Table, replies: pa.Table) -> pa.Table:
        block, opener = _Block({name: blocks[name][0] for name in blocks.schema.names}), zstandard.ZstdDecompressor()
        lengths, codes = block.lengths, block.codes
        # Replies come by range, in the order of the block's words.
        order = np.argsort(np.asarray(replies["part"].combine_chunks()))
        contents = [opener.decompress(replies["content"][i].as_py()) for i in order.tolist()]
        count = np.concatenate([unplanes(c[: len(c) // 9 * 8], np.int64) for c in contents])
        kind = np.concatenate([np.frombuffer(c[len(c) // 9 * 8 :], np.int8) for c in contents]).astype(np.int64)
        previous = block.before()
        here, there, met = kind[codes], kind[previous], count[codes]
        docs = np.repeat(np.arange(len(lengths)), lengths)
        base = np.log10((count + 1) / (total + kinds + 1))[codes]
        emit = np.log10(np.maximum(count, 1))[codes]
        first = np.cumsum(lengths) - lengths
        keys, n = np.unique(docs * (WIDE * WIDE) + there * WIDE + here, return_counts=True)
        cuts = np.searchsorted(keys, np.arange(len(lengths) + 1) * (WIDE * WIDE)).astype(np.int32)
        train = block.train()
        # Words seen once stand for unknown ones, on either side.
        once_here, once_there = train & (met == 1), train & (count[previous] == 1)
        pairs = np.concatenate(
            [(there * WIDE + here)[train], (there * WIDE + UNKNOWN)[once_here], (UNKNOWN * WIDE + here)[once_there]]
        )
        learned, times = np.unique(pairs, return_counts=True)
        trained: list = [packed(learned, times), *[None] * (len(lengths) - 1)]
        return pa.table(
            [
                pa.array([block.number] * len(lengths), pa.int64()),
                blocks["doc_ids"].combine_chunks().flatten(),
                pa.array(block.held),
                pa.array(lengths),
                pa.array(np.add.reduceat((met > 0).astype(np.int64), first)),
                pa.array(np.add.reduceat(base, first)),
                pa.array(np.add.reduceat(emit, first)),
                pa.ListArray.from_arrays(pa.array(cuts), pa.array(packed(keys % (WIDE * WIDE), n))),
                pa.array(trained, pa.list_(pa.int64())),
            ],
            names=["block", "doc_id", "held", "n_tokens", "n_known", "base", "emitted", "moves", "trained"],
        )

    return run


def transition_logs(trained: np.ndarray, once: float, total: float) -> np.ndarray:
    """log10 of P(class | class before), minus log10 of the tokens in the class for known
    classes, so that adding log10 of a word's count gives its probability."""
    known = trained[:, :UNKNOWN]
    per_class = trained[:UNKNOWN, :UNKNOWN].sum(0)
    share = (per_class + 1e-3) / (per_class + 1e-3).sum()
    new = (once + 1) / (total + 1)  # chance of an unknown word, whatever stands before
    from_count = np.append(trained[:UNKNOWN, :UNKNOWN].sum(1), trained[UNKNOWN, :UNKNOWN].sum())
    unknown = (np.append(trained[:UNKNOWN, UNKNOWN], 0.0) + new) / (from_count + 1)
    unknown[UNKNOWN] = new
    unknown = np.minimum(unknown, 1 - 1e-6) if total else np.ones(WIDE)
    weight = float(CLASSES)
    inside = (known + weight * share) / (from_count[:, None] + weight)
    with np.errstate(divide="ignore"):
        left = np.log10((1 - unknown)[:, None] * inside) - np.log10(np.maximum(per_class, 1))
        return np.concatenate([left, np.log10(unknown)[:, None]], axis=1)


def _score(logs: np.ndarray):
    flat = logs.ravel()

    def run(moves: pa.Array, emitted: pa.Array) -> pa.Array:
        values = np.asarray(moves.flatten())
        parts = flat[values >> 40] * (values & ((1 << 40) - 1))
        ends = np.concatenate([[0], np.cumsum(parts)])
        cuts = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(moves)))])
        return pa.array(ends[cuts[1:]] - ends[cuts[:-1]] + np.asarray(emitted))

    return run


def _learned(docs: DataFrame, id_column: str, text: str) -> tuple[DataFrame, int, float, np.ndarray, list[float]]:
    """Transitions per document, totals of training, its matrix of transitions, and the
    likelihood after each sweep."""
    spark = docs.sparkSession
    prepare_python(spark)
    narrow = docs.select(
        quoted(id_column).cast("bigint").alias("doc_id"),
        held_out(quoted(id_column)).alias("held"),
        quoted(text).cast("string").alias("text"),
    )
    size = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, -(-size // RANGE_BYTES))
    blocks = materialize(narrow.mapInArrow(_blocks, BLOCK_SCHEMA), "brown-blocks")
    counted = blocks.mapInArrow(_counts(ranges), PACKED).groupBy("part").applyInArrow(_most(MOVED), "word bigint, n bigint")
    top = _top(materialize(counted, "brown-frequent"), MOVED)
    words = np.array([r["word"] for r in top], np.int64).view(np.uint64)
    order = np.argsort(words)
    frequent, counts = words[order], np.array([r["n"] for r in top], np.int64)[order]
    classes, bigrams, history = exchange(blocks, frequent, counts)
    rows = blocks.mapInArrow(_word_rows(frequent, classes, ranges), PACKED)
    replies = materialize(rows.groupBy("part").applyInArrow(_classed(frequent, classes, bigrams), PACKED), "brown-replies")
    sums = [np.frombuffer(r["content"], np.int64) for r in replies.filter("block = -1").select("content").collect()]  # one per range
    tokens, kinds, once = np.sum(sums, axis=0).tolist() if sums else (0, 0, 0)
    answers = replies.filter("block >= 0").groupBy("block")
    moved = blocks.groupBy("block").cogroup(answers).applyInArrow(_moves(float(tokens), float(kinds)), SCORED)
    scored = materialize(moved, "brown-moves")
    learned = scored.select(F.explode("trained").alias("t")).groupBy(F.shiftright("t", 40).alias("pair")).agg(
        F.sum(F.col("t").bitwiseAND((1 << 40) - 1)).alias("n")
    )
    matrix = np.zeros(WIDE * WIDE)
    for row in learned.collect():  # at most WIDE squared
        matrix[row["pair"]] = row["n"]
    return scored, tokens, float(once), matrix.reshape(WIDE, WIDE), history


def brown_scores(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity``."""
    scored, tokens, once, matrix, _ = _learned(docs, id_column, text)
    logs = transition_logs(matrix, once, float(tokens))
    return scored.select(
        "doc_id",
        F.col("held").alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(tokens).cast("bigint").alias("train_tokens"),
        F.col("base").alias("base_score"),
        F.arrow_udf(_score(logs), "double").asNondeterministic()("moves", "emitted").alias("score"),
    ).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
