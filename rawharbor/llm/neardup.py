"""Near-duplicate documents: fast similarity sketches, banding, exact verification.

A document is the set of its five-word shingles. Its sketch has ``BINS`` coordinates: in
each round every shingle is hashed to a bin and leaves its hash there if the bin is still
empty, the least hash winning; after ``BINS`` rounds, round ``BINS + i`` puts all shingles
into bin ``i``, so every coordinate is filled, for sets of any size. Most sets are done after
a few rounds, and coordinates agree with a chance equal to the similarity, with the
concentration of independent ones. ``BANDS`` bands of coordinates are looked up; two sets
at similarity 0.75 miss each other in all bands with a chance below one in 100,000.

Candidates are confirmed on the full sets. Sets that share a band are not all paired:
in each round a few hubs of a band are compared with its members of other components, then
components are joined; the last round compares every pair of different components that
is left in a band, so no link between them is left out. Hubs are those that meet the most
others, as the original of a family of copies does: copies that a hub links cost one
comparison each. Before the later rounds, texts leave that cannot link at all, as too few of
their shingles stand in any other open text. Of the others only those meet whose parity maps
allow a link: a map holds for each of ``MAP_BITS`` slots whether an odd number of shingles
falls there, so where two maps differ, the sets differ too, and two that differ too much
are not linked. This loses no link, and few pairs that do not link pass it.

Defined cases: a text without words, or null, has an empty set and links with nothing;
equal sets are one node, whatever their ids; a component's id is the least document id in
it (null if it has none); rows with equal id and text count as one document when only one
of a group shall stay; tied ids do not matter; very long texts are read whole; other columns,
whatever their names, are kept or not read; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rawharbor.llm.common import free_name, materialize, quoted
from rawharbor.llm.components import connected
from rawharbor.operators.joins import join_reduced
from rawharbor.session import prepare_python

WORDS = 5
BANDS, ROWS = 60, 6
BINS = BANDS * ROWS
PERCENT = 75
HUBS = (8, 64, None)  # per band in the rounds after the first; None: every pair that is left
MAP_BITS = 1 << 11  # above some 3,500 shingles such maps cannot tell sets apart, and all pairs pass
FILTER_BITS = 1 << 23
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the splitmix64 finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, one after the other, and where each begins."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    flat, cuts = lists.flatten(), np.asarray(lists.offsets)
    real = np.asarray(pc.greater(pc.binary_length(flat), 0)).astype(bool)
    bounds = np.concatenate([[0], np.cumsum(real)])[cuts - cuts[0]]
    coded = flat.filter(pa.array(real)).dictionary_encode()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64)
    words = hashes[np.asarray(coded.indices)] if len(hashes) else np.empty(0, np.uint64)
    counts = np.diff(bounds)
    windows = np.maximum(counts - size + 1, np.minimum(counts, 1))
    # Hash of the words at every position, for as many words as a window there has.
    owner = np.repeat(np.arange(len(counts)), windows)
    starts = np.concatenate([[0], np.cumsum(windows)])
    at = bounds[owner] + np.arange(len(owner)) - starts[owner]
    length = np.minimum(counts, size)[owner]
    value = mixed(length.astype(np.uint64) + ODD)
    for step in range(size):
        inside = step < length
        value[inside] = mixed(value[inside] * ODD + words[at[inside] + step])
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    first = np.ones(len(value), bool)
    first[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[first], np.searchsorted(owner[first], np.arange(len(counts) + 1))


def sketches(values: np.ndarray, bounds: np.ndarray, bins: int = BINS) -> np.ndarray:
    """One row of ``bins`` coordinates per set; rows of empty sets stay ``EMPTY``."""
    sets = len(bounds) - 1
    owner = np.repeat(np.arange(sets), np.diff(bounds))
    filled = np.full(sets * bins, EMPTY, np.uint64)
    for number in range(2 * bins):
        if not len(values):
            break
        hashed = mixed(values + np.uint64(int(ODD) * (2 * number + 1) % 2**64))
        if number < bins:
            bin_of = ((hashed >> np.uint64(40)) * np.uint64(bins)) >> np.uint64(24)
        else:
            bin_of = np.full(len(values), number - bins, np.uint64)
        # An earlier round is always less, so only empty bins are filled.
        left = (np.uint64(number) << np.uint64(50)) | (mixed(hashed + ODD) >> np.uint64(14))
        np.minimum.at(filled, owner * bins + bin_of.astype(np.int64), left)
        open_sets = (filled.reshape(sets, bins) == EMPTY).any(axis=1)
        if not open_sets.all():
            more = open_sets[owner]
            values, owner = values[more], owner[more]
    return filled.reshape(sets, bins)


def band_keys(sketch: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = sketch.reshape(len(sketch), bands, -1)
    keys = np.broadcast_to(mixed(np.arange(1, bands + 1, dtype=np.uint64) * ODD), rows.shape[:2]).copy()
    for i in range(rows.shape[2]):
        keys = mixed(keys * ODD + rows[:, :, i])
    return keys.view(np.int64)


NODE = "struct<n:bigint,key:binary,bands:array<bigint>>"


SLICE_BYTES = 1 << 20


def _slices(*texts: pa.Array) -> Iterator[pa.Array]:
    """Stretches of rows whose texts have about a megabyte: the arrays made of a text are
    many times its size."""
    sizes = sum(np.asarray(pc.fill_null(pc.binary_length(t), 0)).astype(np.int64) for t in texts)
    number = (np.cumsum(sizes) - sizes) // SLICE_BYTES
    cuts = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1], [True]])) if len(sizes) else []
    yield from (pa.array(np.arange(a, b)) for a, b in zip(cuts[:-1], cuts[1:]))


def _nodes(texts: pa.Array) -> pa.Array:
    parts = [_some_nodes(texts.take(rows)) for rows in _slices(texts)]
    pa.default_memory_pool().release_unused()
    return pa.concat_arrays(parts) if parts else _some_nodes(texts)


def _some_nodes(texts: pa.Array) -> pa.Array:
    values, bounds = shingle_sets(texts)
    counts = np.diff(bounds)
    keys = band_keys(sketches(values, bounds))
    sums = []
    for salt in (1, 2):
        running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(values * ODD + np.uint64(salt)), dtype=np.uint64)])
        sums.append(mixed(running[bounds[1:]] - running[bounds[:-1]] + counts.astype(np.uint64)))
    whole = np.stack(sums, axis=1).astype(">u8").tobytes()
    present = counts > 0
    key = pa.array([whole[16 * i : 16 * i + 16] if p else None for i, p in enumerate(present)], pa.binary())
    cuts = np.concatenate([[0], np.cumsum(np.where(present, keys.shape[1], 0))]).astype(np.int32)
    bands = pa.ListArray.from_arrays(pa.array(cuts), pa.array(keys[present].ravel(), pa.int64()))
    return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), key, bands], names=["n", "key", "bands"])


def _linked(left: pa.Array, right: pa.Array) -> pa.Array:
    parts = [_some_linked(left.take(rows), right.take(rows)) for rows in _slices(left, right)]
    pa.default_memory_pool().release_unused()
    return pa.concat_arrays(parts) if parts else pa.array([], pa.bool_())


def _some_linked(left: pa.Array, right: pa.Array) -> pa.Array:
    (a, at_a), (b, at_b) = shingle_sets(left), shingle_sets(right)
    answers = []
    for i in range(len(left)):
        x, y = a[at_a[i] : at_a[i + 1]], b[at_b[i] : at_b[i + 1]]
        both = len(np.intersect1d(x, y, assume_unique=True))
        answers.append(both > 0 and 100 * both >= PERCENT * (len(x) + len(y) - both))
    return pa.array(answers, pa.bool_())


def _shingles(texts: pa.Array) -> pa.Array:
    parts = []
    for rows in _slices(texts):
        values, bounds = shingle_sets(texts.take(rows))
        parts.append(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64))))
    pa.default_memory_pool().release_unused()
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int64()))


def _maps(texts: pa.Array) -> pa.Array:
    parts = [_some_maps(texts.take(rows)) for rows in _slices(texts)]
    pa.default_memory_pool().release_unused()
    return pa.concat_arrays(parts) if parts else _some_maps(texts)


def _some_maps(texts: pa.Array) -> pa.Array:
    values, bounds = shingle_sets(texts)
    slots = (values >> np.uint64(64 - (MAP_BITS.bit_length() - 1))).astype(np.int64)
    at = np.repeat(np.arange(len(texts)), np.diff(bounds)) * MAP_BITS + slots
    odd = (np.bincount(at, minlength=len(texts) * MAP_BITS) & 1).astype(np.uint8)
    words = np.packbits(odd, bitorder="little").view(np.int64)
    cuts = np.arange(len(texts) + 1, dtype=np.int32) * (MAP_BITS // 64)
    return pa.ListArray.from_arrays(pa.array(cuts), pa.array(words, pa.int64()))


def _text_key(text):
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``a, b, linked`` of candidate pairs; ``texts`` has one text per node."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    check = F.arrow_udf(_linked, "boolean").asNondeterministic()
    both = pairs.join(left, "a").join(right, "b")
    return both.select("a", "b", check("text_a", "text_b").alias("linked"))


def _near(one: str, other: str):
    """Sets whose sizes differ more cannot be similar enough."""
    return (F.least(one, other) * 100) >= (F.greatest(one, other) * PERCENT)


def _may_link():
    """Sets that differ in ``d`` shingles link if ``(100 + PERCENT) * d`` is at most
    ``(100 - PERCENT)`` times the sum of their sizes; their maps differ in ``d`` slots at most."""
    slots = F.zip_with("map", "hub_map", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    differ = F.aggregate(slots, F.lit(0), lambda total, x: total + x)
    return (differ * (100 + PERCENT)) <= ((F.col("n") + F.col("hub_n")) * (100 - PERCENT))


def _pairs(met: DataFrame) -> DataFrame:
    return met.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


def _first_candidates(members: DataFrame) -> DataFrame:
    """Pairs of every band's best-known member and its other members."""
    hub = F.max(F.struct("known", "node", "n"))
    hubs = members.groupBy("band").agg(hub.alias("h")).select("band", F.col("h.node").alias("hub"), F.col("h.n").alias("hub_n"))
    return _pairs(join_reduced(members, hubs, ["band"], "inner").filter((F.col("node") != F.col("hub")) & _near("n", "hub_n")))


def _unresolved(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of the bands that hold more than one component, with their labels."""
    labelled = members.drop("label").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    spread = labelled.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("top")).filter("low <> top")
    return materialize(join_reduced(labelled, spread.select("band"), ["band"], "inner"), "neardup-open")


def _linkable(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Members that may link with another one, with their maps: a link takes ``PERCENT`` of each set's shingles,
    so a set with more than the rest in no other open set links with none of them. A shingle
    is counted in every task before it is shuffled, however many sets hold it."""
    shingles = F.arrow_udf(_shingles, "array<bigint>").asNondeterministic()
    nodes = members.select("node", "n").distinct()
    held = texts.join(nodes, "node").select("node", "n", F.explode(shingles("text")).alias("shingle"))
    holders = held.groupBy("shingle").agg(F.count("*").alias("sets"), F.min("node").alias("node"), F.min("n").alias("n"))
    alone = holders.filter("sets = 1").groupBy("node", "n").agg(F.count("*").alias("alone"))
    hopeless = alone.filter((F.col("n") - F.col("alone")) * 100 < F.col("n") * PERCENT).select("node")
    left = materialize(members.join(hopeless, "node", "left_anti"), "neardup-linkable")
    maps = F.arrow_udf(_maps, "array<bigint>").asNondeterministic()
    mapped = texts.join(left.select("node").distinct(), "node").select("node", maps("text").alias("map"))
    return materialize(join_reduced(left, mapped, ["node"], "inner"), "neardup-mapped")


def _candidates(members: DataFrame, hubs_per_band: int | None) -> DataFrame:
    """Pairs of a band's best-known members, or of all, with its members of other components
    that their maps allow to link."""
    hubs = members
    if hubs_per_band is not None:
        place = F.row_number().over(Window.partitionBy("band").orderBy(F.desc("known"), F.desc("node")))
        hubs = members.withColumn("place", place).filter(F.col("place") <= hubs_per_band)
    hubs = hubs.select("band", F.col("node").alias("hub"), F.col("label").alias("hub_label"), F.col("n").alias("hub_n"), F.col("map").alias("hub_map"))
    met = members.join(hubs, "band").filter((F.col("label") != F.col("hub_label")) & _near("n", "hub_n") & _may_link())
    return _pairs(met if hubs_per_band is not None else met.filter("node < hub"))


def _asked_texts(narrow: DataFrame, wanted: DataFrame) -> DataFrame:
    """One text per wanted node. A bit map of fixed size, built from hashes of the wanted
    texts, keeps most others out of the shuffle; the join decides."""
    slot = F.pmod("text_key", F.lit(FILTER_BITS))
    maps = (
        wanted.select(F.bitmap_bucket_number(slot).alias("bucket"), F.bitmap_bit_position(slot).alias("bit"))
        .groupBy("bucket")
        .agg(F.bitmap_construct_agg("bit").alias("bits"))
        .collect()
    )
    # Buckets are numbered from 1 and hold 32,768 bits each.
    packed = np.zeros((FILTER_BITS // 32768 + 2, 4096), np.uint8)
    for row in maps:
        packed[row["bucket"]] = np.frombuffer(row["bits"], np.uint8)
    shared = narrow.sparkSession.sparkContext.broadcast(packed.tobytes())

    def asked(slots: pa.Array, buckets: pa.Array, bits: pa.Array) -> pa.Array:
        table, at = np.frombuffer(shared.value, np.uint8).reshape(-1, 4096), np.asarray(bits)
        return pa.array((table[np.asarray(buckets), at >> 3] >> (at & 7) & 1).astype(bool))

    keyed = narrow.withColumn("text_key", _text_key(F.col("text")))
    some = F.arrow_udf(asked, "boolean")(slot, F.bitmap_bucket_number(slot), F.bitmap_bit_position(slot))
    w, d = wanted.alias("w"), keyed.filter(some).alias("d")
    met = d.join(w, (F.col("d.text_key") == F.col("w.text_key")) & F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")))
    # Equal ids and texts may stand on several rows.
    return materialize(met.select("w.node", "d.text").groupBy("node").agg(F.first("text").alias("text")), "neardup-texts")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text_key, n_shingles, component_id, kept, chosen``, one row per row of
    ``docs``. ``kept`` is whether the id is the component's; ``chosen`` marks the rows of
    exactly one id and text per component. ``text_key`` is a hash of the text."""
    spark = docs.sparkSession
    prepare_python(spark)
    narrow = docs.select(quoted(id_column).alias("doc_id"), quoted(text).cast("string").alias("text"))
    sketch = F.arrow_udf(_nodes, NODE).asNondeterministic()
    rows = materialize(
        narrow.select("doc_id", _text_key(F.col("text")).alias("text_key"), sketch("text").alias("s")).select(
            "doc_id", "text_key", "s.*"
        ),
        "neardup-rows",
    )
    distinct = rows.filter("n > 0").groupBy("key").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("first"),
        F.first("n").alias("n"),
        F.first("bands").alias("bands"),
    )
    # Numbers are given once and written, so they stay; they are shorter than the keys.
    nodes = materialize(distinct.withColumn("node", F.monotonically_increasing_id()), "neardup-nodes")
    lookups = nodes.select(F.explode("bands").alias("band"), "node")
    shared = materialize(lookups.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1"), "neardup-shared")
    met = materialize(lookups.join(shared, "band"), "neardup-met")
    # The text that a family of copies was made from meets more of them than they meet
    # each other. As a hub it links nearly all at once.
    known = met.groupBy("node").agg(F.sum("size").alias("known")).join(nodes.select("node", "n", "first"), "node")
    known = materialize(known, "neardup-known")
    members = materialize(join_reduced(met.drop("size"), known.select("node", "known", "n"), ["node"], "inner"), "neardup-bands")
    texts = _asked_texts(narrow, known.select("node", "first.doc_id", "first.text_key"))
    done = materialize(_confirmed(_first_candidates(members), texts), "neardup-pairs")
    labels = materialize(connected(done.filter("linked").select("a", "b")), "neardup-labels")
    for number, hubs in enumerate(HUBS):
        members = _unresolved(members, labels)
        if number == 0:
            members = _linkable(members, texts)
        if members.isEmpty():
            break
        new = _candidates(members, hubs).join(done.select("a", "b"), ["a", "b"], "left_anti")
        answers = materialize(_confirmed(new, texts), "neardup-pairs")
        done = done.unionByName(answers)
        if not answers.filter("linked").isEmpty():
            labels = materialize(connected(done.filter("linked").select("a", "b")), "neardup-labels")
    named = nodes.select("key", "node", "first").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    heads = named.groupBy("label").agg(F.min("first").alias("head"))
    named = join_reduced(named.select("key", "label"), heads, ["label"], "inner").select("key", "head")
    joined = join_reduced(rows.drop("bands"), named, ["key"], "left")
    alone = F.col("n") == 0
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("head.doc_id"))
    chosen = alone | (F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("text_key") == F.col("head.text_key")))
    return joined.select(
        "doc_id",
        "text_key",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
        chosen.alias("chosen"),
    )


def without_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each group; its columns are kept."""
    found = materialize(near_duplicates(docs, id_column, text), "neardup-result")
    stay = found.filter("chosen").select("doc_id", "text_key").distinct()
    total, different = found.count(), found.select("doc_id", "text_key").distinct().count()
    hashed, stay_id, stay_key = (free_name(docs, n) for n in ("_text_key", "_stay_id", "_stay_key"))
    rows = docs.withColumn(hashed, _text_key(quoted(text).cast("string")))
    if different < total:
        rows = rows.dropDuplicates([id_column, hashed])
    stay = stay.toDF(stay_id, stay_key)
    same = quoted(id_column).eqNullSafe(quoted(stay_id)) & (quoted(hashed) == quoted(stay_key))
    joined = rows.join(stay, same, "left_semi")
    return joined.select(*[quoted(c) for c in docs.columns])
