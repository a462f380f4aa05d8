"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A window of letters is *bound* to one vector:
the product of its letters' vectors, each permuted (rotated) by its distance from the
window's end. A text is the *bundle* (sum) of its windows' vectors, a language the bundle of
its training texts, and a text gets the language whose bundle has the greatest cosine.

Windows are three code points long, lie in one word with one blank on either side, and are
lower-cased; all that is not a letter (Unicode category L) ends a word.

Bundles of languages are sums of integers, so they do not depend on the order of rows or
tasks. A task returns one vector per language; the driver holds one vector per language,
of which there may be ``MOST_LANGUAGES``.

Defined cases: a null text, or one without a letter, is ``und`` with score 0, and so is
every text if nothing was learned; training texts with null language are not used; a null id
counts as the empty text where documents are held out; repeated rows count each time; ties go
to the least language; a negative cosine scores 0; very long texts are used whole; an empty
table gives an empty one; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rawharbor.llm.common import quoted
from rawharbor.session import prepare_python

DIMENSIONS = 1024
SEED = 13
MOST_LANGUAGES = 4096
UNKNOWN = "und"
BLANK = 0x20
GRAMS_KEPT = 32_768  # bound vectors a worker keeps; more are made again
ROWS_AT_ONCE = 2_048


def held_out(id_column: Column) -> Column:
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit(""))) % 4 == 2


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def windows(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct windows of a text as numbers of 63 bits, and how often each stands there."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter()[points]
    # One blank before the first word and after each: the first non-letter behind a letter.
    ends = np.concatenate([letter[:-1] & ~letter[1:], letter[-1:]])
    kept = letter.copy()
    kept[1:] |= ends[:-1]
    row = np.where(letter, points, BLANK)[kept].astype(np.int64)
    row = np.concatenate([[BLANK], row, [BLANK] if len(points) and letter[-1] else []]).astype(np.int64)
    if len(row) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    keys = (row[:-2] << 42 | row[1:-1] << 21 | row[2:])[row[1:-1] != BLANK]
    return np.unique(keys, return_counts=True)


@lru_cache(maxsize=8_192)
def letter_vector(point: int, dimensions: int) -> np.ndarray:
    raw = np.random.Philox(key=[SEED, point]).random_raw(-(-dimensions // 64))
    return np.unpackbits(raw.astype("<u8").view(np.uint8))[:dimensions].astype(np.int8) * 2 - 1


def bound(keys: np.ndarray, dimensions: int) -> np.ndarray:
    """The vectors of these windows, one per row."""
    out = np.ones((len(keys), dimensions), np.int8)
    for shift in range(3):
        points, place = np.unique(keys >> (21 * shift) & 0x1FFFFF, return_inverse=True)
        if len(points):
            out *= np.roll(np.stack([letter_vector(int(p), dimensions) for p in points]), shift, axis=1)[place]
    return out


class Bound:
    """Vectors of windows met before, in a worker: ``rows[place[i]]`` is the vector of ``keys[i]``."""

    def __init__(self, dimensions: int):
        self.dimensions = dimensions
        self.forget()

    def forget(self) -> None:
        self.keys, self.place = np.empty(0, np.int64), np.empty(0, np.int64)
        self.rows = np.empty((1_024, self.dimensions), np.int8)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Vectors of at most ``ROWS_AT_ONCE`` sorted distinct windows."""
        at = np.searchsorted(self.keys, keys)
        met = self.keys[np.minimum(at, len(self.keys) - 1)] == keys if len(self.keys) else np.zeros(len(keys), bool)
        if not met.all():
            if len(self.keys) + len(keys) > GRAMS_KEPT:
                self.forget()
                met[:] = False
            new, size = keys[~met], len(self.keys)
            while size + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
            self.rows[size : size + len(new)] = bound(new, self.dimensions)
            order = np.argsort(np.concatenate([self.keys, new]), kind="stable")
            self.keys = np.concatenate([self.keys, new])[order]
            self.place = np.concatenate([self.place, np.arange(size, size + len(new))])[order]
            at = np.searchsorted(self.keys, keys)
        return self.rows[self.place[at]]

    def bundle(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Sum of the vectors, each taken ``counts`` times: whole numbers, exact below 2**53."""
        out = np.zeros(self.dimensions)
        narrow = np.float32 if counts.sum() < 1 << 24 else np.float64
        for i in range(0, len(keys), ROWS_AT_ONCE):
            out += counts[i : i + ROWS_AT_ONCE].astype(narrow) @ self.of(keys[i : i + ROWS_AT_ONCE]).astype(narrow)
        return out


def _learn(dimensions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sums = Bound(dimensions), {}
        for batch in batches:
            found: dict[str, list] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found.setdefault(lang, []).append(windows(text.as_py()))
            for lang, parts in found.items():
                keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
                counts = np.bincount(place, np.concatenate([n for _, n in parts]), len(keys))
                sums[lang] = sums.get(lang, 0) + known.bundle(keys, counts).astype(np.int64)
        rows = [s for s in sums.values()]
        yield pa.record_batch(
            [pa.array(list(sums), pa.string()), pa.array(rows, pa.list_(pa.int64()))], names=["lang", "sums"]
        )

    return run


def learn_languages(docs: DataFrame, text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """The bundle of each language in ``docs``, in the order of languages."""
    prepare_python(docs.sparkSession)
    narrow = docs.select(quoted(lang).cast("string").alias("lang"), quoted(text).cast("string").alias("text"))
    parts = narrow.filter("lang IS NOT NULL AND text IS NOT NULL").mapInArrow(_learn(dimensions), "lang string, sums array<bigint>")
    cells = parts.select("lang", F.posexplode("sums").alias("place", "n")).groupBy("lang", "place").agg(F.sum("n").alias("n"))
    found = cells.limit(MOST_LANGUAGES * dimensions + 1).toArrow()
    if found.num_rows > MOST_LANGUAGES * dimensions:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages = sorted(set(found["lang"].to_pylist()))
    at = {name: i for i, name in enumerate(languages)}
    table = np.zeros((len(languages), dimensions))
    table[[at[name] for name in found["lang"].to_pylist()], found["place"].to_numpy()] = found["n"].to_numpy()
    return {name: row for name, row in zip(languages, table) if row.any()}


def _predict(languages: list[str], profiles: np.ndarray):
    """``profiles`` has one unit vector per language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Bound(profiles.shape[1])
        for batch in batches:
            names, scores = [], []
            for text in batch.column(2):
                keys, counts = windows(text.as_py())
                vector = known.bundle(keys, counts) if len(keys) and languages else np.zeros(1)
                length = np.sqrt(vector @ vector)
                if length == 0:
                    names.append(UNKNOWN), scores.append(0.0)
                    continue
                cosines = profiles @ (vector / length)
                best = int(cosines.argmax())
                names.append(languages[best]), scores.append(float(min(max(cosines[best], 0.0), 1.0)))
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return run


def language_ids(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS
) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document; learned from those not held out."""
    learned = learn_languages(docs.filter(~held_out(quoted(id_column))), text, lang, dimensions)
    profiles = np.stack(list(learned.values())) if learned else np.zeros((0, dimensions))
    profiles /= np.sqrt((profiles * profiles).sum(1, keepdims=True))
    narrow = docs.select(
        quoted(id_column).cast("bigint").alias("doc_id"), held_out(quoted(id_column)).alias("held_out"), quoted(text).cast("string").alias("text")
    )
    return narrow.mapInArrow(_predict(list(learned), profiles), "doc_id bigint, held_out boolean, lang_pred string, score double")
