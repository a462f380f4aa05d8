"""Texts cut into segments, most of which were met before and are looked up.

A blank before anything but white space always begins a match of the expressions by which
byte-level tokenizers split texts, so texts may be cut there and the parts' ids joined.
What was met is kept in Arrow arrays, a batch at a time: an entry takes its own bytes and
its ids', where Python objects take some two hundred bytes more.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LONGEST = 64  # bytes; longer strings rarely recur and are not kept
#: How white space beyond ASCII begins in UTF-8 (with some characters that are none: no cut is always right).
SPACES = np.array([0xC285, 0xC2A0, 0xE19A, 0xE1A0, 0xE280, 0xE281, 0xE380], np.uint16)


def parts_of(strings: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Buffer]:
    """Offsets and bytes of a string array without nulls, and the buffer that holds the bytes."""
    kind = np.int64 if pa.types.is_large_binary(strings.type) else np.int32
    _, offsets, data = strings.buffers()
    data = data if data is not None else pa.py_buffer(b"")
    offsets = np.frombuffer(offsets, kind)[strings.offset : strings.offset + len(strings) + 1] if len(strings) else np.zeros(1, kind)
    return offsets, np.frombuffer(data, np.uint8), data


def before_solid(data: np.ndarray, blanks: np.ndarray) -> np.ndarray:
    """Whether each blank, none of them the last byte, stands before anything but white space."""
    first = data[blanks + 1]
    second = data[np.minimum(blanks + 2, len(data) - 1)]
    return (first > 32) & ~np.isin(first.astype(np.uint16) << 8 | second, SPACES)


def cut(texts: pa.Array, whole: list[int] | tuple[int, ...] = ()) -> tuple[pa.StringArray, np.ndarray]:
    """The segments of all texts one after the other, and how many of them stand before each
    text and behind the last. Texts at the places ``whole`` stay in one; empty ones have none."""
    offsets, data, buffer = parts_of(pc.fill_null(texts.cast(pa.string()), ""))
    start, end = int(offsets[0]), int(offsets[-1])
    begins = np.zeros(end - start, bool)
    blanks = np.flatnonzero(data[start : max(start, end - 1)] == 32) + start
    begins[blanks[before_solid(data, blanks)] - start] = True
    some = offsets[1:] > offsets[:-1]
    begins[offsets[1:][some] - 1 - start] = False  # what follows stands in another text
    for i in whole:
        begins[offsets[i] - start : offsets[i + 1] - start] = False
    begins[offsets[:-1][some] - start] = True
    bounds = np.append(np.flatnonzero(begins) + start, end).astype(np.int32)
    segments = pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), buffer)
    return segments, np.searchsorted(bounds[:-1], offsets)


def ids_array(ids: np.ndarray, ends: np.ndarray) -> pa.LargeBinaryArray:
    """Runs of 32-bit ids, of which each ends at one of ``ends``, as binary values."""
    bounds = np.concatenate([[0], ends]).astype(np.int64) * 4
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(ids, "<u4"))])


class Known:
    """Answers to strings, from what was kept or else from ``make``, asked once per string and batch.

    Of more than ``most`` strings half stay: those asked for again since the last time, then the latest.
    """

    def __init__(self, most: int, make: Callable[[pa.StringArray], pa.LargeBinaryArray]):
        self.most, self.make = most, make
        self.strings = pa.array([], pa.string())
        self.answers = pa.array([], pa.large_binary())
        self.again = np.zeros(0, bool)

    def __call__(self, asked: pa.StringArray) -> pa.LargeBinaryArray:
        coded = asked.dictionary_encode()
        found = pc.index_in(coded.dictionary, value_set=self.strings)
        missing = found.is_null()
        places = found.fill_null(0).to_numpy().astype(np.int64)
        new = missing.to_numpy(zero_copy_only=False)
        self.again[places[~new]] = True
        answers = self.answers
        if new.any():
            fresh = coded.dictionary.filter(missing)
            made = self.make(fresh)
            places[new] = len(answers) + np.arange(len(fresh))
            answers = pa.concat_arrays([answers, made])
            self.keep(fresh, made)
        return answers.take(pa.array(places[coded.indices.to_numpy()]))

    def keep(self, strings: pa.StringArray, answers: pa.LargeBinaryArray) -> None:
        short = pc.less_equal(pc.binary_length(strings), LONGEST)
        self.strings = pa.concat_arrays([self.strings, strings.filter(short)])
        self.answers = pa.concat_arrays([self.answers, answers.filter(short)])
        self.again = np.append(self.again, np.zeros(len(self.strings) - len(self.again), bool))
        if len(self.strings) > self.most:
            half = self.most // 2
            again = np.flatnonzero(self.again)[-half:] if half else np.zeros(0, int)
            once = np.flatnonzero(~self.again)
            stay = pa.array(np.sort(np.concatenate([again, once[len(once) - min(len(once), half - len(again)) :]])))
            self.strings, self.answers = self.strings.take(stay), self.answers.take(stay)
            self.again = np.zeros(len(stay), bool)


def ids_of(texts: pa.Array, known: Known, whole: list[int] | tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts behind one another, and where each text begins and the last ends."""
    segments, counts = cut(texts, whole)
    offsets, data, _ = parts_of(known(segments))
    ids, bounds = data[offsets[0] : offsets[-1]].view("<u4"), (offsets[counts] - offsets[0]) // 4
    del segments
    # Arrow holds on to what a batch needed at its peak, several times the kept strings, unless told not to.
    pa.default_memory_pool().release_unused()
    return ids, bounds
