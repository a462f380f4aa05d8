"""Byte-level BPE by a lazily determinised transducer.

*Encoding.* Applying merges to a piece gives the only sequence of tokens in which each
neighbouring pair is what merging the two together would give. So tokens can be found
from left to right: a configuration is a start position whose bytes so far are a proper
prefix of some token, with the token before it. The state of the transducer is the set of
such configurations. Behind each byte exactly one token can end that may follow the one
before its start; it is the last part of the state. As the bytes of the longest configuration
end with those of all others, its trie node stands for all their nodes, and how bytes move
them is found once for all tokens before. Read back from the end of a piece, each
token's length leads to the one before, which gives the piece's tokens. States and steps
are made when first needed and kept up to a limit, beyond which they are dropped and
made again.

*Decoding.* Token bytes are copied one after the other; text comes from an incremental
UTF-8 machine that holds back at most three bytes of an unfinished character.

Vocabulary files are read on the driver from a path given by the caller and broadcast:
their size is fixed. Defined cases: a null text is an empty one and has no tokens; ids
outside the vocabulary raise; equal rows give equal answers; other columns are kept.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rawharbor.llm.common import free_name, quoted
from rawharbor.llm.segments import Known, ids_array, ids_of, parts_of
from rawharbor.session import prepare_python

STATES = 180_000  # kept states, pair answers, moves, pieces and segments; they bound memory, not results
PAIRS = 100_000
GROWN = 10_000
MOVES = 60_000
SEGMENTS = 300_000
PIECES = 200_000
NEVER = 1 << 60
LETTERS_FIRST = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+|"  # how patterns begin that match runs of letters whole

State = tuple[int, ...]  # trie node of the longest configuration; token before each, longest first


def read_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in content.splitlines() if line)}


class Transducer:
    """Bytes to token ids. One per worker process and vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.lengths = {i: len(t) for t, i in ranks.items()}
        self.children: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                after = self.children[node].get(byte)
                if after is None:
                    after = self.children[node][byte] = len(self.children)
                    self.children.append({})
                    self.token.append(-1)
                node = after
            self.token[node] = rank
        self.pairs: dict[int, bool] = {}
        self.grown: dict[int, tuple] = {}
        self.moves: dict[int, tuple] = {}
        self.chains: dict[int, tuple[int, ...]] = {0: (0,)}
        self.forget()

    def forget(self) -> None:
        start: State = (0, -1)
        self.number: dict[State, int] = {start: 0}  # 256 times the place in ``states``
        self.states = [start]
        self.steps: dict[int, int] = {}  # a state's number plus a byte, to the next state's number

    def edges(self, token: int) -> tuple[list[tuple[int, bytes]], list[tuple[int, bytes]]]:
        """How the first and the last part of a token grow while its bytes are merged in
        order of rank: ``(rank, part)`` from the single byte to the whole token."""
        piece = self.bytes_of[token]
        parts = [piece[i : i + 1] for i in range(len(piece))]
        first, last = [(-1, parts[0])], [(-1, parts[-1])]
        rank = self.ranks.get
        while len(parts) > 1:
            ranked = [(r, i) for i in range(len(parts) - 1) if (r := rank(parts[i] + parts[i + 1])) is not None]
            if not ranked:
                break
            r, i = min(ranked)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            if i == 0:
                first.append((r, parts[0]))
            if i == len(parts) - 1:
                last.append((r, parts[-1]))
        return (first, last) if len(parts) == 1 else ([], [])

    def may_follow(self, before: int, token: int) -> bool:
        """Whether merging both together leaves the boundary between them; kept in ``pairs``.

        The parts at the boundary grow by rank. They are joined across it if their own
        joint rank comes before the next growth on either side (at a tie, the left side
        grows first, the right side after).
        """
        if before < 0:
            return True
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        if len(self.grown) >= GROWN:
            self.grown.clear()
        for t in (before, token):
            if t not in self.grown:
                self.grown[t] = self.edges(t)
        left, right = self.grown[before][1], self.grown[token][0]
        i = j = 0
        known = bool(left) and bool(right)
        while known:
            next_left = left[i + 1][0] if i + 1 < len(left) else NEVER
            next_right = right[j + 1][0] if j + 1 < len(right) else NEVER
            across = self.ranks.get(left[i][1] + right[j][1], NEVER)
            if across < next_left and across <= next_right and across < NEVER:
                known = False
            elif next_left == NEVER and next_right == NEVER:
                break
            elif next_left <= next_right:
                i += 1
            else:
                j += 1
        self.pairs[before << 32 | token] = known
        return known

    def moved(self, node: int, byte: int) -> tuple[int, tuple, tuple]:
        """What a byte does to the configurations whose longest is at ``node``, whatever tokens
        come before them: the longest one after it, the places and tokens that may end, and the
        places of those that go on. Kept in ``moves``."""
        found = self.moves.get(node << 8 | byte)
        if found is None:
            if len(self.moves) >= MOVES:
                self.moves.clear()
            ends, on, chain = [], [], []
            for place, one in enumerate(self.chains[node], 1):
                child = self.children[one].get(byte)
                if child is None:
                    continue
                if self.token[child] >= 0:
                    ends.append((place, self.token[child]))
                if self.children[child]:
                    on.append(place)
                    chain.append(child)
            chain.append(0)
            self.chains.setdefault(chain[0], tuple(chain))
            found = self.moves[node << 8 | byte] = (chain[0], tuple(ends), tuple(on))
        return found

    def ending(self, state: State, ends: tuple, byte: int) -> int:
        pairs = self.pairs
        for place, token in ends:
            before = state[place]
            follows = pairs.get(before << 32 | token)
            if follows or (follows is None and self.may_follow(before, token)):
                return token
        raise ValueError(f"no token ends at byte {byte}: the vocabulary lacks single bytes")

    def step(self, at: int) -> int:
        """Make the step from a state by a byte, given as the sum of both: the next state."""
        state = self.states[at >> 8]
        node, ends, on = self.moved(state[0], at & 255)
        key = (node, *[state[place] for place in on], self.ending(state, ends, at & 255))
        number = self.number.get(key)
        if number is None:
            number = self.number[key] = len(self.states) << 8
            self.states.append(key)
        self.steps[at] = number
        return number

    def last(self, at: int) -> int:
        """The token that ends behind the last byte of a piece. The state after it is not
        needed, and pieces met for the first time mostly differ from others there."""
        found = self.steps.get(at)
        if found is not None:
            return self.states[found >> 8][-1]
        state = self.states[at >> 8]
        return self.ending(state, self.moved(state[0], at & 255)[1], at & 255)

    def encode(self, piece: bytes) -> list[int]:
        if not piece:
            return []
        if len(self.states) > STATES:
            self.forget()
        known, state, passed = self.steps.get, 0, []
        for byte in piece[:-1]:
            at = state | byte
            state = known(at)
            if state is None:
                state = self.step(at)
            passed.append(state)
        states, lengths = self.states, self.lengths
        token = self.last(state | piece[-1])
        at, out = len(piece) - lengths[token], [token]
        while at:
            token = states[passed[at - 1] >> 8][-1]
            out.append(token)
            at -= lengths[token]
        out.reverse()
        return out


class Encoder:
    """Whole texts to ids: the pattern's matches one by one, each through the transducer."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.transducer = Transducer(ranks)
        self.pieces = regex.compile(pattern).findall
        # A run of plain letters, behind a blank or not, is one match of such a pattern.
        self.one = regex.compile(r" ?[A-Za-z]+" if pattern.startswith(LETTERS_FIRST) else r"(?!)").fullmatch
        self.known = Known(SEGMENTS, self.fresh)
        self.known_pieces = Known(PIECES, self.fresh_pieces)

    def fresh_pieces(self, pieces: pa.StringArray) -> pa.LargeBinaryArray:
        offsets, data, _ = parts_of(pieces)
        raw, bounds = data.tobytes(), offsets.tolist()
        encode, ids, ends = self.transducer.encode, array("i"), []
        for start, end in zip(bounds[:-1], bounds[1:]):
            ids.extend(encode(raw[start:end]))
            ends.append(len(ids))
        return ids_array(np.frombuffer(ids, "<u4"), np.array(ends, np.int64))

    def fresh(self, segments: pa.StringArray) -> pa.LargeBinaryArray:
        """Segments met for the first time mostly consist of pieces met before."""
        pieces, counts = [], [0]
        for segment in segments.to_pylist():
            if self.one(segment):
                pieces.append(segment)
            else:
                pieces += self.pieces(segment)
            counts.append(len(pieces))
        offsets, data, _ = parts_of(self.known_pieces(pa.array(pieces, pa.string())))
        ends = (offsets[counts] - offsets[0]) // 4
        return ids_array(data[offsets[0] : offsets[-1]].view("<u4"), ends[1:])

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts behind one another, and where each text begins and the last ends."""
        return ids_of(texts, self.known)

    def encode(self, text: str) -> list[bytes]:
        """Ids of one text as little-endian words."""
        return [self.encode_all(pa.array([text], pa.string()))[0].tobytes()]


class Utf8Stream:
    """Text from bytes that arrive in pieces; an unfinished character waits for the rest."""

    def __init__(self) -> None:
        self.held = b""

    def feed(self, data: bytes) -> str:
        data = self.held + data
        wanted = 0
        # Walk back over continuation bytes to the last lead byte.
        for back in range(1, min(4, len(data)) + 1):
            byte = data[-back]
            if byte & 0xC0 == 0x80:
                continue
            need = 2 if byte >> 5 == 6 else 3 if byte >> 4 == 14 else 4 if byte >> 3 == 30 else 1
            wanted = back if need > back else 0
            break
        self.held = data[len(data) - wanted :] if wanted else b""
        return data[: len(data) - wanted].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


class Decoder:
    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values()) + 1
        self.tokens: list[bytes | None] = [None] * size
        for token, i in ranks.items():
            self.tokens[i] = token
        self.lengths = np.array([-1 if t is None else len(t) for t in self.tokens], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(np.maximum(self.lengths, 0))[:-1]])
        self.blob = np.frombuffer(b"".join(t or b"" for t in self.tokens), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.lengths) or (self.lengths[ids] < 0).any()):
            raise ValueError("an id outside the vocabulary")
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.blob[np.repeat(self.starts[ids] - (ends - lengths), lengths) + np.arange(total)].tobytes()

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        machine = Utf8Stream()
        for i in ids:
            yield machine.feed(self.tokens[i] or b"")
        yield machine.finish()


_MADE: dict[tuple, object] = {}


def _made(kind: type, content: bytes, *more: str):
    """One object per worker process, kind and vocabulary."""
    key = (kind, hashlib.sha256(content).digest(), *more)
    if key not in _MADE:
        _MADE[key] = kind(read_ranks(content), *more)
        # The vocabulary stays, and what is kept holds no cycles: look through it seldom.
        gc.freeze()
        gc.set_threshold(100_000, 50, 50)
    return _MADE[key]


CHUNK = 1 << 16  # ids decoded at a time


def _shared(spark, ranks_path: str):
    prepare_python(spark)
    with open(ranks_path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def _encoded(content, pattern: str):
    def run(texts: pa.Array) -> pa.Array:
        encoder = _made(Encoder, content.value, pattern)
        ids, bounds = encoder.encode_all(texts)
        return pa.ListArray.from_arrays(pa.array(bounds).cast(pa.int32()), pa.array(ids.view("<i4")))

    return run


def _decoded(content, as_text: bool):
    def run(lists: pa.Array) -> pa.Array:
        decoder, found = _made(Decoder, content.value), []
        flat, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        for start, end in zip(offsets[:-1], offsets[1:]):
            chunks = (decoder.decode(flat[i : min(end, i + CHUNK)]) for i in range(start, end, CHUNK))
            if as_text:
                machine = Utf8Stream()
                found.append("".join([*map(machine.feed, chunks), machine.finish()]))
            else:
                found.append(b"".join(chunks))
        return pa.array(found, pa.string() if as_text else pa.binary())

    return run


def encode(docs: DataFrame, out: str, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` and ``array<int>`` of the ids of the whole text, named ``out``."""
    run = _encoded(_shared(docs.sparkSession, ranks_path), pattern)
    return docs.withColumn(out, F.arrow_udf(run, "array<int>").asNondeterministic()(quoted(text).cast("string")))


def decode(rows: DataFrame, ids: str, out: str, ranks_path: str, as_text: bool = False) -> DataFrame:
    """``rows`` and the bytes, or the text, that the array ``ids`` stands for."""
    run = _decoded(_shared(rows.sparkSession, ranks_path), as_text)
    udf = F.arrow_udf(run, "string" if as_text else "binary").asNondeterministic()
    return rows.withColumn(out, udf(F.coalesce(quoted(ids), F.array().cast("array<int>"))))


def encode_and_decode(docs: DataFrame, ids: str, out: str, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """What :func:`encode` and :func:`decode` (to bytes) one after the other give, in one Python
    worker per task instead of two, which would both come to hold an encoder."""
    content = _shared(docs.sparkSession, ranks_path)
    encoded, decoded = _encoded(content, pattern), _decoded(content, False)

    def run(texts: pa.Array) -> pa.Array:
        lists = encoded(texts)
        return pa.StructArray.from_arrays([lists, decoded(lists)], names=["ids", "bytes"])

    both = free_name(docs, "_coded")
    udf = F.arrow_udf(run, "struct<ids:array<int>,bytes:binary>").asNondeterministic()
    coded = docs.withColumn(both, udf(quoted(text).cast("string")))
    return coded.withColumns({ids: quoted(both)["ids"], out: quoted(both)["bytes"]}).drop(both)
