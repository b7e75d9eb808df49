"""Unigram pieces (operator 9): Viterbi over a double-array trie of pieces with log scores.

Encoding marks spaces with U+2581, puts one in front, and finds the pieces whose
log scores add up to most; a character that no piece covers is an unknown, and
with byte fallback becomes one piece for each of its UTF-8 bytes.  Among equal
sums the piece that starts first wins, as in the public implementation.  Decoding
joins pieces, turns markers back into spaces, bytes into text, and takes the first
space off.

A model of the unigram kind brings its log scores.  One of the merge kind only
ranks its pieces; then a piece of rank r scores as Zipf's law has it,
-ln(r + 1) - ln(H), H being the harmonic number of the piece count.  Nothing is
trained here.

A marker may only start a piece (checked when the model is read), and a character
that stands in no longer piece is a cut, so texts fall apart into short segments
that are encoded once each: those not seen yet go through the trie together, one
step of the trie for all of them at a time.

A marker character in the text itself is spelled in bytes, so decoding what was
encoded gives the text back exactly, whatever it holds.

Defined cases: a null text gives null pieces, an empty text no pieces; repeated
rows repeat; the result is whole however long the text is; an empty table gives an empty one;
columns kept may have any names (new ones are underscored until they clash with none).  A
model file that asks for a normalisation of its own is refused.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import bounded_batches, free_name, shared_value, slices

MARK, KEPT_SEGMENTS, SHORT, TOGETHER = "▁", 100_000, 64, 1 << 14
# Kinds of piece and of model in the public model format.
NORMAL, UNKNOWN, CONTROL, USER, BYTE, UNUSED = 1, 2, 3, 4, 6, 5
UNIGRAM_KIND = 1
_ENCODER: dict = {}
#: What an unknown character scores below the worst piece.
UNKNOWN_PENALTY = 10.0


def double_array(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Base, check and value arrays of a trie; the child of s under byte c is base[s] + c if check there is s.

    Value is the key's index or -1.  The root is state 0.  ``keys`` are sorted and
    distinct.
    """
    size = 1024
    base, check, value, used = [0] * size, [-1] * size, [-1] * size, [False] * size
    used[:257] = [True] * 257  # below them not every label could be placed
    free, top = 257, 257  # the first unused slot, and one past the last used one
    todo = [(0, 0, len(keys), 0)]
    while todo:
        state, lo, hi, depth = todo.pop()
        if lo < hi and len(keys[lo]) == depth:
            value[state] = lo
            lo += 1
        if lo == hi:
            continue
        labels, starts = [], []
        for i in range(lo, hi):
            c = keys[i][depth]
            if not labels or c != labels[-1]:
                labels.append(c)
                starts.append(i)
        while used[free]:
            free += 1
        # A single child fills the first hole; several look for room near the end only.
        at = max(1, (free if len(labels) == 1 else max(free, top - 256)) - labels[0])
        while True:
            if at + 512 >= len(used):
                base += [0] * size
                check += [-1] * size
                value += [-1] * size
                used += [False] * size
                size *= 2
            if not any(used[at + c] for c in labels):
                break
            at += 1
        base[state] = at
        for c, a, b in zip(labels, starts, [*starts[1:], hi], strict=True):
            used[at + c] = True
            check[at + c] = state
            todo.append((at + c, a, b, depth + 1))
        top = max(top, at + labels[-1] + 1)
    return np.array(base, dtype=np.int32), np.array(check, dtype=np.int32), np.array(value, dtype=np.int32)


@dataclass
class UnigramModel:
    """Pieces by id, their float32 scores and kinds, and the trie over those that can be matched."""

    pieces: list[str]
    scores: np.ndarray
    kinds: list[int]
    trie: tuple = field(init=False, repr=False)

    def __post_init__(self):
        self.scores = np.asarray(self.scores, dtype=np.float32)
        self.key = hashlib.sha256(repr((self.pieces, self.kinds)).encode() + self.scores.tobytes()).hexdigest()
        match = sorted((p.encode(), i) for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k in (NORMAL, USER) and p)
        self.trie = double_array([k for k, _ in match])
        self.match_ids = np.array([i for _, i in match], dtype=np.int32)
        match_ids = self.match_ids
        if any(MARK in p.lstrip(MARK) for p in (self.pieces[i] for i in match_ids)):
            raise ValueError("a piece holds a marker behind another character")
        self.unknown_score = np.float32(self.scores[match_ids].min() - np.float32(UNKNOWN_PENALTY)) if len(match_ids) else np.float32(-UNKNOWN_PENALTY)
        self.unknown_id = self.kinds.index(UNKNOWN)
        spelled = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        self.bytes = [spelled.get(f"<0x{b:02X}>") for b in range(256)]
        self.fallback = None not in self.bytes
        joined = {c for i in match_ids if len(self.pieces[i]) > 1 for c in self.pieces[i]} - {MARK}
        inner = "".join(f"\\U{ord(c):08x}" for c in sorted(joined)) or "\\0"
        # Markers and what follows them, or such characters alone, or one character that is a cut.
        self.segments = re.compile(f"{MARK}+[{inner}]*|[{inner}]+|[^{MARK}]", re.DOTALL)
        self.plain = [(b"" if k in (CONTROL,) else bytes([self.bytes.index(i)]) if k == BYTE else p.replace(MARK, " ").encode()) for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True))]

    # -- encoding -----------------------------------------------------------

    def _spell(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode("utf-8", "surrogatepass")] if self.fallback else [self.unknown_id]

    def _one(self, segment: str) -> list[int]:
        """One segment of any length, a state at a time."""
        base, check, value = self._lists()
        data = segment.encode()
        n = len(data)
        best, back = [None] * (n + 1), [None] * (n + 1)
        best[0] = np.float32(0)
        scores, unknown, add = self.scores, self.unknown_score, np.float32
        at = 0
        for char in segment:
            wide, single, here = len(char.encode()), False, best[at]
            state, i = 0, at
            while i < n:
                child = base[state] + data[i]
                if check[child] != state:
                    break
                state, i = child, i + 1
                if value[state] >= 0:
                    piece = self.match_ids[value[state]]
                    total = add(here + scores[piece])
                    if best[i] is None or total > best[i]:
                        best[i], back[i] = total, (at, int(piece))
                    single = single or i == at + wide
            if not single and (best[at + wide] is None or add(here + unknown) > best[at + wide]):
                best[at + wide], back[at + wide] = add(here + unknown), (at, -1)
            at += wide
        out: list[int] = []
        while n:
            at, piece = back[n]
            out += [piece] if piece >= 0 else self._spell(data[at:n].decode())[::-1]
            n = at
        return out[::-1]

    def _lists(self):
        if not hasattr(self, "_as_lists"):
            self._as_lists = tuple(a.tolist() for a in self.trie)
        return self._as_lists

    def encode_segments(self, segments: list[str]) -> list[bytes]:
        """The pieces of each segment as 32-bit numbers; short segments go through the trie side by side."""
        out: list = [None] * len(segments)
        data = [s.encode() for s in segments]
        short = [i for i, d in enumerate(data) if len(d) <= SHORT and b"\0" not in d]
        for at in range(0, len(short), TOGETHER):
            some = short[at : at + TOGETHER]
            for i, ids in zip(some, self._together([data[i] for i in some]), strict=True):
                out[i] = ids
        for i, ids in enumerate(out):
            if ids is None:
                out[i] = np.array(self._one(segments[i]), dtype=np.int32).tobytes()
        return out

    def _together(self, data: list[bytes]) -> list[bytes]:
        """All segments laid end to end, each with a zero byte behind it: matches first, then the best sums."""
        base, check, value = self.trie
        lengths = np.array([len(d) for d in data])
        text = np.frombuffer(b"\0".join(data) + b"\0", dtype=np.uint8).astype(np.int32)
        first = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
        place = (np.arange(len(text)) - np.repeat(first, lengths + 1)).astype(np.int16)
        lead = np.flatnonzero(((text & 0xC0) != 0x80) & (text != 0))
        size = np.zeros(len(text), dtype=np.int32)
        size[lead] = 1 + (text[lead] >= 0xC0) + (text[lead] >= 0xE0) + (text[lead] >= 0xF0)
        # Every match of a piece, one step of the trie for all starts at a time.
        live, state, depth = lead, np.zeros(len(lead), dtype=np.int32), 0
        starts, ends, pieces = [], [], []
        single = np.zeros(len(text), dtype=bool)
        while len(live):
            child = base[state] + text[live + depth]
            ok = check[child] == state
            live, state, depth = live[ok], child[ok], depth + 1
            index = value[state]
            hit = index >= 0
            if hit.any():
                at = live[hit]
                starts.append(at)
                ends.append(at + depth)
                pieces.append(self.match_ids[index[hit]])
                single[at[size[at] == depth]] = True
        lone = lead[~single[lead]]
        starts.append(lone)
        ends.append(lone + size[lone])
        pieces.append(np.full(len(lone), -1, dtype=np.int32))
        start, end, piece = np.concatenate(starts), np.concatenate(ends), np.concatenate(pieces)
        score = np.where(piece >= 0, self.scores[piece], self.unknown_score).astype(np.float32)
        order = np.argsort(place[start], kind="stable")
        start, end, piece, score = start[order], end[order], piece[order], score[order]
        cuts = np.searchsorted(place[start], np.arange(int(lengths.max()) + 1))
        best = np.full(len(text), -np.inf, dtype=np.float32)
        best[first] = 0
        taken = np.full(len(text), -1, dtype=np.int64)
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):  # from every first place, then every second place, ...
            e, total = end[lo:hi], best[start[lo:hi]] + score[lo:hi]
            better = np.flatnonzero(total > best[e])
            best[e[better]] = total[better]
            taken[e[better]] = lo + better
        # Back from every end at once; step t of a segment is its t-th piece from the end.
        rows, node, trail = np.arange(len(data)), first + lengths, []
        while True:
            open_ = node > first[rows]
            rows, node = rows[open_], node[open_]
            if not len(rows):
                break
            edge = taken[node]
            trail.append((rows, piece[edge], edge))
            node = start[edge]
        row = np.concatenate([t[0] for t in trail])
        step = np.repeat(np.arange(len(trail)), [len(t[0]) for t in trail])
        order = np.lexsort((-step, row))
        flat, edges = np.concatenate([t[1] for t in trail])[order].astype(np.int32), np.concatenate([t[2] for t in trail])[order]
        bounds = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(data)))]).tolist()
        raw = flat.tobytes()
        out = [raw[4 * a : 4 * b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        for r in np.unique(row[order][flat < 0]).tolist():  # unknown characters are spelled
            ids: list[int] = []
            for n in range(bounds[r], bounds[r + 1]):
                one = edges[n]
                ids += [int(flat[n])] if flat[n] >= 0 else self._spell(text[start[one] : end[one]].astype(np.uint8).tobytes().decode())
            out[r] = np.array(ids, dtype=np.int32).tobytes()
        return out

    def encoder(self, kept: int = KEPT_SEGMENTS):
        """A function from texts to arrays of pieces that remembers between ``kept`` and twice as many segments."""
        known: dict[str, bytes] = {}
        older: dict[str, bytes] = {}
        marker = np.array(self._spell(MARK), dtype=np.int32).tobytes()
        cut = self.segments.findall

        def encode(texts: list[str]) -> list[np.ndarray]:
            nonlocal known, older
            # A text is cut at markers of its own; only its first part gets one put in front.
            parts = [[cut((MARK if k == 0 else "") + p.replace(" ", MARK)) for k, p in enumerate(t.split(MARK))] if t else [] for t in texts]
            every: set[str] = set().union(*(segments for text in parts for segments in text))
            if len(known) + len(every.difference(known)) > kept:  # those in use move over, the rest go with the next change
                known, older = {}, known
            need = every.difference(known)
            seen = {x for x in need if x in older}
            known.update((x, older[x]) for x in seen)
            new = list(need.difference(seen))
            known.update(zip(new, self.encode_segments(new), strict=True))
            get = known.__getitem__
            return [np.frombuffer(marker.join([b"".join(map(get, segments)) for segments in text]), dtype=np.int32) for text in parts]

        return encode

    def shared_encoder(self):
        """The encoder of this process, which keeps its segments from task to task; one model's at a time."""
        if _ENCODER.get("key") != self.key:
            _ENCODER.update(key=self.key, encode=self.encoder())
        return _ENCODER["encode"]

    def encode(self, text: str) -> list[int]:
        return self.shared_encoder()([text])[0].tolist()

    def decode(self, ids) -> str:
        """The text of pieces; bytes that aren't UTF-8 become U+FFFD."""
        text = b"".join(map(self.plain.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def read_model(path: str) -> UnigramModel:
    """A model file of the public format, read on the driver.

    Text is encoded as it is but for a space in front and markers for spaces; a model that
    asks for another normalisation is refused, as its pieces would not be those it means.
    """
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    rules = proto.normalizer_spec
    if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix or not rules.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError(f"{path}: only models with a space in front, all spaces kept and no other normalisation are read")
    pieces, kinds = [p.piece for p in proto.pieces], [p.type for p in proto.pieces]
    scores = np.array([p.score for p in proto.pieces], dtype=np.float32)
    if proto.trainer_spec.model_type != UNIGRAM_KIND:
        scores = zipf_scores(kinds)
    return UnigramModel(pieces, scores, kinds)


def zipf_scores(kinds: list[int]) -> np.ndarray:
    """Log scores by rank for pieces that stand in the order of their merges."""
    rank = np.cumsum([k in (NORMAL, USER) for k in kinds]).astype(np.float64)
    total = np.log(np.sum(1 / np.arange(1, max(2, rank[-1] + 1))))
    return np.where([k in (NORMAL, USER) for k in kinds], -np.log(np.maximum(rank, 1)) - total, 0).astype(np.float32)


def encode_texts(df: DataFrame, model: UnigramModel, text: str = "text", keep: tuple = (), names: tuple = ("pieces", "n_pieces")) -> DataFrame:
    """``keep`` columns with the array of piece ids and their number.  The model, of fixed size, is broadcast."""
    bounded_batches(df.sparkSession)
    shared = shared_value(df.sparkSession, model)
    inner = free_name(keep, "encoded_text")
    source = df.select(*keep, F.col(text).cast("string").alias(inner))
    out = [free_name(keep, n) for n in names]
    schema = T.StructType([*source.schema.fields[:-1], T.StructField(out[0], T.ArrayType(T.IntegerType(), False)), T.StructField(out[1], T.LongType())])

    def run(batches):
        encode = shared.value.shared_encoder()
        for batch in slices(batches):
            texts = batch.column(batch.num_columns - 1).to_pylist()
            found = encode([t for t in texts if t is not None])
            it = iter(found)
            each = [None if t is None else next(it) for t in texts]
            sizes = [0 if e is None else len(e) for e in each]
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), mask=np.array([*(e is None for e in each), False]))
            values = pa.array(np.concatenate(found) if found else np.zeros(0, dtype=np.int32))
            lists = pa.ListArray.from_arrays(offsets, values)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists, pa.array([None if e is None else len(e) for e in each], pa.int64())], names=schema.names)

    return source.mapInArrow(run, schema)


def decode_pieces(df: DataFrame, model: UnigramModel, pieces: str = "pieces", keep: tuple = (), name: str = "decoded") -> DataFrame:
    """``keep`` columns with the text of the pieces (null for null)."""
    bounded_batches(df.sparkSession)
    shared = shared_value(df.sparkSession, model)
    inner = free_name(keep, "decoded_pieces")
    source = df.select(*keep, F.col(pieces).alias(inner))
    out = free_name(keep, name)
    schema = T.StructType([*source.schema.fields[:-1], T.StructField(out, T.StringType())])

    def run(batches):
        for batch in slices(batches):
            lists = batch.column(batch.num_columns - 1)
            values, bounds = lists.values.to_numpy(), lists.offsets.to_pylist()
            texts = [shared.value.decode(values[a:b].tolist()) if ok else None for a, b, ok in zip(bounds[:-1], bounds[1:], lists.is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=schema.names)

    return source.mapInArrow(run, schema)
