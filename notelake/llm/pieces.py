"""SentencePiece encoding by forward filtering and backward sampling over the piece lattice, and lossless decoding.

A text becomes units that no piece spans: runs of marks (a mark stands for a space, and one leads the text) with the
characters up to the next mark, and single line breaks. The lattice of each distinct unit of a batch is built once:
forward sums of path weights, then for every place the cumulative probabilities of the pieces that end there. Every
occurrence walks backward through them with random numbers that depend on nothing but the seed, its row key and its
place, so that reruns, other partitions and lost executors give the same segmentation.

A model of merge ranks has no probabilities; a piece of rank r weighs 1 / (r + 2) (Zipf's law), to the power `sharpness`.
Characters without a piece, and marks in the text itself, are spelled in byte pieces; so decoding gives every text back.

Defined results: null text - null pieces, decoded null; empty text - no pieces; null key - key 0; equal keys and texts -
the same segmentation; texts of any length are encoded whole; extra columns do not matter; empty table - empty result.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, columns, mix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
ALONE = "\ud800"
SLICE = 400_000  # units that are sampled together
KNOWN = 200_000  # units whose lattices a task keeps
SLOTS = 1 << 19
WIDE = 1 << 21  # more than any code point


class Pieces:
    """A piece model: a trie over code points as a sorted array of (state, code point) keys, and weights."""

    def __init__(self, path: str, sharpness: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes_at = np.full(256, -1, np.int64)
        self.text: list[bytes] = [b""] * model.get_piece_size()
        edges: dict[tuple[int, int], int] = {}
        ends: dict[int, int] = {}
        weight = np.full(model.get_piece_size(), -np.inf)
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes_at[int(piece[3:5], 16)] = i
                self.text[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                state = 0
                for ch in piece:
                    state = edges.setdefault((state, ord(ch)), len(edges) + 1)
                ends[state] = i
                weight[i] = -np.log(max(0.0, -model.get_score(i)) + 2) * sharpness
                self.text[i] = piece.replace(MARK, " ").encode()
                if "\n" in piece and len(piece) > 1 or MARK in piece.lstrip(MARK):
                    raise ValueError(f"{path}: piece {i} spans units")
        if (self.bytes_at < 0).any():
            raise ValueError(f"{path} has no byte pieces")
        self.slots, self.next = np.full(SLOTS, -1, np.int64), np.zeros(SLOTS, np.int32)
        for (s, c), to in edges.items():
            slot = int(self._slot(np.array([s * WIDE + c]))[0])
            while self.slots[slot] >= 0:
                slot = (slot + 1) % SLOTS
            self.slots[slot], self.next[slot] = s * WIDE + c, to
        self.piece_of = np.full(len(edges) + 1, -1, np.int64)
        self.piece_of[list(ends)] = list(ends.values())
        self.weight, self.worst = weight, -np.log(len(self.text) + 2.0) * sharpness
        self.size = len(self.text)
        self.forget()

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)

    def _follow(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, next state) of trie edges, by a hash table with linear probing."""
        slot = self._slot(keys)
        held = self.slots[slot]
        off = np.flatnonzero((held != keys) & (held >= 0))
        while len(off):
            slot[off] = (slot[off] + 1) % SLOTS
            now = self.slots[slot[off]]
            held[off] = now
            off = off[(now != keys[off]) & (now >= 0)]
        return held == keys, self.next[slot]

    def forget(self) -> None:
        """Start over with no unit known."""
        self.known: dict[str, int] = {}
        self.starts, self.ends = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.first, self.cumulative, self.piece, self.length = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int32), np.zeros(0, np.int16)

    def learn(self, units: set[str]) -> None:
        """Add the lattices of units that are not known yet."""
        new = sorted(units - self.known.keys())
        if len(self.known) + len(new) > KNOWN:
            self.forget()
            new = sorted(units)
        if not new:
            return
        ends, edge_end, cumulative, piece, length = self.lattice(new)
        places, edges = len(self.first), len(self.cumulative)
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        self.starts = np.concatenate((self.starts, np.concatenate(([0], ends[:-1])) + places))
        self.ends = np.concatenate((self.ends, ends + places))
        self.first = np.concatenate((self.first, np.searchsorted(edge_end, np.arange(ends[-1])) + edges))
        self.cumulative = np.concatenate((self.cumulative, cumulative))
        self.piece = np.concatenate((self.piece, piece.astype(np.int32)))
        self.length = np.concatenate((self.length, length.astype(np.int16)))

    def lattice(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ends of units in places; place, cumulative probability, piece and length of each edge); edges sorted by place.

        The places of a unit of n characters are n consecutive numbers, 1 to n after its first character, and so on.
        Piece numbers from self.size on stand for the character (number - self.size) spelled in bytes.
        """
        length = np.array([len(u) for u in units], np.int64)
        ends = np.cumsum(length)
        chars = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        stop = np.repeat(ends, length)  # one past the last character of each character's unit
        at = np.arange(len(chars))
        state = np.zeros(len(chars), np.int64)
        src, size, piece = [], [], []
        covered = np.zeros(len(chars), bool)
        step = 0
        while len(at):
            key = state * WIDE + chars[at + step]
            ok, to = self._follow(key)
            at, state = at[ok], to[ok].astype(np.int64)
            step += 1
            p = self.piece_of[state]
            hit = p >= 0
            src.append(at[hit])
            size.append(np.full(int(hit.sum()), step))
            piece.append(p[hit])
            if step == 1:
                covered[at[hit]] = True
            more = at + step < stop[at]
            at, state = at[more], state[more]
        lone = np.flatnonzero(~covered)
        src.append(lone)
        size.append(np.ones(len(lone), np.int64))
        piece.append(self.size + chars[lone])
        src, size, piece = np.concatenate(src), np.concatenate(size), np.concatenate(piece)
        spelled = piece >= self.size
        width = np.where(piece - self.size < 0x80, 1, np.where(piece - self.size < 0x800, 2, np.where(piece - self.size < 0x10000, 3, 4)))
        w = np.where(spelled, self.worst * width, self.weight[np.where(spelled, 0, piece)])
        # forward filtering: log of the summed weights of all paths to a place, place by place of every unit at once
        begin = ends - length
        inside = src - np.repeat(begin, length)[src]
        by = np.argsort(inside, kind="stable")
        cuts = np.searchsorted(inside[by], np.arange(int(length.max(initial=0)) + 1))
        total = np.full(len(chars), -np.inf)
        value = np.empty(len(src))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            e = by[a:b]
            value[e] = w[e] + np.where(inside[e] > 0, total[src[e] - 1], 0.0)
            np.logaddexp.at(total, src[e] + size[e] - 1, value[e])
        end = src + size - 1
        by = np.argsort(end, kind="stable")
        end, size, piece = end[by], size[by], piece[by]
        p = np.exp(value[by] - total[end])
        first = np.concatenate(([True], end[1:] != end[:-1]))[: len(end)]
        # summed place by place, so that a unit's sums do not depend on the units that it is learned with
        inner, nth = p.copy(), np.arange(len(end)) - np.maximum.accumulate(np.where(first, np.arange(len(end)), 0))
        for k in range(1, int(nth.max(initial=0)) + 1):
            at = np.flatnonzero(nth == k)
            inner[at] += inner[at - 1]
        last = np.concatenate((first[1:], [True])) if len(first) else first
        return ends, end, np.where(last, 2.0, inner), piece, size

    def split(self, text: str) -> list[str]:
        """Units of a text; marks of the text itself become a lone surrogate, which no text holds and no piece has."""
        return re.findall(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+", MARK + text.replace(MARK, ALONE).replace(" ", MARK))

    def sample(self, texts: list[str], keys: np.ndarray, seed: int) -> list[np.ndarray]:
        """Piece numbers of each text. keys: uint64 per text."""
        split = [self.split(t) if t else [] for t in texts]
        count = np.array([len(u) for u in split], np.int64)
        flat = [u for s in split for u in s]
        if not flat:
            return [np.zeros(0, np.int64) for _ in texts]
        self.learn(set(flat))
        which = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        doc = np.repeat(np.arange(len(texts)), count)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        noise = mix(keys[doc] + mix(nth.astype(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)))
        # backward sampling: all occurrences take a step at a time
        place, live, start = self.ends[which] - 1, np.arange(len(which)), self.starts[which]
        steps, taken = [], np.zeros(len(which), np.int64)
        while len(live):
            u = (mix(noise[live] + taken[live].astype(np.uint64)) >> np.uint64(11)).astype(np.float64) / 2.0**53
            e = self.first[place]
            on = np.flatnonzero(self.cumulative[e] <= u)
            while len(on):
                e[on] += 1
                on = on[self.cumulative[e[on]] <= u[on]]
            steps.append((live, self.piece[e]))
            taken[live] += 1
            place = place - self.length[e]
            more = place >= start[live]
            live, place = live[more], place[more]
        # the step taken last comes first
        after = np.cumsum(taken)
        picked = np.empty(int(after[-1]), np.int64)
        for k, (live, found) in enumerate(steps):
            picked[after[live] - 1 - k] = found
        bounds = np.concatenate(([0], np.cumsum(np.bincount(doc, taken, len(texts)).astype(np.int64))))
        out = []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            ids = picked[a:b]
            out.append(self.spell(ids) if b > a and ids.max() >= self.size else ids)
        return out

    def spell(self, ids: np.ndarray) -> np.ndarray:
        """ids with spelled characters replaced by byte pieces."""
        at = np.flatnonzero(ids >= self.size)
        out, last = [], 0
        for i in at.tolist():
            ch = chr(int(ids[i]) - self.size)
            ch = MARK if ch == ALONE else ch
            out += [ids[last:i], self.bytes_at[list(ch.encode())]]
            last = i + 1
        return np.concatenate([*out, ids[last:]])

    def decode(self, ids: list[int]) -> bytes:
        """The text of a piece sequence, without the leading mark."""
        return b"".join(map(self.text.__getitem__, ids))[1:]


_loaded: dict[tuple[str, float], Pieces] = {}


def load(path: str = MODEL, sharpness: float = 1.0) -> Pieces:
    """The model, read once in each Python process."""
    if (path, sharpness) not in _loaded:
        _loaded[path, sharpness] = Pieces(path, sharpness)
    return _loaded[path, sharpness]


def encode(docs: DataFrame, seed: int = 1, sharpness: float = 1.0, model: str = MODEL, digest: bool = False, rest: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, pieces (array<int>), and the columns named in rest. With digest: n_pieces, pieces_crc32, lossless in place of pieces.

    docs: doc_id, text. lossless: the pieces decode to the very bytes of the text.
    """

    def run(batches):
        p = load(model, sharpness)
        try:
            for batch in batches:
                # rows of one key and text, such as copies that a mix makes, have one segmentation: it is drawn once a batch
                nth: dict[tuple[int, str | None], int] = {}
                row = [nth.setdefault((k or 0, t), len(nth)) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
                texts = [t for _, t in nth]
                keys = mix(np.array([k for k, _ in nth], np.int64).astype(np.uint64))
                weight = np.cumsum([len(t or "") // 4 + 1 for t in texts]) // SLICE
                found: list[np.ndarray] = []
                for a, b in zip(*(lambda c: (c, [*c[1:], len(texts)]))([0, *(np.flatnonzero(np.diff(weight)) + 1).tolist()]), strict=True):
                    part = p.sample(texts[a:b], keys[a:b], seed)
                    if digest:
                        part = [(len(x), zlib.crc32(x.astype("<i4").tobytes()), p.decode(x.tolist()) == (t or "").encode()) for x, t in zip(part, texts[a:b], strict=True)]
                    found += part
                none = [t is None for t in texts]
                if digest:
                    made = [pa.array([None if z else f[i] for f, z in zip(found, none, strict=True)], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.bool_()))]
                else:
                    made = [pa.array([None if z else f.astype(np.int32) for f, z in zip(found, none, strict=True)], pa.list_(pa.int32()))]
                made = [m.take(pa.array(row, pa.int64())) for m in made] if len(nth) < len(row) else made
                yield pa.RecordBatch.from_arrays([batch.column(0), *made, *batch.columns[2:]], names=["doc_id", *(("n_pieces", "pieces_crc32", "lossless") if digest else ("pieces",)), *batch.schema.names[2:]])
        finally:  # workers are used again, by stages that need their memory
            p.forget()

    texts = columns(bounded(docs), "doc_id", "text", *rest).withColumn("doc_id", F.col("doc_id").cast("long"))
    kind = "n_pieces long, pieces_crc32 long, lossless boolean" if digest else "pieces array<int>"
    return texts.mapInArrow(run, f"doc_id long, {kind}" + "".join(f", `{n}` {texts.schema[n].dataType.simpleString()}" for n in rest))


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """Per row: doc_id, text. encoded: doc_id, pieces. Null pieces give a null text."""

    def run(batches):
        p = load(model)
        for batch in batches:
            texts = [None if x is None else p.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "pieces").mapInArrow(run, "doc_id long, text string")
