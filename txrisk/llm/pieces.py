"""SentencePiece encoding and decoding: the best segmentation of whole texts into scored pieces.

The pieces and scores come from a public model file, whose path is a parameter; nothing is trained. A text is its
characters behind one space, with spaces as U+2581; a segmentation's weight is the sum of its pieces' weights,
and the best one wins. Characters that no piece covers are encoded as their UTF-8 bytes. Weights are integers
(the score, then a fixed number of each piece that settles ties), so sums do not depend on their order.

Where two neighbouring characters stand side by side in no piece, every segmentation has a border. The stretches
between such places are solved each for itself, many at once, and each distinct one once per batch.

A giant document is cut into chunks at fixed places, whatever stands there. A piece may reach over a cut, so a
chunk is described by a transfer matrix over boundary states: entry (i, j) is the greatest weight of covering it
from i characters after its begin to j characters after its end. Matrices combine associatively under (max, +),
in a tree of bounded fan-in; walking the tree down again gives each chunk its two states, and then every chunk
is backtraced on its own.
"""

from collections.abc import Iterator
from functools import lru_cache
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from txrisk.llm import text as T
from txrisk.session import checkpointed

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
U64 = np.uint64
NEVER = np.int64(-(1 << 61))
SPACE_PIECE = "▁"
#: Documents with more characters are cut into chunks of that many.
CHUNK = 16384
#: Matrices or states that one step of the tree puts together.
FAN_IN = 64
#: Lanes of one dynamic program: lane characters held at once.
LANE_CELLS = 1 << 19
#: Characters that are encoded at once.
RUN_CHARS = 1 << 21
#: Characters whose borders or hashes are found at once.
BLOCK_CHARS = 1 << 17


class Vocabulary:
    """Pieces of a model file as arrays: hashes of their characters, weights, bytes."""

    def __init__(self, model: bytes):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = sp.get_piece_size()
        texts = [sp.id_to_piece(i) for i in range(size)]
        #: the type that ids are kept in between two passes
        self.packed = np.uint16 if size <= 1 << 16 else np.int32
        self.byte_ids = np.zeros(256, np.int32)
        self.bytes = [b""] * size
        ordinary = []
        for i, t in enumerate(texts):
            if sp.is_byte(i):
                self.byte_ids[int(t[3:5], 16)] = i
                self.bytes[i] = bytes([int(t[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                ordinary.append(i)
                self.bytes[i] = t.replace(SPACE_PIECE, " ").encode()
        chars = sorted({c for i in ordinary for c in texts[i]})
        #: Number of each character from 1 on, the last number for those that no piece has. U+2581 itself is
        #: such a one in a text, as in a piece it stands for space.
        self.unknown = len(chars) + 1
        self.chars = np.full(0x110000, self.unknown, np.int32)
        for k, c in enumerate(chars):
            self.chars[ord(" ") if c == SPACE_PIECE else ord(c)] = k + 1
        number = {c: k + 1 for k, c in enumerate(chars)}
        scores = np.array([sp.get_score(i) for i in ordinary])
        order = T.mix(np.array(ordinary, U64) + U64(1)) >> U64(46)
        self.weights = np.zeros(size, np.int64)
        scores = np.maximum(scores, -(1 << 22))
        # ranks keep 20 bits for the order of ties; log probabilities are small and take what 42 bits leave
        bits = 20 if (scores == np.rint(scores)).all() else max(20, 41 - int(np.ceil(np.log2(np.abs(scores).max()))))
        self.weights[ordinary] = np.rint(scores * 2.0 ** bits).astype(np.int64) - order.astype(np.int64)
        self.fallback = np.int64(int(self.weights[ordinary].min()) - (1 << bits))
        self.longest = max(len(texts[i]) for i in ordinary)
        #: pairs[a, b]: some piece has character a right before b
        self.pairs = np.zeros((len(chars) + 2, len(chars) + 2), bool)
        self.odd = U64(0x9E3779B97F4A7C15)
        hashes = np.zeros(len(ordinary), U64)
        for n, i in enumerate(ordinary):
            codes = [number[c] for c in texts[i]]
            for a, b in zip(codes, codes[1:]):
                self.pairs[a, b] = True
            h = 0
            for c in codes:
                h = (h * int(self.odd) + c) & 0xFFFFFFFFFFFFFFFF
            hashes[n] = h
        self._fill(hashes, np.array(ordinary, np.int32))
        self.powers = np.cumprod(np.concatenate((np.ones(1, U64), np.full(self.longest, self.odd))), dtype=U64)
        #: single[c]: the piece that is character c alone, -1 if there is none
        self.single = self.find(np.arange(len(chars) + 2, dtype=U64))

    def _fill(self, hashes: np.ndarray, ids: np.ndarray) -> None:
        """Two tables of 2^20 slots; a piece that finds its first slot taken has one in the second."""
        slots = (T.mix(hashes) >> U64(44)).astype(np.int64)
        _, first = np.unique(slots, return_index=True)
        rest = np.setdiff1d(np.arange(len(ids)), first)
        salt = U64(1)
        while True:
            other = (T.mix(hashes ^ T.mix(np.array([salt], U64))) >> U64(44)).astype(np.int64)
            if len(np.unique(other[rest])) == len(rest):
                break
            salt += U64(1)
        self.salt = T.mix(np.array([salt], U64))[0]
        self.table, self.keys = np.full((2, 1 << 20), -1, np.int32), np.zeros((2, 1 << 20), U64)
        for j, (rows, at) in enumerate(((first, slots), (rest, other))):
            self.table[j, at[rows]], self.keys[j, at[rows]] = ids[rows], hashes[rows]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece ids of character hashes, -1 for those that are none."""
        at = (T.mix(hashes) >> U64(44)).astype(np.int64)
        found = np.where(self.keys[0, at] == hashes, self.table[0, at], -1)
        if len(open_ := np.flatnonzero(found < 0)):
            at = (T.mix(hashes[open_] ^ self.salt) >> U64(44)).astype(np.int64)
            found[open_] = np.where(self.keys[1, at] == hashes[open_], self.table[1, at], -1)
        return found


@lru_cache(maxsize=2)
def vocabulary(model: bytes) -> Vocabulary:
    return Vocabulary(model)


def read_model(path: str = MODEL) -> bytes:
    """The model file, read where the job is planned and sent to the tasks; it is small by its nature."""
    with open(path, "rb") as f:
        model = f.read()
    if len(model) > 16 << 20:
        raise ValueError(f"{path} is too large for a tokenizer model: {os.path.getsize(path)} bytes")
    return model


def _solve_lanes(v: Vocabulary, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best weights of stretches of `codes`, and the last piece's length at each place of each lane."""
    lanes, most = len(starts), int(sizes.max())
    best = np.full((most + 1, lanes), NEVER, np.int64)
    back = np.zeros((most + 1, lanes), np.int8)
    best[0] = 0
    prefix = np.zeros((most + 1, lanes), U64)
    for t in range(1, most + 1):
        live = np.flatnonzero(sizes >= t)
        code = codes[starts[live] + t - 1]
        prefix[t, live] = prefix[t - 1, live] * v.odd + code.astype(U64)
        top = np.where(v.single[code] >= 0, v.weights[v.single[code]], v.fallback) + best[t - 1, live]
        by = np.ones(len(live), np.int8)
        for n in range(2, min(t, v.longest) + 1):
            found = v.find(prefix[t, live] - prefix[t - n, live] * v.powers[n])
            hit = np.flatnonzero(found >= 0)
            if len(hit):
                w = v.weights[found[hit]] + best[t - n, live[hit]]
                better = w > top[hit]
                top[hit[better]], by[hit[better]] = w[better], n
        best[t, live], back[t, live] = top, by
    return best[sizes, np.arange(lanes)], back


def _lane_pieces(v: Vocabulary, points: np.ndarray, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all lanes, one lane after the other, and their number in each lane; traced from the end."""
    place = sizes.copy()
    steps = []
    live = np.flatnonzero(place > 0)
    while len(live):
        n = back[place[live], live].astype(np.int64)
        steps.append((live, starts[live] + place[live] - n, n))
        place[live] -= n
        live = live[place[live] > 0]
    if not steps:
        return np.zeros(0, np.int32), np.zeros(len(starts), np.int64)
    lane, at, n = (np.concatenate([s[k] for s in steps[::-1]]) for k in range(3))
    order = np.argsort(lane, kind="stable")
    lane, at, n = lane[order], at[order], n[order]
    h = np.zeros(len(at), U64)
    for k in range(int(n.max())):
        inside = np.flatnonzero(n > k)
        h[inside] = h[inside] * v.odd + codes[at[inside] + k].astype(U64)
    ids = v.find(h)
    if (ids < 0).any():  # bytes of the characters that no piece has
        parts = [v.byte_ids[np.frombuffer(chr(points[a]).encode("utf-8", "surrogatepass"), np.uint8)] if i < 0 else np.array([i], np.int32) for i, a in zip(ids, at)]
        lane, ids = np.repeat(lane, [len(p) for p in parts]), np.concatenate(parts)
    return ids.astype(np.int32), np.bincount(lane, minlength=len(starts))


class Solver:
    """Solves stretches of text; equal stretches of one call are solved once."""

    def __init__(self, v: Vocabulary):
        self.v = v

    def characters(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Code points and where each text begins."""
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        return points, np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)

    def borders(self, points: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Whether each character begins a stretch because no piece has it behind the one before."""
        out = np.ones(len(codes), bool)
        for lo in range(1, len(codes), BLOCK_CHARS):
            hi = min(lo + BLOCK_CHARS, len(codes))
            out[lo:hi] = ~self.v.pairs[codes[lo - 1:hi - 1], codes[lo:hi]]
        return out

    def solve(self, points: np.ndarray, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, pieces: bool = True):
        """Weight of each stretch, then the distinct solutions' piece ids and lengths, and each stretch's number in them."""
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        same = self.stretch_hash(points, starts, sizes)
        _, first, which = np.unique(same, return_index=True, return_inverse=True)
        order = np.argsort(sizes[first], kind="stable")
        s, n = starts[first][order], sizes[first][order]
        which = np.argsort(order)[which]
        weights, found, lengths = np.zeros(len(s), np.int64), [np.zeros(0, np.int32)], np.zeros(len(s), np.int64)
        lo = 0
        while lo < len(s):
            near = n[lo:lo + LANE_CELLS]
            hi = lo + max(1, int(np.searchsorted(np.arange(1, len(near) + 1) * (near + 1), LANE_CELLS, "right")))
            weights[lo:hi], back = _solve_lanes(self.v, codes, s[lo:hi], n[lo:hi])
            if pieces:
                ids, lengths[lo:hi] = _lane_pieces(self.v, points, codes, s[lo:hi], n[lo:hi], back)
                found.append(ids)
            lo = hi
        return weights[which], np.concatenate(found), lengths, which

    def stretch_hash(self, points: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """A hash of each stretch's characters; a block of stretches at a time, as its arrays are wider than the text."""
        longest = int(sizes.max())
        if longest > len(_POWERS[0]):
            _POWERS[0] = np.cumprod(np.full(longest, self.v.odd), dtype=U64)
        out, ends, lo = np.zeros(len(sizes), U64), np.cumsum(sizes), 0
        while lo < len(sizes):
            before = int(ends[lo - 1]) if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, before + BLOCK_CHARS, "right")))
            heads, n = ends[lo:hi] - sizes[lo:hi] - before, sizes[lo:hi]
            place = np.arange(int(n.sum())) - np.repeat(heads, n)
            own = points[np.repeat(starts[lo:hi], n) + place].astype(U64) + U64(1)
            own *= _POWERS[0][place]
            out[lo:hi] = T.mix(np.add.reduceat(own, heads) + n.astype(U64))
            lo = hi
        return out


_POWERS = [np.cumprod(np.full(64, U64(0x9E3779B97F4A7C15)), dtype=U64)]


def _gather(ids: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the solutions numbered `which`, one after the other, and how many each has."""
    heads, n = (np.cumsum(sizes) - sizes)[which], sizes[which]
    return ids[np.repeat(heads - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))], n


def encode_texts(v: Vocabulary, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts, one after the other, and where each text begins in them. An empty text has none."""
    solver = Solver(v)
    points, off = solver.characters([" " + t if t else "" for t in texts])
    if not len(points):
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    codes = v.chars[points]
    begins = solver.borders(points, codes)
    heads = off[:-1][off[:-1] < len(points)]
    begins[heads] = True
    starts = np.flatnonzero(begins)
    sizes = np.diff(np.append(starts, len(points)))
    _, ids, lengths, which = solver.solve(points, codes, starts, sizes)
    out, n = _gather(ids, lengths, which)
    total = np.concatenate(([0], np.cumsum(n)))
    return out, total[np.searchsorted(starts, off)]


def decode_ids(v: Vocabulary, ids: np.ndarray) -> str:
    """The text of a sequence of piece ids: their bytes without the leading space."""
    return b"".join(map(v.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")[1:]


def _lists(ids: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids, pa.int32()))


def _encode(model):
    """(doc_id, text) to doc_id, ids and whether the ids decode to the text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model.value)
        for batch in T.slices(batches):
            texts = batch.column("text").fill_null("").to_pylist()
            ends, lo = np.cumsum(np.array([len(t) for t in texts], np.int64)), 0
            while lo < len(texts):
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + RUN_CHARS, "right")))
                ids, off = encode_texts(v, texts[lo:hi])
                same = [decode_ids(v, ids[off[k]:off[k + 1]]) == texts[lo + k] for k in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[lo:hi], _lists(ids, off), pa.array(same)], names=["doc_id", "ids", "round_trip"])
                lo = hi
    return run


#: What a chunk leaves after its first pass: its transfer matrix, the pieces between its first and last border, and the
#: text before and behind them, which is segmented when its states are known; `lead` characters of the tail are its own.
PASSED = "row string, idx long, matrix binary, body binary, head string, tail string, lead int"


class ChunkRun:
    """Chunks of giant documents, each from its begin to its longest reach into the next one, worked on together."""

    def __init__(self, v: Vocabulary, texts: list[str], sizes: list[int], idx: list[int], last: list[bool]):
        self.v, self.solver, self.texts, self.sizes = v, Solver(v), texts, sizes
        self.points, self.off = self.solver.characters(texts)
        self.codes = v.chars[self.points]
        borders = np.flatnonzero(self.solver.borders(self.points, self.codes))
        reach = v.longest
        self.ins = [1 if k == 0 else min(reach, n + 1) for k, n in zip(idx, sizes)]
        self.outs = [1 if end else min(reach, len(t) - n + 1) for t, n, end in zip(texts, sizes, last)]
        #: per chunk the borders at which all paths meet, from behind the last in-state up to the chunk's end
        self.middle = []
        for c, n in enumerate(sizes):
            at = self.off[c]
            lo, hi = np.searchsorted(borders, (at + max(self.ins[c] - 1, 1), at + n + 1))
            self.middle.append(borders[lo:hi])

    def passed(self) -> Iterator[tuple[bytes, bytes, str, str, int]]:
        """Matrix, body, head, tail and lead of each chunk."""
        reach = self.v.longest
        spans, bodies = [], []
        for c, n in enumerate(self.sizes):
            at, m = self.off[c], self.middle[c]
            ins, outs = at + np.arange(self.ins[c]), at + n + np.arange(self.outs[c])
            if len(m):
                spans.append((np.concatenate((ins, np.full(len(outs), m[-1]))), np.concatenate((np.full(len(ins), m[0]), outs))))
                bodies.append((m[:-1], m[1:]))
            else:  # no border to meet at: every state with every other
                i, j = np.repeat(ins, len(outs)), np.tile(outs, len(ins))
                spans.append((i, np.maximum(i, j)))
                bodies.append((m, m))
        starts, ends = (np.concatenate([x[k] for x in spans]) for k in (0, 1))
        weights, full = np.zeros(len(starts), np.int64), np.flatnonzero(ends > starts)
        weights[full] = self.solver.solve(self.points, self.codes, starts[full], (ends - starts)[full], pieces=False)[0]
        starts, ends = (np.concatenate([x[k] for x in bodies]) for k in (0, 1))
        own, ids, lengths, which = self.solver.solve(self.points, self.codes, starts, ends - starts)
        flat, counts = _gather(ids, lengths, which) if len(starts) else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        places = np.concatenate(([0], np.cumsum(counts)))
        first = first_body = 0
        for c, n in enumerate(self.sizes):
            rows, cols, m, text = self.ins[c], self.outs[c], self.middle[c], self.texts[c]
            out = np.full((reach, reach), NEVER, np.int64)
            stop = first_body + max(len(m) - 1, 0)
            if len(m):
                heads, tails = np.split(weights[first:first + rows + cols], [rows])
                out[:rows, :cols] = heads[:, None] + int(own[first_body:stop].sum()) + tails[None, :]
                first += rows + cols
                a, b = int(m[0] - self.off[c]), int(m[-1] - self.off[c])
                head, tail, lead = text[:a], text[b:], n - b
            else:
                i, j = np.arange(rows)[:, None], n + np.arange(cols)[None, :]
                out[:rows, :cols] = np.where(i <= j, weights[first:first + rows * cols].reshape(rows, cols), NEVER)
                first += rows * cols
                head, tail, lead = text, None, n
            yield out.tobytes(), flat[places[first_body]:places[stop]].astype(self.v.packed).tobytes(), head, tail, lead
            first_body = stop


def _first_pass(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model.value)
        for batch in T.slices(batches):
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                c = {n: part.column(n).to_pylist() for n in ("text", "size", "idx", "last")}
                out = list(ChunkRun(v, c["text"], c["size"], c["idx"], c["last"]).passed())
                kinds = (pa.binary(), pa.binary(), pa.string(), pa.string(), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("idx"), *[pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)]],
                                                 names=["row", "idx", "matrix", "body", "head", "tail", "lead"])
    return run


def _backtrace(model):
    """Pieces of each chunk between its two states, independent of all other chunks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model.value)
        solver = Solver(v)
        for batch in T.slices(batches, column="body"):
            c = {n: batch.column(n).to_pylist() for n in ("head", "tail", "lead", "i", "j", "body")}
            parts = []
            for head, tail, lead, i, j in zip(*[c[n] for n in ("head", "tail", "lead", "i", "j")]):
                parts += [head[i:], tail[:lead + j]] if tail is not None else [head[i:lead + j], ""]
            points, off = solver.characters(parts)
            full = np.flatnonzero(off[1:] > off[:-1])
            ids: list = [np.zeros(0, np.int32)] * len(parts)
            if len(full):
                _, found, lengths, which = solver.solve(points, v.chars[points], off[full], (off[1:] - off[:-1])[full])
                flat, n = _gather(found, lengths, which)
                for k, own in zip(full, np.split(flat, np.cumsum(n)[:-1])):
                    ids[k] = own
            whole = [np.concatenate((ids[2 * k], np.frombuffer(b, v.packed).astype(np.int32), ids[2 * k + 1])) for k, b in enumerate(c["body"])]
            if whole:
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("idx"), _lists(np.concatenate(whole), np.concatenate(([0], np.cumsum([len(w) for w in whole]))))],
                                                 names=["row", "idx", "out"])
    return run


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(max, +) product of two transfer matrices; NEVER stays below any sum of real weights."""
    return np.maximum((a[:, :, None] + b[None, :, :]).max(1), NEVER)


def _matrices(values, reach: int) -> np.ndarray:
    return np.stack([np.frombuffer(m, np.int64).reshape(reach, reach) for m in values])


def _up(reach: int):
    def run(batches):
        for g in T.in_groups(batches, ["row", "idx"]):
            parts = _matrices(g.sort_by("child")["matrix"].to_pylist(), reach)
            whole = parts[0]
            for m in parts[1:]:
                whole = product(whole, m)
            yield pa.RecordBatch.from_arrays([pa.array([g["row"][0].as_py()]), pa.array([g["idx"][0].as_py()]), pa.array([whole.tobytes()], pa.binary())], names=["row", "idx", "matrix"])
    return run


def _down(reach: int):
    """States of the children from those of their parent: the best path through at most FAN_IN matrices."""
    def run(batches):
        for g in T.in_groups(batches, ["row", "idx"]):
            g = g.sort_by("child")
            parts = _matrices(g["matrix"].to_pylist(), reach)
            i, j = g["i"][0].as_py(), g["j"][0].as_py()
            ahead = [np.where(np.arange(reach) == i, 0, NEVER)]
            for m in parts[:-1]:
                ahead.append(np.maximum((ahead[-1][:, None] + m).max(0), NEVER))
            states = [j]
            for k in range(len(parts) - 1, 0, -1):
                states.append(int((ahead[k] + parts[k][:, states[-1]]).argmax()))
            states = [i, *states[::-1]]
            yield pa.RecordBatch.from_arrays(
                [g["row"].combine_chunks(), g["child"].combine_chunks(), pa.array(states[:-1], pa.int32()), pa.array(states[1:], pa.int32())],
                names=["row", "idx", "i", "j"])
    return run


def _grouped(df: DataFrame) -> DataFrame:
    return df.repartition("row", "idx").sortWithinPartitions("row", "idx", "child")


def _decoded(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model.value)
        for whole in batches:
            ends, lo = np.cumsum(whole.column("ids").value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
            while lo < whole.num_rows:  # about RUN_CHARS ids, or one row
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + RUN_CHARS, "right")))
                batch = whole.slice(lo, hi - lo)
                ids = batch.column("ids")
                off, flat, valid = ends[lo:hi] - (ends[lo - 1] if lo else 0), ids.flatten().to_numpy(), ids.is_valid().to_pylist()
                texts = [decode_ids(v, flat[off[k - 1] if k else 0:off[k]]) if valid[k] else None for k in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([batch.column(n) for n in batch.schema.names] + [pa.array(texts, pa.string())], names=[*batch.schema.names, "text"])
                lo = hi
    return run


def _model(df: DataFrame, path: str):
    return df.sparkSession.sparkContext.broadcast(read_model(path))


def decode(encoded: DataFrame, model_path: str = MODEL) -> DataFrame:
    """(doc_id, ids, text): the texts that the ids stand for; null ids give a null text, no ids the empty text."""
    rows = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    return rows.mapInArrow(_decoded(_model(rows, model_path)), "doc_id long, ids array<int>, text string")


def _giants(rows: DataFrame, model, longest: int, chunk: int) -> DataFrame:
    """(doc_id, ids, round_trip) of texts longer than `chunk` characters, by chunks."""
    marked = rows.select("doc_id", "text", F.xxhash64("text").alias("mark"), (F.length("text") + 1).alias("n")).withColumn(
        "row", F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.col("mark").cast("string")))
    last = F.floor((F.col("n") - 1) / chunk)
    chunks = (
        marked.withColumns({"idx": F.explode(F.sequence(F.lit(0).cast("long"), last)), "whole": F.concat(F.lit(" "), F.col("text"))})
        .select("row", "idx", F.substring("whole", (F.col("idx") * chunk + 1).cast("int"), F.lit(chunk + longest)).alias("text"),
                F.least(F.lit(chunk), F.col("n") - F.col("idx") * chunk).cast("int").alias("size"), (F.col("idx") == last).alias("last"))
        .repartition(F.col("row"), F.col("idx")).dropDuplicates(["row", "idx"]))
    passed = checkpointed(chunks.mapInArrow(_first_pass(model), PASSED))
    levels = [passed.select("row", "idx", "matrix")]
    while levels[-1].filter("idx > 0").limit(1).count():
        up = _grouped(levels[-1].select("row", F.floor(F.col("idx") / FAN_IN).alias("idx"), F.col("idx").alias("child"), "matrix"))
        levels.append(checkpointed(up.mapInArrow(_up(longest), "row string, idx long, matrix binary")))
    states = levels[-1].select("row", "idx", F.lit(0).alias("i"), F.lit(0).alias("j"))
    for level in levels[-2::-1]:
        children = level.select("row", F.floor(F.col("idx") / FAN_IN).alias("idx"), F.col("idx").alias("child"), "matrix")
        states = checkpointed(_grouped(children.join(states, ["row", "idx"])).mapInArrow(_down(longest), "row string, idx long, i int, j int"))
    done = passed.drop("matrix").join(states, ["row", "idx"]).mapInArrow(_backtrace(model), "row string, idx long, out array<int>")
    ids = done.groupBy("row").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("idx", "out"))), lambda s: s["out"])).alias("ids"))
    # repeated rows are encoded once and returned each
    found = marked.select("row", F.struct("doc_id", "mark").alias("doc_id")).join(ids, "row")
    texts = found.select("doc_id", "ids").mapInArrow(_decoded(model), "doc_id struct<doc_id: long, mark: long>, ids array<int>, text string")
    return texts.select(F.col("doc_id.doc_id").alias("doc_id"), "ids", (F.xxhash64("text") == F.col("doc_id.mark")).alias("round_trip"))


def encode(docs: DataFrame, model_path: str = MODEL, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_pieces, ids, round_trip) for each document; round_trip tells whether decoding gives the text again.

    Null and empty texts have no pieces. Repeated rows are encoded each. One document's ids are one row, as its
    text is one; the work of a giant text is spread over its chunks.
    """
    rows = T.id_and_text(docs)
    model = _model(rows, model_path)
    longest = vocabulary(model.value).longest
    short = rows.filter(F.coalesce(F.length("text") < chunk, F.lit(True))).mapInArrow(_encode(model), "doc_id long, ids array<int>, round_trip boolean")
    giant = _giants(rows.filter(F.length("text") >= chunk), model, longest, chunk)
    return short.unionByName(giant).select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "round_trip")
