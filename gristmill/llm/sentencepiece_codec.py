"""SentencePiece encoding and decoding by streaming Viterbi (operator 5).

The best path over a model's pieces maximises the sum of their scores; ties go to the longer
last piece.  There is one engine, `Lanes`: it goes through many streams in lockstep, a block of
characters at a time, with scores for a window of the longest piece beyond the block.  As soon as
the backpointer paths of all positions in a stream's window meet in one boundary, the ids before
it are committed and what precedes is forgotten, so the state does not grow with the text.

Between two characters that stand side by side in no piece every path passes, so it is known
before any score is computed that all meet there.  `Model.encode` starts a stream at each of these
points and sends equal stretches of a batch through the engine once (equal by comparison, not by
hash alone).  `StreamingViterbi` is the engine with one stream, for text that comes in chunks.

The model file's path is a parameter; the driver reads it and broadcasts the bytes.  Only models
with an identity normaliser, a dummy prefix and byte fallback are taken; a literal U+2581 is
encoded as bytes, so decoding gives back every text exactly.  A model trained as BPE is read as
its pieces with their scores: ids are the best-scoring segmentation, not the order of merges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from gristmill.llm._spark import batches, tidy
from gristmill.llm._text import U64, mix64, value_sums

SPACE = 0x2581
LOW = 128  # classes of the characters that most pieces hold: their steps in the trie are a table
#: Characters of a batch that are encoded at once, and streams in lockstep.
CHARS, STREAMS = 1 << 20, 1 << 14
#: The former where a pass also decodes.
BOTH_CHARS = 1 << 18


def _starts(n: np.ndarray) -> np.ndarray:
    return np.cumsum(n) - n


def _runs(n: np.ndarray) -> np.ndarray:
    """0 .. n[0] - 1, 0 .. n[1] - 1 and so on."""
    return np.arange(int(n.sum())) - np.repeat(_starts(n), n)


def _spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0] .. start[0] + n[0] - 1, start[1] .. start[1] + n[1] - 1 and so on."""
    ends = np.cumsum(n)
    return np.repeat(start - ends + n, n) + np.arange(int(ends[-1]) if len(ends) else 0)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each distinct key, and for every key the number of its place; by hashing, without a sort."""
    of = pa.array(keys).dictionary_encode().indices.to_numpy().astype(np.int64)
    place = np.empty(int(of.max()) + 1, np.int64)
    place[of] = np.arange(len(of))
    return place, of


class Model:
    """Pieces of a SentencePiece model: their trie, scores, byte fallback, and bytes for decoding."""

    def __init__(self, raw: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(raw)
        spec = proto.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not proto.trainer_spec.byte_fallback:
            raise ValueError("only models with an identity normaliser, a dummy prefix, kept white space and byte fallback are supported")
        self.pieces = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        self.score = np.array([p.score for p in proto.pieces], np.float64)
        self.unknown = min(p.score for p in proto.pieces if p.type == 1) - 10
        self.bytes = np.zeros(256, np.int64)
        shown = []
        for i, p in enumerate(proto.pieces):
            if p.type == 6:
                self.bytes[int(p.piece[3:5], 16)] = i
                shown.append(bytes([int(p.piece[3:5], 16)]))
            else:
                shown.append(p.piece.replace("▁", " ").encode() if p.type == 1 else b"")
        self.longest = max(map(len, self.pieces))
        self.dtype = np.dtype("<u2" if len(shown) <= 1 << 16 else "<u4")
        self.flat = np.frombuffer(b"".join(shown), np.uint8)
        self.length = np.array([len(x) for x in shown], np.int64)
        self.start = _starts(self.length)
        self.mixed = mix64(np.arange(1, 0x110001, dtype=U64))  # a hash of each code point
        self._trie()

    def _trie(self) -> None:
        uses: dict[str, int] = {}
        for p in self.pieces:
            for c in p:
                uses[c] = uses.get(c, 0) + 1
        order = {c: i for i, c in enumerate(sorted(uses, key=lambda c: (-uses[c], c)), 1)}
        self.kind = np.zeros(0x110000, np.int32)  # class of each code point; 0: in no piece
        self.kind[[ord(c) for c in order]] = list(order.values())
        self.kind[32], self.kind[SPACE] = self.kind[SPACE], 0  # a space is shown as U+2581; that sign itself is in no piece
        node = {p[:n] for p in self.pieces for n in range(1, len(p) + 1)}
        node = {p: i for i, p in enumerate(sorted(node, key=lambda p: (len(p), p)), 1)}
        self.piece = np.full(len(node) + 1, -1, np.int32)
        self.row = np.zeros(len(node) + 1, np.int32)  # 0: no longer piece begins like this
        self.first = np.zeros(len(order) + 1, np.int32)
        steps = [(node[p[:-1]], order[p[-1]], i) for p, i in node.items() if len(p) > 1]
        for p, i in node.items():
            self.piece[i] = self.pieces.get(p, -1)
            if len(p) == 1:
                self.first[order[p]] = i
        self.one = self.piece[self.first]  # by class: the piece that is this character alone, and its score
        self.one_score = np.where(self.one >= 0, self.score[self.one], self.unknown)
        above = sorted({a for a, _, _ in steps})
        self.row[above] = np.arange(1, len(above) + 1)
        self.table = np.zeros((len(above) + 1) * LOW, np.int32)
        a, c, i = np.array(steps, np.int64).reshape(-1, 3).T
        self.table[(self.row[a] * LOW + c)[c < LOW]] = i[c < LOW]
        far = np.flatnonzero(c >= LOW)
        far = far[np.argsort(a[far] << 21 | c[far])]
        self.far, self.far_to = np.append(a[far] << 21 | c[far], 1 << 62), np.append(i[far], 0).astype(np.int32)
        beside = np.unique(np.array([order[x] << 21 | order[y] for p in self.pieces for x, y in zip(p, p[1:], strict=False)] or [0], np.int64))
        self.beside = np.append(beside, 1 << 62)
        self.beside_low = np.zeros((LOW + 1) * (LOW + 1), bool)
        x, y = beside >> 21, beside & ((1 << 21) - 1)
        self.beside_low[(x * (LOW + 1) + y)[(x < LOW) & (y < LOW)]] = True

    def step(self, node: np.ndarray, row: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """The trie's nodes one character further, given the nodes' rows; 0: none."""
        out = self.table[row * LOW + np.minimum(kind, LOW - 1)]
        if len(high := np.flatnonzero(kind >= LOW)):
            key = node[high].astype(np.int64) << 21 | kind[high]
            at = np.searchsorted(self.far, key)
            out[high] = np.where(self.far[at] == key, self.far_to[at], 0)
        return out

    def joined(self, kind: np.ndarray) -> np.ndarray:
        """For each character but the first: whether a piece may hold it and the one before."""
        x, y = kind[:-1], kind[1:]
        out = self.beside_low[np.minimum(x, LOW) * (LOW + 1) + np.minimum(y, LOW)]
        if len(high := np.flatnonzero((x >= LOW) | (y >= LOW))):
            key = x[high].astype(np.int64) << 21 | y[high]
            out[high] = self.beside[np.searchsorted(self.beside, key)] == key
        return out

    def spelled(self, ids: np.ndarray, cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids with each -1 replaced by the byte ids of its code point; and how many ids each became."""
        n = np.ones(len(ids), np.int64)
        odd = np.flatnonzero(ids < 0)
        if not len(odd):
            return ids, n
        raw = [chr(c).encode() for c in cp[odd].tolist()]
        n[odd] = [len(x) for x in raw]
        out = np.repeat(ids, n)
        out[out < 0] = self.bytes[np.frombuffer(b"".join(raw), np.uint8)]
        return out, n

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts, one after the other, and each text's number; null and empty texts have none."""
        flat = np.frombuffer("".join(f" {t}\0" if t else "" for t in texts).encode("utf-32-le"), np.uint32)
        size = np.array([len(t) + 2 if t else 0 for t in texts], np.int64)
        if not len(flat):
            return np.zeros(0, self.dtype), np.zeros(len(texts), np.int64)
        kind = np.append(self.kind[flat], np.zeros(self.longest, np.int32))
        new = np.ones(len(flat), bool)
        new[1:] = ~self.joined(kind[: len(flat)])
        between = _starts(size)[size > 0] + size[size > 0] - 1  # the separator after each text
        new[between] = True
        start = np.flatnonzero(new)
        length = np.diff(start, append=len(flat))
        text = np.searchsorted(between, start)  # among the texts that are not empty
        keep = start != between[text]
        start, length, text = start[keep], length[keep], text[keep]
        sums, down = value_sums(self.mixed[flat])
        stretch = mix64((sums[start + length] - sums[start]) * down[start] + length.astype(U64) * U64(0xD6E8FEB86659FD93))
        first, of = _distinct(stretch)
        body = np.ones(len(flat), bool)  # stretches are all but the separators
        body[between] = False
        if (length[first][of] != length).any() or (flat[_spread(start[first][of], length)] != flat[body]).any():
            first = of = np.arange(len(start))  # a hash stands for two stretches
        longest = int(length.max())
        order = np.argsort((longest - length[first]).astype(np.uint16 if longest < 1 << 16 else np.int64), kind="stable")  # two bytes are sorted by radix
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        first, of = first[order], back[of]
        ids, n = [], []
        for i in range(0, len(first), STREAMS):
            own = first[i : i + STREAMS]
            lanes = Lanes(self, kind, start[own], length[own])
            lanes.finish()
            lane, end, piece = lanes.taken()
            out, each = self.spelled(piece, flat[start[own][lane] + end - 1])
            ids.append(out)
            n.append(np.bincount(lane, each, len(own)).astype(np.int64))
        ids, n = np.concatenate(ids).astype(self.dtype), np.concatenate(n)
        many = n[of]
        counts = np.zeros(len(texts), np.int64)
        counts[size > 0] = np.bincount(text, many, len(between)).astype(np.int64)
        return ids[_spread(_starts(n)[of], many)], counts

    def encode_all(self, texts: list[str | None], chars: int = CHARS) -> tuple[np.ndarray, np.ndarray]:
        """`encode` of about `chars` characters at a time: what is held at once doesn't grow with the batch."""
        out, part, size = [], [], 0
        for t in texts:
            part.append(t)
            size += len(t or "")
            if size >= chars:
                out.append(self.encode(part))
                part, size = [], 0
        out.append(self.encode(part))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def decode(self, packed: list[bytes | None]) -> list[str]:
        """Texts of packed ids; the dummy prefix goes."""
        ids = np.frombuffer(b"".join(x or b"" for x in packed), self.dtype)
        n = self.length[ids]
        raw = self.flat[np.repeat(self.start[ids] - _starts(n), n) + np.arange(int(n.sum()))].tobytes()
        count = np.array([len(x or b"") // self.dtype.itemsize for x in packed], np.int64)
        ends = np.concatenate([[0], np.cumsum(n)])[np.cumsum(count)].tolist()
        return [raw[a + 1 : b].decode("utf-8", "replace") for a, b in zip([0, *ends[:-1]], ends, strict=True)]


class Lanes:
    """Streaming Viterbi over many streams in lockstep; `kind` has the streams' classes of characters, longest stream first.

    Rows of score, back and piece are the boundaries from `base` on, columns the streams that go on.  What precedes the
    boundary up to which all streams are committed is dropped.  Where the paths of a stream do not meet for long (a piece
    repeated without end), its backpointers stay, 5 bytes a character, and the search is put off until they have doubled.
    """

    def __init__(self, model: Model, kind: np.ndarray, start: np.ndarray, length: np.ndarray):
        self.model, self.kind, self.start, self.length = model, kind, start, length
        n = len(start)
        self.at = self.base = self.again = self.widest = 0
        self.score, self.back, self.piece = np.zeros((1, n)), np.zeros((1, n), np.uint8), np.full((1, n), -1, np.int32)
        self.given = np.zeros(n, np.int64)  # boundaries up to which ids are committed
        self.out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def _matches(self, lanes: np.ndarray, end: int):
        """Pieces that begin at the characters of a block: (piece, score) of single characters, and by length of the longer ones their first in each row, streams, pieces and scores."""
        m = self.model
        first = np.append(_starts(lanes), lanes.sum())
        lane = _runs(lanes)
        pos = self.start[lane] + np.repeat(np.arange(self.at, end), lanes)
        kind = self.kind[pos]
        longer, at, node = {}, np.arange(len(pos)), m.first[kind]
        for n in range(2, m.longest + 1):
            row = m.row[node]
            on = np.flatnonzero(row)
            if not len(on):
                break
            at, pos = at[on], pos[on] + 1
            node = m.step(node[on], row[on], self.kind[pos])
            on = np.flatnonzero(node)
            at, pos, node = at[on], pos[on], node[on]
            ids = m.piece[node]
            known = ids >= 0
            if known.any():
                ids = ids[known]
                longer[n] = (np.searchsorted(at[known], first).tolist(), lane[at[known]], ids, m.score[ids])
        return first.tolist(), m.one[kind], m.one_score[kind], longer

    def block(self, end: int) -> None:
        """Takes the pieces that begin before `end`; commits what is certain then."""
        base, lanes = self.base, np.searchsorted(-self.length, -np.arange(self.at, end))
        more = end + self.model.longest - base + 1 - len(self.score)
        grown = lambda x, v: np.concatenate([x, np.full((more, x.shape[1]), v, x.dtype)])
        score, back, piece = self.score, self.back, self.piece = grown(self.score, -np.inf), grown(self.back, 0), grown(self.piece, -1)
        self.widest = max(self.widest, len(score))
        first, one, single, longer = self._matches(lanes, end)
        for j, w in enumerate(lanes.tolist()):
            if not w:
                break
            r, a = self.at - base + j, first[j]
            own = score[r]
            new, to = own[:w] + single[a : a + w], score[r + 1, :w]
            better = new > to
            np.copyto(to, new, where=better)
            np.copyto(back[r + 1, :w], 1, where=better)
            np.copyto(piece[r + 1, :w], one[a : a + w], where=better)
            for n, (bound, lane, ids, add) in longer.items():
                x, y = bound[j], bound[j + 1]
                if x < y:
                    at = lane[x:y]
                    new, to = own[at] + add[x:y], score[r + n]
                    better = new > to[at]
                    at = at[better]
                    to[at], back[r + n, at], piece[r + n, at] = new[better], n, ids[x:y][better]
        self.at = end
        on = int(np.searchsorted(-self.length, -end))  # streams that go on
        self._commit(np.arange(on, score.shape[1]), self.length[on : score.shape[1]])
        if on and end >= self.again:
            self._commit(np.arange(on), self._meeting(on))
        keep = int(self.given[:on].min()) - base if on else len(score) - 1
        if end >= self.again:
            self.again = end + (end - base - keep)
        self.base = base + keep
        self.score, self.back, self.piece = score[keep:, :on] - score[end - base, :on], back[keep:, :on], piece[keep:, :on]

    def _meeting(self, on: int) -> np.ndarray:
        """The boundary in which the paths from all positions in each stream's window meet."""
        window = self.score[self.at - self.base :, :on]
        now = self.at + np.where(window > -np.inf, np.arange(len(window))[:, None], 0)
        while len(cols := np.flatnonzero((last := now.max(axis=0)) > now.min(axis=0))):
            far = last[cols]
            own = now[:, cols]
            now[:, cols] = np.where(own == far, far - self.back[far - self.base, cols], own)
        return now[0]

    def _commit(self, lanes: np.ndarray, to: np.ndarray) -> None:
        at, low = to.copy(), self.given[lanes]
        self.given[lanes] = to
        while True:
            on = at > low
            if not on.all():
                lanes, at, low = lanes[on], at[on], low[on]
            if not len(lanes):
                return
            row = at - self.base
            self.out.append((lanes, at, self.piece[row, lanes]))
            at = at - self.back[row, lanes]

    def finish(self) -> None:
        """Goes through all streams to their ends."""
        while self.score.shape[1]:
            self.block(min(self.at + 2 * self.model.longest, int(self.length[0])))

    def taken(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What was committed since the last call: streams, ends and pieces (-1: a character in no piece), in order."""
        if not self.out:
            return tuple(np.zeros(0, np.int64) for _ in range(3))
        lane, end, piece = (np.concatenate(x) for x in zip(*self.out, strict=True))
        self.out = []
        order = np.lexsort((end, lane)) if len(self.start) > 1 else np.argsort(end)
        return lane[order], end[order], piece[order].astype(np.int64)


class StreamingViterbi:
    """Encodes text that comes in chunks; `feed` and `end` return the ids that are certain by then. Of the text only what is not committed is kept."""

    def __init__(self, model: Model):
        self.model, self.cp, self.lost = model, np.zeros(0, np.uint32), 0
        self.lanes = Lanes(model, np.zeros(0, np.int32), np.zeros(1, np.int64), np.array([1 << 62]))

    @property
    def widest(self) -> int:
        return self.lanes.widest

    def _take(self, end: int) -> list[int]:
        x = self.lanes
        x.kind = np.append(self.model.kind[self.cp], np.zeros(self.model.longest, np.int32))
        x.start = np.array([-self.lost])
        if x.score.shape[1]:
            x.block(end)
        _, at, piece = x.taken()
        ids, _ = self.model.spelled(piece, self.cp[at - 1 - self.lost])
        done = min(int(x.given[0]), x.base) - self.lost
        self.cp, self.lost = self.cp[done:], self.lost + done
        return ids.tolist()

    def feed(self, text: str) -> list[int]:
        self.cp = np.append(self.cp, np.frombuffer(text.encode("utf-32-le"), np.uint32))
        out, block, known = [], 2 * self.model.longest, self.lost + len(self.cp)
        while self.lanes.at + block + self.model.longest <= known:
            out += self._take(self.lanes.at + block)
        return out

    def end(self) -> list[int]:
        size, out = self.lost + len(self.cp), []
        self.lanes.length = np.array([size])
        while self.lanes.at < size:
            out += self._take(min(size, self.lanes.at + 2 * self.model.longest))
        return out


_models: dict[bytes, Model] = {}


def model_of(raw: bytes | str) -> Model:
    """The model of a file's bytes (or, in the driver, of its path), once for each Python process."""
    if isinstance(raw, str):
        with open(raw, "rb") as f:
            raw = f.read()
    if raw not in _models:
        _models[raw] = Model(raw)
    return _models[raw]


def shipped(spark: SparkSession, model_path: str):
    """A broadcast of the model file's bytes; executors need not have the file."""
    with open(model_path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _with(schema: T.StructType, *more: tuple[str, T.DataType]) -> T.StructType:
    names = {n for n, _ in more}
    return T.StructType([*(f for f in schema.fields if f.name not in names), *(T.StructField(n, t) for n, t in more)])


def binary(ids: np.ndarray, counts: np.ndarray) -> pa.BinaryArray:
    """Packed ids as an Arrow column, without a copy for each row."""
    ends = np.concatenate([[0], np.cumsum(counts)]) * ids.dtype.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(ids))]).cast(pa.binary())


def encode(docs: DataFrame, model_path: str, *, text_col: str = "text") -> DataFrame:
    """docs with `ids` (packed little-endian integers, 2 bytes where the vocabulary allows, else 4) and `n_ids`.

    Null and empty texts have no ids.  Columns called ids or n_ids are replaced, others stay, whatever
    their names; repeated rows are encoded alike; equal scores go to the longer last piece.  A very long text, or
    one without a break, needs no more memory than its ids and an Arrow batch.  An empty table gives an empty table.
    """
    batches(docs.sparkSession)
    model = shipped(docs.sparkSession, model_path)

    @tidy
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model_of(model.value)
        for b in parts:
            ids, n = m.encode_all(b.column(b.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], binary(ids, n), pa.array(n)], names=[*names, "ids", "n_ids"])

    kept = docs.drop("ids", "n_ids")
    names = kept.columns
    return kept.select("*", docs[text_col].alias("__text")).mapInArrow(run, _with(kept.schema, ("ids", T.BinaryType()), ("n_ids", T.LongType())))


def decode(rows: DataFrame, model_path: str, *, ids_col: str = "ids") -> DataFrame:
    """rows with `decoded`, the text of the packed ids; null and empty ids give the empty text.

    A column called decoded is replaced, others stay; repeated rows are decoded alike; an empty table gives an empty table.
    """
    batches(rows.sparkSession)
    model = shipped(rows.sparkSession, model_path)

    @tidy
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model_of(model.value)
        for b in parts:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(m.decode(b.column(b.num_columns - 1).to_pylist()), pa.string())], names=[*names, "decoded"])

    kept = rows.drop("decoded")
    names = kept.columns
    return kept.select("*", rows[ids_col].alias("__ids")).mapInArrow(run, _with(kept.schema, ("decoded", T.StringType())))


def round_trip(docs: DataFrame, model_path: str, *, text_col: str = "text") -> DataFrame:
    """`decode` of `encode`, in one pass: a task has one Python worker with one model, not two.

    docs with `ids`, `n_ids` and `decoded`; columns of these names are replaced, others stay.
    """
    batches(docs.sparkSession)
    model = shipped(docs.sparkSession, model_path)

    @tidy
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model_of(model.value)
        for b in parts:
            ids, n = m.encode_all(b.column(b.num_columns - 1).to_pylist(), BOTH_CHARS)
            packed = binary(ids, n)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], packed, pa.array(n), pa.array(m.decode(packed.to_pylist()), pa.string())], names=[*names, "ids", "n_ids", "decoded"])

    kept = docs.drop("ids", "n_ids", "decoded")
    names = kept.columns
    return kept.select("*", docs[text_col].alias("__text")).mapInArrow(run, _with(kept.schema, ("ids", T.BinaryType()), ("n_ids", T.LongType()), ("decoded", T.StringType())))
