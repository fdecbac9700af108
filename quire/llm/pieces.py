"""SentencePiece encoding by sampling over the piece lattice, and lossless decoding."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from quire.llm.shared import Substrings, bounded_batches, chunked, mix64, utf8_rows

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
THETA, SEED = 0.4, 7
CHUNK_BYTES, CHUNK_IDS = 1 << 20, 1 << 19
_SPACE, _LITERAL = 0x2581, 0x110000
_SLOT_BITS = 20


def _codes(points: np.ndarray) -> np.ndarray:
    return mix64(points.astype(np.uint64) + np.uint64(0x51ED27)) | np.uint64(1)


@dataclass
class Pieces:
    """A piece vocabulary as arrays: a hash table of its pieces, their log weights, and what each id decodes to."""

    slots: np.ndarray  # 1 + index in `hashes`, one layer for each piece that falls on a slot
    hashes: np.ndarray
    ids: np.ndarray
    weights: np.ndarray
    longest: int
    in_use: np.ndarray  # by code point
    crossing: bool
    byte_ids: np.ndarray
    byte_weight: float
    decoded: list[bytes]


def load_pieces(model_file: str = MODEL_FILE, theta: float = THETA) -> Pieces:
    """Pieces of a SentencePiece model with byte fallback.

    The weight of a piece is theta times its log probability; a BPE model has ranks in place of probabilities and gets
    those of Zipf's law.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    n = model.get_piece_size()
    text, score = [model.id_to_piece(i) for i in range(n)], np.array([model.get_score(i) for i in range(n)])
    plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) and text[i]]
    logs = score[plain]
    if np.array_equal(logs, np.round(logs)):
        logs = -np.log(2 - logs)
    points = [np.frombuffer(text[i].encode("utf-32-le"), dtype=np.uint32) for i in plain]
    sums = Substrings(_codes(np.concatenate(points)))
    end = np.cumsum([len(p) for p in points])
    hashes = sums.hash(np.concatenate(([0], end[:-1])), end)
    slot = (hashes >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
    layers, rest = [], np.arange(len(plain))
    while len(rest):
        _, first = np.unique(slot[rest], return_index=True)
        layer = np.zeros(1 << _SLOT_BITS, dtype=np.int32)
        layer[slot[rest[first]]] = rest[first] + 1
        layers.append(layer)
        rest = np.delete(rest, first)
    in_use = np.zeros(_LITERAL + 1, dtype=bool)
    in_use[np.concatenate(points)] = True
    byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int32)
    decoded = [t.replace("▁", " ").encode() for t in text]
    for b, i in enumerate(byte_ids.tolist()):
        decoded[i] = bytes([b])
    crossing = any("▁" in text[i].lstrip("▁") for i in plain)
    return Pieces(np.array(layers), hashes, np.array(plain, dtype=np.int32), (theta * logs).astype(np.float32), max(map(len, points)), in_use, crossing, byte_ids, theta * float(logs.min()) - 1, decoded)


def _lookup(p: Pieces, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the hashes are those of pieces, and the pieces. A layer has a slot only if the layer before has another."""
    slot = (h >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
    found, pieces, rest = [], [], np.arange(len(h))
    for layer in p.slots:
        at = layer[slot[rest]]
        some = np.flatnonzero(at)
        rest, at = rest[some], at[some] - 1
        same = p.hashes[at] == h[rest]
        found.append(rest[same])
        pieces.append(at[same])
        rest = rest[~same]
    return np.concatenate(found), np.concatenate(pieces)


def _utf8_lengths(points: np.ndarray) -> np.ndarray:
    return 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)


def _utf8_byte(points: np.ndarray, k: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Byte k of the n bytes of each code point."""
    lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[n]
    return np.where(k == 0, lead | (points >> (6 * (n - 1))), 0x80 | ((points >> (6 * np.maximum(n - 1 - k, 0))) & 0x3F))


def sample(p: Pieces, texts: list[bytes], keys: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts one after the other, and the number of each text.

    A text's lattice has an edge for each piece that stands at a place in it, and one of byte pieces for a character
    that is none. The lattice falls apart where no piece can cross: before a space after another character, and around
    characters of no piece. Over the distinct parts of the chunk, weights are summed forward; then each part's last
    edge is drawn in proportion, the one before it, and so on to the part's start. What is drawn depends on the row's
    key, the place in the text and the seed alone, so rows can be encoded again anywhere with the same result.
    """
    points = [np.frombuffer(t.decode().encode("utf-32-le"), dtype=np.uint32) for t in texts]
    sizes = np.array([len(x) + 1 if len(x) else 0 for x in points])
    real = np.concatenate([np.concatenate(([32], x)) for x in points if len(x)] or [np.zeros(0, np.uint32)]).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    n = len(real)
    if not n:
        return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    points = np.where(real == 32, _SPACE, np.where(real == _SPACE, _LITERAL, real))
    known = p.in_use[points]
    cut = ~known
    cut[1:] |= ~known[:-1]
    if not p.crossing:
        cut[1:] |= (points[1:] == _SPACE) & (points[:-1] != _SPACE)
    cut[starts[sizes > 0]] = True
    begin = np.flatnonzero(cut)
    length = np.diff(np.concatenate((begin, [n])))
    _, which, part = np.unique(Substrings(_codes(points)).hash(begin, begin + length), return_index=True, return_inverse=True)

    # distinct parts, end to end
    size = length[which]
    base = np.cumsum(size) - size
    inside = np.arange(size.sum()) - np.repeat(base, size)
    flat = points[np.repeat(begin[which], size) + inside]
    sums = Substrings(_codes(flat))
    longest = min(p.longest, int(size.max()))
    ends, spans, kinds = [], [], []  # of each edge the place where it ends, its length less one, and its piece or -1
    bare = np.ones(len(flat), dtype=bool)
    for k in range(longest):
        end = np.flatnonzero(inside >= k)
        hit, piece = _lookup(p, sums.hash(end - k, end + 1))
        ends.append(end[hit])
        spans.append(np.full(len(hit), k))
        kinds.append(piece)
        if k == 0:
            bare[ends[0]] = False
            lone = np.flatnonzero(bare)
            ends.append(lone)
            spans.append(np.zeros(len(lone), dtype=np.int64))
            kinds.append(np.full(len(lone), -1, dtype=np.int32))
    # edges by the place in its part where they end, so that a step of all parts is a slice
    order = np.argsort(inside.astype(np.int32), kind="stable")
    rank = np.empty(len(flat), dtype=np.int64)
    rank[order] = np.arange(len(flat))
    first = np.zeros(len(flat) + 1, dtype=np.int64)
    for end in ends:
        first[rank[end] + 1] += 1  # an end is in each list once
    np.cumsum(first, out=first)
    free, span, kind = first[:-1].copy(), np.empty(first[-1], dtype=np.int64), np.empty(first[-1], dtype=np.int32)
    for end, k, piece in zip(ends, spans, kinds, strict=True):
        at = free[rank[end]]
        span[at], kind[at] = k, piece
        free[rank[end]] += 1
    place = np.repeat(order, np.diff(first))
    weight = np.where(kind >= 0, p.weights[kind], p.byte_weight * _utf8_lengths(flat[place]))
    before = np.where(inside[place] == span, len(flat), place - span - 1)
    total = np.zeros(len(flat) + 1)  # log of the summed weights of all ways to a place's end; the last is that to a start
    chance = np.empty(len(weight))  # of an edge and those before it at its place
    steps = np.searchsorted(inside[order], np.arange(int(size.max()) + 1))
    for i in range(int(size.max())):
        a, b = first[steps[i]], first[steps[i + 1]]
        heads, width = first[steps[i] : steps[i + 1]] - a, np.diff(first[steps[i] : steps[i + 1] + 1])
        ways = weight[a:b] + total[before[a:b]]
        top = np.maximum.reduceat(ways, heads)
        share = np.exp(ways - np.repeat(top, width))
        whole = np.add.reduceat(share, heads)
        total[order[steps[i] : steps[i + 1]]] = top + np.log(whole)
        upto = np.cumsum(share)
        chance[a:b] = (upto - np.repeat(upto[heads] - share[heads], width)) / np.repeat(whole, width)

    # draw backward, all parts at once
    text = np.repeat(np.arange(len(texts)), sizes)[begin]
    stream = mix64(mix64(keys.astype(np.int64).view(np.uint64)[text] + np.uint64(seed)) + (begin - starts[text]).astype(np.uint64))
    chosen = np.full(n, -1, dtype=np.int64)
    live, left = np.arange(len(begin)), length.copy()
    while len(live):
        end = rank[base[part[live]] + left[live] - 1]
        u = (mix64(stream[live] + left[live].astype(np.uint64)) >> np.uint64(40)).astype(np.float64) * 2.0**-24
        edge, last = first[end], first[end + 1] - 1
        beyond = np.flatnonzero((chance[edge] <= u) & (edge < last))
        while len(beyond):
            edge[beyond] += 1
            beyond = beyond[(chance[edge[beyond]] <= u[beyond]) & (edge[beyond] < last[beyond])]
        left[live] -= span[edge] + 1
        chosen[begin[live] + left[live]] = np.where(kind[edge] >= 0, p.ids[kind[edge]], -2)
        live = live[left[live] > 0]
    at = np.flatnonzero(chosen != -1)
    piece, char = chosen[at], real[at]
    times = np.where(piece >= 0, 1, _utf8_lengths(char))
    k = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    piece, char, long = np.repeat(piece, times), np.repeat(char, times), np.repeat(_utf8_lengths(char), times)
    ids = np.where(piece >= 0, piece, p.byte_ids[_utf8_byte(char, k, long)]).astype(np.int32)
    return ids, np.bincount(np.repeat(np.arange(len(texts)), sizes)[at], times, len(texts)).astype(np.int64)


def encode(spark: SparkSession, text: Column, key: Column, model_file: str = MODEL_FILE, theta: float = THETA, seed: int = SEED) -> Column:
    """array<int> of piece ids, sampled by the row's key (a long; null counts as 0). Null and empty texts: no pieces.
    Equal texts with equal keys get equal pieces."""
    bounded_batches(spark)
    pieces = spark.sparkContext.broadcast(load_pieces(model_file, theta))

    def run(text: pa.Array, key: pa.Array) -> pa.Array:
        rows, keys, out, counts = utf8_rows(text), key.to_numpy(zero_copy_only=False), [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
        for i, j in chunked(rows, CHUNK_BYTES):
            ids, n = sample(pieces.value, rows[i:j], keys[i:j], seed)
            out.append(ids)
            counts.append(n)
        return pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(counts)).astype(np.int32)), pa.array(np.concatenate(out)))

    return F.arrow_udf(run, "array<int>")(text.cast("string"), F.coalesce(key.cast("long"), F.lit(0)))


def decode(spark: SparkSession, pieces: Column, model_file: str = MODEL_FILE) -> Column:
    """The text of piece ids; null and empty arrays: the empty text."""
    decoded = load_pieces(model_file).decoded
    size = np.array([len(d) for d in decoded])
    table = spark.sparkContext.broadcast((np.frombuffer(b"".join(decoded), dtype=np.uint8), np.cumsum(size) - size, size))

    def run(pieces: pa.Array) -> pa.Array:
        letters, start, size = table.value
        offsets, ids, out, row = pieces.offsets.to_numpy(), pieces.values.to_numpy(), [], 0
        while row < len(pieces):
            end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_IDS)) - 1)
            part = ids[offsets[row] : offsets[end]]
            n = size[part]
            upto = np.concatenate(([0], np.cumsum(n)))
            text = letters[np.repeat(start[part] - upto[:-1], n) + np.arange(upto[-1])].tobytes()
            ends = upto[offsets[row : end + 1] - offsets[row]].tolist()
            out += [text[a + 1 : b] for a, b in zip(ends, ends[1:], strict=False)]  # without the space put first
            row = end
        return pa.array(out, pa.binary()).cast(pa.string())

    return F.arrow_udf(run, "string")(F.coalesce(pieces, F.array().cast("array<int>")))
