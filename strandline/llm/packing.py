"""Token ids of whole texts, packed into fixed-length rows.

Texts are cut into units on which the byte-level BPE works independently (a
word with the blank before it, a run of white space); each distinct unit of a
chunk is encoded once and all others are gathered by array operations. A
document's ids end with the end-of-text id. Documents longer than a row are
split without loss: full rows leave at once, the rest is packed best-fit
decreasing, where a segment tree over free capacities finds the tightest row
that still fits. Rows are packed within pools of ``POOL`` pieces of an input
partition, so that nothing is shuffled, memory is bounded, and a lost task
repeats only its own part.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from strandline.llm import wordhash as W

#: Where the vocabulary files are, and which is used; its ids end at 50255 and 50256 is free.
TOKENIZERS, RANKS, END = "/opt/tokenizers", "byte_bpe_multi_50k.tiktoken", 50256
#: How text is split before merges (fixed value that goes with the rank file).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Ids in a row, and pieces in a pool.
ROW, POOL = 2048, 8192
#: Units that a worker remembers before it starts anew.
REMEMBERED = 200_000

_U = np.uint64
_rng = np.random.default_rng(0xB17E)
_FIRST, _SECOND = (_rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1) for _ in range(2))


class Encoder:
    """A rank file's byte-level BPE with a memory of encoded units."""

    def __init__(self, ranks: bytes):
        import tiktoken

        self.bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}, special_tokens={})
        self.core = self.bpe._core_bpe
        self.line = self.core.encode_ordinary("\n")[0]
        self.forget()

    def forget(self) -> None:
        self.known: dict[int, int] = {}
        self.check, self.start, self.length = [np.zeros(0, _U)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        self.pool, self.used, self.filled = [np.zeros(0, np.uint16)], 0, 0

    def _ids(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units, end to end, and their lengths.

        Words are encoded in one call, a line each: the pattern cuts around a
        single line break. Where the breaks do not come out one for one (a
        unit that ends in other white space), units are encoded one by one.
        """
        ids = np.array(self.core.encode_ordinary("\n".join(found)), np.uint16)
        cuts = np.flatnonzero(ids == self.line)
        if len(cuts) == len(found) - 1:
            lengths = np.diff(np.concatenate(([-1], cuts, [len(ids)]))) - 1
            return np.delete(ids, cuts), lengths
        each = [self.core.encode_ordinary(x) for x in found]
        return np.array([x for e in each for x in e], np.uint16), np.array(list(map(len, each)), np.int64)

    def _learn(self, keys: np.ndarray, checks: np.ndarray, found: list[str]) -> np.ndarray:
        """Remember units; returns their places."""
        blank = [i for i, x in enumerate(found) if x.isspace()]
        words = [i for i, x in enumerate(found) if not x.isspace()]
        parts, order = [], [*words, *blank]
        if words:
            parts.append(self._ids([found[i] for i in words]))
        for i in blank:
            ids = np.array(self.core.encode_ordinary(found[i]), np.uint16)
            parts.append((ids, np.array([len(ids)])))
        lengths = np.concatenate([n for _, n in parts])
        self.pool.append(np.concatenate([x for x, _ in parts]))
        at = np.empty(len(found), np.int64)
        at[order] = self.used + np.arange(len(found))
        self.check.append(checks[order])
        self.start.append(self.filled + np.cumsum(lengths) - lengths)
        self.length.append(lengths)
        self.known.update(zip(keys[order].tolist(), range(self.used, self.used + len(found)), strict=True))
        self.used += len(found)
        self.filled += int(lengths.sum())
        for name in ("pool", "check", "start", "length"):
            setattr(self, name, [np.concatenate(getattr(self, name))])
        return at

    def encode(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts between ``bounds``, and where each text's ids begin."""
        if not len(raw):
            return np.zeros(0, np.uint16), np.zeros(len(bounds), np.int64)
        bounds = bounds - bounds[0]
        starts, ends = units(raw, bounds)
        up, down = W._pow(len(raw) + 1)
        keys = []
        for table in (_FIRST, _SECOND):
            sums = np.zeros(len(raw) + 1, _U)
            np.cumsum(table[raw] * up[: len(raw)], out=sums[1:])
            keys.append((sums[ends] - sums[starts]) * down[starts])
        key, first, where = np.unique(W.mix(keys[0] ^ (ends - starts).astype(_U)), return_index=True, return_inverse=True)
        if self.used > REMEMBERED:
            self.forget()
        data, check = raw.tobytes(), keys[1]
        at = np.array([self.known.get(k, -1) for k in key.tolist()], np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            f = first[new]
            at[new] = self._learn(key[new], check[f], [data[a:b].decode() for a, b in zip(starts[f].tolist(), ends[f].tolist(), strict=True)])
        at = at[where]
        if (self.check[0][at] != check).any():  # two units share a first hash: encode this chunk plainly
            ids = [self.bpe.encode_ordinary(data[a:b].decode()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            return np.array([x for t in ids for x in t], np.uint16), np.cumsum([0, *map(len, ids)])
        many = self.length[0][at]
        done = np.concatenate(([0], np.cumsum(many)))
        ids = self.pool[0][np.repeat(self.start[0][at] - done[:-1], many) + np.arange(done[-1])]
        return ids, done[np.searchsorted(starts, bounds)]


def units(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cut texts where the splitting pattern always cuts."""
    starts, ends, _ = W.spans(raw, bounds, W.NOT_SPACE)
    cut = np.zeros(len(raw) + 1, bool)
    edge = np.zeros(len(raw) + 1, bool)
    edge[bounds] = True
    cut[ends] = True
    blank = (starts > 0) & ~edge[starts]
    blank[blank] = raw[starts[blank] - 1] == 0x20
    cut[starts - blank] = True
    bare = starts[~blank & ~edge[starts]]  # white space before these ends in something other than a blank
    cut[bare - 1] = True
    cut |= edge
    at = np.flatnonzero(cut[:-1])
    return at, np.append(at[1:], len(raw))


_encoders: dict[int, Encoder] = {}


def encoder(ranks: bytes) -> Encoder:
    key = xxhash.xxh64_intdigest(ranks)
    if key not in _encoders:
        _encoders[key] = Encoder(ranks)
    return _encoders[key]


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: rows of piece numbers, none above ``capacity``.

    A segment tree over free capacities counts the open rows; its leftmost
    occupied leaf at or after a piece's length is the tightest row that fits.
    """
    leaves = 1 << capacity.bit_length()
    tree = [0] * (2 * leaves)
    open_rows: list[list[int]] = [[] for _ in range(capacity + 1)]
    rows: list[list[int]] = []

    def count(c: int, by: int) -> None:
        i = c + leaves
        while i:
            tree[i] += by
            i >>= 1

    for piece in sorted(range(len(lengths)), key=lambda p: -lengths[p]):
        n = lengths[piece]
        i = n + leaves
        if not tree[i]:
            while i > 1 and (i & 1 or not tree[i + 1]):
                i >>= 1
            i = i + 1 if i > 1 else 0
            while i and i < leaves:
                i = 2 * i if tree[2 * i] else 2 * i + 1
        if i:
            free = i - leaves
            row = open_rows[free].pop()
            count(free, -1)
        else:
            free, row = capacity, len(rows)
            rows.append([])
        rows[row].append(piece)
        if free > n:
            open_rows[free - n].append(row)
            count(free - n, 1)
    return rows


def _row(pieces: list[tuple], width: int) -> tuple:
    """A packed row: ids padded with the end id, segment bounds, and where positions start again."""
    ids = np.full(width, END, np.uint16)
    bounds = [0]
    for _, _, x in pieces:
        ids[bounds[-1] : bounds[-1] + len(x)] = x
        bounds.append(bounds[-1] + len(x))
    return ids.astype("<u2").tobytes(), bounds, bounds[:-1], [p[0] for p in pieces], [p[1] for p in pieces], bounds[-1]


def _packer(sent, width: int, pool: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        bpe = encoder(sent.value)
        waiting: list[tuple] = []
        kind = None

        def batch(rows):
            types = (pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(kind), pa.list_(pa.int64()), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["ids", "cu_seqlens", "position_resets", "doc_ids", "doc_offsets", "n_tokens"])

        def flush():
            rows = best_fit([len(w[2]) for w in waiting], width)
            for i in range(0, len(rows), 256):
                yield batch([_row([waiting[p] for p in row], width) for row in rows[i : i + 256]])
            waiting.clear()

        for rb in batches:
            kind = rb.column(0).type
            doc_ids = rb.column(0).to_pylist()
            raw, bounds = W.text_bytes(rb.column(1))
            for a, b in W.chunks(bounds):
                ids, at = bpe.encode(raw[bounds[a] : bounds[b]], bounds[a : b + 1])
                full = []
                for i in range(a, b):
                    own = np.append(ids[at[i - a] : at[i - a + 1]], np.uint16(END))
                    for s in range(0, len(own), width):
                        piece = (doc_ids[i], s, own[s : s + width])
                        if len(piece[2]) == width:
                            full.append(_row([piece], width))
                        else:
                            waiting.append(piece)
                    if len(full) >= 256:
                        yield batch(full)
                        full = []
                    if len(waiting) >= pool:
                        yield from flush()
                if full:
                    yield batch(full)
        if waiting:
            yield from flush()

    return run


def read_ranks(name: str = RANKS, folder: str = TOKENIZERS) -> bytes:
    with open(os.path.join(folder, name), "rb") as f:
        return f.read()


def pack(docs: DataFrame, width: int = ROW, pool: int = POOL, ranks: str = RANKS, folder: str = TOKENIZERS) -> DataFrame:
    """Packed rows of all texts of ``docs(doc_id, text)``.

    ``ids``: ``width`` little-endian uint16 ids (the end id fills up a row);
    ``cu_seqlens``: cumulative lengths of the row's segments, from 0;
    ``position_resets``: where positions start again at 0; ``doc_ids`` and
    ``doc_offsets``: each segment's document, and its place among that
    document's ids; ``n_tokens``: ids before the filling. Every row of ``docs``
    is in the output, whole: null and empty texts as a lone end id, repeated
    rows repeatedly, a null doc_id as null. An empty table gives no rows. Very
    long texts are split over rows; the longest one's ids bound a task's memory.
    Pieces that tie in length are placed in input order. Which pieces share a
    row follows from how the input is split, so that differently split files
    give other rows of the same pieces. Other columns, whatever their names, are
    not read. The rank file is read on the driver.
    """
    spark: SparkSession = docs.sparkSession
    base = docs.select("doc_id", "text")
    kind = base.schema["doc_id"].dataType.simpleString()
    sent = spark.sparkContext.broadcast(read_ranks(ranks, folder))  # about 1 MB
    return base.mapInArrow(_packer(sent, width, pool), f"ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<{kind}>, doc_offsets array<bigint>, n_tokens int")


def positions(resets: list[int], n_tokens: int, width: int) -> np.ndarray:
    """Position ids of a row from its resets; the filling counts on from its own start."""
    starts = np.array([*resets, n_tokens] if n_tokens < width else resets, np.int64)
    return np.arange(width) - np.repeat(starts, np.diff(np.append(starts, width)))
