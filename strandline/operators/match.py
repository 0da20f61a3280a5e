"""Exact matches between sequences without a suffix array.

Seeds are k-mers with k equal to the least match length, found by an equi-join;
runs of seeds on one diagonal are maximal exact matches; a match that no other
contains on either sequence is a maximal unique match. Seeds are joined by
128-bit rolling hashes, which numpy makes of whole texts in Arrow batches. Where
the reference has few k-mers, their hashes go to every task and only hits leave
it; otherwise both sides meet in a shuffled join.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.intervals import islands
from strandline.operators.suffix import shared_strings
from strandline.session import dealt, spread

#: Characters of a chunk, besides the overlap of k - 1.
CHUNK = 256
#: k-mers of a reference that are sent to every task, at most (16 MB); positions that are hashed at once.
SENT_KMERS, POSITIONS = 1_000_000, 1 << 16
#: Different k-mers that a task counts before it passes them on, k-mers that wait to be merged with them, and parts that they are dealt to.
HELD_KMERS, WAITING, PARTS = 1 << 22, 1 << 21, 1024

_U = np.uint64
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


@lru_cache(8)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    out = []
    for x in (base, pow(base, -1, 1 << 64)):
        full = np.full(n, x, _U)
        full[0] = 1
        out.append(np.cumprod(full, dtype=_U))
    return out[0], out[1]


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(29))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(32))


def _pair(own: np.ndarray, k: int) -> list[np.ndarray]:
    """Two hashes of each k-mer of up to POSITIONS + k - 1 letters."""
    pair = []
    for base in _BASES:
        up, down = _powers(base, POSITIONS + k)
        sums = np.zeros(len(own) + 1, _U)
        np.cumsum(_spread(own + _U(base >> 7)) * up[: len(own)], out=sums[1:])
        pair.append(_spread((sums[k:] - sums[:-k]) * down[: len(own) - k + 1]))
    return pair


def rolling(text: str, k: int, stop: str = "") -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Positions of the k-mers of a text without a letter of ``stop``, and two hashes of each, in bounded pieces."""
    letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    bad = np.isin(letters, [ord(c) for c in stop]) if stop else None
    for a in range(0, len(letters) - k + 1, POSITIONS):
        own = letters[a : a + POSITIONS + k - 1].astype(_U)
        n = len(own) - k + 1
        pos = np.arange(a, a + n)
        pair = [h.view(np.int64) for h in _pair(own, k)]
        if bad is not None:
            seen = np.concatenate(([0], np.cumsum(bad[a : a + len(own)])))
            fine = seen[k:] == seen[:-k]
            pos, pair = pos[fine], [h[fine] for h in pair]
        yield pos, pair[0], pair[1]


def _hashed(k: int, stop: str, sent=None):
    """Rows of key, position and hashes; with ``sent`` only of k-mers whose first hash is among the sorted ones."""

    def run(batches):
        known = None if sent is None else sent.value
        for rb in batches:
            for i, text in enumerate(rb.column(1).to_pylist()):
                for pos, h1, h2 in rolling(text or "", k, stop):
                    if known is not None:
                        at = np.minimum(np.searchsorted(known, h1), len(known) - 1)
                        hit = known[at] == h1
                        pos, h1, h2 = pos[hit], h1[hit], h2[hit]
                    if len(pos):
                        yield pa.RecordBatch.from_arrays([rb.column(0).take(pa.array(np.full(len(pos), i))), pa.array(pos, pa.int64()), pa.array(h1), pa.array(h2)], ["key", "pos", "h1", "h2"])

    return run


def hashed_kmers(df: DataFrame, key: str, seq: str, k: int, stop: str = "", sent=None) -> DataFrame:
    """``key, pos, h1, h2``: the k-mers of every sequence by 128 bits of hash; none that holds a letter of ``stop``."""
    kind = df.schema[key].dataType.simpleString()
    return spread(df.select(F.col(key).alias("key"), F.col(seq).alias("seq"))).mapInArrow(_hashed(k, stop, sent), f"key {kind}, pos bigint, h1 bigint, h2 bigint")


def _named(texts: list[str | None], k: int, stop: str) -> Iterator[tuple[bool, tuple[np.ndarray, ...]]]:
    """The k-mers of texts by name, in bounded pieces.

    A k-mer whose letters fit into 64 bits together (k = 8: Latin-1) is named
    by them, any other (a wide one) by 128 bits of hash, the last of them set.
    """
    letters = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t or "") for t in texts])
    bits, barred = 64 // k, [ord(c) for c in stop]
    for a in range(0, len(letters) - k + 1, POSITIONS):
        own = letters[a : a + POSITIONS + k - 1]
        first = np.zeros(len(own) + 1, bool)  # letters that begin a text
        first[ends[np.searchsorted(ends, a) : np.searchsorted(ends, a + len(own), "right")] - a] = True
        held = lambda marks, skip=0: (seen := np.concatenate(([0], np.cumsum(marks))))[k:] != seen[skip : len(seen) - k + skip]  # noqa: E731  whether a k-mer has a mark, after its first letters
        fine = ~held(first[:-1], 1)
        if barred:
            fine &= ~held(np.isin(own, barred))
        wide = held(own >> bits > 0) if bits < 32 else np.zeros(len(fine), bool)
        own = own.astype(_U)
        if (narrow := fine & ~wide).any():
            name = np.zeros(len(fine), _U)
            for i in range(k):
                name = (name << _U(bits)) | own[i : len(fine) + i]
            yield False, (name[narrow],)
        if (wide := fine & wide).any():
            h1, h2 = _pair(own, k)
            yield True, (h1[wide], h2[wide] | _U(1))


class _Tally:
    """Different names in order and how often each was added."""

    def __init__(self, width: int):
        self.keys, self.n = (np.zeros(0, _U),) * width, np.zeros(0, np.int64)
        self.waiting, self.rows = [], 0

    def add(self, keys: tuple[np.ndarray, ...], n: np.ndarray | None = None) -> None:
        """Names, each once for ``n`` of None."""
        self.waiting.append((keys, n))
        self.rows += len(keys[0])
        if self.rows >= WAITING:
            self.merge()

    def merge(self) -> None:
        plain, summed = ([x for x in self.waiting if (x[1] is None) == none] for none in (True, False))
        self.waiting, self.rows = [], 0
        if plain:
            summed.append(self._sums(tuple(map(np.concatenate, zip(*(x[0] for x in plain), strict=True))), None))
        if summed:
            summed.append((self.keys, self.n))
            self.keys, self.n = self._sums(tuple(map(np.concatenate, zip(*(x[0] for x in summed), strict=True))), np.concatenate([x[1] for x in summed]))

    @staticmethod
    def _sums(keys: tuple[np.ndarray, ...], n: np.ndarray | None) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
        if n is None and len(keys) == 1:
            keys = (np.sort(keys[0]),)
        else:
            order = np.lexsort(keys[::-1])
            keys, n = tuple(x[order] for x in keys), None if n is None else n[order]
        new = np.ones(len(keys[0]), bool)
        new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in keys])
        at = np.flatnonzero(new)
        return tuple(x[at] for x in keys), np.diff(at, append=len(new)) if n is None else np.add.reduceat(n, at)


def _packed(keys: tuple[np.ndarray, ...], n: np.ndarray) -> bytes:
    """Ordered names as differences, and their counts: equal bytes of the numbers side by side, compressed."""
    cols = [np.diff(keys[0], prepend=_U(0)), *keys[1:], n.astype(_U)]
    return pa.compress(b"".join(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes() for x in cols), codec="zstd", asbytes=True)


def _unpacked(data: bytes, rows: int, width: int) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    raw = np.frombuffer(pa.decompress(data, 8 * rows * (width + 1), codec="zstd", asbytes=True), np.uint8).reshape(width + 1, 8, rows)
    cols = [np.ascontiguousarray(x.T).view(_U).ravel() for x in raw]
    return (np.cumsum(cols[0], dtype=_U), *cols[1:-1]), cols[-1].view(np.int64)


def _counted(k: int, stop: str):
    """``part, wide, n, data``: the k-mers of a partition of texts, counted and dealt to parts.

    Names that differ in their last letters only are in one part, where they lie close.
    """
    ending = _U(64 // k * min(3, k // 2))

    def leave(tally: _Tally, wide: bool) -> Iterator[pa.RecordBatch]:
        part = ((tally.keys[0] if wide else _spread(tally.keys[0] >> ending)) % _U(PARTS)).astype(np.int16)
        order = np.argsort(part, kind="stable")
        edge = np.searchsorted(part[order], np.arange(PARTS + 1))
        rows = [(i, wide, b - a, _packed(tuple(x[order[a:b]] for x in tally.keys), tally.n[order[a:b]])) for i, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if b > a]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (pa.int32(), pa.bool_(), pa.int64(), pa.binary()), strict=True)], ["part", "wide", "n", "data"])

    def run(batches):
        held = [_Tally(1), _Tally(2)]
        for rb in batches:
            for wide, keys in _named(rb.column(0).to_pylist(), k, stop):
                held[wide].add(keys)
                if len(held[wide].n) >= HELD_KMERS:
                    held[wide].merge()
                    yield from leave(held[wide], wide)
                    held[wide] = _Tally(1 + wide)
        for wide, tally in enumerate(held):
            tally.merge()
            yield from leave(tally, bool(wide))

    return run


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the k-mers of each part, of rows sorted by ``part, wide``."""

    def leave(tally: _Tally) -> pa.RecordBatch:
        tally.merge()
        h1, h2 = tally.keys if len(tally.keys) > 1 else (tally.keys[0], np.zeros(len(tally.n), _U))
        return pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(tally.n)], ["h1", "h2", "n"])

    now, tally = None, None
    for rb in batches:
        for part, wide, n, data in zip(*(c.to_pylist() for c in rb.columns), strict=True):
            if (part, wide) != now:
                if tally is not None:
                    yield leave(tally)
                now, tally = (part, wide), _Tally(1 + wide)
            tally.add(*_unpacked(data, n, 1 + wide))
    if tally is not None:
        yield leave(tally)


def kmer_counts(df: DataFrame, seq: str, k: int, stop: str = "") -> DataFrame:
    """``h1, h2, n``: how often each k-mer occurs.

    Tasks count what they read, up to HELD_KMERS different k-mers at a time;
    ordered runs of them are shuffled, a few bytes for each, and merged.
    """
    runs = spread(df.select(seq)).mapInArrow(_counted(k, stop), "part int, wide boolean, n bigint, data binary")
    return dealt(runs, "part", "wide").sortWithinPartitions("part", "wide").mapInArrow(_together, "h1 bigint, h2 bigint, n bigint")


def kmers(df: DataFrame, keys: list[str], seq: str, k: int, chunk: int = CHUNK) -> DataFrame:
    """``keys, pos, kmer`` for every 0-based position of every sequence."""
    n = F.char_length(seq)
    parts = df.where(n >= k).select(*keys, F.col(seq).alias("__s"), F.explode(F.sequence(F.lit(0), n - k, F.lit(chunk))).alias("__at"))
    parts = parts.select(*keys, "__at", F.substring("__s", F.col("__at") + 1, F.lit(chunk + k - 1)).alias("__c"))
    pos = parts.select(*keys, "__at", "__c", F.explode(F.sequence(F.lit(0), F.char_length("__c") - k)).alias("__i"))
    return pos.select(*keys, (F.col("__at") + F.col("__i")).cast("bigint").alias("pos"), F.substring("__c", F.col("__i") + 1, F.lit(k)).alias("kmer"))


def seeds(ref: DataFrame, qry: DataFrame, ref_key: str, qry_key: str, ref_seq: str, qry_seq: str, k: int, stop: str = "") -> DataFrame:
    """Equal k-mers without a letter of ``stop``: ``ref_key, r_pos, qry_key, q_pos``."""
    spark = ref.sparkSession
    a = hashed_kmers(ref, ref_key, ref_seq, k, stop)
    least = F.sum(F.greatest(F.char_length(ref_seq) - (k - 1), F.lit(0)))
    sent = None
    if (ref.agg(least).first()[0] or 0) <= SENT_KMERS:
        known = np.unique(a.select("h1").distinct().toPandas()["h1"].to_numpy(np.int64))  # SENT_KMERS at most
        if not len(known):
            known = np.zeros(1, np.int64)
        sent = spark.sparkContext.broadcast(known)
    b = hashed_kmers(qry, qry_key, qry_seq, k, stop, sent)
    a = a.select(F.col("key").alias(ref_key), F.col("pos").alias("r_pos"), "h1", "h2")
    b = b.select(F.col("key").alias(qry_key), F.col("pos").alias("q_pos"), "h1", "h2")
    return a.join(b, ["h1", "h2"]).select(ref_key, "r_pos", qry_key, "q_pos")


def mems(found: DataFrame, ref_key: str, qry_key: str, k: int) -> DataFrame:
    """Maximal exact matches from seeds: ``ref_key, qry_key, r_start, q_start, length``."""
    diagonal = found.withColumn("diag", F.col("q_pos") - F.col("r_pos"))
    w = Window.partitionBy(ref_key, qry_key, "diag").orderBy("r_pos")
    runs = islands(diagonal, [ref_key, qry_key, "diag"], ["r_pos"], F.col("r_pos") != F.lag("r_pos").over(w) + 1)
    return runs.groupBy(ref_key, qry_key, "diag", "island").agg(F.min("r_pos").alias("r_start"), F.min("q_pos").alias("q_start"), (F.count(F.lit(1)) + (k - 1)).alias("length")).drop("diag", "island")


def mums(matches: DataFrame, ref_key: str, qry_key: str) -> DataFrame:
    """Matches that no other match of the same pair contains on either sequence."""
    keys = [ref_key, qry_key]
    out = matches
    for axis in ("r", "q"):
        s, e = F.col(f"{axis}_start"), F.col(f"{axis}_start") + F.col("length")
        before = Window.partitionBy(*keys).orderBy(s, e.desc()).rowsBetween(Window.unboundedPreceding, -1)
        same = Window.partitionBy(*keys, f"{axis}_start", "length")
        out = out.withColumn(f"__{axis}", F.coalesce(F.max(e).over(before) >= e, F.lit(False)) | (F.count(F.lit(1)).over(same) > 1))
    return out.where("not __r and not __q").drop("__r", "__q")


def multi_matches(seqs: DataFrame, sample: str, key: str, seq: str, k: int, least: int = 2, repeats: bool = False, stop: str = "") -> DataFrame:
    """Maximal matches of ``least`` or more samples: ``string, length, samples, occurrences``.

    A match is maximal if its occurrences differ in what comes before and in
    what comes after (an end or a stop letter differs from everything). Without
    ``repeats`` it occurs once in each of its samples. They are the intervals of
    shared prefixes in the suffix order of all sequences, so that no two
    occurrences are ever paired; what goes into the result are its rows alone.
    """
    found = shared_strings(seqs, sample, key, seq, k, repeats, stop)
    differ = lambda c: F.count_distinct(c) + F.count_if(F.col(c).isNull()) > 1
    place = F.struct(F.col("sample").alias(sample), F.col("key").alias(key), "pos")
    grouped = found.groupBy("idx_from", "idx_to", "length").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("sample").alias("samples"), (differ("left") & differ("right")).alias("maximal"), F.array_sort(F.collect_list(place)).alias("occurrences"), F.min(F.struct("sample", "key", "pos")).alias("one"))
    once = F.lit(True) if repeats else F.col("n") == F.col("samples")
    kept = grouped.where(once & (F.col("samples") >= least) & F.col("maximal"))
    text = seqs.select(F.col(sample).alias("__sample"), F.col(key).alias("__key"), F.col(seq).alias("__seq"))
    rows = kept.join(text, (F.col("one.sample") == F.col("__sample")) & (F.col("one.key") == F.col("__key")))
    return rows.select(F.substring("__seq", (F.col("one.pos") + 1).cast("int"), F.col("length").cast("int")).alias("string"), "length", "samples", "occurrences")


def multi_mums(seqs: DataFrame, sample: str, key: str, seq: str, k: int, least: int = 2, stop: str = "") -> DataFrame:
    """Maximal matches that occur exactly once in each of ``least`` or more samples."""
    return multi_matches(seqs, sample, key, seq, k, least, False, stop)


def multi_mems(seqs: DataFrame, sample: str, key: str, seq: str, k: int, least: int = 2, stop: str = "") -> DataFrame:
    """Maximal matches of ``least`` or more samples, which can occur in each more than once."""
    return multi_matches(seqs, sample, key, seq, k, least, True, stop)


def same_samples(matches: DataFrame, sample: str) -> DataFrame:
    """The matches of :func:`multi_matches` that occur in just the samples of the best one: that of most samples, then of most letters, then the first."""
    names = F.array_sort(F.array_distinct(F.transform("occurrences", lambda o: o[sample])))
    named = matches.withColumn("__names", names)
    best = named.agg(F.max(F.struct("samples", "length")).alias("__m"))
    top = best.select(F.col("__m.samples").alias("__s"), F.col("__m.length").alias("__l"))
    first = named.join(F.broadcast(top), (F.col("samples") == F.col("__s")) & (F.col("length") == F.col("__l"))).agg(F.min_by("__names", "string").alias("__best"))  # one row
    return named.join(F.broadcast(first), F.col("__names") == F.col("__best")).select(*matches.columns)


def combinations(matches: DataFrame, sample: str) -> DataFrame:
    """Each match with every choice of one occurrence in each of its samples: ``string, length, places``."""
    names = F.array_sort(F.array_distinct(F.transform("occurrences", lambda o: o[sample])))
    by = F.transform(names, lambda s: F.filter("occurrences", lambda o: o[sample] == s))
    none = F.slice(F.array(F.slice("occurrences", 1, 0)), 1, 1)
    every = F.aggregate(by, none, lambda acc, own: F.flatten(F.transform(acc, lambda a: F.transform(own, lambda o: F.concat(a, F.array(o))))))
    return matches.select("string", "length", F.explode(every).alias("places"))
