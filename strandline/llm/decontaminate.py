"""Benchmark decontamination as a prefix-filtered set join.

A benchmark item is cut into windows of ``window`` consecutive words (a shorter
item is one window). A window's elements are its word shingles. A document can
only contain a window if it has all of its elements, so by the prefix principle
one of them is enough to find every candidate: the rarest one, by document
frequency over the whole corpus. A candidate fixes where the window would have
to start, so length and position bounds follow; then the window's words are
compared exactly.

The benchmark is a stated query set: it is handled in blocks of at most
``BLOCK_WINDOWS`` windows, and only a block is ever sent to the executors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm import wordhash as W
from strandline.session import materialise

#: Words of a window, and of the shingles that are a window's elements.
WINDOW, SHINGLE = 10, 3
#: Windows in a block; at about 250 bytes each a broadcast stays under 32 MB.
BLOCK_WINDOWS = 100_000

_U = np.uint64
_BITS = 20


def _item_windows(window: int, shingle: int):
    """Windows of the items: key, words as text, item, length, and the hashes of the elements."""

    def run(batches):
        for rb in batches:
            ids = rb.column(0).to_pylist()
            raw, bounds = W.text_bytes(rb.column(1))
            h, starts, ends, at = W.word_hashes(raw, bounds, W.ALNUM)
            words = [raw[a:b].tobytes().lower().decode() for a, b in zip(starts, ends, strict=True)]
            out: list[tuple] = []
            for d, item in enumerate(ids):
                lo, hi = int(at[d]), int(at[d + 1])
                for s in range(lo, max(hi - window, lo) + 1) if hi > lo else ():
                    n = min(window, hi - s)
                    k = min(shingle, n)
                    elements = W.combine([h[s + i : s + n - k + 1 + i] for i in range(k)])
                    out.append((int(W.combine([h[s + i : s + i + 1] for i in range(n)]).view(np.int64)[0]), " ".join(words[s : s + n]), "" if item is None else str(item), n, elements.view(np.int64).tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.int64())))], ["key", "words", "item", "n", "elements"])

    return run


def _lookup(tokens: np.ndarray) -> np.ndarray:
    table = np.zeros(1 << _BITS, bool)
    table[(tokens >> _U(64 - _BITS)).astype(np.int64)] = True
    return table


def _positions(h: np.ndarray, at: np.ndarray, k: int, tokens: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where k-word shingles equal a token, inside one text: position, token, text."""
    if len(h) < k or not len(tokens):
        none = np.zeros(0, np.int64)
        return none, none, none
    s = W.combine([h[i : len(h) - k + 1 + i] for i in range(k)])
    p = np.flatnonzero(table[(s >> _U(64 - _BITS)).astype(np.int64)])
    t = np.minimum(np.searchsorted(tokens, s[p]), len(tokens) - 1)
    same = tokens[t] == s[p]
    p, t = p[same], t[same]
    d = np.searchsorted(at, p, "right") - 1
    inside = p + k <= at[d + 1]
    return p[inside], t[inside], d[inside]


def _frequency(sent):
    """Documents that hold each element, summed over a task."""

    def run(batches):
        lengths = [(k, np.asarray(t), _lookup(t)) for k, t in sent.value]
        counts = [np.zeros(len(t), np.int64) for _, t, _ in lengths]
        for rb in batches:
            raw, bounds = W.text_bytes(rb.column(0))
            for a, b in W.chunks(bounds):
                h, _, _, at = W.word_hashes(raw[bounds[a] : bounds[b]], bounds[a : b + 1], W.ALNUM)
                for (k, tokens, table), n in zip(lengths, counts, strict=True):
                    _, t, d = _positions(h, at, k, tokens, table)
                    n += np.bincount(np.unique(d * len(tokens) + t) % len(tokens), minlength=len(tokens))
        tokens = np.concatenate([t for _, t, _ in lengths]).view(np.int64)
        total = np.concatenate(counts)
        yield pa.RecordBatch.from_arrays([pa.array(tokens[total > 0]), pa.array(total[total > 0])], ["token", "n"])

    return run


class Block:
    """Windows with their rarest elements, ready to be matched."""

    def __init__(self, windows: pd.DataFrame, frequency: dict[int, int], shingle: int):
        windows = windows.drop_duplicates(["key", "words", "item"])
        self.items = [sorted(x) for x in windows.groupby(["key", "words"], sort=True)["item"].agg(list)]
        one = windows.drop_duplicates(["key", "words"]).sort_values(["key", "words"], kind="stable")
        self.keys = one.key.to_numpy(np.int64).view(_U)
        self.words = one.words.tolist()
        self.n = one.n.to_numpy(np.int64)
        entries: dict[int, list[tuple[int, int, int]]] = {}
        for w, (n, elements) in enumerate(zip(one.n, one.elements, strict=True)):
            rare, o = min((frequency.get(int(e), 0), i) for i, e in enumerate(elements))
            if rare:  # else no document has all elements
                entries.setdefault(min(shingle, int(n)), []).append((int(elements[o]) & 0xFFFFFFFFFFFFFFFF, w, o))
        self.prefixes = []
        for k, rows in sorted(entries.items()):
            rows.sort()
            token = np.array([x[0] for x in rows], _U)
            tokens, first = np.unique(token, return_index=True)
            self.prefixes.append((k, tokens, _lookup(tokens), np.append(first, len(rows)), np.array([x[1] for x in rows], np.int64), np.array([x[2] for x in rows], np.int64)))

    def match(self, column: pa.Array):
        """For each chunk of texts: words, words hit, sorted items of each text, and (text, start, end) of the windows found."""
        raw, bounds = W.text_bytes(column)
        for a, b in W.chunks(bounds):
            part = raw[bounds[a] : bounds[b]]
            h, starts, ends, at = W.word_hashes(part, bounds[a : b + 1], W.ALNUM)
            found: list[tuple[int, int, int]] = []  # text, window, start
            for k, tokens, table, first, window, offset in self.prefixes:
                p, t, d = _positions(h, at, k, tokens, table)
                many = first[t + 1] - first[t]
                row = np.repeat(first[t] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                p, d, w = np.repeat(p, many) - offset[row], np.repeat(d, many), window[row]
                fits = (p >= at[d]) & (p + self.n[w] <= at[d + 1])
                p, d, w = p[fits], d[fits], w[fits]
                for n in np.unique(self.n[w]):
                    m = np.flatnonzero(self.n[w] == n)
                    m = m[W.combine([h[p[m] + i] for i in range(n)]) == self.keys[w[m]]]
                    for x in m:
                        s = int(p[x])
                        text = b" ".join(part[starts[s + i] : ends[s + i]].tobytes() for i in range(n)).lower()
                        if text == self.words[w[x]].encode():
                            found.append((int(d[x]), int(w[x]), s))
            cover = np.zeros(len(h) + 1, np.int64)
            if found:
                f = np.array(found)
                np.add.at(cover, f[:, 2], 1)
                np.add.at(cover, f[:, 2] + self.n[f[:, 1]], -1)
            hit = np.concatenate(([0], np.cumsum(np.cumsum(cover)[:-1] > 0)))
            items: list[set[str]] = [set() for _ in range(b - a)]
            where: list[list[tuple[int, int]]] = [[] for _ in range(b - a)]
            for d, w, s in found:
                items[d].update(self.items[w])
                where[d].append((s - int(at[d]), s - int(at[d]) + int(self.n[w])))
            yield np.diff(at), hit[at[1:]] - hit[at[:-1]], [sorted(x) for x in items], where


def blocks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block_windows: int = BLOCK_WINDOWS) -> Iterator[tuple]:
    """One after the other, broadcast blocks of the benchmark's windows, their elements ordered by rarity over ``docs``, and whether it is the only one."""
    spark = docs.sparkSession
    kinds = "key bigint, words string, item string, n int, elements array<bigint>"
    windows = materialise(benchmark.select("item_id", "text").mapInArrow(_item_windows(window, shingle), kinds), "windows")
    total = windows.count()
    cuts = max(1, -(-total // block_windows))
    for c in range(cuts):
        own = windows.where(F.pmod(F.xxhash64("key"), F.lit(cuts)) == c) if cuts > 1 else windows
        held = own.toPandas()  # one block, bounded by block_windows on average
        by: dict[int, set[int]] = {}
        for n, elements in zip(held.n, held.elements, strict=True):
            by.setdefault(min(shingle, int(n)), set()).update(int(e) & 0xFFFFFFFFFFFFFFFF for e in elements)
        frequency: dict[int, int] = {}
        if by:
            sent = spark.sparkContext.broadcast([(k, np.array(sorted(t), _U)) for k, t in sorted(by.items())])
            counted = docs.select("text").mapInArrow(_frequency(sent), "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
            frequency = {r.token: r.n for r in counted.collect()}  # elements of this block only
        block = spark.sparkContext.broadcast(Block(held, frequency, shingle))
        yield block, cuts == 1
        if cuts > 1:  # its hits are written by now
            block.unpersist()


_SPANS = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
_FOUND = "n_words bigint, items array<string>, spans array<struct<s: bigint, e: bigint>>"


def _matches(sent, keys: int):
    """Of every row its first ``keys`` columns, words, items found, and spans of their windows in words."""

    def run(batches):
        block = sent.value
        for rb in batches:
            a = 0
            for n, _, items, where in block.match(rb.column(keys)):
                spans = pa.array([[{"s": s, "e": e} for s, e in own] for own in where], _SPANS)
                yield pa.RecordBatch.from_arrays([*(rb.column(i).slice(a, len(n)) for i in range(keys)), pa.array(n, pa.int64()), pa.array(items, pa.list_(pa.string())), spans], [*rb.schema.names[:keys], "n_words", "items", "spans"])
                a += len(n)

    return run


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """``(doc_id, n_words, items array<string>, spans array<struct<s, e>>)`` for every row of ``docs(doc_id, text)``: benchmark items whose windows occur, and where, from word ``s`` to before word ``e``.

    Null and empty texts have no words, items without words no windows, and a
    null item_id counts as an empty one. Rows that repeat a doc_id, or have
    none, each get a row; items that share an id count as one. With an empty
    benchmark nothing is found, without documents the result is empty. Very
    long texts are read in chunks of whole texts, the longest one bounding a
    task's memory. Windows that tie in rarity take the first shingle. Other
    columns, whatever their names, are not read. One block of windows needs no
    shuffle; more are passes of their own, merged by document.
    """
    base = docs.select("doc_id", "text")
    kind = base.schema["doc_id"].dataType.simpleString()
    marked = base.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    parts = None
    for sent, only in blocks(base, benchmark, window, shingle, block_windows):
        if only:
            return base.mapInArrow(_matches(sent, 1), f"doc_id {kind}, {_FOUND}")
        own = materialise(marked.mapInArrow(_matches(sent, 2), f"doc_id {kind}, mark bigint, {_FOUND}").where("size(items) > 0").drop("n_words"), "hits")
        parts = own if parts is None else parts.unionByName(own)
    every = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    hits = parts.groupBy("doc_id", "mark").agg(every("items"), every("spans")).select(F.col("doc_id").alias("hit_id"), F.col("mark").alias("hit_mark"), "items", "spans")
    words = marked.mapInArrow(_count_words, f"doc_id {kind}, mark bigint, n_words bigint")
    out = words.join(hits, words.doc_id.eqNullSafe(hits.hit_id) & words.mark.eqNullSafe(hits.hit_mark), "left")
    return out.select("doc_id", "n_words", *[F.coalesce(c, F.array().cast(hits.schema[c].dataType)).alias(c) for c in ("items", "spans")])


def _count_words(batches):
    for rb in batches:
        raw, bounds = W.text_bytes(rb.column(2))
        yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), pa.array(np.diff(W.spans(raw, bounds, W.ALNUM)[2]), pa.int64())], ["doc_id", "mark", "n_words"])


def words_hit(spans: Column) -> Column:
    """How many words lie in any of the spans."""
    zero = F.lit(0).cast("bigint")
    add = lambda acc, x: F.struct(F.greatest(acc["to"], x["e"]).alias("to"), (acc["n"] + F.greatest(zero, x["e"] - F.greatest(acc["to"], x["s"]))).alias("n"))
    return F.aggregate(F.array_sort(spans), F.struct(zero.alias("to"), zero.alias("n")), add)["n"]


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)``: counts and a digest of :func:`find_contamination`."""
    found = find_contamination(docs, benchmark, **options).withColumn("n_hit", words_hit(F.col("spans")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def _clean(sent, column: int) -> Callable:
    def run(batches):
        block = sent.value
        for rb in batches:
            hit = [x[1] for x in block.match(rb.column(column))]
            yield rb.filter(pa.array(np.concatenate(hit) == 0)) if hit else rb

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that hold any window of the benchmark; columns stay as they are, whatever their names.

    Null and empty texts hold none, repeated rows go or stay together.
    """
    rest = docs
    for sent, only in blocks(docs, benchmark, **options):
        rest = rest.mapInArrow(_clean(sent, docs.columns.index("text")), docs.schema)
        if not only:
            rest = materialise(rest, "clean")
    return rest
