"""MinHash near-dedup on HyperMinHash registers.

Every text becomes the set of its distinct word shingles (64-bit hashes). The
set's HyperMinHash sketch keeps, per bucket, the leading-zero count of the
smallest hash and the mantissa bits that follow. Bands of registers are
candidate keys; a collision-corrected Jaccard estimate drops chance
candidates; what is left is confirmed on the full sets.

A small set leaves most buckets empty, so that a band often holds a single
element and any common line makes a candidate, in groups that grow with the
corpus. Bands of small sets are therefore of minima of the whole set under as
many multipliers; sets about the border have both kinds.

No group is ever expanded into all its pairs:

1. texts with equal sets are one class (a digest, combined on the map side);
2. in each band group every class is compared with the group's smallest one;
3. what these links connect is contracted; band groups that still hold two
   unconnected members (apart from the smallest) are first reduced to members
   with a plausible partner, by sketches alone, and then compared in full, in
   blocks of bounded bytes. A pair is looked at in its first common band only,
   and a block returns a spanning forest of the links that it confirms.

Steps 2 and 3 together confirm or refute every candidate pair up to links that
are already implied, so that no bucket needs a cap.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from strandline.llm import wordhash as W
from strandline.operators.components import connected_components
from strandline.session import materialise

#: Sketch: 2**BUCKET_BITS buckets, registers of 6 + MANTISSA_BITS bits, which two bytes hold.
BUCKET_BITS, MANTISSA_BITS = 7, 10
BUCKETS, REGISTER = 1 << BUCKET_BITS, np.uint16
#: Bands of ROWS registers. At Jaccard 0.8 a pair shares none of the 32 bands with probability 5e-8.
ROWS = 4
BANDS = BUCKETS // ROWS
#: Sets of up to SPARSE elements have bands of minima under multipliers; sets that could be linked with a larger one have bands of buckets (too).
SPARSE = 256
#: Standard deviations that an estimate may fall short of the threshold before a candidate is dropped.
SLACK = 4.5
#: Bytes of sets that one block of a band group holds, and its members.
BLOCK_BYTES, BLOCK_ROWS = 32 << 20, 2048
#: Members that are held against one copy of their group's smallest.
STAR_ROWS = 512
#: Keys of more than one in HOT of all rows: there are fewer than HOT, so that a list of them can be sent. Parts that the rows of one are dealt to.
HOT, SALTS = 1000, 64

_U = np.uint64
_LOW = (np.arange(BUCKETS, dtype=np.uint64) << _U(64 - BUCKET_BITS)).astype(_U)


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text.

    Fewer than ``k`` words: the whole sequence as one shingle; none: empty.
    """
    raw, bounds = W.text_bytes(column)
    for a, b in W.chunks(bounds):
        words, _, _, at = W.word_hashes(raw[bounds[a] : bounds[b]], bounds[a : b + 1], W.NOT_SPACE)
        full = W.combine([words[i : len(words) - k + 1 + i] for i in range(k)]) if len(words) >= k else words[:0]
        for lo, hi in zip(at[:-1], at[1:], strict=True):
            n = hi - lo
            if n >= k:
                s = np.sort(full[lo : hi - k + 1])
                yield s[np.concatenate(([True], s[1:] != s[:-1]))] if n > k else s
            elif n:
                yield W.combine([words[lo + i : lo + i + 1] for i in range(n)])
            else:
                yield words[:0]


def registers(minima: np.ndarray, present: np.ndarray, mantissa_bits: int = MANTISSA_BITS) -> np.ndarray:
    """Compressed registers of bucket minima (their bits below the bucket's): (leading zeros + 1, mantissa); 0 is an empty bucket."""
    v = minima << _U(BUCKET_BITS)
    top = (v >> _U(11)).astype(np.float64)  # exact in 53 bits
    zeros = np.where(top > 0, 53 - np.frexp(top)[1], 53).astype(np.uint64)
    rest = np.where(zeros < 53, (v << zeros) << _U(1), 0).astype(np.uint64) >> _U(64 - mantissa_bits)
    return np.where(present, ((zeros + _U(1)) << _U(mantissa_bits)) | rest, 0).astype(np.uint32)


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """One row of registers for each set."""
    minima = np.zeros((len(sets), BUCKETS), _U)
    present = np.zeros((len(sets), BUCKETS), bool)
    for i, s in enumerate(sets):
        if len(s):
            at = np.searchsorted(s, _LOW)
            got = s[np.minimum(at, len(s) - 1)]
            present[i] = (at < len(s)) & ((got ^ _LOW) >> _U(64 - BUCKET_BITS) == 0)
            minima[i] = got
    return registers(minima, present).astype(REGISTER)


_CELLS = 2.0 ** -np.arange(0, 48)[:, None]  # upper ends of the intervals that leading-zero counts tell apart


def collisions(n: np.ndarray, m: np.ndarray, mantissa_bits: int = MANTISSA_BITS) -> np.ndarray:
    """Chance that two buckets of disjoint sets of ``n`` and ``m`` elements have equal registers.

    A bucket holds the smallest of its share of a set, one element at least.
    Minima of a and b numbers have densities a (1 - x)**(a - 1) and so on; in
    the interval from 2**-(z+1) to 2**-z a mantissa step is 2**-(z+1+bits)
    wide, and the product of the densities has a closed integral.
    """
    a, b = np.maximum(1.0, np.atleast_1d(n) / BUCKETS), np.maximum(1.0, np.atleast_1d(m) / BUCKETS)
    k = a + b - 1
    within = (1 - _CELLS / 2) ** k - (1 - _CELLS) ** k
    return (_CELLS / 2 * within).sum(0) * a * b / k * 2.0**-mantissa_bits


@lru_cache(4)
def _collision_table(mantissa_bits: int) -> np.ndarray:
    """:func:`collisions` of set sizes in steps of a quarter of a power of two."""
    sizes = BUCKETS * 2.0 ** (np.arange(160) / 4)
    return np.stack([collisions(np.full(len(sizes), n), sizes, mantissa_bits) for n in sizes])


def _step(n: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(4 * np.log2(np.maximum(n, BUCKETS) / BUCKETS)), 0, 159).astype(np.int64)


def estimate(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, mantissa_bits: int = MANTISSA_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimates of register rows, and how many buckets each rests on."""
    some = np.maximum(((x | y) != 0).sum(-1), 1)
    equal = ((x == y) & (x != 0)).sum(-1) / some
    c = _collision_table(mantissa_bits)[_step(n), _step(m)]
    return np.clip((equal - c) / (1 - c), 0, 1), some


def plausible(x, y, n, m, num: int, den: int) -> np.ndarray:
    """Whether a pair's estimate, less its error, and its sizes allow the threshold."""
    j, some = estimate(x, y, n, m)
    t = num / den
    return (j >= t - SLACK * np.sqrt(t * (1 - t) / some)) & (den * np.minimum(n, m) >= num * np.maximum(n, m))


def linked(s: np.ndarray, t: np.ndarray, num: int, den: int) -> bool:
    """Exact test on full sets: den * |s & t| >= num * |s | t|."""
    both = len(np.intersect1d(s, t, assume_unique=True))
    return both > 0 and den * both >= num * (len(s) + len(t) - both)


def _features(k: int, ratio: tuple[int, int] | None = None):
    """doc_id, set size and digest of each text, with its keys if a threshold is given."""

    def run(batches):
        for rb in batches:
            ids, texts = rb.column(0), rb.column(1)
            for a in range(0, len(texts), 512):
                sets = list(shingle_sets(texts.slice(a, 512), k))
                cols = {"doc_id": ids.slice(a, 512), "n_shingles": pa.array([len(s) for s in sets], pa.int64()), "digest": pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary())}
                if ratio is not None:
                    cols["keys"] = pa.array([x.tobytes() if len(s) else None for s, x in zip(sets, all_keys(sets, sketch(sets), *ratio), strict=True)], pa.binary())
                yield pa.RecordBatch.from_pydict(cols)

    return run


def _rows(column: pa.Array, dtype=REGISTER) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


def band_keys(regs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A key for each row and band, and whether the band has any register."""
    parts = regs.reshape(len(regs), BANDS, ROWS).astype(np.uint64)
    band = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:2])
    return W.combine([band.ravel(), *(parts[:, :, i].ravel() for i in range(ROWS))]).reshape(parts.shape[:2]), (parts != 0).any(-1)


_ODD = np.random.default_rng(42).integers(0, 1 << 63, BUCKETS, dtype=_U) * _U(2) + _U(1)


def all_keys(sets: list[np.ndarray], regs: np.ndarray, num: int, den: int) -> np.ndarray:
    """The keys of each set's bands of buckets, then those of its bands of minima; 0 where it has no such band.

    Two sets that the threshold can link have all bands of one kind in common:
    both are small, or the smaller one has ``num / den`` of SPARSE elements at least.
    """
    keys, some = band_keys(regs)
    size = np.array([len(s) for s in sets])
    out = np.zeros((len(sets), 2 * BANDS), _U)
    out[:, :BANDS] = np.where(some & (den * size >= num * SPARSE)[:, None], keys, 0)
    small = np.flatnonzero((size > 0) & (size <= SPARSE))
    if len(small):
        minima = np.stack([(sets[i][:, None] * _ODD).min(0) for i in small]).reshape(len(small), BANDS, ROWS)
        band = np.broadcast_to(np.arange(BANDS, 2 * BANDS, dtype=_U), minima.shape[:2])
        out[small, BANDS:] = W.combine([band.ravel(), *(minima[:, :, i].ravel() for i in range(ROWS))]).reshape(minima.shape[:2])
    return out


def _bands(batches):
    for rb in batches:
        for a in range(0, len(rb), 1024):
            part = rb.slice(a, 1024)
            keys = _rows(part.column(1), _U)
            row, col = np.nonzero(keys)
            yield pa.RecordBatch.from_arrays([pa.array(keys[row, col].view(np.int64)), part.column(0).take(pa.array(row))], ["key", "rep"])


def _sets(k: int, ratio: tuple[int, int]):
    def run(batches):
        for rb in batches:
            for a in range(0, len(rb), 512):
                part = rb.slice(a, 512)
                sets = list(shingle_sets(part.column(1), k))
                held, regs = [s.tobytes() for s in sets], sketch(sets)
                found = [[xxhash.xxh3_128_digest(x) if x else None for x in held], held, [r.tobytes() for r in regs], [x.tobytes() for x in all_keys(sets, regs, *ratio)]]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in found], ["digest", "elements", "sketch", "keys"])

    return run


def _stars(num: int, den: int):
    """Rows sorted by (leader, salt, leader first): each member is held against the leader row before it."""

    def run(batches):
        now, head, regs = None, None, None
        for rb in batches:
            out = []
            cols = [rb.column(i).to_pylist() for i in range(5)]  # leader, salt, member, elements, sketch
            for leader, salt, member, elements, sk in zip(*cols, strict=True):
                s, r = np.frombuffer(elements, _U), np.frombuffer(sk, REGISTER)
                if member is None:
                    now, head, regs = (leader, salt), s, r
                elif now == (leader, salt) and plausible(regs, r, len(head), len(s), num, den) and linked(head, s, num, den):
                    out.append((leader, member))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], rb.column(0).type) for i in (0, 1)], ["src", "dst"])

    return run


def _groups(batches, keys: int) -> Iterator[list[list]]:
    """Columns of each run of equal leading ``keys`` columns of sorted batches."""
    now, held = None, None
    for rb in batches:
        cols = [c.to_pylist() for c in rb.columns]
        marks = list(zip(*cols[:keys], strict=True))
        a = 0
        while a < len(marks):
            b = a + 1
            while b < len(marks) and marks[b] == marks[a]:
                b += 1
            if marks[a] == now:
                for x, c in zip(held, cols, strict=True):
                    x.extend(c[a:b])
            else:
                if held is not None:
                    yield held
                now, held = marks[a], [c[a:b] for c in cols]
            a = b
    if held is not None:
        yield held


def _open_pairs(cols: list[list], num: int, den: int) -> Iterator[tuple[int, np.ndarray]]:
    """In one block of a band group, each row's plausible partners in other components that share no earlier band with it."""
    key, bi, bj, rep, comp, block = (np.array(c) for c in cols[:6])
    regs = np.frombuffer(b"".join(cols[6]), REGISTER).reshape(len(rep), -1)
    size = np.array(cols[7])
    keys = np.frombuffer(b"".join(cols[8]), _U).reshape(len(rep), -1)
    band = int(np.flatnonzero(keys[0].view(np.int64) == key[0])[0])
    keys = np.where(keys != 0, keys, np.arange(len(rep), dtype=_U)[:, None])[:, :band]  # an empty band is shared with no one
    for i in np.flatnonzero(block == bi[0]):
        j = np.flatnonzero((block == bj[0]) & (comp != comp[i]) & ((rep > rep[i]) | (bi[0] != bj[0])))
        j = j[~(keys[j] == keys[i]).any(1)]
        j = j[plausible(regs[i], regs[j], size[i], size[j], num, den)]
        if len(j):
            yield int(i), j


def _still_open(num: int, den: int):
    """Rows of band groups that have a plausible partner."""

    def run(batches):
        for cols in _groups(batches, 3):
            some = np.zeros(len(cols[0]), bool)
            for i, j in _open_pairs(cols, num, den):
                some[i] = True
                some[j] = True
            at = np.flatnonzero(some)
            if len(at):
                yield pa.RecordBatch.from_pydict({n: [c[i] for i in at] for n, c in (("key", cols[0]), ("rep", cols[3]), ("comp", cols[4]))})

    return run


def _forest(num: int, den: int):
    """Links between components among the plausible pairs of a block: a spanning forest."""

    def run(batches):
        for cols in _groups(batches, 3):
            rep, comp = cols[3], cols[4]
            sets = [np.frombuffer(x, _U) for x in cols[9]]
            up = {c: c for c in comp}

            def root(c, up=up):
                while up[c] != c:
                    up[c] = up[up[c]]
                    c = up[c]
                return c

            found = []
            for i, j in _open_pairs(cols, num, den):
                for x in j:
                    a, b = root(comp[i]), root(comp[x])
                    if a != b and linked(sets[i], sets[x], num, den):
                        up[a] = b
                        found.append((rep[i], rep[x]))
            if found:
                yield pa.RecordBatch.from_pydict({"src": [x[0] for x in found], "dst": [x[1] for x in found]})

    return run


def _meet(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """``rows(key, rep, ...)`` with ``found(key, n, ...)``, a row for each key and the number ``n`` of its rows.

    Counts are combined on the map side. A key of more than one in HOT of all
    rows, of which there are fewer than HOT, is dealt to ``SALTS`` parts by a
    hash of ``rep``, so that no group's rows come together in one task. Their
    list stands in the plan: rows are joined once, with ``found``.
    """
    seen = Observation()
    found = materialise(found.observe(seen, F.sum("n").alias("total")), "found")
    total = seen.get.get("total") or 0
    hot = [r[0] for r in found.where(F.col("n") * HOT > total).select(key).collect()]
    parts = F.when(F.col(key).isin(hot), F.lit(SALTS)).otherwise(F.lit(1))
    left = rows.withColumn("__salt", F.pmod(F.xxhash64("rep", F.lit(7)), parts).cast("int"))
    right = found.drop("n").withColumn("__salt", F.explode(F.sequence(F.lit(0), parts - 1)))
    return left.join(right, [key, "__salt"]).drop("__salt")


def _count() -> Column:
    return F.count(F.lit(1)).alias("n")


def _blocks(rows: DataFrame, sets: DataFrame, full: bool) -> DataFrame:
    """Rows of band groups dealt to pairs of blocks, sorted by them, with sketches and, if ``full``, sets."""
    size = F.octet_length("sketch") + F.octet_length("keys") + (F.octet_length("elements") if full else F.lit(0))
    own = sets.select("rep", "sketch", (F.octet_length("elements") / 8).cast("bigint").alias("size"), "keys", *(["elements"] if full else []), size.alias("bytes"))
    rows = rows.join(own.select("rep", "bytes"), "rep")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum("bytes") / BLOCK_BYTES)).cast("int")
    cut = _meet(rows, rows.groupBy("key").agg(_count(), blocks.alias("blocks")), "key").withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    one = cut.where("blocks = 1").select("key", F.lit(0).alias("bi"), F.lit(0).alias("bj"), "rep", "comp", "block")
    many = cut.where("blocks > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "rep", "comp", "block")
    wide = one.unionByName(many).join(own, "rep").select("key", "bi", "bj", "rep", "comp", "block", "sketch", "size", "keys", *(["elements"] if full else []))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # as many as configured: little to read, much to compare
    return wide.repartition(tasks, "key", "bi", "bj").sortWithinPartitions("key", "bi", "bj", "rep")


def repeated(docs: DataFrame) -> DataFrame:
    """The doc_ids that more than one row has."""
    return materialise(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "again")


def near_groups(docs: DataFrame, shingle: int = 3, num: int = 85, den: int = 100) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row of ``docs(doc_id, text)``.

    Documents are linked when ``den * |A & B| >= num * |A | B|`` on their sets
    of ``shingle``-word shingles; ``component_id`` is the smallest doc_id
    reachable and ``kept`` marks it. Null and empty texts have no shingles and
    link with nothing. Rows that repeat a doc_id each get a row and count as
    one document: what is linked with one of its texts is linked with it. A
    null doc_id keeps its row and is never linked. Rows that tie have one
    component by its smallest id, so no order matters. Very long texts are read
    in chunks of whole texts; the longest one's set bounds a task's memory. An
    empty table gives an empty result; other columns, whatever their names, are
    not read.
    """
    spark = docs.sparkSession
    given = docs.schema["doc_id"].dataType.simpleString()
    kind = "bigint" if given in ("tinyint", "smallint", "int") else given
    base = docs.select(F.col("doc_id").cast(kind), "text")
    hashed = f"doc_id {kind}, n_shingles bigint, digest binary"
    node = F.xxhash64("digest")
    feats = base.mapInArrow(_features(shingle, (num, den)), f"{hashed}, keys binary")
    classes = materialise(feats.where("n_shingles > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("keys").alias("keys"), F.count(F.lit(1)).alias("copies")).withColumn("rep", node), "classes")
    bands = classes.select("rep", "keys").mapInArrow(_bands, "key bigint, rep bigint")
    heads = bands.groupBy("key").agg(_count(), F.min("rep").alias("leader"), F.max("rep").alias("last")).where("leader <> last").drop("last")
    groups = materialise(_meet(bands, heads, "key").where("rep <> leader").select("key", "rep", "leader"), "bands")
    held = groups.count()

    pairs = materialise(groups.select("leader", "rep").distinct(), "pairs", rows=held)
    ids = pairs.select(F.col("leader").alias("rep")).unionByName(pairs.select("rep")).distinct()
    firsts = classes.join(ids, "rep", "left_semi").select(F.col("doc_id").alias("__first")).distinct()
    sets = materialise(base.join(firsts.hint("shuffle_hash"), base.doc_id == firsts["__first"], "left_semi").mapInArrow(_sets(shingle, (num, den)), "digest binary, elements binary, sketch binary, keys binary").select(node.alias("rep"), "elements", "sketch", "keys"), "sets")
    if sets.count() != ids.count():  # doc_ids repeat, some with other texts
        sets = materialise(sets.join(ids, "rep", "left_semi").groupBy("rep").agg(F.first("elements").alias("elements"), F.first("sketch").alias("sketch"), F.first("keys").alias("keys")), "sets")
    salts = materialise(pairs.groupBy("leader").agg(_count(), F.ceil(F.count(F.lit(1)) / STAR_ROWS).cast("int").alias("salts")), "salts", rows=held)
    members = _meet(pairs, salts, "leader").select("leader", F.pmod(F.xxhash64("rep"), "salts").cast("int").alias("salt"), F.col("rep").alias("member"))
    rows = members.join(sets, members.member == sets.rep).select("leader", "salt", "member", "elements", "sketch")
    tops = salts.select("leader", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).join(sets, F.col("leader") == F.col("rep")).select("leader", "salt", F.lit(None).cast("bigint").alias("member"), "elements", "sketch")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = rows.unionByName(tops).repartition(tasks, "leader", "salt").sortWithinPartitions("leader", "salt", F.col("member").asc_nulls_first())
    links = materialise(both.mapInArrow(_stars(num, den), "src bigint, dst bigint"), "links")

    comp = connected_components(links)
    placed = groups.join(comp, groups.rep == comp.node, "left").select("key", "rep", F.coalesce("component", "rep").alias("comp"))
    placed = materialise(placed, "placed", rows=held)
    still = placed.groupBy("key").agg(_count(), F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").drop("a", "b")
    left = _blocks(_meet(placed, still, "key"), sets, full=False).mapInArrow(_still_open(num, den), "key bigint, rep bigint, comp bigint")
    left = materialise(left.distinct(), "open", rows=held)
    more = materialise(_blocks(left, sets, full=True).mapInArrow(_forest(num, den), "src bigint, dst bigint"), "links")

    links = links.unionByName(more)
    again = repeated(base)
    if again.head(1):  # rows of a doc_id are one document, so their texts are linked
        own = base.join(again.hint("shuffle_hash"), "doc_id", "left_semi").mapInArrow(_features(shingle), hashed)
        own = materialise(own.where("n_shingles > 0").select("doc_id", node.alias("rep")).distinct(), "repeated")
        links = links.unionByName(own.join(own.groupBy("doc_id").agg(F.min("rep").alias("dst")), "doc_id").where("rep <> dst").select(F.col("rep").alias("src"), "dst").distinct())
    final = connected_components(links)
    placed = classes.join(final, classes.rep == final.node, "left").select("digest", "rep", "doc_id", "copies", F.coalesce("component", "rep").alias("component"))
    least = placed.groupBy("component").agg(_count(), F.min("doc_id").alias("component_id"))
    label = materialise(_meet(placed, least, "component").select("digest", "rep", "component_id", "copies"), "label")
    sizes = base.mapInArrow(_features(shingle), hashed)  # cheaper to read again than to keep
    total = label.agg(F.sum("copies")).first()[0] or 0
    hot = label.where(F.col("copies") * HOT > total).select("digest", F.col("component_id").alias("known"))  # fewer than HOT rows
    sizes = sizes.join(F.broadcast(hot), "digest", "left")
    spread = F.xxhash64("doc_id").cast("string").cast("binary")  # rows that are done or have no words meet no label, and no one task
    sizes = sizes.withColumn("own", F.when(F.col("known").isNull() & F.col("digest").isNotNull(), F.col("digest")).otherwise(spread))
    out = sizes.drop("digest").join(label.select(F.col("digest").alias("own"), "component_id"), "own", "left").withColumn("component_id", F.coalesce("known", "component_id"))
    if again.head(1):  # a row without shingles goes with its document's others
        whole = own.join(label.drop("digest"), "rep").groupBy("doc_id").agg(F.min("component_id").alias("whole"))
        out = out.join(whole, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "whole")).drop("whole")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))).select(F.col("doc_id").cast(given), "n_shingles", F.col("component_id").cast(given), "kept")


def keep_one(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` without all but one document of each near-duplicate group.

    The smallest doc_id of a group stays. Of rows that repeat a doc_id, one
    stays (the smallest hash); rows without doc_id all stay. Columns are those
    of ``docs``.
    """
    keep = near_groups(docs, shingle, num, den).where("kept").select(F.col("doc_id").alias("__kept")).distinct()
    again = repeated(docs.select("doc_id")).withColumnRenamed("doc_id", "__again")
    stay = docs.join(keep.hint("shuffle_hash"), docs.doc_id.eqNullSafe(keep["__kept"]), "left_semi")
    if not again.head(1):
        return stay
    more = stay.join(again.hint("shuffle_hash"), stay.doc_id == again["__again"], "left_semi")
    one = more.groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("__row")).select("__row.*")
    return stay.join(again.hint("shuffle_hash"), stay.doc_id == again["__again"], "left_anti").unionByName(one)
