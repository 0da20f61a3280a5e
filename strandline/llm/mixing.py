"""Mixing sources to target weights, in fixed-length blocks.

Each source's words, in a fixed pseudorandom order of its documents, form one
stream that is cut into blocks of ``block_words`` words. Targets come from the
weights by water filling under an epoch limit. Source counts of every output
shard are multinomial draws; draws beyond a source's quota are dealt again to
the sources that are short of theirs, so totals are exact. A source's k-th slot
takes block ``permutation(epoch)(k mod blocks)``, epoch ``k div blocks``, from a
keyed pseudorandom permutation that needs no shuffle and no state; slots and
blocks then meet in a join by (source, index), whose keys are uniform however
large a source is. What this join gives is the mix: :func:`mixed_blocks` returns
it, :func:`mixture` counts its words, :func:`repeat_documents` puts them back
into documents.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm import wordhash as W
from strandline.operators.suffix import running
from strandline.session import materialise

#: Words of a block, times that a block may be taken, and weights in code-point order of the sources, repeating.
BLOCK_WORDS, EPOCHS, WEIGHTS = 64, 3, (1, 2, 3)
#: Output shards at most, sources that one task plans, and cells (shards x groups of sources) of the plan made on the driver; all independent of the data's size.
SHARDS, GROUP, PLAN_CELLS = 4096, 512, 4_000_000
#: Sources whose totals are sent to every task, at most.
SENT_SOURCES = 10_000
#: Slots of a row of the plan at most, and slots that one task makes, about.
PLAN_SLOTS, TASK_SLOTS = 1 << 14, 1 << 20
_U = np.uint64


def _count_words(batches):
    for rb in batches:
        raw, bounds = W.text_bytes(rb.column(2))
        n = np.zeros(len(rb), np.int64)
        for a, b in W.chunks(bounds):
            n[a:b] = np.diff(W.spans(raw[bounds[a] : bounds[b]], bounds[a : b + 1], W.NOT_SPACE)[2])
        yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), pa.array(n), rb.column(3), rb.column(4)], ["doc_id", "source", "size", "k1", "k2"])


def water_fill(sources: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """Adds ``target`` to (source_size, weight): shares of the total by weight, none above ``epochs`` times its source."""
    roof = F.lit(epochs) * F.col("source_size")
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, capped = -1.0, -1
    while True:
        at = F.lit(level) * F.col("weight") >= roof if capped >= 0 else F.lit(False)
        r = sources.agg(F.count_if(at).alias("n"), F.coalesce(F.sum(F.when(at, roof)), F.lit(0)).alias("full"), F.coalesce(F.sum(F.when(~at, F.col("weight"))), F.lit(0)).alias("w")).first()
        if r.n == capped or not r.w:
            break
        level, capped = max(total - r.full, 0) / r.w, r.n
    return sources.withColumn("target", F.least(roof.cast("double"), F.lit(level) * F.col("weight")))


def plan_slots(quota: np.ndarray, shards: int | np.ndarray, *seed: int) -> np.ndarray:
    """Slots of each (shard, source): multinomial draws, with draws beyond a quota dealt again to sources short of theirs; ``shards`` are as many of even size, or the slots of each."""
    total = int(quota.sum())
    each = shards if isinstance(shards, np.ndarray) else np.diff(np.minimum(np.arange(shards + 1) * (total // shards) + np.minimum(np.arange(shards + 1), total % shards), total))
    if not total:
        return np.zeros((len(each), len(quota)), np.int64)
    p = quota / total
    drawn = np.stack([np.random.default_rng([*seed, s]).multinomial(n, p) for s, n in enumerate(each)]).astype(np.int64)
    before = np.cumsum(drawn, 0) - drawn
    kept = np.clip(quota - before, 0, drawn)
    freed = np.cumsum((drawn - kept).sum(1))
    short = np.cumsum(quota - kept.sum(0))
    lo = np.maximum((freed - (drawn - kept).sum(1))[:, None], (short - (quota - kept.sum(0)))[None, :])
    return kept + np.maximum(np.minimum(freed[:, None], short[None, :]) - lo, 0)


_PLAN = "shard bigint, rank bigint, start bigint, n bigint, blocks bigint"


def _planned(seed: int):
    """Rows of the plan of each group's sources, from the group's slots of every shard."""

    def run(batches):
        for rb in batches:
            for group, own, each in zip(*(c.to_pylist() for c in rb.columns), strict=True):
                own = sorted((x["rank"], x["quota"], x["blocks"]) for x in own)
                rank, quota, blocks = (np.array(x, np.int64) for x in zip(*own, strict=True))
                counts = plan_slots(quota, np.array(each, np.int64), seed, 1 + group)
                shard, who = np.nonzero(counts)
                starts = (np.cumsum(counts, 0) - counts)[shard, who]
                cols = (shard, rank[who], starts, counts[shard, who], blocks[who])
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], ["shard", "rank", "start", "n", "blocks"])

    return run


def planned(sources: DataFrame, seed: int) -> tuple[DataFrame, int]:
    """The plan's rows ``(shard, rank, start, n, blocks)`` for ``sources(rank, quota, blocks)``, and its slots.

    A draw over all sources is one over groups of ``GROUP`` sources and one
    within a group: the driver draws for the groups, a task for each one's
    sources.
    """
    grouped = sources.groupBy(F.floor((F.col("rank") - 1) / GROUP).cast("bigint").alias("group"))
    held = grouped.agg(F.sum("quota").alias("quota")).toPandas().sort_values("group")  # a row for GROUP sources
    total = int(held.quota.sum())
    shards = max(1, min(SHARDS, PLAN_CELLS // max(1, len(held)), math.ceil(total / 4096)))
    each = plan_slots(held.quota.to_numpy(np.int64), shards, seed, 0)
    sent = sources.sparkSession.createDataFrame(pa.table({"group": pa.array(held.group.to_numpy(np.int64)), "each": pa.array(list(each.T), pa.list_(pa.int64()))}))
    own = grouped.agg(F.collect_list(F.struct("rank", "quota", "blocks")).alias("own"))
    return own.join(sent, "group").select("group", "own", "each").mapInArrow(_planned(seed), _PLAN), total


def permute(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed permutation of range(size), row by row: a four-round Feistel network with cycle walking."""
    x, size, key = index.astype(_U), size.astype(_U), key.astype(_U)
    half = np.maximum(1, np.ceil(np.log2(np.maximum(size, 2).astype(np.float64)) / 2 + 1e-9)).astype(_U)
    mask = (_U(1) << half) - _U(1)
    todo = np.arange(len(x))
    while len(todo):
        left, right = x[todo] >> half[todo], x[todo] & mask[todo]
        for r in range(4):
            left, right = right, left ^ (W.mix(right + key[todo] + _U((r + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) & mask[todo])
        x[todo] = (left << half[todo]) | right
        todo = todo[x[todo] >= size[todo]]
    return x.astype(np.int64)


def deal_slots(plan: DataFrame, total: int) -> DataFrame:
    """``(shard, rank, blocks, slot)``: a row for each of the ``total`` slots of the plan's rows ``(shard, rank, start, n, blocks)``.

    Rows of the plan are cut to ``PLAN_SLOTS`` slots and dealt to a number of
    tasks that follows from the number of slots, which adaptive execution
    leaves as it is: the plan is small, what it expands to is not.
    """
    usual = int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(1, min(math.ceil(total / PLAN_SLOTS), max(usual, math.ceil(total / TASK_SLOTS))))
    end = F.col("start") + F.col("n")
    cut = plan.where("n > 0").select("shard", "rank", "blocks", end.alias("end"), F.explode(F.sequence(F.col("start"), end - 1, F.lit(PLAN_SLOTS))).alias("first"))
    upto = F.least(F.col("first") + PLAN_SLOTS, F.col("end")) - 1
    return cut.repartition(tasks, "shard", "rank", "first").select("shard", "rank", "blocks", F.explode(F.sequence(F.col("first"), upto)).alias("slot"))


def _permuted(seed: int):
    """Rows ``(shard, rank, blocks, slot)`` to ``(shard, slot, rank, block)``.

    Not a UDF in a column: a join on ``block`` filters it, and the filter would
    have a copy of its own, with a second Python worker in every task.
    """

    def run(batches):
        for rb in batches:
            own, n, k = (rb.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
            key = W.mix(own.astype(_U) * _U(0xD1342543DE82EF95) + (k // n).astype(_U) + W.mix(np.full(len(k), seed, _U)))
            yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(3), rb.column(1), pa.array(permute(k % n, n, key), pa.int64())], ["shard", "slot", "rank", "block"])

    return run


def _keys() -> list[Column]:
    """Two hashes of a row; rows that agree in them are equal in doc_id, source and text."""
    read = ["doc_id", "source", "text", F.col("doc_id").isNull(), F.col("source").isNull(), F.col("text").isNull()]
    return [F.xxhash64(*read).alias("k1"), F.hash(*read).alias("k2")]


def _mix(docs: DataFrame, block_words: int, seed: int, epochs: int, weights: tuple[int, ...]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Sources, rows with their sizes, rows with words and their places in the streams, their pieces by block, and slots with the blocks that they take."""
    spark = docs.sparkSession
    base = docs.select("doc_id", F.col("source").cast("string").alias("source"), "text", *_keys())
    kind = base.schema["doc_id"].dataType.simpleString()
    sizes = materialise(base.mapInArrow(_count_words, f"doc_id {kind}, source string, size bigint, k1 bigint, k2 int"), "sizes")

    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("last", F.col("source").isNull())
    totals = running(totals, ["last", "source"], F.lit(1).cast("bigint"), "before").withColumn("rank", F.col("before") + 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    sources = water_fill(materialise(totals.select("source", "source_size", "rank", weight.alias("weight")), "sources"), epochs)
    blocks = F.ceil(F.col("source_size") / block_words).cast("bigint")
    quota = F.least(F.rint(F.col("target") * blocks / F.greatest("source_size", F.lit(1))).cast("bigint"), epochs * blocks)
    sources = materialise(sources.select("*", blocks.alias("blocks"), quota.alias("quota")), "targets")
    plan, total = planned(sources, seed)
    dealt = deal_slots(plan, total)
    slots = dealt.mapInArrow(_permuted(seed), "shard bigint, slot bigint, rank bigint, block bigint")

    known = sources.select(F.col("source").alias("own"), "rank", "source_size", "target")
    known = F.broadcast(known) if known.count() <= SENT_SOURCES else known
    rows = sizes.join(known, sizes.source.eqNullSafe(F.col("own"))).drop("own", "source")
    buckets = max(1, math.isqrt(sizes.count()))  # as many buckets as rows in each: both windows below stay short
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("k1", F.lit(seed)), F.lit(buckets)))  # of the whole row: rows that share an id, or have none, spread
    filled = rows.where("size > 0")
    within = Window.partitionBy("rank", "bucket").orderBy("k1", "k2", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    across = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bases = filled.groupBy("rank", "bucket").agg(F.sum("size").alias("here")).select("rank", "bucket", (F.sum("here").over(across) - F.col("here")).alias("base"))
    placed = filled.withColumn("upto", F.sum("size").over(within)).join(bases.hint("merge"), ["rank", "bucket"]).withColumn("from", F.col("base") + F.col("upto") - F.col("size"))
    to = F.col("from") + F.col("size")
    pieces = placed.select("rank", "from", "size", F.explode(F.sequence(F.expr(f"`from` div {block_words}"), F.expr(f"(`from` + size - 1) div {block_words}"))).alias("block"))
    first = F.greatest(F.col("from"), F.col("block") * block_words)
    pieces = pieces.select("rank", "from", "block", (first - F.col("from")).alias("first"), (F.least(to, (F.col("block") + 1) * block_words) - first).alias("words"))
    return sources, rows, placed, pieces, slots


def mixture(docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = 11, epochs: int = EPOCHS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` for every row of ``docs(doc_id, text, source)``.

    ``size`` counts words, ``taken`` the words that the mix takes of the row,
    repeats counted: at most ``epochs`` times its size. A null source is a
    source of its own, last in order; null and empty texts have size 0 and take
    part with nothing. Rows that repeat a doc_id, or have none, each take part.
    Sources that are no strings count by their text. An empty table gives an
    empty result; very long texts are counted in pieces of whole texts, so one
    text bounds a task's memory. Streams are ordered by a hash of whole rows, so
    that only equal rows tie, which are alike. Columns besides the three named
    ones are not read. A run with the same rows and seed gives the same result
    whatever the partitioning.
    """
    _, rows, placed, pieces, slots = _mix(docs, block_words, seed, epochs, weights)
    taken = pieces.join(slots.hint("merge"), ["rank", "block"]).groupBy("rank", "from").agg(F.sum("words").alias("got"))
    out = placed.join(taken.hint("merge"), ["rank", "from"], "left").select("doc_id", "size", "source_size", "target", F.coalesce("got", F.lit(0)).cast("bigint").alias("taken"))
    return out.unionByName(rows.where("size = 0").select("doc_id", "size", "source_size", "target", F.lit(0).cast("bigint").alias("taken")))


def _with_rows(docs: DataFrame, own: DataFrame, name: str) -> DataFrame:
    """``docs`` with a further column ``name``, the value that ``own(k1, k2, value)`` has for the row; equal rows get one each."""
    k1, k2, nth = (f"{name}_{x}" for x in ("k1", "k2", "nth"))
    lists = own.groupBy("k1", "k2").agg(F.sort_array(F.collect_list("value")).alias(name)).withColumnsRenamed({"k1": k1, "k2": k2})
    keyed = docs.select("*", *[k.alias(n) for k, n in zip(_keys(), (k1, k2), strict=True)])
    number = F.row_number().over(Window.partitionBy(k1, k2).orderBy(F.lit(0)))
    return keyed.join(lists.hint("shuffle_hash"), [k1, k2]).withColumn(nth, number).select(*[F.col(f"`{c}`") for c in docs.columns], F.element_at(name, F.col(nth)).alias(name))


def _unused(docs: DataFrame) -> str:
    """A name that begins no column of ``docs``, in any case."""
    name = "__own"
    while any(c.lower().startswith(name) for c in docs.columns):
        name = "_" + name
    return name


def _cut(batches):
    """Pieces of texts: rows of (doc_id, text, rank, from, array of block, first, words in turn)."""
    for rb in batches:
        raw_all, bounds_all = W.text_bytes(rb.column(1))
        for a, b in W.chunks(bounds_all):
            raw, bounds = raw_all[bounds_all[a] : bounds_all[b]], bounds_all[a : b + 1] - bounds_all[a]
            starts, ends, at = W.spans(raw, bounds, W.NOT_SPACE)
            data, texts, owner, numbers = raw.tobytes(), [], [], []
            for d in range(b - a):
                own = np.asarray(rb.column(4)[a + d].values).reshape(-1, 3)
                texts += [data[starts[i] : ends[i + n - 1]].decode() for i, n in zip(at[d] + own[:, 1], own[:, 2], strict=True)]
                owner += [a + d] * len(own)
                numbers.append(own)
            block, first, words = np.concatenate(numbers).T if numbers else np.zeros((3, 0), np.int64)
            who = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays([rb.column(2).take(who), pa.array(block), rb.column(3).take(who), rb.column(0).take(who), pa.array(first), pa.array(words), pa.array(texts, pa.string())], ["rank", "block", "from", "doc_id", "first", "words", "text"])


def mixed_blocks(docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = 11, epochs: int = EPOCHS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``(shard, slot, source, words, pieces array<struct<doc_id, first, words, text>>)``: the mix, one row for each block that it takes.

    ``slot`` numbers the takes of a source. A piece is ``words`` words of a
    document from its word ``first`` on, its text as it stands there. Blocks
    have ``block_words`` words, the last one of a source the rest.
    """
    sources, _, placed, pieces, slots = _mix(docs, block_words, seed, epochs, weights)
    held = pieces.groupBy("rank", "from").agg(F.flatten(F.collect_list(F.array("block", "first", "words"))).alias("cuts"))
    value = placed.select("k1", "k2", "rank", "from").join(held, ["rank", "from"]).select("k1", "k2", F.struct("rank", "from", "cuts").alias("value"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = _with_rows(docs.select("doc_id", "source", "text"), value, "__own").select("doc_id", "text", "__own.rank", "__own.from", "__own.cuts").mapInArrow(_cut, f"rank bigint, block bigint, `from` bigint, doc_id {kind}, first bigint, words bigint, text string")
    whole = texts.groupBy("rank", "block").agg(F.sum("words").alias("words"), F.array_sort(F.collect_list(F.struct("from", "doc_id", "first", "words", "text"))).alias("pieces"))
    out = slots.join(whole.hint("merge"), ["rank", "block"]).join(sources.select("rank", "source"), "rank")
    return out.select("shard", "slot", "source", "words", F.transform("pieces", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["first"].alias("first"), x["words"].alias("words"), x["text"].alias("text"))).alias("pieces"))


def _taken(names: list[str]):
    """Rows of documents and an array of first, words, times in turn, to one row for each time: the words taken that often at least."""
    where = names.index("text")

    def run(batches):
        for rb in batches:
            raw_all, bounds_all = W.text_bytes(rb.column(where))
            for a, b in W.chunks(bounds_all):
                raw, bounds = raw_all[bounds_all[a] : bounds_all[b]], bounds_all[a : b + 1] - bounds_all[a]
                starts, ends, at = W.spans(raw, bounds, W.NOT_SPACE)
                data, texts, owner = raw.tobytes(), [], []
                for d in range(b - a):
                    own = np.asarray(rb.column(len(names))[a + d].values).reshape(-1, 3)
                    own = own[np.argsort(own[:, 0])]
                    for time in range(1, int(own[:, 2].max(initial=0)) + 1):
                        part = own[own[:, 2] >= time]
                        new = np.flatnonzero(np.append(True, part[1:, 0] != part[:-1, 0] + part[:-1, 1]))
                        lo, hi = part[new, 0] + at[d], (part[:, 0] + part[:, 1])[np.append(new[1:], len(part)) - 1] + at[d] - 1
                        all_ = len(new) == 1 and lo[0] == at[d] and hi[0] == at[d + 1] - 1
                        texts.append(data[bounds[d] : bounds[d + 1]].decode() if all_ else "\n".join(data[starts[i] : ends[j]].decode() for i, j in zip(lo, hi, strict=True)))
                        owner.append(a + d)
                who, text = pa.array(owner, pa.int64()), pa.array(texts, pa.string())
                out = [c.take(who) for c in rb.columns[:-1]]
                out[where] = text
                if "n_chars" in names:
                    i = names.index("n_chars")
                    out[i] = pc.if_else(pc.is_valid(out[i]), pc.utf8_length(text).cast(out[i].type), out[i])
                yield pa.RecordBatch.from_arrays(out, names)

    return run


def repeat_documents(docs: DataFrame, seed: int = 11, block_words: int = BLOCK_WORDS, epochs: int = EPOCHS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``docs`` as the mix takes them: each row 0 to ``epochs`` times, with the words that the mix takes.

    A row's k-th copy holds the words that are in blocks taken k times at least,
    in their order, with a line break where others are left out; a copy of all
    words is the text as it is. So every document and source has as many words
    as :func:`mixture` takes: sources keep their targets up to rounding to
    blocks. Other columns stay, whatever their names, but for ``n_chars``, which
    counts the text. Null and empty texts are taken 0 times; an empty table
    stays empty.
    """
    _, _, placed, pieces, slots = _mix(docs, block_words, seed, epochs, weights)
    times = slots.groupBy("rank", "block").agg(F.count(F.lit(1)).alias("times"))
    held = pieces.join(times.hint("merge"), ["rank", "block"]).groupBy("rank", "from").agg(F.flatten(F.collect_list(F.array("first", "words", "times"))).alias("cuts"))
    value = placed.select("k1", "k2", "rank", "from").join(held.hint("merge"), ["rank", "from"], "left").select("k1", "k2", F.struct("rank", "from", F.coalesce("cuts", F.array().cast("array<bigint>")).alias("cuts")).alias("value"))
    own = _unused(docs)
    return _with_rows(docs, value, own).withColumn(own, F.col(f"{own}.cuts")).where(F.size(own) > 0).mapInArrow(_taken(docs.columns), docs.schema)
