"""Suffix order of many sequences by prefix doubling, common prefixes of neighbours, and intervals of shared prefixes.

Every position has a rank: how many positions begin with a smaller string of so
many letters. Ranks by twice as many letters are ranks of pairs, that of the
position and that of the one so many letters on; only positions that share
their rank take part. Ranks of all rounds are kept: from the last to the first
they give the common prefix of two neighbours in the order, by one lookup a
round. Runs of neighbours with long common prefixes are the strings that occur
more than once and go on differently.

Nothing is compared pairwise, and no order is one task's: keys are counted
before they are ordered, dealt by ranges, and numbered by sums over ranges.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.grouped import map_groups
from strandline.session import materialise, spread

#: Positions of a batch.
ROWS = 1 << 14


def running(df: DataFrame, order: list[str], amount: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``amount`` over all rows that come before in ``order``, which tells all rows apart.

    Rows are dealt by ranges of the order; a window sums within a range, and one
    row a range sums over the earlier ones.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialise(df.withColumn("__n", amount).repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "dealt")
    w = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    line = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    base = dealt.groupBy("__part").agg(F.sum("__n").alias("__total")).select("__part", F.coalesce(F.sum("__total").over(line), F.lit(0)).alias("__base"))
    return dealt.withColumn("__in", F.coalesce(F.sum("__n").over(w), F.lit(0))).join(base, "__part").withColumn(name, F.col("__base") + F.col("__in")).drop("__n", "__part", "__in", "__base")


def _positions(k: int, stop: str):
    stops = set(stop)

    def run(batches):
        for rb in batches:
            for i, text in enumerate(rb.column(1).to_pylist()):
                text = text or ""
                ends, end = [0] * len(text), len(text)
                for p in range(len(text) - 1, -1, -1):  # where the stretch without stop letters ends
                    if text[p] in stops:
                        end = p
                    ends[p] = end
                for a in range(0, len(text), ROWS):
                    at = [p for p in range(a, min(a + ROWS, len(text))) if ends[p] > p]
                    keys = rb.column(0).take(pa.array([i] * len(at), pa.int64()))
                    words = pa.array([text[p : min(p + k, ends[p])] for p in at], pa.string())
                    left = pa.array([text[p - 1] if p and text[p - 1] not in stops else None for p in at], pa.string())
                    yield pa.RecordBatch.from_arrays([keys, pa.array(at, pa.int64()), words, left, pa.array([ends[p] - p for p in at], pa.int64())], ["key", "pos", "word", "left", "rest"])

    return run


def ranks(seqs: DataFrame, key: str, seq: str, k: int, stop: str = "") -> tuple[DataFrame, int]:
    """``key, pos, word, left, rest, ranks``: every position outside stop letters with its first letters, up to k, the letter before, how many letters follow up to a stop letter or the end, and its ranks by k, 2k, 4k ... letters; and the number of rounds.

    A position has as many ranks as it took to tell it from all others, or to
    come to the end of what it has.
    """
    kind = seqs.schema[key].dataType.simpleString()
    rows = spread(seqs.select(F.col(key).alias("key"), F.col(seq).alias("seq"))).mapInArrow(_positions(k, stop), f"key {kind}, pos bigint, word string, left string, rest bigint")
    rows = materialise(rows, "positions")
    words = running(rows.groupBy("word").agg(F.count(F.lit(1)).alias("n")), ["word"], F.col("n"), "rank")
    done = materialise(rows.join(words, "word").select(*rows.columns, F.array("rank").alias("ranks"), F.col("n")), "ranked")
    level = 0
    while True:
        size = k << level
        latest = F.element_at("ranks", -1)
        again = materialise(done.where((F.col("n") > 1) & (F.size("ranks") == level + 1)), "again")
        open_ = again.where(F.col("rest") > size).select(latest.alias("rank")).distinct()
        again = materialise(again.withColumn("rank", latest).join(open_, "rank", "left_semi"), "again")  # groups of which all members end are told apart by nothing
        if not again.take(1):
            return done.drop("n"), level + 1
        on = done.select("key", (F.col("pos") - size).alias("pos"), latest.alias("second"))
        paired = materialise(again.join(on, ["key", "pos"], "left").withColumn("second", F.when(F.col("rest") > size, F.col("second")).otherwise(F.lit(-1))), "paired")
        counts = running(paired.groupBy("rank", "second").agg(F.count(F.lit(1)).alias("m")), ["rank", "second"], F.col("m"), "at")
        first = counts.groupBy("rank").agg(F.min("at").alias("first"))
        fresh = counts.join(first, "rank").select("rank", "second", F.col("m"), (F.col("rank") + F.col("at") - F.col("first")).alias("new"))
        more = paired.join(fresh, ["rank", "second"]).select("key", "pos", F.col("new"), F.col("m"))
        grown = done.join(more, ["key", "pos"], "left").withColumn("ranks", F.when(F.col("new").isNotNull(), F.concat("ranks", F.array("new"))).otherwise(F.col("ranks"))).withColumn("n", F.coalesce("m", "n"))
        done = materialise(grown.drop("new", "m"), "ranked")
        level += 1


def _prefix(column_a: int, column_b: int):
    """Appends how many letters the words of two columns have in common at the start."""

    def run(batches):
        for rb in batches:
            out = []
            for a, b in zip(rb.column(column_a).to_pylist(), rb.column(column_b).to_pylist(), strict=True):
                a, b = a or "", b or ""
                n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
                out.append(n)
            yield pa.RecordBatch.from_arrays([*rb.columns, pa.array(out, pa.int64())], [*rb.schema.names, "tail"])

    return run


def ordered(found: DataFrame, rounds: int, k: int) -> DataFrame:
    """``idx, block, lcp, key, pos, left``: positions of strings of k letters that occur more than once, in suffix order, with the length of what each has in common with the one before; blocks share their first k letters."""
    own = found.where((F.size("ranks") > 1) | (F.col("rest") >= k))
    block = F.get("ranks", F.lit(0))
    many = own.groupBy(block.alias("block")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("block")
    own = own.withColumn("block", block).join(many, "block", "left_semi").where(F.char_length("word") == k)
    order = own.select("block", F.element_at("ranks", -1).alias("rank"), F.xxhash64("key", "pos").alias("tie"), "key", "pos", "left")
    order = materialise(running(order, ["rank", "tie", "key", "pos"], F.lit(1).cast("bigint"), "idx"), "order")
    a = order.select("block", "idx", F.col("key").alias("ka"), F.col("pos").alias("pa"))
    b = order.select("block", (F.col("idx") - 1).alias("idx"), F.col("key").alias("kb"), F.col("pos").alias("pb"))
    pairs = materialise(a.join(b, ["block", "idx"]).select((F.col("idx") + 1).alias("idx"), "ka", "pa", "kb", "pb", F.lit(0).cast("bigint").alias("off")), "pairs")
    at = found.select("key", "pos", "ranks", "rest", "word")
    for level in range(rounds - 1, -1, -1):
        side = lambda x: at.select(F.col("key").alias(f"k{x}"), F.col("pos").alias(f"at{x}"), F.get("ranks", F.lit(level)).alias(f"r{x}"), F.col("rest").alias(f"rest{x}"))  # noqa: E731, B023
        seen = pairs.withColumn("ata", F.col("pa") + F.col("off")).withColumn("atb", F.col("pb") + F.col("off"))
        seen = seen.join(side("a"), ["ka", "ata"], "left").join(side("b"), ["kb", "atb"], "left")
        step = F.when(F.col("ra") == F.col("rb"), F.least(F.lit(k << level), F.col("resta"))).otherwise(F.lit(0))
        pairs = materialise(seen.select("idx", "ka", "pa", "kb", "pb", (F.col("off") + step).alias("off")), "pairs")
    word = lambda x: at.select(F.col("key").alias(f"k{x}"), F.col("pos").alias(f"at{x}"), F.col("word").alias(f"w{x}"))
    last = pairs.withColumn("ata", F.col("pa") + F.col("off")).withColumn("atb", F.col("pb") + F.col("off"))
    last = last.join(word("a"), ["ka", "ata"], "left").join(word("b"), ["kb", "atb"], "left").select("idx", "off", "wa", "wb")
    lcp = last.mapInArrow(_prefix(2, 3), "idx bigint, off bigint, wa string, wb string, tail bigint").select("idx", (F.col("off") + F.col("tail")).alias("lcp"))
    return order.join(lcp, "idx", "left").select("idx", "block", F.coalesce("lcp", F.lit(0)).alias("lcp"), "key", "pos", "left")


def sweep(rows: list[tuple], repeats: bool) -> list[tuple[int, int, int]]:
    """(first, last, length) of the intervals of a block's rows (idx, lcp, sample, left): maximal runs of neighbours that share ``length`` letters, which no letter before them has in common.

    Bottom up with a stack; without ``repeats`` only runs in which no sample
    comes twice, else those of two samples or more.
    """
    found, stack, seen = [], [], {}
    one = lambda x: (x, False)

    def joined(x, y):
        """Whether two states (value, mixed) are mixed together; a null mixes with everything."""
        return (x[0], x[1] or y[1] or x[0] is None or y[0] is None or x[0] != y[0])

    last = None
    for idx, lcp, sample, left in [*rows, (None, -1, None, None)]:
        if last is not None:
            state = [last[0], *last[1:]]  # first idx, left, sample, latest earlier place of a sample
            while stack and stack[-1][0] > lcp:
                length, first, lefts, samples, before = stack.pop()
                lefts, samples, before = joined(lefts, state[1]), joined(samples, state[2]), max(before, state[3])
                if lefts[1] and (samples[1] if repeats else before < first):
                    found.append((first, end, length))
                state = [first, lefts, samples, before]
            if stack and stack[-1][0] == lcp:
                length, first, lefts, samples, before = stack[-1]
                stack[-1] = (length, first, joined(lefts, state[1]), joined(samples, state[2]), max(before, state[3]))
            elif lcp > 0:
                stack.append((lcp, *state))
        if idx is None:
            break
        last, end = (idx, one(left), one(sample), seen.get(sample, -1)), idx
        seen[sample] = idx
    return found


def shared_strings(seqs: DataFrame, sample: str, key: str, seq: str, k: int, repeats: bool, stop: str = "") -> DataFrame:
    """``idx_from, idx_to, length, sample, key, pos, left, right``: the occurrences of every string of k letters or more that occurs twice or more and goes on and comes differently, letters before and after included."""
    own = seqs.select(F.struct(F.col(sample).alias("sample"), F.col(key).alias("key")).alias("__id"), F.col(seq).alias("__seq"))
    found, rounds = ranks(own, "__id", "__seq", k, stop)
    order = materialise(ordered(found, rounds, k), "order")

    def fold(cols: list[list]) -> list[tuple]:
        rows = list(zip(cols[1], cols[2], [x["sample"] for x in cols[3]], cols[5], strict=True))
        return sweep(rows, repeats)

    runs = map_groups(order.select("block", "idx", "lcp", "key", "pos", "left"), ["block"], ["idx"], fold, "idx_from bigint, idx_to bigint, length bigint")
    runs = materialise(runs.where(F.col("length") >= k), "runs")
    each = runs.withColumn("idx", F.explode(F.sequence("idx_from", "idx_to")))
    hit = each.join(order.select("idx", "key", "pos", "left"), "idx").withColumn("next", F.col("pos") + F.col("length"))
    after = found.select("key", F.col("pos").alias("next"), F.substring("word", 1, 1).alias("right"))
    return hit.join(after, ["key", "next"], "left").select("idx_from", "idx_to", "length", F.col("key.sample").alias("sample"), F.col("key.key").alias("key"), "pos", "left", "right")
