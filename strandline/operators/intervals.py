"""Gaps and islands, containment, overlap, complement and range joins over half-open intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.grouped import map_groups
from strandline.session import materialise


def islands(df: DataFrame, partition: list[str], order: list[str], is_new: Column, name: str = "island") -> DataFrame:
    """Number runs of rows: ``is_new`` (over lag columns of the same window) starts a run."""
    w = Window.partitionBy(*partition).orderBy(*order)
    marked = df.withColumn("__new", F.coalesce(is_new.cast("int"), F.lit(1)))
    return marked.withColumn(name, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("__new")


def drop_contained(df: DataFrame, partition: list[str], start: str, end: str, ties: list[str]) -> DataFrame:
    """Drop intervals that lie inside another one; of equal intervals the first by ``ties`` stays."""
    w = Window.partitionBy(*partition).orderBy(F.col(start), F.col(end).desc(), *ties).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("__reach", F.max(end).over(w)).where(F.col("__reach").isNull() | (F.col("__reach") < F.col(end))).drop("__reach")


def complement(df: DataFrame, partition: list[str], start: str, end: str, low: Column, high: Column) -> DataFrame:
    """Parts of ``[low, high)`` that no interval covers, for each partition that has intervals."""
    w = Window.partitionBy(*partition).orderBy(start, end)
    seen = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = df.withColumn("__from", F.greatest(F.coalesce(seen, low), low)).withColumn("__to", F.least(F.col(start), high))
    gaps = rows.where("__from < __to").select(*partition, F.col("__from").alias("gap_start"), F.col("__to").alias("gap_end"))
    tail = df.withColumn("__low", low).withColumn("__high", high).groupBy(*partition, "__low", "__high").agg(F.max(end).alias("__e"))
    tail = tail.select(*partition, F.greatest("__e", "__low").alias("gap_start"), F.col("__high").alias("gap_end")).where("gap_start < gap_end")
    return gaps.unionByName(tail)


def stab_join(points: DataFrame, ranges: DataFrame, point: str, start: str, end: str, width: int, on: list[str] | None = None, how: str = "inner") -> DataFrame:
    """Points joined with the ranges that hold them: an equi-join on bins of ``width``, then the exact test.

    A point has one bin, so that no pair appears twice; a range has one row for
    each bin that it touches. ``how`` "left" keeps points that no range holds,
    with nulls, "anti" returns those alone, repeated ones as often as they come.
    """
    on = on or []
    if how not in ("inner", "left", "anti"):
        raise ValueError(how)
    rows = points if how == "inner" else materialise(points.withColumn("__row", F.monotonically_increasing_id()), "points")
    p = rows.withColumn("__bin", F.floor(F.col(point) / width))
    r = ranges.where(F.col(start) < F.col(end)).withColumn("__bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))
    hit = p.join(r, [*on, "__bin"]).where((F.col(point) >= F.col(start)) & (F.col(point) < F.col(end))).drop("__bin")
    if how == "inner":
        return hit
    alone = rows.join(hit.select("__row").distinct(), "__row", "left_anti").drop("__row")
    return alone if how == "anti" else hit.drop("__row").unionByName(alone, allowMissingColumns=True)


def asof_join(points: DataFrame, marks: DataFrame, point: str, mark: str, on: list[str], how: str = "inner") -> DataFrame:
    """Each point with the last mark at or before it that has equal keys ``on``: the points' columns and the marks' others.

    Both are put into one order and dealt by ranges of it; a window carries the
    last mark along each range, and one row a range carries it over the borders,
    so that neither a key nor a stretch without marks is one task's. Of marks at
    one place the greatest row counts. Points that tie are dealt by a hash of
    theirs. Null keys and places meet nothing; ``how`` "left" keeps points
    without a mark. Names of other columns must differ.
    """
    if how not in ("inner", "left"):
        raise ValueError(how)
    spark = points.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rest = [c for c in marks.columns if c not in on]
    place = points.schema[point].dataType
    key = F.struct(*on) if on else F.struct(F.lit(1).alias("one"))
    known = lambda c: F.forall(F.array(*[F.col(x).isNotNull() for x in (*on, c)]), lambda x: x)
    own = marks.where(known(mark)).select(key.alias("__key"), F.col(mark).cast(place).alias("__at"), F.lit(0).alias("__side"), F.struct(*rest).alias("__mark"))
    mine = points.where(known(point)).select(key.alias("__key"), F.col(point).alias("__at"), F.lit(1).alias("__side"), F.struct(*points.columns).alias("__point"))
    both = own.unionByName(mine, allowMissingColumns=True)
    order = ["__key", "__at", "__side", "__tie"]
    both = both.withColumn("__tie", F.when(F.col("__side") == 1, F.xxhash64("__point")))
    dealt = materialise(both.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "asof")
    w = Window.partitionBy("__part").orderBy("__key", "__at", "__side", "__mark", "__tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = F.last(F.when(F.col("__side") == 0, F.struct("__key", "__mark")), ignorenulls=True).over(w)
    last = dealt.groupBy("__part").agg(F.max(F.when(F.col("__side") == 0, F.struct("__key", "__at", "__mark"))).alias("m"))
    line = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    carried = last.select("__part", F.last(F.when(F.col("m").isNotNull(), F.struct("m.__key", "m.__mark")), ignorenulls=True).over(line).alias("__before"))
    found = dealt.withColumn("__held", held).where("__side = 1").join(carried, "__part").withColumn("__held", F.coalesce("__held", "__before"))
    hit = F.col("__held.__key") == F.col("__key")
    out = found.withColumn("__hit", F.when(hit, F.col("__held.__mark"))).where("__hit is not null" if how == "inner" else "true")
    out = out.select("__point.*", *[F.col(f"__hit.{c}").alias(c) for c in rest])
    if how == "left":
        out = out.unionByName(points.where(~known(point)), allowMissingColumns=True)
    return out


def subtract(left: DataFrame, right: DataFrame, l_start: str, l_end: str, r_start: str, r_end: str, width: int, on: list[str], how: str = "parts") -> DataFrame:
    """What the intervals of ``right`` with equal keys leave of each interval of ``left``.

    The rows of ``left`` with their bounds narrowed to each part that is left,
    in pieces where something in the middle is taken. ``how`` "anti" returns
    only intervals that nothing touches, "outer" also a row with null bounds for
    each that is covered as a whole. Empty intervals have no parts.
    """
    if how not in ("parts", "anti", "outer"):
        raise ValueError(how)
    rows = materialise(left.withColumn("__row", F.monotonically_increasing_id()), "left")
    cover = right.select(*on, F.col(r_start).alias("__rs"), F.col(r_end).alias("__re"))
    pairs = overlap_join(rows.select(*on, "__row", F.col(l_start).alias("__ls"), F.col(l_end).alias("__le")), cover, "__ls", "__le", "__rs", "__re", width, on)
    pairs = materialise(pairs.select("__row", "__ls", "__le", "__rs", "__re"), "pairs")
    full = rows.where(F.col(l_start) < F.col(l_end))
    whole = full.join(pairs.select("__row").distinct(), "__row", "left_anti")
    if how == "anti":
        return whole.select(*left.columns)
    rest = complement(pairs, ["__row", "__ls", "__le"], "__rs", "__re", F.col("__ls"), F.col("__le")).select("__row", "gap_start", "gap_end")
    cut = full.join(rest, "__row").withColumn(l_start, F.col("gap_start")).withColumn(l_end, F.col("gap_end")).select("__row", *left.columns)
    out = whole.select("__row", *left.columns).unionByName(cut)
    if how == "outer":
        gone = full.join(out.select("__row").distinct(), "__row", "left_anti")
        out = out.unionByName(gone.select("__row", *[F.lit(None).cast(left.schema[c].dataType).alias(c) if c in (l_start, l_end) else F.col(c) for c in left.columns]))
    return out.select(*left.columns)


def mask(seqs: DataFrame, spans: DataFrame, key: str, seq: str, start: str, end: str, letter: str = "N") -> DataFrame:
    """``seqs`` with every letter inside a span of its ``key`` replaced; spans may overlap and reach past the ends."""
    w = Window.partitionBy(key).orderBy(start, end)
    runs = islands(spans.select(key, start, end).where(F.col(start) < F.col(end)), [key], [start, end], F.col(start) > F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    one = runs.groupBy(key, "island").agg(F.greatest(F.min(start), F.lit(0)).alias("s"), F.max(end).alias("e"))
    every = one.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("__spans"))
    rows = seqs.join(every, key, "left")
    n = F.char_length(seq)
    edges = F.transform("__spans", lambda x, i: F.struct(F.when(i == 0, F.lit(0)).otherwise(F.get("__spans", i - 1)["e"]).alias("from"), F.least(x["s"], n).alias("s"), F.least(x["e"], n).alias("e")))
    cut = lambda a, b: F.substring(seq, (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))
    parts = F.transform(edges, lambda x: F.concat(cut(x["from"], x["s"]), F.repeat(F.lit(letter), F.greatest(x["e"] - x["s"], F.lit(0)).cast("int"))))
    tail = cut(F.least(F.element_at("__spans", -1)["e"], n), n)
    return rows.withColumn(seq, F.when(F.col("__spans").isNull(), F.col(seq)).otherwise(F.concat(F.array_join(parts, ""), tail))).select(*seqs.columns)


def overlap_join(left: DataFrame, right: DataFrame, l_start: str, l_end: str, r_start: str, r_end: str, width: int, on: list[str]) -> DataFrame:
    """Pairs of overlapping intervals within the same keys; a pair is kept in the bin of its first common position."""
    def binned(df: DataFrame, s: str, e: str) -> DataFrame:
        return df.where(F.col(s) < F.col(e)).withColumn("__bin", F.explode(F.sequence(F.floor(F.col(s) / width), F.floor((F.col(e) - 1) / width))))

    joined = binned(left, l_start, l_end).join(binned(right, r_start, r_end), [*on, "__bin"])
    first = F.greatest(F.col(l_start), F.col(r_start))
    return joined.where((first < F.least(F.col(l_end), F.col(r_end))) & (F.col("__bin") == F.floor(first / width))).drop("__bin")


def box_join(points: DataFrame, boxes: DataFrame, dims: list[tuple[str, str, str]], width: int, on: list[str] | None = None) -> DataFrame:
    """Points with the boxes that hold them, ends included; ``dims`` are (point, low, high), the first of which is binned by ``width``.

    The first dimension should be the most selective one.
    """
    point, low, high = dims[0]
    p = points.withColumn("__bin", F.floor(F.col(point) / width))
    r = boxes.where(F.col(low) <= F.col(high)).withColumn("__bin", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    inside = F.lit(True)
    for c, a, b in dims:
        inside = inside & F.col(c).between(F.col(a), F.col(b))
    return p.join(r, [*(on or []), "__bin"]).where(inside).drop("__bin")


def trim_overlap(df: DataFrame, partition: list[str], start: str, end: str) -> DataFrame:
    """Along one axis both of two overlapping neighbours lose the overlap; what is left of length 0 or less goes.

    Contained intervals go first. The walk is an ordered fold, so each
    partition is folded in order.
    """
    kept = drop_contained(df, partition, start, end, [])

    rest = [c for c in kept.columns if c not in (*partition, start, end)]
    n = len(partition)

    def fold(cols: list[list]) -> list[tuple]:
        s, e = cols[n][:], cols[n + 1][:]
        last, keep = -1, [True] * len(s)
        for i in range(len(s)):
            while last >= 0:
                over = e[last] - s[i]
                if over <= 0:
                    break
                s[i], e[last] = s[i] + over, e[last] - over
                if e[last] > s[last]:
                    break
                keep[last] = False
                last -= 1
                while last >= 0 and not keep[last]:
                    last -= 1
            if e[i] > s[i]:
                last = i
            else:
                keep[i] = False
        other = [c for c in cols[:n]] + [s, e] + cols[n + 2 :]
        return [tuple(c[i] for c in other) for i in range(len(s)) if keep[i]]

    rows = kept.select(*partition, start, end, *rest)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return map_groups(rows, partition, [start, end], fold, schema).select(*kept.columns)
