"""Document fingerprints by order min-hashing, in DataFrame functions only.

A text's tokens are its words (runs of up to ``TOKEN`` characters without white
space) and, in longer runs, what begins at every character: up to ``PIECE``
characters. So a change moves only the tokens around it, in unspaced text too.
Tokens give k-mers of ``K`` tokens. Equal k-mers are numbered by occurrence, so that every
one is a distinct element. An element's hash names its bucket and its rank
there; a bucket keeps its ``PICK`` smallest elements, puts them back into text
order, and hashes the tuple. Two texts are alike in as many buckets as hold the
same tuple: this needs the same rare pieces in the same order, as small edit
distance does.

All steps are array functions on one row. ``_let`` binds an intermediate array
to a lambda variable, so that it is computed once a row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.session import materialise

#: Characters of a word at most, and of a token in longer runs; tokens of a k-mer, elements kept in a bucket, bits of the bucket number.
TOKEN, PIECE, K, PICK, BUCKET_BITS = 16, 4, 2, 2, 6
#: Low bits of an element that hold its place in the text, and bits of a bucket's tuple hash.
PLACE_BITS, CODE_BITS = 26, 16

_PLACE = (1 << PLACE_BITS) - 1
_WORD = rf"(?<!\S)\S{{1,{TOKEN}}}+(?!\S)"
#: Group 1 is the token: a word, which is passed over, or a piece of a longer run, of which one character is.
_TOKENS = rf"(?=({_WORD}|\S{{1,{PIECE}}}+))(?:{_WORD}|\S)"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _upto(n: Column) -> Column:
    """0 .. n - 1, also for n = 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _high(x: Column) -> Column:
    return x.bitwiseAND(F.lit(~_PLACE))


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_PLACE))


def _run_starts(sorted_: Column, same: Callable[[Column], Column]) -> Column:
    """Indices of a sorted array where ``same`` changes."""
    return F.filter(_upto(F.size(sorted_)), lambda i: (i == 0) | (same(F.get(sorted_, i)) != same(F.get(sorted_, i - 1))))


def signature(text: Column) -> Column:
    """``array<int>``: bucket number and tuple hash of every occupied bucket, ascending."""
    bits = 64 - BUCKET_BITS
    bucket = lambda x: F.shiftright(x, bits)

    def kmers(w: Column) -> Column:
        n = F.size(w)
        many = F.transform(F.sequence(F.lit(0), n - K), lambda i: _high(F.xxhash64(*[F.get(w, i + j) for j in range(K)])).bitwiseOR(i.cast("bigint")))
        return F.when(n >= K, many).when(n > 0, F.array(_high(F.xxhash64(w)))).otherwise(F.array().cast("array<bigint>"))

    def numbered(s: Column) -> Column:
        def runs(starts: Column) -> Column:
            def run(at: Column, j: Column) -> Column:
                end = F.coalesce(F.get(starts, j + 1), F.size(s))
                return F.transform(F.sequence(at, end - 1), lambda i: _high(F.xxhash64(_high(F.get(s, i)), i - at)).bitwiseOR(_low(F.get(s, i))))

            return F.flatten(F.transform(starts, run))

        return _let(_run_starts(s, _high), runs)

    def code(e: Column, at: Column) -> Column:
        own = F.filter(F.slice(e, at + 1, PICK), lambda x: bucket(x) == bucket(F.get(e, at)))
        ordered = F.sort_array(F.transform(own, lambda x: F.shiftleft(_low(x), 64 - PLACE_BITS).bitwiseOR(F.shiftrightunsigned(x, PLACE_BITS))))
        tuple_ = F.xxhash64(F.transform(ordered, lambda x: x.bitwiseAND(F.lit((1 << 64 - PLACE_BITS) - 1))))
        place = F.pmod(bucket(F.get(e, at)), F.lit(1 << BUCKET_BITS))
        return F.shiftleft(place, CODE_BITS).bitwiseOR(F.pmod(tuple_, F.lit(1 << CODE_BITS))).cast("int")

    def tuples(e: Column) -> Column:
        return F.transform(_run_starts(e, bucket), lambda at: code(e, at))

    words = F.regexp_extract_all(text, F.lit(_TOKENS), F.lit(1))
    return F.sort_array(_let(words, lambda w: _let(F.sort_array(kmers(w)), lambda s: _let(F.sort_array(numbered(s)), tuples))))


def as_text(signature_: Column) -> Column:
    """A signature as a string: six hex digits a bucket."""
    return F.array_join(F.transform(signature_, lambda v: F.lpad(F.hex(v), (BUCKET_BITS + CODE_BITS + 3) // 4, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal tuples among the buckets that either text occupies; two empty texts are alike."""
    places = lambda s: F.transform(s, lambda v: F.shiftright(v, CODE_BITS))
    either = F.size(F.array_union(places(a), places(b)))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def with_previous(docs: DataFrame) -> DataFrame:
    """``(doc_id, mark, copy, n_chars, prev_id, prev_mark, prev_copy, prev_chars)``: each row's predecessor in descending doc_id, the first row's being the last.

    Ids alone are dealt by range and written; neighbours across ranges come
    from one row a range. Null ids come last; rows with equal ids are ordered
    by a hash of their texts, and equal rows are numbered by ``copy``.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = (F.col("doc_id").desc_nulls_last(), F.col("mark"))
    ids = docs.select("doc_id", F.xxhash64("text").alias("mark"), F.char_length("text").cast("bigint").alias("n_chars"))
    ids = materialise(ids.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "ids")
    within = Window.partitionBy("part").orderBy(*order)
    copy = F.row_number().over(Window.partitionBy("part", "doc_id", "mark").orderBy("n_chars"))
    own = F.struct("doc_id", "mark", "copy", "n_chars")
    rows = ids.withColumn("copy", copy).withColumn("own", own)
    within = Window.partitionBy("part").orderBy(*order, "copy")
    ranked = rows.withColumn("before", F.lag("own").over(within))
    last = rows.withColumn("next", F.lead("doc_id").over(within)).withColumn("end", F.lead(F.lit(1)).over(within).isNull()).where("end").select("part", F.col("own").alias("tail"))
    line = Window.orderBy("part")  # one row a range
    wrap = F.last("tail").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    tails = last.select("part", F.coalesce(F.lag("tail").over(line), wrap).alias("tail"))
    prev = F.coalesce("before", "tail")
    return ranked.join(tails, "part").select("doc_id", "mark", "copy", "n_chars", prev["doc_id"].alias("prev_id"), prev["mark"].alias("prev_mark"), prev["copy"].alias("prev_copy"), prev["n_chars"].alias("prev_chars"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)`` for every row of ``docs(doc_id, text)``.

    A null text counts as empty; an empty text has an empty fingerprint. The
    edited text has its last half replaced by the start of the next document's
    text, in descending doc_id; a table of one row is its own next. Null ids
    come last; rows that share an id are ordered by a hash of their texts, and
    equal rows, which are alike, in any order. Repeated rows each get a row. A
    very long text is one row's arrays, of one element a token; places in it
    are told apart up to 2 ** ``PLACE_BITS``. An empty table gives an empty
    result; other columns, whatever their names, are not read.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    links = materialise(with_previous(base), "previous")
    copies = bool(links.where("copy > 1").take(1))
    texts = base.withColumn("mark", F.xxhash64("text")).withColumn("own", signature(F.col("text")))
    keys = ["doc_id", "mark"]
    if copies:  # only then rows need numbers to be told apart
        texts = texts.withColumn("copy", F.row_number().over(Window.partitionBy(*keys).orderBy("mark")))
        keys.append("copy")
    links = links.select(*[F.col(k).alias(f"l_{k}") for k in keys], "n_chars", *[F.col(f"prev_{k.removeprefix('doc_')}").alias(f"p_{k}") for k in keys], "prev_chars")

    def match(left: DataFrame, right: DataFrame, prefix: str) -> DataFrame:
        on = left[keys[0]].eqNullSafe(right[f"{prefix}_{keys[0]}"])
        for k in keys[1:]:
            on = on & (left[k] == right[f"{prefix}_{k}"])
        return left.join(right, on)

    rows = match(texts, links, "l")
    given = rows.select(*[F.col(f"p_{k}").alias(f"g_{k}") for k in keys], F.expr("substring(text, 1, int(prev_chars div 2))").alias("given"), F.col("own").alias("next_own"))
    kept = rows.select(*keys, "text", "n_chars", "own")
    both = match(kept, given, "g")
    edited = F.concat(F.expr("substring(text, 1, int(n_chars - n_chars div 2))"), F.col("given"))
    out = both.select("doc_id", "n_chars", "own", "next_own", edited.alias("edited"))
    out = out.select("doc_id", "n_chars", "own", "next_own", F.sha2("edited", 256).alias("edited_sha256"), signature(F.col("edited")).alias("changed"))
    return out.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"), as_text(F.col("changed")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("next_own")).alias("near_next"))
