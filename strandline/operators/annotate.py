"""Repeat annotation of variants: the best report row of each, and the class that follows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.expr import repeat_class


def best_hits(report: DataFrame, key: str, score: str, order: list[str]) -> DataFrame:
    """The row of highest score of each key; ties keep the first by ``order``."""
    rest = [c for c in report.columns if c not in (key, score, *order)]
    best = F.min(F.struct((-F.col(score)).alias("__s"), *order, *rest)).alias("b")
    return report.groupBy(key).agg(best).select(key, (-F.col("b.__s")).alias(score), *[F.col(f"b.{c}").alias(c) for c in (*order, *rest)])


def annotate(variants: DataFrame, repeats: DataFrame, tandems: DataFrame, min_diff: int = 0, max_diff: int | None = None) -> DataFrame:
    """Variants ``(name, size)`` whose size lies in the window, with the class of their best repeat and tandem report rows.

    ``repeats(name, score, qbegin, qend, rbegin, rend, rleft, rfamily)`` covers a
    variant by qbegin..qend and a repeat of length rend + rleft by rbegin..rend;
    ``tandems(name, score, start, end, period_size)`` covers it by start..end.
    Variants without a report row are ``other``.
    """
    own = variants.where(F.col("size") >= min_diff)
    if max_diff is not None:
        own = own.where(F.col("size") < max_diff)
    r = best_hits(repeats, "name", "score", ["qbegin", "qend"])
    t = best_hits(tandems, "name", "score", ["start", "end"])
    part = (F.col("rend") - F.col("rbegin") + 1) / (F.col("rend") + F.col("rleft"))
    r = r.select("name", (F.col("qend") - F.col("qbegin") + 1).alias("covered"), part.alias("of_repeat"), "rfamily")
    t = t.select("name", (F.col("end") - F.col("start") + 1).alias("tandem"), "period_size")
    rows = own.join(r, "name", "left").join(t, "name", "left")
    share = lambda c: F.coalesce(F.col(c) / F.col("size"), F.lit(0.0))
    kind = repeat_class(F.coalesce("of_repeat", F.lit(0.0)), share("covered"), F.coalesce("rfamily", F.lit("")), share("tandem"), F.coalesce("period_size", F.lit(0)))
    return rows.select("name", "size", "rfamily", "period_size", kind.alias("class"))
