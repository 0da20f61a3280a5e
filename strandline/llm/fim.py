"""Fill-in-middle by bit-parallel arithmetic on whole texts.

A text's UTF-8 bytes are one big integer per character class, a bit for each
byte, the first byte highest: ``bytes.translate`` writes the class as binary
digits. Shifted boolean operations leave one bit at the last byte of every
token (white space and the word after it; white space at the end is a token of
its own), ``bit_count`` gives the number of tokens, and halving the integer
finds the bits of given rank. A cut lies behind a whole token, so a text is
only ever cut between characters; their number is a ``bit_count`` too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentinels before prefix, suffix and middle; none is part of another or overlaps one.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Seed of the draws, texts in a hundred that are rearranged, and rearranged ones in a hundred that begin with the suffix.
SEED, RATE, SPM = 42, 50, 80
#: Bytes of results after which a batch is handed on.
FLUSH = 4 << 20

_SPACE = b" \t\n\v\f\r"
_SOLID = bytes(0x30 + (b not in _SPACE) for b in range(256))
_LEAD = bytes(0x30 + (not 0x80 <= b < 0xC0) for b in range(256))


def class_mask(raw: bytes, table: bytes) -> int:
    """A bit for each byte of ``raw``, set where ``table`` says 1; the first byte is the highest bit."""
    return int(raw.translate(table), 2) if raw else 0


def token_ends(raw: bytes) -> int:
    """A bit at the last byte of every token."""
    solid = class_mask(raw, _SOLID)
    ends = solid ^ (solid & solid << 1)
    return ends | 1 if raw and not solid & 1 else ends


def ranked(bits: int, width: int, ranks: Sequence[int], before: int = 0) -> list[int]:
    """For ascending ranks from 1, how many of ``width`` places lie up to the set bit of that rank, counted from the highest."""
    if not ranks:
        return []
    if width == 1:
        return [before + 1] * len(ranks)
    low = width // 2
    high = bits >> low
    n = high.bit_count()
    cut = sum(r <= n for r in ranks)
    return ranked(high, width - low, ranks[:cut], before) + ranked(bits & ((1 << low) - 1), low, [r - n for r in ranks[cut:]], before + width - low)


def draws(doc_id, seed: int) -> list[int]:
    """The first four 32-bit numbers of the sha256 of ``seed:doc_id``."""
    held = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(held[i : i + 8], 16) for i in (0, 8, 16, 24)]


def rearranged(raw: bytes, doc_id, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> tuple[int, str, int | None, int | None, bytes]:
    """Number of tokens, form, characters of prefix and middle, and the output."""
    ends = token_ends(raw)
    n = ends.bit_count()
    h = draws(doc_id, seed)
    if not raw or h[2] % 100 >= rate or any(s in raw for s in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, raw
    units = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = [0] * units.count(0) + ranked(ends, len(raw), [u for u in units if u])
    lead = class_mask(raw, _LEAD)
    to = [(lead >> len(raw) - x).bit_count() for x in (a, b)]
    prefix, middle, suffix = raw[:a], raw[a:b], raw[b:]
    form = "spm" if h[3] % 100 < spm else "psm"
    parts = (SUFFIX, suffix, PREFIX, prefix) if form == "spm" else (PREFIX, prefix, SUFFIX, suffix)
    return n, form, to[0], to[1] - to[0], b"".join((*parts, MIDDLE, middle))


def _texts(seed: int, rate: int, spm: int):
    names = ("n", "form", "prefix_chars", "middle_chars", "output")
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())

    def batch(ids, rows):
        cols = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([ids, *cols[:4], cols[4].cast(pa.string())], ["doc_id", *names])

    def run(batches):
        for rb in batches:
            ids, texts = rb.column(0), rb.column(1).cast(pa.binary())
            rows, a, size = [], 0, 0
            for i in range(len(rb)):
                rows.append(rearranged(texts[i].as_py() or b"", ids[i].as_py(), seed, rate, spm))
                size += len(rows[-1][4])
                if size > FLUSH:
                    yield batch(ids.slice(a, len(rows)), rows)
                    rows, a, size = [], i + 1, 0
            yield batch(ids.slice(a), rows)

    return run


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """``(doc_id, n, form, prefix_chars, middle_chars, output)`` for every row of ``docs(doc_id, text)``.

    A null text counts as empty; empty texts and texts that hold a sentinel are
    plain, as is the share of texts that ``rate`` leaves. A null doc_id draws as
    an empty one; rows that repeat a doc_id draw alike, equal rows give equal
    rows. A text of white space is one token. Cuts that tie leave an empty
    middle. A very long text takes some bytes for each of its own, in one row's
    task, which hands results on after ``FLUSH`` bytes. An empty table gives an
    empty result; other columns, whatever their names, are not read. Nothing is
    shuffled.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
    return docs.select("doc_id", "text").mapInArrow(_texts(seed, rate, spm), found)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a given form was made of."""
    parts = F.split(output, "<[PSM]>", -1)
    psm = F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2)))
    spm = F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(formed: DataFrame) -> DataFrame:
    """Digests of :func:`fill_in_middle`'s outputs and of the texts rebuilt from them."""
    back = restored(F.col("output"), F.col("form"))
    return formed.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))
