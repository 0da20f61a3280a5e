"""Quality by weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every text.
Expectation-maximisation over the counts of vote patterns of all documents
estimates each labeller's confusion matrix and the class prior; the posterior
labels of a bounded sample train a linear scorer on hashed word shapes, which
then scores every document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import wordhash as W
from strandline.llm.toxicity import fit_linear, in_order

#: Documents that the scorer is fitted on, at most (the smallest hashes of doc_id), and hash bits of its features.
TRAIN_ROWS, BITS = 20_000, 12
#: Words of the windows in which distinct words are counted.
WINDOW = 500
#: Names of the labellers, in the order of their votes.
LABELLERS = ("shouting", "symbols", "word_length", "short_words", "length", "punctuation", "repeated_words", "repeated_lines", "digits", "separators", "word_runs")
DENSE = len(LABELLERS)

_U = np.uint64
# Shapes: a byte's class takes the place of the byte; punctuation keeps its identity.
_SHAPE = np.arange(256)
_SHAPE[97:123], _SHAPE[65:91], _SHAPE[48:58], _SHAPE[128:] = 97, 65, 48, 97
_CODE = W._BYTE[_SHAPE] ^ _U(0xA5A5A5A5)
_KIND = np.zeros(256, np.uint8)
_KIND[65:91], _KIND[97:123], _KIND[128:], _KIND[48:58] = 1, 2, 2, 3
_KIND[[*b"#$%&*|!<>{}[]\\^~_=+@"]] = 4
_KIND[ord("|")] = 5
_KIND[[*b".,;:?"]] = 6


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(flags)))[bounds])


def distinct_share(words: np.ndarray) -> float:
    """Mean share of distinct words in windows of ``WINDOW`` words, by their words; so that a text's length alone does not change it."""
    if len(words) <= WINDOW:
        return len(np.unique(words)) / len(words)
    at = np.arange(len(words)) // WINDOW
    order = np.lexsort((words, at))
    new = (words[order[1:]] != words[order[:-1]]) | (at[order[1:]] != at[order[:-1]])
    return (1 + int(new.sum())) / len(words)


def read(column: pa.Array):
    """For each chunk of texts: (text, shape, count) triples, dense values and votes (1 good, -1 bad, 0 none)."""
    raw_all, bounds_all = W.text_bytes(column)
    for a, b in W.chunks(bounds_all):
        raw, bounds = raw_all[bounds_all[a] : bounds_all[b]], bounds_all[a : b + 1] - bounds_all[a]
        h, starts, ends, at = W.word_hashes(raw, bounds, W.NOT_SPACE)
        n, words = b - a, np.maximum(np.diff(at), 1)
        if len(starts):
            up, down = W._pow(len(raw) + 1)
            sums = np.concatenate((np.zeros(1, _U), np.cumsum(_CODE[raw] * up[: len(raw)], dtype=_U)))
            shape = (W.mix((sums[ends] - sums[starts]) * down[starts]) >> _U(64 - BITS)).astype(np.int64)
            pair, count = np.unique(np.repeat(np.arange(n), np.diff(at)) << BITS | shape, return_counts=True)
        else:
            pair = count = np.zeros(0, np.int64)
        kinds = _KIND[raw]
        upper, lower, digit, symbol, bar, stop = (_sums(kinds == k, bounds) for k in range(1, 7))
        letters, size = np.maximum(upper + lower, 1), np.maximum(np.diff(bounds), 1)
        length = ends - starts
        mean = np.bincount(np.repeat(np.arange(n), np.diff(at)), length, n) / words
        short = np.bincount(np.repeat(np.arange(n), np.diff(at)), length <= 3, n) / words
        same = np.concatenate((np.zeros(1, np.int64), np.cumsum(h[1:] == h[:-1]))) if len(h) else np.zeros(1, np.int64)
        runs = np.where(np.diff(at) > 1, same[np.maximum(at[1:] - 1, 0)] - same[np.minimum(at[:-1], len(same) - 1)], 0) / words
        distinct, lines = np.ones(n), np.zeros(n)
        for d in range(n):
            own = h[at[d] : at[d + 1]]
            if len(own):
                distinct[d] = distinct_share(own)
                parts = raw[bounds[d] : bounds[d + 1]].tobytes().split(b"\n")
                lines[d] = 1 - len(set(parts)) / len(parts)
        values = np.stack([upper / letters, (symbol + bar) / size, mean, short, np.diff(at).astype(float), stop / words, distinct, lines, digit / size, bar / words, runs], 1)
        yield (pair >> BITS, pair & ((1 << BITS) - 1), count), np.concatenate([np.log1p(values[:, 4:5]), np.delete(values, 4, 1)], 1), vote(values)


def vote(values: np.ndarray) -> np.ndarray:
    """Votes of the labellers on (shouting share, symbol share, mean word length, share of short words, words, stops a word, distinct share, repeated lines, digit share, bars a word, share of words that repeat the one before)."""
    shout, symbols, mean, short, words, stops, distinct, lines, digits, bars, runs = values.T

    def say(bad, good):
        return np.where(bad, -1, np.where(good, 1, 0)).astype(np.int8)

    return np.stack(
        [
            say((shout > 0.3) & (words >= 5), shout < 0.1), say(symbols > 0.04, symbols < 0.005), say((mean < 2.5) | (mean > 12), (mean > 3.5) & (mean < 9)), say((short < 0.08) & (words >= 20), short > 0.2), say(words == 0, words > 40),
            say((stops < 0.02) & (words >= 20), (stops > 0.05) & (stops < 0.4)), say(distinct < 0.25, distinct > 0.4), say(lines > 0.3, lines == 0), say(digits > 0.2, digits < 0.02), say(bars > 0.1, bars == 0), say((runs > 0.1) & (words >= 20), runs < 0.01),
        ],
        1,
    )


def _patterns(batches):
    total: dict[int, int] = {}
    for rb in batches:
        for _, _, votes in read(rb.column(0)):
            code = (votes.astype(np.int64) + 1) @ (3 ** np.arange(len(LABELLERS)))
            for k, n in zip(*map(np.ndarray.tolist, np.unique(code, return_counts=True)), strict=True):
                total[k] = total.get(k, 0) + n
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["code", "n"])


def _examples(batches):
    for rb in batches:
        for (text, shape, count), dense, votes in read(rb.column(0)):
            cut = np.searchsorted(text, np.arange(len(votes) + 1))
            pairs = list(zip(cut[:-1], cut[1:], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([shape[i:j] for i, j in pairs], pa.list_(pa.int32())), pa.array([count[i:j] for i, j in pairs], pa.list_(pa.int32())), pa.array(list(dense), pa.list_(pa.float64())), pa.array(list(votes), pa.list_(pa.int8()))], ["shapes", "counts", "dense", "votes"])


class Labellers:
    """Confusion matrices of labellers and the class prior, by expectation-maximisation over vote patterns."""

    def fit(self, votes: np.ndarray, n: np.ndarray, rounds: int = 100) -> Labellers:
        onehot = votes[:, :, None] == np.array([-1, 0, 1])
        post = np.array([0.98, 0.4, 0.05])[np.minimum((votes < 0).sum(1), 2)]  # bad votes fire rarely, so they count for more to begin with
        for _ in range(rounds):
            w = np.stack([n * (1 - post), n * post])
            self.prior = np.log((w.sum(1) + 1) / (w.sum() + 2))
            t = np.einsum("cp,pia->cia", w, onehot) + 0.5
            t[:, :, 1] = 0  # a labeller that abstains says nothing
            t = t / t.sum(2, keepdims=True)
            t[:, :, 1] = 1
            self.table = np.log(t)
            new = self.posterior(votes)
            done = np.abs(new - post).max() < 1e-8
            post = new
            if done:
                break
        return self

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of good for each row of votes."""
        k = np.arange(votes.shape[1])
        s = self.prior[:, None] + self.table[:, k, votes.astype(int) + 1].sum(2)
        return 1 / (1 + np.exp(np.clip(s[0] - s[1], -50, 50)))


class Model:
    labellers: Labellers | None = None

    def scores(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Posterior of the labellers and score of the linear model for each text."""
        if self.labellers is None:
            return np.zeros(len(column)), np.zeros(len(column))
        post, out = [], []
        for (text, shape, count), dense, votes in read(column):
            z = np.bincount(text, self._scaled(text, count, len(dense)) * self.weights[shape], len(dense)) + ((dense - self.mean) / self.scale) @ self.dense + self.bias
            out.append(1 / (1 + np.exp(-np.clip(z, -50, 50))))
            post.append(self.labellers.posterior(votes))
        return (np.concatenate(post), np.concatenate(out)) if out else (np.zeros(0), np.zeros(0))

    @staticmethod
    def _scaled(text: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
        return count / np.maximum(np.bincount(text, count, n), 1)[text]


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Fit on ``docs(doc_id, text)``: labellers on the votes of all, the scorer on about ``train_rows``, those whose hashes are smallest."""
    model = Model()
    seen = docs.select("text").mapInArrow(_patterns, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).toPandas().sort_values("code")  # 3 ** 11 patterns at most
    if not len(seen):
        return model
    patterns = (seen.code.to_numpy()[:, None] // 3 ** np.arange(len(LABELLERS))) % 3 - 1
    model.labellers = Labellers().fit(patterns, seen.n.to_numpy(float))
    key = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40))  # hashes alone decide: nothing is sorted, equal rows count once
    share = min(1.0, train_rows / max(int(seen.n.sum()), 1))
    chosen = docs.select(key.alias("key"), "text").where(F.col("key") < int(share * (1 << 40))).groupBy("key").agg(F.first("text").alias("text"))
    rows = in_order(chosen.select("text").mapInArrow(_examples, "shapes array<int>, counts array<int>, dense array<double>, votes array<tinyint>").toPandas())  # about train_rows
    dense = np.array(rows.dense.tolist()).reshape(-1, DENSE)
    model.mean, model.scale = (dense.mean(0), dense.std(0) + 1e-6) if len(dense) else (np.zeros(DENSE), np.ones(DENSE))
    row = np.repeat(np.arange(len(rows)), [len(x) for x in rows["shapes"]])
    col = np.concatenate([np.zeros(0, np.int64), *(np.asarray(x, np.int64) for x in rows["shapes"])])
    val = np.concatenate([np.zeros(0), *(np.asarray(x, float) for x in rows["counts"])])
    target = model.labellers.posterior(np.array(rows.votes.tolist(), int).reshape(-1, len(LABELLERS)))
    if len(rows):
        model.weights, model.dense, model.bias = fit_linear(row, col, Model._scaled(row, val, len(rows)), (dense - model.mean) / model.scale, target, 1 << BITS)
    else:
        model.weights, model.dense, model.bias = np.zeros(1 << BITS), np.zeros(DENSE), 0.0
    return model


def _scorer(sent):
    def run(batches):
        for rb in batches:
            post, score = sent.value.scores(rb.column(1))
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(post, pa.float64()), pa.array(score, pa.float64())], ["doc_id", "posterior", "score"])

    return run


def score(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``(doc_id, posterior, score, kept)`` for every row of ``docs(doc_id, text)``.

    ``posterior`` is the label model's probability that the text is good,
    ``score`` the linear scorer's; rows with a score of 0.5 or more are kept.
    Null and empty texts are scored like texts without words; repeated rows
    and rows without an id each get a row, equal texts equal scores; an empty
    table gives none. Very long texts are read in chunks of whole texts, so the
    longest one bounds a task's memory. Other columns, whatever their names, are
    not read.
    """
    base = docs.select("doc_id", "text")
    kind = base.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(fit(base, train_rows))
    out = base.mapInArrow(_scorer(sent), f"doc_id {kind}, posterior double, score double")
    return out.withColumn("kept", F.col("score") >= 0.5)


def drop_bad(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that score below 0.5; columns stay as they are, whatever their names.

    Null, empty and very long texts are scored as in :func:`score`, repeated
    rows go or stay together, and an empty table stays empty.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs.select("doc_id", "text"), **options))
    at = docs.columns.index("text")

    def run(batches):
        for rb in batches:
            yield rb.filter(pa.array(sent.value.scores(rb.column(at))[1] >= 0.5))

    return docs.mapInArrow(run, docs.schema)
