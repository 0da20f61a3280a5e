"""Toxicity by weak supervision.

Lexicons of words and word beginnings are mined from labelled rows. Each
lexicon, in a strict and a lenient form, and a few surface patterns are voters.
A generative label model estimates, over the votes of all documents, each
voter's accuracy given the class and the correlations between voters (a
maximum spanning forest of class-conditional dependences, re-estimated by
expectation-maximisation); labelled rows only help it to the accuracies. Its
posterior labels of a bounded sample of all documents, nearly all of them
without a label, train a linear classifier on hashed features, which scores
whole texts. The classifier sees no label of an annotator.

Labels are only read from the rows given as training rows; no score uses a
label, language, source or id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm import wordhash as W
from strandline.session import materialise

#: Labelled rows that lexicons are mined from, at most (the smallest hashes of doc_id), and documents that the classifier is trained on, about (the smallest hashes of doc_id and text).
TRAIN_ROWS, SAMPLE_ROWS = 20_000, 20_000
#: Hash bits of features; lexicon features kept; bytes of the word beginnings (0: whole words).
BITS, FEATURES, PREFIXES = 20, 2048, (0, 5, 6, 8)
#: A feature belongs to a strict lexicon from this log-odds on; to a lenient one from the lower.
STRICT, LENIENT = 4.0, 2.0
#: Words of a text for each strict hit that can be there by chance; a lenient lexicon votes no below the first sum of log-odds a word, yes from the second on.
CHANCE, RATES = 200, (0.03, 0.1)
#: Dependences weaker than this mutual information (nats) are left out of the label model.
DEPENDENCE = 0.01
VOTERS = 2 * len(PREFIXES) + 3
DENSE = 4

_U = np.uint64
_TEXT = np.zeros(256, np.uint8)
_TEXT[65:91] = 1
_TEXT[97:123] = 2
_TEXT[ord("!")] = 3
_TEXT[ord("*")] = 4


def _feature_ids(raw: np.ndarray, bounds: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashed features of every word for each prefix length (-1: none), and text bounds in words."""
    starts, ends, at = W.spans(raw, bounds, W.ALNUM)
    if not len(starts):
        return [np.zeros(0, np.int64)] * len(PREFIXES), at
    up, down = W._pow(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, _U)
    np.cumsum(W._BYTE[raw] * up[: len(raw)], out=sums[1:])
    out = []
    for n in PREFIXES:
        e = ends if not n else np.minimum(starts + n, ends)
        h = W.mix((sums[e] - sums[starts]) * down[starts] + _U(n * 0x51ED2701))
        ids = (h >> _U(64 - BITS)).astype(np.int64)
        out.append(ids if not n else np.where(ends - starts > n, ids, -1))
    return out, at


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(flags)))[bounds - bounds[0]])


class Lexicon:
    """Selected features: their table, log-odds and families."""

    def __init__(self, ids: np.ndarray, odds: np.ndarray, family: np.ndarray, alone: np.ndarray):
        self.odds, self.family, self.alone = odds, family, alone
        self.table = np.full((len(PREFIXES), 1 << BITS), -1, np.int16)
        self.table[family, ids] = np.arange(len(ids))

    def read(self, column: pa.Array, toxic: np.ndarray | None = None):
        """For each chunk of texts: (text, feature, count) triples, dense values and votes.

        For training texts ``toxic`` has their labels; features that a toxic
        text has only helped into the lexicon itself are then left out, so
        that training texts look like unseen ones.
        """
        raw_all, bounds_all = W.text_bytes(column)
        for a, b in W.chunks(bounds_all):
            raw, bounds = raw_all[bounds_all[a] : bounds_all[b]], bounds_all[a : b + 1]
            ids, at = _feature_ids(raw, bounds)
            texts, feats = [], []
            for f, own in enumerate(ids):
                got = np.where(own >= 0, self.table[f][own], -1)
                p = np.flatnonzero(got >= 0)
                texts.append(np.searchsorted(at, p, "right") - 1)
                feats.append(got[p].astype(np.int64))
            pair, count = np.unique(np.concatenate(texts) * FEATURES + np.concatenate(feats), return_counts=True)
            text, feat = pair // FEATURES, pair % FEATURES
            if toxic is not None:
                m = ~(self.alone[feat] & (toxic[a:b][text] > 0))
                text, feat, count = text[m], feat[m], count[m]
            n = b - a
            kinds = _TEXT[raw]
            upper, lower, bang, star = (_per_text(kinds == k, bounds) for k in (1, 2, 3, 4))
            words = np.diff(at)
            hits = np.bincount(text, count * self.odds[feat], n) if len(text) else np.zeros(n)
            dense = np.stack([np.log1p(words), upper / np.maximum(upper + lower, 1), bang / np.maximum(words, 1), hits / np.maximum(words, 1)], 1)
            votes = np.zeros((n, VOTERS), np.int8)
            for f in range(len(PREFIXES)):
                own = self.family[feat] == f
                strict = own & (self.odds[feat] >= STRICT)
                c = np.bincount(text[strict], count[strict], n)
                votes[:, 2 * f] = np.where(c * CHANCE > words, 1, np.where(c == 0, -1, 0))
                rate = np.bincount(text[own], count[own] * self.odds[feat[own]], n) / np.maximum(words, 1)
                votes[:, 2 * f + 1] = np.where(rate >= RATES[1], 1, np.where(rate < RATES[0], -1, 0))
            k = 2 * len(PREFIXES)
            votes[:, k] = np.where(upper > 0.5 * np.maximum(upper + lower, 1), 1, 0)
            votes[:, k + 1] = np.where(bang > 0.2 * np.maximum(words, 1), 1, 0)
            votes[:, k + 2] = np.where(star > 2, 1, 0)
            yield (text, feat, count), dense, votes


def _document_counts(batches):
    counts = np.zeros((2, len(PREFIXES), 1 << BITS), np.int32)
    seen = np.zeros(2, np.int64)
    for rb in batches:
        label = np.asarray(rb.column(1)).astype(int)
        raw_all, bounds_all = W.text_bytes(rb.column(0))
        for a, b in W.chunks(bounds_all):
            ids, at = _feature_ids(raw_all[bounds_all[a] : bounds_all[b]], bounds_all[a : b + 1])
            text = np.repeat(np.arange(b - a), np.diff(at))
            for f, own in enumerate(ids):
                p = own >= 0
                pair = np.unique(text[p] << BITS | own[p])
                y = label[a:b][pair >> BITS]
                for c in (0, 1):
                    counts[c, f] += np.bincount(pair[y == c] & ((1 << BITS) - 1), minlength=1 << BITS).astype(np.int32)
        seen += np.bincount(label, minlength=2)[:2]
    f, i = np.nonzero(counts.any(0))
    yield pa.RecordBatch.from_arrays([pa.array(np.append(f, -1).astype(np.int32)), pa.array(np.append(i, 0).astype(np.int32)), pa.array(np.append(counts[0, f, i], seen[0]).astype(np.int64)), pa.array(np.append(counts[1, f, i], seen[1]).astype(np.int64))], ["family", "id", "n0", "n1"])


def _vote_counts(sent):
    def run(batches):
        lexicon, total = sent.value, {}
        for rb in batches:
            for _, _, votes in lexicon.read(rb.column(0)):
                code = (votes.astype(np.int64) + 1) @ (3 ** np.arange(VOTERS))
                for k, n in zip(*map(np.ndarray.tolist, np.unique(code, return_counts=True)), strict=True):
                    total[k] = total.get(k, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["code", "n"])

    return run


def _examples(sent):
    def run(batches):
        lexicon = sent.value
        for rb in batches:
            a = 0
            for (text, feat, count), dense, votes in lexicon.read(rb.column(0), np.asarray(rb.column(1)).astype(int)):
                n = len(votes)
                cut = np.searchsorted(text, np.arange(n + 1))
                rows = [(feat[i:j].tolist(), count[i:j].tolist()) for i, j in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([rb.column(1).slice(a, n).cast(pa.int32()), pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.int32())), pa.array(dense.tolist(), pa.list_(pa.float64())), pa.array(votes.tolist(), pa.list_(pa.int32()))], ["label", "feats", "counts", "dense", "votes"])
                a += n

    return run


class LabelModel:
    """Class-conditional voters in a forest of dependences, by expectation-maximisation over vote patterns."""

    def fit(self, votes: np.ndarray, n: np.ndarray, start: np.ndarray, known: np.ndarray | None = None, rounds: int = 25) -> LabelModel:
        """``votes`` (patterns x voters, -1 / 0 / 1), their counts and first posteriors, which stay where ``known``.

        Voters count as independent given the class until the accuracies have
        settled; then the dependences that are left enter once, so that
        they cannot explain away the class itself.
        """
        post = start
        self.parent, self.order = [-1] * votes.shape[1], list(range(votes.shape[1]))
        onehot = votes[:, :, None] == np.array([-1, 0, 1])
        for t in range(rounds):
            w = np.stack([n * (1 - post), n * post])  # class x pattern
            self.prior = np.log((w.sum(1) + 1) / (w.sum() + 2))
            joint = np.einsum("cp,pia,pjb->cijab", w, onehot, onehot, optimize=True) + 0.1
            joint /= joint.sum((3, 4), keepdims=True)
            single = np.einsum("ciiaa->cia", joint)
            single = single / single.sum(2, keepdims=True)
            ind = joint.sum(4, keepdims=True) * joint.sum(3, keepdims=True)
            share = w.sum(1) / w.sum()
            mutual = np.einsum("c,cij->ij", share, (joint * np.log(joint / ind)).sum((3, 4)))
            if t == rounds * 2 // 3:
                self.parent, self.order = self._forest(mutual)
            self.mutual, self.single = mutual, single
            self.table = np.log(joint / joint.sum(4, keepdims=True))  # P(v_j = b | v_i = a, class)
            new = self.posterior(votes)
            if known is not None:
                new = np.where(known, start, new)
            if np.abs(new - post).max() < 1e-6 and t > rounds * 2 // 3:
                break
            post = new
        return self

    @staticmethod
    def _forest(mutual: np.ndarray) -> tuple[list[int], list[int]]:
        """Prim's maximum spanning forest: parents (-1: a root) and an order in which parents come first."""
        v = len(mutual)
        parent, order, left = [-1] * v, [], set(range(v))
        while left:
            best = max(((mutual[i, j], i, j) for i in order for j in left), default=(0, -1, -1))
            if best[0] > DEPENDENCE:
                parent[best[2]] = best[1]
                order.append(best[2])
            else:
                order.append(min(left))
            left.discard(order[-1])
        return parent, order

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        score = np.repeat(self.prior[:, None], len(votes), 1)
        v = votes + 1
        for j in self.order:
            i = self.parent[j]
            score = score + (np.log(self.single[:, j])[:, v[:, j]] if i < 0 else self.table[:, i, j][:, v[:, i], v[:, j]])
        return 1 / (1 + np.exp(np.clip(score[0] - score[1], -50, 50)))


def fit_linear(row: np.ndarray, col: np.ndarray, val: np.ndarray, dense: np.ndarray, target: np.ndarray, width: int, rounds: int = 400, l2: float = 1e-4) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression on sparse and dense values against soft labels, by Adam over all rows."""
    n, d = dense.shape
    theta = np.zeros(width + d + 1)
    p = target.mean()
    theta[-1] = np.log((p + 1e-3) / (1 - p + 1e-3))
    m, s = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        z = np.bincount(row, val * theta[col], n) + dense @ theta[width:-1] + theta[-1]
        g = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - target) / n
        grad = np.concatenate([np.bincount(col, val * g[row], width), dense.T @ g, [g.sum()]])
        grad[:-1] += l2 * theta[:-1]
        m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad**2
        theta -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    return theta[:width], theta[width:-1], float(theta[-1])


class Model:
    """A fitted lexicon and classifier; without toxic and clean training rows, a constant 0."""

    lexicon: Lexicon | None = None

    def scores(self, column: pa.Array) -> np.ndarray:
        if self.lexicon is None:
            return np.zeros(len(column))
        out = []
        for (text, feat, count), dense, _ in self.lexicon.read(column):
            z = np.bincount(text, (1 + np.log(count)) * self.weights[feat], len(dense)) + ((dense - self.mean) / self.scale) @ self.dense + self.bias
            out.append(1 / (1 + np.exp(-np.clip(z, -50, 50))))
        return np.concatenate(out) if out else np.zeros(0)


def sample(docs: DataFrame, rows: int, total: int) -> DataFrame:
    """About ``rows`` of the ``total`` rows of ``docs(doc_id, text)``, those whose hashes are smallest; rows that are held out are none of them.

    Hashes alone decide, so nothing is sorted or collected; equal rows count
    once.
    """
    share = min(1.0, rows / max(total * 0.8, 1))
    key = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40))
    return docs.where(~held_out()).select(key.alias("key"), "text").where(F.col("key") < int(share * (1 << 40))).groupBy("key").agg(F.first("text").alias("text"))


def fit_labels(codes: np.ndarray, n: np.ndarray, votes: np.ndarray, y: np.ndarray) -> LabelModel:
    """The label model on the vote patterns of all documents, and of labelled ones whose class is known while accuracies are estimated."""
    patterns = (codes[:, None] // 3 ** np.arange(VOTERS)) % 3 - 1
    first = np.where(y > 0, 0.99, 0.01)
    own = LabelModel().fit(votes, np.ones(len(votes)), first, rounds=1)
    stacked = np.concatenate([patterns, votes])
    weight = np.full(len(votes), max(1.0, n.sum() / len(votes)))  # labelled rows count as much as all others
    known = np.arange(len(stacked)) >= len(patterns)
    return LabelModel().fit(stacked, np.concatenate([n, weight]), np.concatenate([own.posterior(patterns), first]), known)


def in_order(rows: pd.DataFrame) -> pd.DataFrame:
    """Rows in the order of their values, so that sums over them do not depend on the order in which tasks end."""
    keys = [tuple(tuple(x) if isinstance(x, (list, np.ndarray)) else x for x in r) for r in rows.itertuples(index=False)]
    return rows.iloc[sorted(range(len(rows)), key=keys.__getitem__)].reset_index(drop=True)


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on ``docs(doc_id, text)`` and the training rows ``labels(doc_id, toxic)``; votes are counted over all of ``docs``."""
    spark, model = docs.sparkSession, Model()
    gold = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    held = gold.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows).toArrow()  # train_rows at most
    if len(held["y"].unique()) < 2:
        return model
    ids = spark.createDataFrame(held, gold.schema)  # Arrow is read by the JVM; rows of pandas would start Python workers of another kind, which stay beside those of mapInArrow
    train = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # of rows that repeat a labelled doc_id one
    train = materialise(train.select("text", F.least("y", F.lit(1)).alias("y")), "labelled", rows=train_rows)
    counts = train.mapInArrow(_document_counts, "family int, id int, n0 bigint, n1 bigint").groupBy("family", "id").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    total = counts.where("family = -1").first()
    if total is None or not total.n0 or not total.n1:
        return model
    odds = F.log((F.col("n1") + 0.5) / F.lit(total.n1 + 1.0)) - F.log((F.col("n0") + 0.5) / F.lit(total.n0 + 1.0))
    least = max(2, total.n1 // 500)  # toxic rows that a feature must occur in
    best = counts.where((F.col("family") >= 0) & (F.col("n1") >= least)).withColumn("odds", odds).where(F.col("odds") >= LENIENT)
    best = best.orderBy((F.col("n1") * F.col("odds")).desc(), "family", "id").limit(FEATURES).toPandas()
    model.lexicon = lexicon = Lexicon(best.id.to_numpy(np.int64), best.odds.to_numpy(float), best.family.to_numpy(np.int64), best.n1.to_numpy() <= least)
    sent = spark.sparkContext.broadcast(lexicon)  # 8 MB whatever the corpus
    seen = docs.select("text").mapInArrow(_vote_counts(sent), "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).toPandas().sort_values("code")  # 3 ** VOTERS patterns at most
    kinds = "label int, feats array<int>, counts array<int>, dense array<double>, votes array<int>"
    labelled = in_order(train.mapInArrow(_examples(sent), kinds).select("label", "votes").toPandas())  # train_rows at most
    examples = in_order(sample(docs, sample_rows, int(seen.n.sum())).select("text", F.lit(0).alias("y")).mapInArrow(_examples(sent), kinds).toPandas())  # about sample_rows
    model.labels = fit_labels(seen.code.to_numpy(), seen.n.to_numpy(float), np.array(labelled.votes.tolist()), labelled.label.to_numpy())
    target = model.labels.posterior(np.array(examples.votes.tolist()))

    row = np.repeat(np.arange(len(examples)), [len(x) for x in examples.feats])
    col = np.concatenate([np.asarray(x, np.int64) for x in examples.feats])
    val = 1 + np.log(np.concatenate([np.asarray(x, float) for x in examples.counts]))
    dense = np.array(examples.dense.tolist())
    model.mean, model.scale = dense.mean(0), dense.std(0) + 1e-6
    model.weights, model.dense, model.bias = fit_linear(row, col, val, (dense - model.mean) / model.scale, target, FEATURES, l2=max(1e-4, 0.3 / len(examples)))
    return model


def _scorer(sent, keep: list[str]):
    def run(batches):
        model = sent.value
        for rb in batches:
            yield pa.RecordBatch.from_arrays([*(rb.column(i) for i in range(len(keep))), pa.array(model.scores(rb.column(len(keep))), pa.float64())], [*keep, "score"])

    return run


def held_out() -> Column:
    """Whether a row's labels are kept from training: crc32 of doc_id as text, modulo 5, is 0 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def score(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``.

    Null and empty texts are scored like texts without any word. Repeated rows
    each get a row and equal scores. Without labelled rows of both classes, or
    without documents, every score is 0. Very long texts are read in chunks of
    whole texts, so the longest text bounds a task's memory. Labels that
    disagree about an id count as toxic; features tie by family and hash. Other
    columns, whatever their names, are not read.
    """
    base = docs.select("doc_id", "text")
    model = fit(base, labels.where(~held_out()), **options)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = base.schema["doc_id"].dataType.simpleString()
    out = base.mapInArrow(_scorer(sent, ["doc_id"]), f"doc_id {kind}, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _filter(sent, column: int, least: float):
    def run(batches):
        for rb in batches:
            yield rb.filter(pa.array(sent.value.scores(rb.column(column)) < least))

    return run


def drop_toxic(docs: DataFrame, labels: DataFrame, least: float = 0.5, **options) -> DataFrame:
    """``docs`` without the rows whose score is ``least`` or more; columns stay as they are, whatever their names.

    Scores are those of :func:`score`: null, empty and very long texts are
    scored as there, repeated rows go or stay together, rows without an id are
    scored like others, and an empty table stays empty.
    """
    model = fit(docs.select("doc_id", "text"), labels.where(~held_out()), **options)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_filter(sent, docs.columns.index("text"), least), docs.schema)
