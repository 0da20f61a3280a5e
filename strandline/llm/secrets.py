"""Secret scans: fixed patterns, and a character convolutional network over every other candidate.

Base findings are pattern matches and always stay. Candidates are all runs of 16
or more token characters. The network reads a candidate with its surroundings,
a long one in steps of which the best counts, so that a key inside a path is
read too. It is trained in numpy on labelled findings of two kinds: a seeded
generator's (keys of many formats in code and prose against identifiers, paths,
versions, words), and those of a bounded sample of the corpus: base findings as
they stand, and with their characters drawn anew; generated keys and plain runs
put into the places of words; and the documents' own other runs, as negatives.
Findings of a fifth of the sampled documents are kept from training: on them the
outputs are calibrated, the threshold is the highest that keeps a required
recall, and recall and precision are reported.
"""

from __future__ import annotations

import random
import re
import string
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm import wordhash as W

#: Base kinds in their order, with patterns and least lengths (fixed values).
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
ASSIGN_VALUE, ACCESS_LENGTH, HEX_LENGTH = 12, 18, 16
HEX_RUN, TOKEN_RUN, WORD = re.compile(rb"[0-9a-f]{16,}"), re.compile(rb"[A-Za-z0-9+/_=.-]{16,}"), re.compile(rb"(?<![^\s])[A-Za-z]{3,15}(?![^\s.,;])")
#: What a sample calls base findings of digits alone.
DIGITS = "digits"
#: The kind of findings that the network adds.
NETWORK = "network"
#: Characters read before a candidate, of its start and end, and after it.
BEFORE, HEAD, TAIL, AFTER = 24, 32, 16, 8
LENGTH = BEFORE + HEAD + TAIL + AFTER
#: Least length of a candidate; characters from a window to the next in one of more than HEAD + TAIL; windows scored at once.
CANDIDATE, STEP, SCORED = 16, 8, 4096
#: Network: embedding, filter width, filters; training examples, epochs; epochs of the training on documents that follows; recall that the threshold must keep.
EMBED, WIDTH, FILTERS, EXAMPLES, EPOCHS, MORE_EPOCHS, RECALL = 8, 5, 24, 6000, 5, 4, 0.98
#: Documents whose findings the network is trained on, about (the smallest hashes of doc_id and text), and findings of each kind of a document.
SAMPLE_ROWS, OWN_FINDINGS = 3000, 4

_HEX = np.zeros(256, bool)
_HEX[[*b"0123456789abcdef"]] = True
_TOKEN = np.zeros(256, bool)
_TOKEN[[*(string.ascii_letters + string.digits + "+/_=-.").encode()]] = True
_SYMBOL = np.full(256, 1, np.int64)  # 0 fills up, 1 is any other byte
_SYMBOL[32:127] = np.arange(2, 97)
SYMBOLS = 97


def window(before: bytes, token: bytes, after: bytes) -> np.ndarray:
    """Symbol numbers of a candidate and its surroundings, in fixed places."""
    out = np.zeros(LENGTH, np.int64)
    b = np.frombuffer(before[-BEFORE:], np.uint8)
    out[BEFORE - len(b) : BEFORE] = _SYMBOL[b]
    t = np.frombuffer(token, np.uint8)
    head = t[:HEAD]
    out[BEFORE : BEFORE + len(head)] = _SYMBOL[head]
    tail = t[max(HEAD, len(t) - TAIL) :]
    out[BEFORE + HEAD : BEFORE + HEAD + len(tail)] = _SYMBOL[tail]
    a = np.frombuffer(after[:AFTER], np.uint8)
    out[LENGTH - AFTER : LENGTH - AFTER + len(a)] = _SYMBOL[a]
    return out


def windows(before: bytes, token: bytes, after: bytes) -> Iterator[np.ndarray]:
    """Blocks of the windows of a candidate: one of a short one; of a long one those of HEAD characters at every STEP, and its last."""
    if len(token) <= HEAD + TAIL:
        yield window(before, token, after)[None]
        return
    before, after = before[-BEFORE:], after[:AFTER]
    all_ = np.frombuffer(before + token + after, np.uint8)
    padded = np.concatenate((np.zeros(BEFORE - len(before), np.int64), _SYMBOL[all_], np.zeros(AFTER - len(after), np.int64)))
    seen = np.lib.stride_tricks.sliding_window_view(padded, BEFORE + HEAD + AFTER)
    places = np.append(np.arange(0, len(token) - HEAD, STEP), len(token) - HEAD)
    for a in range(0, len(places), SCORED):
        part = seen[places[a : a + SCORED]]
        out = np.zeros((len(part), LENGTH), np.int64)
        out[:, : BEFORE + HEAD], out[:, LENGTH - AFTER :] = part[:, : BEFORE + HEAD], part[:, BEFORE + HEAD :]
        yield out


def labelled_findings(n: int, seed: int, places: list[tuple[bytes, bytes]] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Windows and labels of generated findings, half of them secrets; of a long finding one window, of a key inside it the one that shows most.

    With ``places``, contexts of documents, a finding stands in one of them.
    """
    rng = random.Random(seed)
    pick = rng.choice
    draw = lambda alphabet, lo, hi: "".join(rng.choices(alphabet, k=rng.randint(lo, hi)))
    low, alnum, b64 = string.ascii_lowercase, string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    hexes = "0123456789abcdef"
    syllables = ["er", "an", "th", "in", "on", "re", "ver", "ung", "sch", "tion", "ment", "que", "ar", "os", "ble", "ly", "st", "the", "ha", "he", "ing", "re", "nicht", "zu", "lich", "ein", "keit", "be", "de", "le", "pa", "sou", "eau", "con", "pro", "ma", "ti", "lo", "ru", "ni", "da", "mo", "ck", "ee", "ist", "und", "com", "www", "key", "get", "set"]
    onsets, vowels, codas = (x.split(",") for x in (",b,c,d,f,g,h,j,k,l,m,n,p,qu,r,s,t,v,w,y,z,st,tr,ch,sh,th,pl,pr,br,gr,cl,sp,str,pf,sch", "a,e,i,o,u,a,e,i,o,e,ea,ou,ie,ai,oo,y,io", ",,,n,r,s,t,l,m,d,ck,ng,x,nd,st,rk,ft,pf,ss,rs,ct,p,b,ts"))
    syllable = lambda: pick(syllables) if rng.random() < 0.4 else pick(onsets) + pick(vowels) + pick(codas)
    word = lambda: "".join(syllable() for _ in range(rng.randrange(1, 5)))
    prose = lambda: " ".join(word() for _ in range(rng.randrange(1, 6)))
    secrets = (
        lambda: draw(hexes, 32, 64),
        lambda: draw(b64, 24, 60) + pick(["", "=", "=="]),
        lambda: draw(alnum, 20, 48),
        lambda: pick(["ghp_", "gho_", "sk-", "sk_live_", "xoxb-", "glpat-", "pk_", "npm_", "hf_", "AIza"]) + draw(alnum, 20, 40),
        lambda: "eyJ" + draw(alnum, 16, 30) + ".eyJ" + draw(alnum, 20, 40) + "." + draw(alnum + "_-", 24, 43),
        lambda: draw(hexes.upper(), 32, 40),
        lambda: draw(pick([string.ascii_letters, alnum]), 16, 26),
    )
    path = lambda: pick(["/", "/", ".", "-", "="]).join(word() for _ in range(rng.randrange(1, 8)))
    plain = (
        lambda: pick(["-", "_"]).join([word() for _ in range(rng.randrange(3, 6))] + [str(rng.randrange(1, 2025))]),
        lambda: "/".join([word() for _ in range(rng.randrange(3, 6))]) + f"/{rng.randrange(1, 99)}",
        lambda: f"{word()}{word()}-{rng.randrange(0, 20)}.{rng.randrange(0, 20)}.{rng.randrange(0, 99)}.{pick(['tar.gz', 'whl', 'jar', 'zip', 'html'])}",
        lambda: f"20{rng.randrange(10, 30)}-{rng.randrange(10, 13)}-{rng.randrange(10, 29)}T{rng.randrange(10, 24)}-00-00.000Z",
        lambda: word() + word() + word() + word() + str(rng.randrange(0, 10)),
        lambda: ".".join(word() for _ in range(4)) + str(rng.randrange(0, 1000)),
        lambda: word().upper() + "_" + word().upper() + "_" + word().upper() + str(rng.randrange(0, 100)),
        lambda: pick(low) * rng.randrange(14, 30) + str(rng.randrange(10, 99)),
        lambda: "=" * rng.randrange(10, 30) + word() + str(rng.randrange(0, 9)),
        lambda: f"id={rng.randrange(1, 10**6)}-page={rng.randrange(1, 100)}-{word()}",
        lambda: "".join(word() for _ in range(rng.randrange(3, 9))) + pick(["", "."]),
        lambda: "".join(word() for _ in range(rng.randrange(3, 9))).upper() + pick(["", "."]),
        lambda: "".join(word().capitalize() for _ in range(rng.randrange(3, 7))),
        lambda: pick(["-", "_", ".", "/"]).join(word() for _ in range(rng.randrange(3, 14))),
        lambda: "/".join(path() for _ in range(rng.randrange(3, 6))),
        lambda: draw(string.digits, 16, 40),
        lambda: pick("=-_./+") * rng.randrange(16, 80),
        lambda: pick(string.ascii_letters + string.digits) * rng.randrange(16, 80),
    )
    keys = ["key", "auth", "Authorization", "credential", "client_id", "private", "access", "bearer", "value", "hash", "url", "path", "file", "name", "ref"]
    xs, ys = [], []
    for _ in range(n):
        y = rng.randrange(2)
        token = pick(secrets if y else plain)()
        while len(token) < CANDIDATE:
            token += word() + pick(["", str(rng.randrange(10))])
        key = (0, len(token))
        if y and rng.random() < 0.3:
            first, last = path() + "/", "/" + path()
            key = (len(first), len(first) + len(token))
            token = first + token + last
        lead = pick([prose() + " ", prose() + ". ", f"{pick(keys)}: ", f'{pick(keys)} = "', f'"{pick(keys)}": "', prose() + "\n", "(", ""])
        tail = pick([" " + prose(), '"', ".", "\n" + prose(), ")", ""])
        around = pick(places) if places else (lead.encode(), tail.encode())
        own = np.concatenate(list(windows(around[0], token.encode(), around[1])))
        at = np.append(np.arange(0, len(token) - HEAD, STEP), len(token) - HEAD)
        shown = np.minimum(at + HEAD, key[1]) - np.maximum(at, key[0])
        xs.append(own[0 if len(own) == 1 else int(shown.argmax()) if y else rng.randrange(len(own))])
        ys.append(y)
    return np.array(xs), np.array(ys, float)


class Network:
    """Embedding, one convolution, maxima over positions, a logistic output, temperature and threshold."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.p = {"e": rng.normal(0, 0.3, (SYMBOLS, EMBED)), "r": rng.normal(0, 0.3, (4, EMBED)), "c": rng.normal(0, 0.15, (WIDTH * EMBED, FILTERS)), "b": np.zeros(FILTERS), "w": rng.normal(0, 0.2, 2 * FILTERS), "o": np.zeros(1)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.region = np.repeat(np.arange(4), (BEFORE, HEAD, TAIL, AFTER))
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5
        self.report: dict[str, float] = {}

    def forward(self, x: np.ndarray):
        """Logits, with what the backward pass needs: maxima and means of the filters."""
        p = self.p
        e = p["e"][x] * (x > 0)[:, :, None] + p["r"][self.region]
        cols = np.lib.stride_tricks.sliding_window_view(e, WIDTH, 1).transpose(0, 1, 3, 2).reshape(len(x), -1, WIDTH * EMBED)
        z = np.maximum(cols @ p["c"] + p["b"], 0)
        best = z.argmax(1)
        h = np.concatenate([np.take_along_axis(z, best[:, None], 1)[:, 0], z.mean(1)], 1)
        return h @ p["w"] + p["o"][0], (cols, z, best, h)

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = 128, rate: float = 0.01, seed: int = 6) -> None:
        rng = np.random.default_rng(seed)
        state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        t = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for s in range(0, len(x), batch):
                i = order[s : s + batch]
                logit, (cols, z, best, h) = self.forward(x[i])
                g = ((1 / (1 + np.exp(-logit)) - y[i]) / len(i)).astype(np.float32)
                gh = g[:, None] * self.p["w"]
                gz = np.repeat(gh[:, None, FILTERS:] / z.shape[1], z.shape[1], 1)
                np.put_along_axis(gz, best[:, None], np.take_along_axis(gz, best[:, None], 1) + gh[:, None, :FILTERS], 1)
                gz *= z > 0
                gc = (gz @ self.p["c"].T).reshape(len(i), -1, WIDTH, EMBED)
                ge = np.zeros((len(i), LENGTH, EMBED), np.float32)
                for k in range(WIDTH):
                    ge[:, k : k + gc.shape[1]] += gc[:, :, k]
                flat = ge.reshape(-1, EMBED)
                at = x[i].ravel()
                grads = {"e": np.stack([np.bincount(at, flat[:, d] * (at > 0), SYMBOLS) for d in range(EMBED)], 1), "r": np.stack([ge[:, self.region == r].sum((0, 1)) for r in range(4)]), "c": cols.reshape(-1, WIDTH * EMBED).T @ gz.reshape(-1, FILTERS), "b": gz.sum((0, 1)), "w": h.T @ g, "o": np.array([g.sum()])}
                t += 1
                for k, v in grads.items():
                    m, s2 = state[k]
                    m += 0.1 * (v - m)
                    s2 += 0.001 * (v * v - s2)
                    self.p[k] -= (rate * (m / (1 - 0.9**t)) / (np.sqrt(s2 / (1 - 0.999**t)) + 1e-8)).astype(np.float32)

    def calibrate(self, x: np.ndarray, y: np.ndarray, recall: float = RECALL) -> None:
        """Scale and shift of the logits by logistic regression, then the highest threshold with the recall asked for."""
        logit = self.forward(x)[0]
        a, b = 1.0, 0.0
        for _ in range(200):
            g = 1 / (1 + np.exp(-(a * logit + b))) - y
            a, b = a - 0.1 * (g * logit).mean(), b - 0.1 * g.mean()
        self.scale, self.shift = a, b
        own = np.sort(self.score(x[y == 1]))
        self.threshold = float(own[int(np.floor((1 - recall) * len(own)))]) if len(own) else 0.5
        found = self.score(x) >= self.threshold
        self.report = {"findings": len(y), "recall": float(found[y == 1].mean()) if len(own) else 1.0, "precision": float(y[found].mean()) if found.any() else 1.0}

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities."""
        out = [1 / (1 + np.exp(-np.clip(self.scale * self.forward(x[i : i + 512])[0] + self.shift, -50, 50))) for i in range(0, len(x), 512)]
        return np.concatenate(out) if out else np.zeros(0)


#: :func:`labelled_findings` without places, once for each size and seed.
generated = lru_cache(4)(labelled_findings)


@lru_cache(1)
def trained(examples: int = EXAMPLES) -> Network:
    """The network on ``examples`` generated findings, calibrated on a fifth as many others."""
    net = Network()
    net.train(*generated(examples, 1))
    net.calibrate(*generated(examples // 5, 2))
    return net


_CLASSES = (string.digits.encode(), b"abcdef", string.ascii_lowercase.encode(), string.ascii_uppercase.encode())


def perturbed(token: bytes, rng: np.random.Generator) -> bytes:
    """A token with each digit and letter drawn anew from its kind; hexadecimal ones stay hexadecimal."""
    low = b"abcdef" if all(x in b"0123456789abcdef" for x in token) else _CLASSES[2]
    kinds = [_CLASSES[0] if 48 <= x < 58 else low if 97 <= x < 123 else _CLASSES[3] if 65 <= x < 91 else bytes([x]) for x in token]
    return bytes(k[int(rng.integers(len(k)))] for k in kinds)


def _sampled(batches) -> Iterator[pa.RecordBatch]:
    """Of each text: base findings with the name of their kind, other candidates and places of words, some of each: (key, kind, name, before, token, after)."""
    for rb in batches:
        out = []
        for key, text in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), strict=True):
            data = (text or "").encode()
            rng = np.random.default_rng(key & 0xFFFFFFFF)
            by = ([m.span(2) for m in ASSIGN.finditer(data) if len(m[2]) >= ASSIGN_VALUE], [m.span() for m in ACCESS.finditer(data) if len(m[0]) >= ACCESS_LENGTH], [m.span() for m in HEX_RUN.finditer(data)])
            covered = sorted(x for own in by for x in own)
            runs = []
            for m in TOKEN_RUN.finditer(data):
                i = bisect_left(covered, (m.end(), 0))
                if not any(b > m.start() for _, b in covered[max(0, i - 2) : i]):
                    runs.append((*m.span(), None))
            base = [(a, b, DIGITS if data[a:b].isdigit() else name) for name, own in zip(KINDS, by, strict=True) for a, b in own]
            words = [(*m.span(), None) for m in WORD.finditer(data)]
            for kind, own in ((1, base), (0, runs), (2, words)):
                for i in rng.permutation(len(own))[: OWN_FINDINGS]:
                    a, b, name = own[int(i)]
                    out.append((key, kind, name, data[max(0, a - BEFORE) : a], data[a:b], data[b : b + AFTER]))
        kinds = (pa.int64(), pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["key", "kind", "name", "before", "token", "after"])


def sampled_findings(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``(key, kind, name, before, token, after)`` of about ``rows`` documents: kind 1 base findings with the name of theirs or ``DIGITS``, 0 other candidates, 2 words.

    ``key`` is the hash of a document's id and text that put it into the
    sample; equal rows count once.
    """
    share = min(1.0, rows / max(docs.count(), 1))
    key = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40))
    own = docs.select(key.alias("key"), "text").where(F.col("key") < int(share * (1 << 40))).groupBy("key").agg(F.first("text").alias("text"))
    return own.mapInArrow(_sampled, "key bigint, kind int, name string, before binary, token binary, after binary")


def _best_scores(net: Network, blocks: list[np.ndarray]) -> np.ndarray:
    """The best score among each candidate's windows, all scored together."""
    if not blocks:
        return np.zeros(0)
    first = np.cumsum([0, *(len(x) for x in blocks[:-1])])
    return np.maximum.reduceat(net.score(np.concatenate(blocks)), first)


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS, examples: int = EXAMPLES) -> Network:
    """The network on generated findings and on those of a sample of ``docs(doc_id, text)``, calibrated on held-out ones.

    It is trained on generated findings first and goes on with the documents'
    from there. Of the documents' own runs, which nobody labelled, those that
    it takes for keys by then are left out, and so are base findings of digits
    alone, which say nothing about keys. ``report`` has the recall of every kind
    of base finding of held-out documents, those of digits included. Without
    documents, or without findings and words in them, the generated ones are
    all.
    """
    held = sampled_findings(docs, rows).toPandas()  # about rows * 3 * OWN_FINDINGS short rows
    first = trained(examples)
    if not len(held):
        return first
    rng = np.random.default_rng(8)
    held = held.sort_values(["key", "kind", "token", "before", "after"]).reset_index(drop=True)
    held["apart"] = held.key % 5 == 0
    seen = lambda r: np.concatenate(list(windows(r.before, r.token, r.after)))
    base = dict(list(held[held.kind == 1].groupby("name")))
    runs = [(seen(r), r.apart) for r in held[held.kind == 0].itertuples()]
    runs = [x for x, score in zip(runs, _best_scores(first, [x[0] for x in runs]), strict=True) if score < first.threshold]
    xs, ys, apart = [x[int(rng.integers(len(x)))] for x, _ in runs], [0.0] * len(runs), [a for _, a in runs]
    for name in KINDS:
        for r in base[name].itertuples() if name in base else ():
            for token in (r.token, perturbed(r.token, rng)):
                own = np.concatenate(list(windows(r.before, token, r.after)))
                xs.append(own[int(rng.integers(len(own)))])
                ys.append(1.0)
                apart.append(r.apart)
    words = held[held.kind == 2]
    parts = [(np.array(xs, np.int64).reshape(-1, LENGTH), np.array(ys, float), np.array(apart, bool))]
    for out in (False, True):
        places = list(zip(words.before[words.apart == out], words.after[words.apart == out], strict=True))
        n = examples // 5 if out else examples // 2
        made = [tuple(x[:n] for x in generated(examples // 5 if out else examples, 1 + out))]
        made += [labelled_findings(n, 3 + out, places)] if places else []
        parts += [(x, y, np.full(len(y), out)) for x, y in made]
    x, y, out = (np.concatenate([p[i] for p in parts]) for i in range(3))
    net = Network()
    net.p = {k: v.copy() for k, v in first.p.items()}
    net.train(x[~out], y[~out], epochs=MORE_EPOCHS)
    net.calibrate(x[out], y[out])
    for name, every in base.items():
        own = every[every.apart]
        if len(own):
            net.report[f"recall_{name}"] = float((_best_scores(net, [seen(r) for r in own.itertuples()]) >= net.threshold).mean())
    return net


def _base(data: bytes) -> list[tuple[int, int, int]]:
    """Pattern matches of a text: start, kind number, end, in bytes; hexadecimal runs are found elsewhere."""
    found = []
    low = data.lower()
    if any(k in low for k in (b"passw", b"secret", b"token", b"api")):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(data) if len(m[2]) >= ASSIGN_VALUE]
    if b"AKIA" in data:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(data) if m.end() - m.start() >= ACCESS_LENGTH]
    return found


def scan(column: pa.Array, net: Network) -> Iterator[list[list[tuple[str, int, int, float]]]]:
    """For each chunk of texts their findings: kind, start and end in characters, the network's score; by start, then kind."""
    raw_all, bounds_all = W.text_bytes(column)
    for a, b in W.chunks(bounds_all):
        raw, bounds = raw_all[bounds_all[a] : bounds_all[b]], bounds_all[a : b + 1] - bounds_all[a]
        data = raw.tobytes()
        found: list[list[tuple[int, int, int]]] = [_base(data[s:e]) for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
        starts, ends, at = W.spans(raw, bounds, _HEX)
        for i in np.flatnonzero(ends - starts >= HEX_LENGTH):
            d = int(np.searchsorted(at, i, "right")) - 1
            found[d].append((int(starts[i] - bounds[d]), 2, int(ends[i] - bounds[d])))
        begin = [sorted(x for x, _, _ in own) for own in found]
        reach = [list(accumulate((y for _, _, y in sorted(own)), max)) for own in found]
        starts, ends, at = W.spans(raw, bounds, _TOKEN)
        for i in np.flatnonzero(ends - starts >= CANDIDATE):
            d = int(np.searchsorted(at, i, "right")) - 1
            s, e = int(starts[i] - bounds[d]), int(ends[i] - bounds[d])
            before = bisect_left(begin[d], e)
            if not before or reach[d][before - 1] <= s:
                found[d].append((s, 3, e))
        points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
        flat = [(d, s, k, e) for d, own in enumerate(found) for s, k, e in sorted(own)]
        scores, owners, held, waiting = np.zeros(len(flat)), [], [], 0
        for i, (d, s, _, e) in enumerate(flat):
            lo, hi = int(bounds[d]), int(bounds[d + 1])
            for part in windows(data[max(lo, lo + s - BEFORE) : lo + s], data[lo + s : lo + e], data[lo + e : min(hi, lo + e + AFTER)]):
                owners.append(np.full(len(part), i))
                held.append(part)
                waiting += len(part)
                if waiting >= SCORED:
                    np.maximum.at(scores, np.concatenate(owners), net.score(np.concatenate(held)))
                    owners, held, waiting = [], [], 0
        if held:
            np.maximum.at(scores, np.concatenate(owners), net.score(np.concatenate(held)))
        out: list[list[tuple[str, int, int, float]]] = [[] for _ in found]
        for (d, s, k, e), score in zip(flat, scores, strict=True):
            if k < 3 or score >= net.threshold:
                p, q = points[bounds[d] + s] - points[bounds[d]], points[bounds[d] + e] - points[bounds[d]]
                out[d].append(((*KINDS, NETWORK)[k], int(p), int(q), float(score)))
        yield out


_FINDING = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])


def _scanner(sent):
    def run(batches):
        for rb in batches:
            a = 0
            for part in scan(rb.column(1), sent.value):
                rows = [[dict(zip(("kind", "start", "end", "score"), x, strict=True)) for x in own] for own in part]
                yield pa.RecordBatch.from_arrays([rb.column(0).slice(a, len(part)), pa.array(rows, pa.list_(_FINDING))], ["doc_id", "findings"])
                a += len(part)

    return run


def find_secrets(docs: DataFrame) -> DataFrame:
    """``(doc_id, findings array<struct<kind, start, end, score>>)`` for every row of ``docs(doc_id, text)``.

    Null and empty texts have no findings. A network finding never overlaps a
    base finding. Repeated rows and rows without an id each get a row; findings
    that begin together are in order of their kinds. Very long texts are read in
    chunks of whole texts, so the longest one bounds a task's memory. An empty
    table gives an empty result; other columns, whatever their names, are not
    read.
    """
    base = docs.select("doc_id", "text")
    kind = base.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(fit(base))
    return base.mapInArrow(_scanner(sent), f"doc_id {kind}, findings array<struct<kind: string, start: bigint, `end`: bigint, score: double>>")


def _spans(findings: Column) -> Column:
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts by kind, a digest of the base findings, all spans and the network's scores of them, for each row of :func:`find_secrets`."""

    def count(kind: str) -> Column:
        return F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    base = F.filter("findings", lambda x: x["kind"] != NETWORK)
    return found.select("doc_id", *counts, F.sha2(_spans(base), 256).alias("base_sha256"), _spans(F.col("findings")).alias("spans"), F.array_join(F.transform("findings", lambda x: F.format_number(x["score"], 4)), ",").alias("scores"))
