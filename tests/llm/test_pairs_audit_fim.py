"""SimHash groups, the filter audit and fill-in-middle against brute force, and their odd cases."""

import collections
import hashlib
import itertools
import random
import re
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from strandline.llm import fim, interaction, simhash

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, rep bigint, part string, mask int, n bigint, digest string, component_id bigint, output string, key bigint"
ODD = [(1, None, None), (2, "", "a"), (3, "one", "a"), (3, "one", "a"), (3, "other words for three", "a"), (4, " \n\t ", "b"), (None, "no id here at all, none", "b"), (None, "no id here at all, none", "b"), (5, "Éàü ß 漢字 emoji 😀 word\x00 nul", None), (6, "same text here", "a"), (7, "same text here", "b"), (8, "w " * 20_000, "b"), (9, "x" * 50_000, "c"), (10, "a <P> b", "c"), (11, " lead and trail \n", "")]


def documents(spark, rows):
    """Rows of (doc_id, text, source) with further columns whose names clash with results and steps."""
    return spark.createDataFrame([(i, t, "xx", s, *[None] * 9) for i, t, s in rows], DOCS)


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


# ------------------------------------------------------------------ SimHash

def brute_print(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, distance=2):
    """Smallest id reachable of {id: set of fingerprints}."""
    ids = sorted(prints)
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(ids, 2):
        if any((x ^ y).bit_count() <= distance for x in prints[a] for y in prints[b]):
            lo, hi = sorted((root(a), root(b)))
            up[hi] = lo
    return {i: root(i) for i in ids}


def check_groups(spark, rows):
    got = simhash.simhash_groups(documents(spark, rows)).collect()
    prints = collections.defaultdict(set)
    for i, t, _ in rows:
        if i is not None:
            prints[i].add(brute_print(t))
    comp = brute_components(prints)
    want = sorted((-1 if i is None else i, f"{brute_print(t):016x}", -1 if i is None else comp[i]) for i, t, _ in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.fingerprint, -1 if r.component_id is None else r.component_id) for r in got) == want


def test_simhash_of_the_table_and_its_groups(spark):
    rows = [(r.doc_id, r.text, r.source) for r in table(spark, "documents").collect()]
    check_groups(spark, rows)


def test_simhash_odd_rows_ties_and_chains(spark):
    rng = random.Random(1)
    base = [rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(300)]
    rows = list(ODD)
    for i in range(60):  # texts that drift away from one another: chains of links
        base[rng.randrange(300)] = rng.choice("xyz") * 3
        rows.append((100 + i, ("\n" if i % 2 else "  ").join(base).upper() if i % 3 else " ".join(base), "d"))
    check_groups(spark, rows)


def test_simhash_of_nothing(spark):
    assert simhash.simhash_groups(documents(spark, [])).collect() == []
    assert [tuple(r) for r in simhash.simhash_groups(documents(spark, [(None, None, None)])).collect()] == [(None, "0" * 16, None)]


@pytest.mark.parametrize("bucket_rows", [1024, 3])
@pytest.mark.parametrize("distance", [0, 1, 2])
def test_links_of_dense_groups(spark, distance, bucket_rows):
    """Groups around few centres, with correlated bits, compared directly and by common neighbours."""
    rng = np.random.default_rng(distance)
    centres = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    prints = {int(c) for c in centres}
    for c in centres:
        for _ in range(60):
            x = int(c)
            for b in rng.choice(64, rng.integers(1, 5), replace=False):
                x ^= 1 << int(b)
            prints.add(x)
    signed = sorted(int(np.uint64(x).view(np.int64)) for x in prints)
    frame = spark.createDataFrame([(x,) for x in signed], "rep bigint")
    parts = simhash.plan(len(signed), simhash.joint_counts(frame), distance)
    assert sum(p.threshold + 1 for p in parts) == distance + 1
    got = simhash.links(frame, parts, distance, bucket_rows).collect()
    assert all(((r.src ^ r.dst) & (2**64 - 1)).bit_count() <= distance for r in got)
    up = {x: {x} for x in signed}
    for r in got:
        if up[r.src] is not up[r.dst]:
            up[r.src] |= up[r.dst]
            for x in up[r.src]:
                up[x] = up[r.src]
    want = brute_components({x: {x & (2**64 - 1)} for x in signed}, distance)
    assert {x: min(up[x]) for x in signed} == want


def test_thresholds_are_unequal_where_that_is_cheaper():
    """The dynamic program against all ways to deal the units; what a billion random fingerprints and correlated bits ask for."""
    rng = random.Random(3)
    for _ in range(50):
        costs = [[rng.random() * 10 ** rng.randint(0, 3) for _ in range(3)] for _ in range(rng.randint(1, 4))]
        ways = [d for d in itertools.product(range(4), repeat=len(costs)) if sum(d) == 3]
        want = min(sum(c[u - 1] for c, u in zip(costs, d) if u) for d in ways)
        cost, dealt = simhash.allocate(costs, 3)
        assert sum(dealt) == 3 and abs(cost - want) < 1e-9

    def counts(n, p, same=()):
        joint = n * np.outer(p, p)
        np.fill_diagonal(joint, n * p)
        for a, b in same:
            joint[a, b] = joint[b, a] = n * p[a]
        return joint

    p = np.full(64, 0.5)
    few, many = simhash.plan(10**4, counts(10**4, p)), simhash.plan(10**11, counts(10**11, p))
    assert [x.threshold for x in few] == [0, 0, 0]
    assert sorted(x.threshold for x in many) == [0, 1] and all(len(x.bits) == 32 for x in many)
    equal = counts(10**6, p, [(a, b) for a in range(16) for b in range(16) if a != b])
    groups = simhash.Costs(10**6, equal).groups(4)
    assert set(groups[0]) == set(range(16))  # bits that always agree are one part
    assert all(not set(x.bits) <= set(range(16)) for x in simhash.plan(10**6, equal))  # which is not looked at


def test_every_close_pair_shares_a_probe():
    rng = random.Random(4)
    for thresholds in ([0, 0, 0], [1, 0], [2], [0, 1, -1]):
        m = len(thresholds)
        parts = [simhash.Part(tuple(range(64))[i::m], t) for i, t in enumerate(thresholds) if t >= 0]
        for _ in range(300):
            x = rng.getrandbits(64)
            y = x
            for b in rng.sample(range(64), rng.randint(0, 2)):
                y ^= 1 << b
            assert any((y & p.mask) in {(x & p.mask) ^ int(f) for f in p.flips()} for p in parts)


# ------------------------------------------------------------------ filter audit

def brute_audit(rows, labels):
    def word(t):
        return re.findall(r"[^\x20\x09-\x0D]+", t)

    smallest = {}
    for i, t, _ in rows:
        if i is not None:
            smallest[t or ""] = min(i, smallest.get(t or "", i))
    tests = {
        "A": lambda i, t: len(word(t)) < 50,
        "B": lambda i, t: 100 * len(set(word(t))) < 65 * len(word(t)),
        "C": lambda i, t: 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t),
        "D": lambda i, t: any(c in "#$%&*|" for c in t),
        "E": lambda i, t: i is not None and i > smallest[t],
    }
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    out = {}
    for part in {s or "" for _, _, s in rows}:
        fails = [(i, {f for f in tests if tests[f](i, t or "")}) for i, t, s in rows if (s or "") == part]
        removed_by = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            left = fails
            for step, f in enumerate(order, 1):
                here = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                removed_by[f] += len(here)
                out[part, "".join(order), step] = [len(left), len(here), sum(f in x[1] for x in fails) - len(here), sum(x[1] == {f} for x in fails), sum(x[0] in good for x in here), sum(x[0] in toxic for x in here)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(removed_by[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def audited(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def test_audit_of_odd_rows(spark):
    rng = random.Random(5)
    rows = ODD + [(20 + i, rng.choice(["CAPS here ", "a b c d ", "x # y ", "long word list of many different ones "]) * rng.choice([1, 9, 30]), rng.choice(["a", "b", "", None])) for i in range(80)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 100, 2)] + [(20, 1, 0), (20, 0, 1), (None, 1, 1)]
    known = spark.createDataFrame([(*x, 1, "n") for x in labels], "doc_id bigint, quality int, toxic int, n int, part string")
    got = audited(interaction.audit(documents(spark, rows), known))
    assert got == brute_audit(rows, labels) and len(got) == 600 * 4


def test_audit_of_nothing(spark):
    known = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert interaction.audit(documents(spark, []), known).collect() == []
    assert len(interaction.audit(documents(spark, [(1, "a", None)]), known).collect()) == 600


@pytest.mark.parametrize("k", [1, 2, 3, 4])
def test_polynomials_against_orders_of_removal(k):
    rng = random.Random(k)
    counts = [rng.randint(0, 9) for _ in range(1 << k)]
    f = interaction.removal_polynomial(counts)
    at = interaction.corners(f)
    for t in range(1 << k):
        assert at[t] == sum(n for s, n in enumerate(counts) if s & t)
    x = [Fraction(rng.randint(0, 7), 7) for _ in range(k)]

    def product(values):
        out = Fraction(1)
        for v in values:
            out *= v
        return out

    direct = sum(n * (1 - product(1 - x[i] for i in range(k) if s >> i & 1)) for s, n in enumerate(counts))
    assert direct == sum(a * product(x[i] for i in range(k) if u >> i & 1) for u, a in enumerate(f))
    for i in range(k):
        orders = list(itertools.permutations(range(k)))
        gain = sum(at[sum(1 << j for j in o[: o.index(i) + 1])] - at[sum(1 << j for j in o[: o.index(i)])] for o in orders)
        assert interaction.shapley(f, i) == Fraction(gain, len(orders))


# ------------------------------------------------------------------ fill in the middle

def brute_middle(text, doc_id):
    t = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", t)
    n = len(units)
    x = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, t
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_of_random_texts_reads_back():
    rng = random.Random(6)
    forms = collections.Counter()
    for i in range(3000):
        text = "".join(rng.choices([" ", "\n", "\t", "\x0b", "a", "b", "é", "漢", "😀", "<", "S>", "<P", "\x00", " ", "\x1c"], k=rng.randint(0, 40)))
        n, form, p, m, out = fim.rearranged(text.encode(), i)
        assert (n, form, p, m, out.decode()) == brute_middle(text, i)
        forms[form] += 1
    assert min(forms.values()) > 100 and len(forms) == 3


def test_fill_in_middle_odd_rows(spark):
    rows = ODD + [(1000 + i, t, None) for i, t in enumerate(["<S", "a<", ">b", "<<P", " ", "a", "\n a", "a \n"] * 12)]
    df = fim.fill_in_middle(documents(spark, rows)).withColumn("back", fim.restored(F.col("output"), F.col("form")))
    got = sorted(((r.doc_id or -1, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in df.collect()), key=repr)
    assert got == sorted(((i or -1, *brute_middle(t, i), t or "") for i, t, _ in rows), key=repr)
    assert fim.fill_in_middle(documents(spark, [])).collect() == []


def test_ranked_bits_and_long_texts():
    rng = random.Random(7)
    for width in (1, 2, 3, 63, 64, 65, 1000):
        bits = rng.getrandbits(width)
        places = [i + 1 for i in range(width) if bits >> width - 1 - i & 1]
        ranks = sorted(rng.choices(range(1, len(places) + 1), k=5)) if places else []
        assert fim.ranked(bits, width, ranks) == [places[r - 1] for r in ranks]
    text = "word é\n" * 300_000
    doc = next(i for i in range(99) if brute_middle("a b c d", i)[1] != "plain")
    n, form, p, m, out = fim.rearranged(text.encode(), doc)
    assert (n, form, p, m, out.decode()) == brute_middle(text, doc)


def test_fill_in_middle_hands_results_on(monkeypatch):
    monkeypatch.setattr(fim, "FLUSH", 10)
    rb = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(50)), "text": pa.array([f"text number {i}" for i in range(50)])})
    got = [x for out in fim._texts(42, 50, 80)([rb]) for x in out.to_pylist()]
    assert [(x["doc_id"], x["n"], x["form"], x["prefix_chars"], x["middle_chars"], x["output"]) for x in got] == [(i, *brute_middle(f"text number {i}", i)) for i in range(50)]


# ------------------------------------------------------------------ secrets

def test_secrets_of_tables_without_findings(spark):
    """No base finding and no other candidate in the sample: the network of generated findings alone."""
    from strandline.llm import secrets

    for texts in ([], [None], [""], ["some plain words here"], ["some plain words here", None, "", "1234567890123456789"], ["x" * 40]):
        rows = [(i, t, None) for i, t in enumerate(texts)]
        found = secrets.find_secrets(documents(spark, rows)).collect()
        assert sorted(r.doc_id for r in found) == list(range(len(texts)))
        base = [f for r in found for f in r.findings if f["kind"] != secrets.NETWORK]
        assert len(base) == sum(t is not None and t.startswith("123") for t in texts)


def test_secret_network_reports_recall_by_kind(spark):
    from strandline.llm import secrets

    rng = random.Random(8)
    keys = ["".join(rng.choices("0123456789abcdef", k=40)) for _ in range(400)]
    rows = [(i, f"some words before {k} and words after, password = {k.upper()}x{i}" if i % 2 else f"the number {rng.randrange(10**19, 10**20)} and words", None) for i, k in enumerate(keys)]
    report = secrets.fit(documents(spark, rows)).report
    assert report["recall"] >= 0.97 and report["recall_hex"] >= 0.9 and report["recall_assign"] >= 0.9 and "recall_digits" in report and "recall_access" not in report


# ------------------------------------------------------------------ mixes of many sources, templates by counts

def test_plans_of_groups_of_sources_fill_every_quota(spark, monkeypatch):
    from strandline.llm import mixing

    monkeypatch.setattr(mixing, "GROUP", 3)
    rng = random.Random(9)
    rows = [(r, rng.randint(0, 900), rng.randint(1, 50)) for r in range(1, 24)]
    plan, total = mixing.planned(spark.createDataFrame(rows, "rank bigint, quota bigint, blocks bigint"), 5)
    got = plan.collect()
    assert total == sum(q for _, q, _ in rows)
    for rank, quota, blocks in rows:
        own = sorted((r.start, r.n, r.blocks) for r in got if r.rank == rank and r.n)
        assert sum(n for _, n, _ in own) == quota and all(b == blocks for _, _, b in own)
        assert [s for s, _, _ in own] == list(itertools.accumulate([0, *(n for _, n, _ in own)]))[: len(own)]
    assert sorted(map(tuple, plan.collect())) == sorted(map(tuple, got))


def test_mix_of_more_sources_than_a_group(spark, monkeypatch):
    from strandline.llm import mixing

    monkeypatch.setattr(mixing, "GROUP", 4)
    monkeypatch.setattr(mixing, "SENT_SOURCES", 2)
    rng = random.Random(10)
    rows = [(i, "w " * rng.randint(1, 200), rng.choice([None, "", *(f"s{j}" for j in range(20))])) for i in range(400)]
    got = mixing.mixture(documents(spark, rows)).collect()
    taken, target = collections.Counter(), {}
    source = {i: s for i, _, s in rows}
    for r in got:
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
        assert r.taken <= 3 * r.size
    assert len(got) == 400 and len(target) == 22
    assert all(abs(taken[s] - t) <= 64 + 0.02 * t for s, t in target.items())


def test_counts_decide_where_hosts_have_enough_pages(spark):
    from strandline.llm import html_text

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    size = collections.Counter(html_text.host(r.url) for r in pages.collect())
    assert max(size.values()) >= html_text.ENOUGH > min(size.values())
    found = {r.page_id: r.text for r in html_text.main_text(pages).collect()}
    without = {r.page_id: r.text for r in html_text.main_text(pages, many=1 << 30).collect()}
    by_name = {r.page_id: r.text for r in html_text.main_text(pages, enough=1 << 30).collect()}
    assert found == by_name  # both ways agree on this table
    large = {r.page_id for r in pages.collect() if size[html_text.host(r.url)] >= html_text.ENOUGH}
    assert {i for i in found if found[i] != without[i]} == large and len(large) > 50  # nothing but the counts cleans these
    long_ = "x-" * 150 + "sidebar"
    assert html_text.extract(f'<article><p>a</p><div class="{long_}">z</div></article>', set()) == "a"


# ------------------------------------------------------------------ training rows

def test_training_rows_are_bounded_and_their_order_does_not_matter(spark):
    from strandline.llm import quality, toxicity

    docs = table(spark, "documents").select("doc_id", "text")
    labels = table(spark, "labels")
    one = labels.where("toxic = 1").first().doc_id
    many = docs.unionByName(docs.where(F.col("doc_id") == one).crossJoin(spark.range(300)).select("doc_id", F.concat("text", F.lit(" "), F.col("id").cast("string")).alias("text")))
    scores = lambda d, m, parts: sorted((r.doc_id, r.score) for r in m.score(d.repartition(parts), *([labels] if m is toxicity else [])).collect())
    assert scores(many, toxicity, 1) == scores(many, toxicity, 7)  # to the last digit
    assert scores(docs, quality, 1) == scores(docs, quality, 7)
    empty = docs.limit(0)
    assert toxicity.drop_toxic(empty, labels).count() == 0 and quality.drop_bad(empty).count() == 0
    odd = documents(spark, ODD)
    assert toxicity.drop_toxic(odd, labels).columns == odd.columns and quality.drop_bad(odd).columns == odd.columns
