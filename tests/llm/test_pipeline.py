"""The pipeline's stages, and queries against their DuckDB statements."""

import collections

import duckdb
import numpy as np
import pytest
from test_llm import brute_groups, brute_leaks, words

import corpus_pipeline
from strandline.llm import mixing, packing, queries, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.materialise(stage(spark, docs, SF), name)
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        docs = out
        counts.append(out.count())
    assert counts[0] > counts[1] > counts[2] > counts[3] and counts[4] > 0
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    ids = {d for r in rows for d in r.doc_ids}
    assert ids == {r.doc_id for r in docs.select("doc_id").collect()}


def test_stages_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    clean = corpus_pipeline.materialise(stages["toxicity"](spark, docs, SF), "toxicity")
    scores = toxicity.score(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert ids(clean) == {r.doc_id for r in scores if r.score < 0.5}
    one = corpus_pipeline.materialise(stages["near_dedup"](spark, clean, SF), "near")
    groups = brute_groups([(r.doc_id, r.text) for r in clean.collect()], 5, 80, 100)
    assert ids(one) == {i for i, (_, root) in groups.items() if i == root}
    rest = corpus_pipeline.materialise(stages["decontamination"](spark, one, SF), "rest")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = rest.collect()
    assert {r.doc_id for r in rows} == {x[0] for x in brute_leaks([(r.doc_id, r.text) for r in one.collect()], items) if not x[5]}
    mixed = corpus_pipeline.materialise(stages["mixing"](spark, rest, SF), "mixed")
    taken, copies = collections.Counter(), collections.Counter()
    for r in mixing.mixture(rest).collect():
        taken[r.doc_id] += r.taken
    text = {r.doc_id: r.text for r in rows}
    for r in mixed.collect():
        copies[r.doc_id] += len(words(r.text))
        assert set(words(r.text)) <= set(words(text[r.doc_id])) and r.n_chars == len(r.text)
    assert copies == +taken
    bpe = packing.encoder(packing.read_ranks()).bpe
    packed = collections.Counter(x for r in stages["packing"](spark, mixed, SF).collect() for x in np.frombuffer(r.ids, "<u2")[: r.n_tokens].tolist())
    plain = collections.Counter(x for r in mixed.collect() for x in [*bpe.encode_ordinary(r.text), packing.END])
    assert packed == plain


def test_run_gives_the_stages_result(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "packing"]


def python_at_once(df):
    """Python nodes that a task of the plan runs at once, at most."""
    most = 0

    def below(node):
        nonlocal most
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return below(node.initialPlan())
        nodes = sum(below(node.children().apply(i)) for i in range(node.children().size())) + name.startswith(("MapInArrow", "ArrowEvalPython", "BatchEvalPython"))
        most = max(most, nodes)
        return 0 if "Exchange" in name else nodes

    below(df._jdf.queryExecution().executedPlan())
    return most


def test_tasks_of_the_stages_have_one_python_worker(spark, monkeypatch):
    """Workers stay when a task has ended, each as large as it has ever been, so a second one for a task doubles what an executor holds."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", lambda *a, **b: pytest.fail("rows made by Python workers of another kind"))
    for _, stage in corpus_pipeline.STAGES:
        assert python_at_once(stage(spark, docs, SF)) == 1
    assert mixing.repeat_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    cur = c.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(cur.fetchall())
