"""Queries without SQL, and statistics, against plain versions."""

from __future__ import annotations

import hashlib
import math
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import chunking
from millrace.operators import agent, evaluation, experiments, reports
from millrace.operators.documents import clean_documents
from millrace.plans import registry
from millrace.sources import config, qa


def density(x, df):
    return math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi) * (1 + x * x / df) ** (-(df + 1) / 2)


def upper_tail(t, df, steps=20_000):
    """P(T >= t) by Simpson's rule on [0, t]."""
    x = np.linspace(0, t, steps + 1)
    y = np.array([density(v, df) for v in x])
    return 0.5 - t / steps / 3 * (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum())


def test_p_values_against_a_numeric_integral(spark, sf_dir):
    rows = registry.QUERIES["paired_p_values"](spark, sf_dir).collect()
    assert rows
    for r in rows:
        if r.t is not None and abs(r.t) < 50:
            assert r.p_value == pytest.approx(2 * upper_tail(abs(r.t), r.n - 1), abs=1e-6) and r.significant == (r.p_value < r.bonferroni_alpha)


def test_t_intervals_against_a_numeric_integral(spark, sf_dir):
    rows = registry.QUERIES["t_intervals"](spark, sf_dir).collect()
    assert rows
    for r in rows:
        if r.n > 1 and r.std > 0:
            t = (r.ci_high - r.mean) / (r.std / math.sqrt(r.n))
            assert upper_tail(t, r.n - 1) == pytest.approx(0.025, abs=1e-5) and r.mean - r.ci_low == pytest.approx(r.ci_high - r.mean)


def test_score_comparison_p(spark, sf_dir):
    t = {r.metric: r for r in registry.QUERIES["score_comparison"](spark, sf_dir).collect()}
    for r in registry.QUERIES["score_comparison_p"](spark, sf_dir).collect():
        stat = t[r.metric]
        assert r.p_value == pytest.approx(2 * upper_tail(abs(stat.t), stat.n - 1), abs=1e-6)
        assert (r.significant_05, r.significant_01) == (r.p_value < 0.05, r.p_value < 0.01)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.one_of(st.none(), st.integers(-20, 20).map(float), st.floats(-1e6, 1e6))), min_size=1, max_size=60))
def test_percentiles_against_numpy(spark, values):
    shares = [0.0, 0.25, 0.5, 0.95, 0.99, 1.0]
    df = spark.createDataFrame(values, "g string, v double")
    got = {r.g: r for r in evaluation.exact_percentiles(df, ["g"], "v", shares, buckets=4).collect()}
    for g in "ab":
        mine = [v for h, v in values if h == g and v is not None]
        if mine:
            assert [got[g][f"p{i}"] for i in range(len(shares))] == pytest.approx(list(np.percentile(mine, [100 * s for s in shares])), rel=1e-9, abs=1e-9)
        else:
            assert g not in got


def documents(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def test_nfkc_against_plain_python(spark, sf_dir):
    """The rows are those of texts that plain Python normalised before."""
    texts = {i: unicodedata.normalize("NFKC", t or "") for i, t in documents(spark, sf_dir).items()}
    plain = clean_documents(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), unicode=False)
    expected = {r.doc_id: (hashlib.md5(r.text.encode()).hexdigest(), r.char_count) for r in plain.collect()}
    assert {r.doc_id: (r.text_md5, r.char_count) for r in registry.QUERIES["clean_nfkc"](spark, sf_dir).collect()} == expected


CHUNKERS = {"recursive_chunks": "recursive", "code_chunks": "code_aware", "table_chunks": "table_aware"}


@pytest.mark.parametrize("name", [*CHUNKERS, "auto_chunks"])
def test_chunks_against_plain_python(spark, sf_dir, name):
    """The rows are what the chunker gives for each text alone, numbered from 0, and hold every word of it."""
    texts, found = documents(spark, sf_dir), {}
    for r in registry.QUERIES[name](spark, sf_dir).collect():
        found.setdefault(r.doc_id, {})[r.chunk_index] = r
    how = {r.doc_id: r.strategy for r in registry.QUERIES["content_strategy"](spark, sf_dir).collect()}
    assert set(found) == {i for i, t in texts.items() if chunking.STRATEGIES[CHUNKERS.get(name) or how[i]](t)}
    for i, rows in found.items():
        chunks = chunking.STRATEGIES[CHUNKERS.get(name) or how[i]](texts[i])
        assert sorted(rows) == list(range(len(chunks)))
        assert {w for c in chunks for w in c.split()} >= set(texts[i].split())
        for n, chunk in enumerate(chunks):
            told = rows[n].asDict()
            assert told.get("chunk_text", chunk) == chunk and told.get("chunk_md5", hashlib.md5(chunk.encode()).hexdigest()) == hashlib.md5(chunk.encode()).hexdigest() and told.get("n_chars", len(chunk)) == len(chunk)


def plain_score(rows, alpha, k, depth=10):
    return sorted(rows, key=lambda r: (-round((alpha / (k + r[1]) if r[1] else 0) + ((1 - alpha) / (k + r[2]) if r[2] else 0), 9), min(x for x in r[1:3] if x), -r[0]))[:depth]


def test_final_evaluation_against_brute_force(spark):
    rng = np.random.default_rng(3)
    dense, sparse, truth = {}, {}, {}
    for q in range(12):
        dense[q], sparse[q] = rng.permutation(30)[:10].tolist(), rng.permutation(30)[:10].tolist()
        truth[q] = set(rng.permutation(30)[:8].tolist())
    frame = lambda side: spark.createDataFrame([(q, d, 1.0 / (i + 1), i + 1) for q, ds in side.items() for i, d in enumerate(ds)], "query_id long, vec_id long, score double, rank int")
    qrels = spark.createDataFrame([(q, d) for q, ds in truth.items() for d in ds], "query_id long, vec_id long")
    alphas, ks = [0.2, 0.5, 0.8], [20, 60]
    got = experiments.final_evaluation(frame(dense), frame(sparse), qrels, alphas, ks, F.col("query_id") % 2 == 0).collect()

    def top(q, alpha, k):
        ids = {*dense[q], *sparse[q]}
        place = lambda side, d: side[q].index(d) + 1 if d in side[q] else None
        return [r[0] for r in plain_score([(d, place(dense, d), place(sparse, d)) for d in ids], alpha, k)]

    def objective(alpha, k):
        values = []
        for q in range(0, 12, 2):
            hit = [d in truth[q] for d in top(q, alpha, k)]
            values.append((float(any(hit[:3])), sum(hit[:3]) / 3, sum(hit) / len(truth[q]), sum(hit) / len(hit)))
        m = np.mean(values, axis=0)
        return round(0.35 * m[0] + 0.30 * m[1] + 0.20 * m[2] + 0.15 * m[3], 6)

    alpha, k = min(((a, k) for a in alphas for k in ks), key=lambda s: (-objective(*s), abs(s[0] - 0.5), abs(s[1] - 60), *s))
    assert {(r.alpha, r.rrf_k) for r in got} == {(alpha, k)}
    precision = np.mean([sum(d in truth[q] for d in top(q, alpha, k)[:5]) / 5 for q in range(1, 12, 2)])
    assert [r["mean"] for r in got if r.metric == "precision" and r.k == 5] == [pytest.approx(precision, abs=1e-6)]


def test_grid_test_query(spark, sf_dir):
    winner = {(r.alpha, r.rrf_k) for r in registry.QUERIES["grid_test"](spark, sf_dir).collect()}
    assert len(winner) == 1


def test_macro_means_and_model_names(spark):
    rows = spark.createDataFrame([("m", 5, 1.0), ("m", 5, None), ("m", 5, 0.5), ("n", 1, None)], "metric string, k int, value double")
    assert {(r.metric, r["mean"], r.n) for r in reports.macro_means(rows).collect()} == {("m", 0.75, 2), ("n", None, 0)}
    assert reports.embedding_model({"embedding": {"dense": {"model": "d"}, "sparse": {"model": "s"}}}) == "d"
    assert reports.embedding_model({"embedding": {"sparse": {}}}) == reports.embedding_model({}) == "unknown" and reports.embedding_model({"embedding": {"model": "m"}}) == "m"


def test_run_log_and_statistics_export(spark, tmp_path):
    path = f"file://{tmp_path}"
    reports.write_run(spark, f"{path}/log", "q", "an answer", "c")
    reports.write_run(spark, f"{path}/log", "r", "short")
    log = reports.read_json(spark, f"{path}/log", "question string, answer string, context string")
    assert tuple(reports.log_counts(log).first())[:3] == (2, 1, 1)
    metrics = spark.createDataFrame([("a", 1, "map", 0, 0.5), ("a", 2, "map", 0, 1.0)], "method string, query_id int, metric string, k int, value double")
    reports.export_metrics(metrics, f"{path}/out")
    assert spark.read.csv(f"{path}/out/statistics", header=True).first()["mean"] == "0.75"


@pytest.fixture
def folder(tmp_path):
    data = tmp_path / "data"
    data.mkdir()
    q = ["question_id,question_title,question_body,tags,question_type,answer_posts"]
    q += [f"{i},A title of question {i} which is long,\"['About the question with number {i}.', 'It\\'s a body of some length. And more']\",\"['t']\",1,\"{10 + i}, 99\"" for i in range(30)]
    (data / "question.csv").write_text("\n".join(q) + "\n")
    a = ["answer_id,answer_body,summary"] + [f"{10 + i},\"['body {i}']\",\"['First sentence {i}', 'second one', 'third']\"" for i in range(30)]
    (data / "answer.csv").write_text("\n".join(a) + "\n")
    return str(tmp_path)


def test_adapter_of_a_folder(spark, folder, tmp_path):
    adapter = config.load_adapter("stackoverflow", folder=f"file://{folder}")
    rows = adapter.read_rows(spark)
    assert [r.external_id for r in rows.orderBy("_pos").collect()] == [f"q_{i}" for i in range(30)] + [f"a_{10 + i}" for i in range(30)]
    docs = adapter.to_documents(rows, "test")
    assert docs.count() == 30 and {(r.source, r.split, r.dataset_version, r.has_question_context) for r in docs.collect()} == {("stackoverflow_sosum", "test", "1.0.0", True)}
    queries = adapter.evaluation_queries(rows)
    assert queries.count() == 4 * 30
    found = {r.query_id: r for r in queries.collect()}
    assert found["eval_qbody2a_3"].query == "About the question with number 3"
    assert found["eval_a2a_13"].query == "First sentence 3 second one" and found["eval_q2a_3"].expected == ["a_13"]
    with pytest.raises(FileNotFoundError):
        qa.post_files(spark, f"file://{tmp_path}/absent")


def test_query_set_up_to_a_number(spark, folder):
    raw = [qa.read_csv(spark, p) for p in qa.post_files(spark, f"file://{folder}")]
    got = [r.query_id for r in qa.query_set(*raw, most=100).collect()]
    asked = [q for q in got if not q.startswith("eval_a2a_")]
    assert len(asked) == 60 and {q.rsplit("_", 1)[1] for q in asked} == {str(i) for i in range(20)} and len(got) == 60 + 30


def test_judge_asks_in_batches(spark):
    """Ten rows in batches of four; every third fails once, one for good; and a call that replies too little fails as a whole."""
    rows = spark.createDataFrame([(f"q{i}", "a", None) for i in range(10)], "question string, answer string, context string").coalesce(1)
    good = '{"faithfulness": 3, "relevance": 4, "helpfulness": 5, "justification": "fine"}'

    def model(questions, answers, contexts, attempt):
        assert len(questions) <= 4 and len(questions) == len(answers) == len(contexts)
        return ["no json" if q == "q7" or (int(q[1:]) % 3 == 0 and attempt == 1) else good for q in questions]

    got = {r.question: r for r in agent.judge(rows, model, batch=4).collect()}
    assert {q for q, r in got.items() if r.attempts == 2} == {"q0", "q3", "q6", "q9"} and got["q1"].attempts == 1 and got["q1"].justification == "fine"
    assert got["q7"].attempts == 3 and got["q7"].faithfulness == 0 and got["q7"].justification.startswith("failed 3 times")
    short = agent.judge(rows, lambda q, a, c, n: [good], batch=4).collect()
    assert len(short) == 10 and all(r.faithfulness == 0 and "1 replies" in r.justification for r in short)


def test_medians_of_a_hot_group(spark):
    from millrace.operators.evaluation import summary

    rows = [("m", 1, float(i % 7)) for i in range(700)] + [("n", None, 2.0), ("n", None, float("nan")), ("o", 1, None)]
    got = {r.metric: r for r in summary(spark.createDataFrame(rows, "metric string, k int, value double")).collect()}
    assert (got["m"].median, got["m"].total, got["m"]["count"]) == (3.0, 700, 700)
    assert (got["n"].median, got["n"].total, got["n"]["count"]) == (2.0, 2, 1) and got["o"].median is None and got["o"].total == 1
