"""Expressions, metrics, tests, resampling, state: fixed values and properties."""

import math
import random
import threading

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from titleforge.functions import control, text
from titleforge.operators import estimators, features, metrics, paired, resample, state, tables


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()]


# Text


@pytest.mark.parametrize("pad", [" ", "　", "\n", "  ", "\t\u0085", " "])
def test_strip_unicode(spark, pad):
    assert column(spark, [pad + "a b" + pad, pad, None], text.strip) == ["a b", "", None]


def test_rescue(spark):
    cases = {"标签Yes": "", "标签：yes.": "Yes", "No-op": "No", "noé": "", "Yes_": "", "<Yes>": "Yes", "Yes2": "", "": ""}
    assert column(spark, list(cases), text.rescue_label) == list(cases.values())


def test_clamp(spark):
    assert column(spark, ["0.5", "7", "-1", "NaN", "x", None], text.clamp_confidence) == [0.5, 1.0, 0.0, 0.0, None, None]


RESPONSES = [
    '{"label": "Yes", "confidence": 0.8, "explanation": " a "}', '```json\n{"label":"no","confidence":"0.25"}\n```', 'Sure: {"label":"YES"} ok', '{"label":"Yes"} x {y}', "{'label':'Yes'}", '{"label":"Yes",}',
    '{"label":"maybe","explanation":"no doubt"}', '{"label":"Yes","confidence":null}', '{"label":"Yes","confidence":"90%"}', '{"label":"Yes","confidence":true}', '{"label":"Yes","confidence":7}', "", "no", "nothing",
    '{"label":"No","a":{"b":[1,2]}}', "x" * 300, '{"label":"Yes","confidence":"high"}',
]


def test_native_parser_equals_exact_one(spark):
    native = [tuple(r) for r in column(spark, [*RESPONSES, None], text.parse_response)]
    exact = [tuple(r) for r in column(spark, [*RESPONSES, None], lambda c: text.parse_response_exact(c))]
    assert native == exact
    assert exact[0] == ("Yes", "a", 0.8, True) and exact[3][3] is False and exact[6][0] == "No" and exact[9][2] == 1.0


def test_keyword_rule(spark):
    rule = text.KeywordRule()
    got = column(spark, ["专家辟谣:根治", "能降血压吗?", "根治?", "祖传", "偏方降血压", "天气", None], lambda c: rule.predict(c))
    assert [tuple(r) for r in got] == [("No", 0.1), ("No", 0.25), ("Yes", 0.9), ("Yes", 0.9), ("Yes", 0.75), ("No", 0.3), ("No", 0.3)]


def test_char_ngrams(spark):
    assert column(spark, ["AB 中", "a  b", "x", "", None], lambda c: text.char_ngrams(c, (2, 3))) == [["ab", "b ", " 中", "ab ", "b 中"], ["a ", " b", "a b"], [], [], []]


# Requests


def test_stage_budgets(spark):
    stages = (4096, 8192, 16384)
    assert column(spark, range(5), lambda c: control.stage_budget(c, stages), "long") == [4096, 8192, 16384, 4096, 8192]
    assert column(spark, [*range(8), 400], lambda c: control.stage_budget(c, stages, geometric=True), "long") == [4096, 8192, 16384, 32768, 65536, 131072, 262144, 262144, 262144]


def test_parse_stages():
    assert control.parse_stages("1, 2,2", 1) == [1, 2, 2] and control.parse_stages("2,4", 1, strict=True) == [1, 2, 4]
    for bad in (("", 1), ("2", 1), ("1,0", 1), ("3,2", 3)):
        with pytest.raises(ValueError):
            control.parse_stages(*bad)
    with pytest.raises(ValueError):
        control.parse_stages("1,1", 1, strict=True)


@pytest.mark.parametrize(
    ("status", "message", "kind"),
    [(402, "", "balance_exhausted"), (400, "请充值", "balance_exhausted"), (503, "", "transient"), (None, "Read timed out", "transient"), (422, "", "invalid_parameters"), (403, "timeout", "permanent"), (None, None, "permanent")],
)
def test_error_class(spark, status, message, kind):
    assert spark.createDataFrame([(status, message)], "s int, m string").select(control.error_class(F.col("s"), F.col("m"))).first()[0] == kind


def test_retry_delay(spark):
    got = spark.createDataFrame([(0, None), (3, None), (9, None), (0, "5"), (0, "-1"), (0, "999"), (0, "x"), (1, "NaN")], "a int, r string").select(control.retry_delay(F.col("a"), F.col("r"))).collect()
    assert [r[0] for r in got] == [2.0, 16.0, 60.0, 5.0, 0.0, 60.0, 2.0, 4.0]


def test_progress_record(spark):
    c = F.lit
    row = spark.range(1).select(control.progress_record(c("request_started"), c("none"), c(1), c("abc"), c(7), c(1.23456)).alias("r"), control.timed_out(c(300.0)).alias("t")).first()
    assert (row.r.attempt_status, row.r.thinking_observed, row.r.latency_ms, row.r.http_status, row.t) == ("request_started", True, 1234.56, None, True)
    assert control.request_policy(stages=(1, 2))["token_stages"] == [1, 2]


def test_stable_hash():
    assert control.stable_hash({"b": 1, "a": "中"}) == control.stable_hash({"a": "中", "b": 1}) != control.stable_hash({"a": "中", "b": 2})


# Metrics


def test_bins(spark):
    assert column(spark, [0.1, 0.2, 0.3, 0.6, 0.7, 0.8, 0.9, 1.0, 1 - 0.7, 1 - 0.8, 1 - 0.9, 0.0, -0.1, 1.1], metrics.bin_of, "double") == [1, 2, 2, 5, 6, 8, 9, 9, 3, 1, 0, 0, None, None]
    assert np.allclose(metrics.EDGES, np.linspace(0, 1, 11), atol=0)


def frame(spark, gold, pred, conf=None):
    return spark.createDataFrame([("m", "s", f"{i:04d}", g, p, c) for i, (g, p, c) in enumerate(zip(gold, pred, conf or [0.7] * len(gold)))], "model_name string, subset string, id string, gold_label string, pred_label string, confidence double")


def test_one_class_gold(spark):
    df = frame(spark, ["No"] * 3, ["No"] * 3)
    fixed, seen = (metrics.point_metrics(df, policy=p).first() for p in ("fixed", "observed"))
    assert (fixed.macro_f1, fixed.balanced_accuracy, seen.macro_f1, seen.balanced_accuracy, fixed.mcc) == (0.5, 0.5, 1.0, 1.0, 0.0)
    assert metrics.auroc(df).first().auroc is None


def test_metrics_against_plain_python(spark):
    rng = random.Random(5)
    gold, pred = ([rng.choice(["Yes", "No"]) for _ in range(200)] for _ in range(2))
    conf = [rng.choice([0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) for _ in range(200)]
    row = metrics.evaluation(frame(spark, gold, pred, conf)).first()
    y, p = np.array([g == "Yes" for g in gold]), np.array([q == "Yes" for q in pred])
    s = np.where(p, conf, 1.0 - np.array(conf))
    assert row.accuracy == pytest.approx((y == p).mean())
    assert row.mcc == pytest.approx(np.corrcoef(y, p)[0, 1])
    wins = [(a > b) + (a == b) / 2 for a in s[y] for b in s[~y]]
    assert row.auroc == pytest.approx(np.mean(wins))
    edges = np.linspace(0, 1, 11)
    which = np.minimum(np.searchsorted(edges, s, side="right") - 1, 9)
    assert row.ece == pytest.approx(sum((which == k).mean() * abs(s[which == k].mean() - y[which == k].mean()) for k in set(which.tolist())))
    assert metrics.evaluation(frame(spark, gold, pred, conf).limit(0)).count() == 0


def test_exact_binomial(spark):
    cases = {(0, 5): 0.0625, (3, 10): 0.34375, (5, 10): 1.0, (7, 40): 4.2277022657799534e-05, (0, 0): 1.0}
    df = spark.createDataFrame([(*k, v) for k, v in cases.items()], "k long, n long, v double")
    for r in df.select("v", paired.exact_binomial("k", "n").alias("a"), paired.exact_binomial_sql(F.col("k"), F.col("n")).alias("b")).collect():
        assert r.a == pytest.approx(r.v, rel=1e-12) and r.b == pytest.approx(r.v, rel=1e-12)
    big = spark.createDataFrame([(49_000, 100_000)], "k long, n long").select(paired.exact_binomial("k", "n")).first()[0]
    assert big == pytest.approx(math.erfc(((50_000 - 49_000 - 0.5) / math.sqrt(25_000)) / math.sqrt(2)), rel=0.01)


def test_holm(spark):
    df = spark.createDataFrame([("s", 1, 0.01), ("s", 2, 0.04), ("s", 3, 0.03), ("t", 4, 0.9), ("t", 5, 0.9)], "subset string, i int, p double")
    got = {r.i: r.holm_adjusted_p for r in paired.holm(df, "p", "subset").collect()}
    assert got == pytest.approx({1: 0.03, 2: 0.06, 3: 0.06, 4: 1.0, 5: 1.0})


def test_percentile(spark):
    df = spark.createDataFrame([("g", 1.7 * i) for i in range(11)], "g string, accuracy double")
    assert resample._percentiles(df, ["g"], ["accuracy"]).first().accuracy_ci_low == pytest.approx(0.425)


def test_bootstrap_streams(spark):
    rng = random.Random(8)
    gold, pred = ([rng.choice(["Yes", "No"]) for _ in range(72)] for _ in range(2))
    df = frame(spark, gold, pred)
    got = resample.bootstrap_numpy(df, rounds=100).first()
    own, y, p = np.random.default_rng(42), np.array(gold), np.array(pred)
    values = [np.mean(y[i] == p[i]) for i in (own.integers(0, 72, 72) for _ in range(100))]
    assert (got.accuracy_ci_low, got.accuracy_ci_high) == pytest.approx(tuple(np.percentile(values, [2.5, 97.5])))
    free = resample.bootstrap(df, rounds=2_000).first()
    assert free.accuracy_ci_low == pytest.approx(got.accuracy_ci_low, abs=0.06) and free == resample.bootstrap(df, rounds=2_000).first()
    assert resample.bootstrap(df.limit(1)).count() == 0 and resample.bootstrap_numpy(df.limit(1)).count() in (0, 1)


def test_gathered_rounds_write_no_draws(spark):
    """Equal to plain indexing, for groups held whole, in pieces, and with rounds cut into slices; no join per draw."""
    rng = random.Random(3)
    rows = [(m, "s", f"{i:05d}", rng.choice(["Yes", "No"]), rng.choice(["Yes", "No", None])) for m, n in (("a", 1), ("b", 2), ("c", 2_500), ("d", 20_011)) for i in range(n)]
    df = spark.createDataFrame(rows, "model_name string, subset string, id string, gold_label string, pred_label string").repartition(5)
    want = {}
    for m in "bcd":
        y, p = (np.array([r[k] == "Yes" for r in rows if r[0] == m]) for k in (3, 4))
        pos, accuracy = np.arange(len(y)), []
        for r in range(40):
            i = ((r + 1) * 7_919 + pos * (r * 2 + 104_729) + pos * pos % 1_009 * 31) % len(y)
            accuracy.append((y == p)[i].mean())
        want[m] = pytest.approx(np.percentile(accuracy, [2.5, 97.5]).tolist())
    for sizes in ({}, {"piece": 900, "draws": 5_000}):
        got = resample.bootstrap_gather(df, rounds=40, **sizes)
        assert {r.model_name: [r.accuracy_ci_low, r.accuracy_ci_high] for r in got.collect()} == want
        assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


# State


def lines(spark, rows):
    base = ("sig", "plan", "m", "s", "1", "t", "Yes", 4096)
    full = [(i + 1, *(v if v is not None else b for v, b in zip(r[:8], base)), *r[8:]) for i, r in enumerate(rows)]
    return spark.createDataFrame(
        full,
        "line_no long, condition_signature string, token_plan_signature string, model_name string, subset string, id string, title string, gold_label string, token_budget long, token_stage_index long, status string, pred_label string, confidence double, format_valid boolean",
    )


def line(stage, status, label="", **k):
    names = ["condition_signature", "token_plan_signature", "model_name", "subset", "id", "title", "gold_label", "token_budget"]
    return (*(k.get(n) for n in names), stage, status, label, 0.5, True)


def test_success_state(spark):
    signatures = spark.createDataFrame([("m", "sig")], "model_name string, condition_signature string")
    titles = spark.createDataFrame([("s", "1", "t", "No"), ("s", "2", "u", "Yes")], "subset string, id string, title string, gold_label string")
    log = lines(spark, [line(0, "success", "Yes"), line(0, "permanent_failure"), line(0, "success", "No"), line(0, "success", "Yes", condition_signature="old"), line(0, "success", "Yes", title="changed"), line(0, "success", "maybe"), line(0, "success", "Yes", id="9")])
    rows = state.latest_success(log, signatures, titles, columns=("title", "gold_label", "pred_label")).collect()
    assert [(r.id, r.line_no, r.gold_label, r.pred_label) for r in rows] == [("1", 3, "No", "No")]


def test_stages(spark):
    signatures = spark.createDataFrame([("m", "sig")], "model_name string, condition_signature string")
    titles = spark.createDataFrame([("s", "1", "t", "Yes"), ("s", "2", "t", "Yes")], "subset string, id string, title string, gold_label string")
    log = lines(spark, [line(None, "token_limit"), line(1, "transient_failure"), line(1, "token_limit"), line(3, "token_limit"), line(-1, "token_limit"), line(2, "token_limit", token_plan_signature="old")])
    got = state.stage_outcomes(log, signatures, "plan", titles)
    assert sorted((r.stage, r.status) for r in got.collect()) == [(0, "token_limit"), (1, "token_limit"), (3, "token_limit")]
    keys = titles.select(F.lit("m").alias("model_name"), "subset", "id")
    assert {r.id: r.stage for r in state.item_stage(got, keys).collect()} == {"1": 2, "2": 0}
    pending = state.stage_pending(state.stage_candidates(keys, got), got)
    assert sorted((r.id, r.stage) for r in pending.collect()) == [("1", 2), ("1", 4), ("2", 0)]
    assert state.ready_stage(pending, got).first().asDict() == {"stage": 2, "pending": 1, "fresh": 1}
    wide = state.stage_outcomes(log, signatures, "plan", titles, stages=(4096, 8192), geometric=True)
    assert [r.stage for r in wide.collect()] == [0]


def test_shards(spark):
    jobs = spark.createDataFrame([("m", "s", str(i)) for i in range(5)], "model_name string, subset string, id string")
    got = state.sharded(jobs, 2).collect()
    assert {k: {r.job_index for r in got if r.shard_index == k} for k in (0, 1)} == {0: {0, 2, 4}, 1: {1, 3}}


# Tables and models


def test_ordinals(spark):
    df = spark.createDataFrame([(i * 7 % 101, i) for i in range(101)], "k int, v int").repartition(5)
    got = {r.k: r.ordinal for r in tables.ordered_ordinal(df, ["k"]).collect()}
    assert got == {k: k + 1 for k in range(101)}
    with pytest.raises(ValueError):
        tables.positional_split(tables.ordered_ordinal(df, ["k"]), 60, 60)
    split = tables.positional_split(tables.ordered_ordinal(df, ["k"]), 20, 30).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in split} == {"train": 51, "dev": 20, "test": 30}


@pytest.fixture(scope="module")
def small(spark):
    rng = random.Random(11)
    yes, no = ["根治秘方", "神效偏方", "百试百灵"], ["天气预报", "交通新闻", "专家辟谣"]
    rows = [(f"{i:03d}", rng.choice(yes if i % 3 else no) + rng.choice("春夏秋冬") + str(rng.randrange(9)), "Yes" if i % 3 else "No") for i in range(60)]
    return spark.createDataFrame(rows, "id string, title string, gold_label string")


@pytest.mark.parametrize("whole", [2_000_000, 0])
def test_models_reach_their_optimum(small, monkeypatch, whole):
    monkeypatch.setattr(estimators, "WHOLE", whole)
    data = estimators.prepare(small)
    rows = data.rows.toPandas()
    ids = {k: i for i, k in enumerate(sorted(rows["id"].unique()))}
    x = np.zeros((len(ids), data.size))
    x[[ids[k] for k in rows["id"]], rows["index"]] = rows["weight"]
    per = rows.drop_duplicates("id").sort_values("id")
    y, c = per["y"].to_numpy() * 2 - 1, per["c"].to_numpy()
    assert np.allclose((x * x).sum(axis=1), 1)
    svm = estimators.squared_hinge(data, 1.0)
    w = np.append(svm.weights, svm.intercept)
    z = np.hstack([x, np.ones((len(x), 1))])
    g = w - 2 * z.T @ (c * y * np.maximum(0, 1 - y * (z @ w)))
    assert np.linalg.norm(g) < 1e-4
    lr = estimators.logistic(data, 1.0)
    f = x @ lr.weights + lr.intercept
    g = lr.weights - x.T @ (c * y / (1 + np.exp(y * f)))
    assert np.linalg.norm(g) < 1e-3
    nb = estimators.complement_nb(data, 0.5)
    sums = np.stack([x[y < 0].sum(axis=0), x[y > 0].sum(axis=0)])[::-1] + 0.5
    logs = np.log(sums / sums.sum(axis=1, keepdims=True))
    assert np.allclose(nb.weights, logs[0] - logs[1])


@pytest.mark.parametrize("together", [1_000_000, 7])
def test_counted_grams_equal_the_table(spark, monkeypatch, together):
    """Counts and weights over batches are those of the table of all grams, whatever the signs and the lengths."""
    monkeypatch.setattr(features, "TOGETHER", together)
    texts = ["", "a", "\U0001f600\U0001f600\U0001f600", "Ab  aB\u3000\u3000ab", None, "\u0130\ud55c\uae00 x" * 40, "aaaaaaa", "z"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, title string")
    plain = features.plain(df)
    tf = features.term_frequencies(df)
    assert sorted(features.document_frequencies(tf).collect()) == sorted(features.gram_counts(plain).collect())
    vocab = features.vocabulary(features.document_frequencies(tf), len(texts), max_features=40)
    rows = plain.orderBy("id").collect()
    sizes, index, weight = features.vectors([r._t for r in rows], *features.lookup(vocab, len(texts)))
    got = dict(zip(zip(np.repeat([r.id for r in rows], sizes).tolist(), index.tolist()), weight, strict=True))
    assert got == pytest.approx({(r.id, r["index"]): r.weight for r in features.tfidf(tf, vocab, len(texts)).collect()})


@pytest.mark.parametrize("whole", [2_000_000, 0])
def test_titles_without_grams_count(spark, small, monkeypatch, whole):
    """A title too short for any gram pulls at the intercept; gradient and score see it."""
    monkeypatch.setattr(estimators, "WHOLE", whole)
    short = spark.createDataFrame([(f"x{i}", "\u4e2d", "No") for i in range(15)], "id string, title string, gold_label string")
    data = estimators.prepare(small.unionByName(short))
    svm = estimators.squared_hinge(data, 1.0)
    f = svm.predict(small.unionByName(short)).select("gold_label", F.log(F.col("score_yes") / (1 - F.col("score_yes"))).alias("f")).toPandas()
    y = np.where(f.gold_label == "Yes", 1.0, -1.0)
    c = np.where(y > 0, 75 / (2 * (y > 0).sum()), 75 / (2 * (y < 0).sum()))
    assert abs(svm.intercept - 2 * (c * y * np.maximum(0, 1 - y * f.f)).sum()) < 1e-4


def test_equal_features_are_fitted_as_one():
    """Features of equal entries become one, and the weights are those of the whole table."""
    rng, n, size = np.random.default_rng(3), 300, 60
    x = np.where(rng.random((n, 20)) < 0.3, rng.random((n, 20)), 0.0)[:, np.arange(size) % 20]
    y, at = np.where(rng.random(n) < 0.5, 1.0, -1.0), [np.flatnonzero(r) for r in x]
    block = {"y": y, "c": np.ones(n), "sizes": np.array([len(k) for k in at]), "i": np.concatenate(at).astype(np.int32), "v": x[x > 0]}
    parts = [pd.DataFrame({k: [v.tobytes()] for k, v in block.items()})]

    def loss(y, f):
        slack = np.maximum(0.0, 1 - y * f)
        return slack * slack, -2 * slack * y, 2.0 * (slack > 0)

    merged, same, times = estimators._merged(parts, size)
    assert len(times) == 20 and set(times) == {3} and len(merged["v"][0]) * 3 == len(parts[0]["v"][0])
    held = estimators._Titles(merged, 20, loss, 1.0, turned=True)
    u = estimators._newton(lambda part, length, *given: part(held, *given), np.ones(21), 100, 1e-10)
    w, b = (u[:-1] / np.sqrt(times))[same], u[-1]
    pull = y * np.maximum(0, 1 - y * (x @ w + b))
    assert np.allclose(w, 2 * x.T @ pull, atol=1e-6) and b == pytest.approx(2 * pull.sum(), abs=1e-6)


@pytest.mark.parametrize("turned", [True, False])
def test_fits_take_few_passes(turned):
    """Common and rare features of very different curvature: few passes over the titles to a gradient of 1e-8."""
    rng, n, size = np.random.default_rng(5), 4_000, 1_500
    i = np.minimum((rng.pareto(0.7, (n, 30)) * 3).astype(np.int32), size - 1)
    y, v, c = np.where(rng.random(n) < 0.4, 1.0, -1.0), rng.random((n, 30)) / 4, np.ones(n)
    blocks = pd.DataFrame({"y": [y.tobytes()], "c": [c.tobytes()], "sizes": [np.full(n, 30).tobytes()], "i": [i.tobytes()], "v": [v.tobytes()]})
    dense = np.zeros((n, size + 1))
    np.add.at(dense, (np.repeat(np.arange(n), 30), i.ravel()), v.ravel())
    dense[:, size] = 1
    penalty, seen = np.append(np.ones(size), 0.0), []

    def loss(y, f):
        wrong = 1 / (1 + np.exp(y * f))
        return np.logaddexp(0.0, -y * f), -y * wrong, wrong * (1 - wrong)

    held = estimators._Titles(blocks, size, loss, 4.0, turned=turned)
    w = estimators._newton(lambda part, length, *given: seen.append(part) or part(held, *given), penalty, 1_000, 1e-8)
    slope = lambda w: penalty * w - 4 * dense.T @ (y / (1 + np.exp(y * (dense @ w))))
    assert np.linalg.norm(slope(w)) <= 1.1e-8 * np.linalg.norm(slope(np.zeros(size + 1))) and len(seen) < 300


def test_curvature_is_taken_once_a_step():
    """The products of one step share the losses' second derivatives."""
    y, asked = np.array([1.0, -1.0, 1.0]), []
    arrays = {"y": y, "c": np.ones(3), "sizes": np.ones(3, np.int64), "i": np.arange(3, dtype=np.int32), "v": np.ones(3)}

    def loss(y, f):
        asked.append(1)
        return f, f, f + 2

    held = estimators._Titles(pd.DataFrame({k: [x.tobytes()] for k, x in arrays.items()}), 3, loss, 2.0, turned=True)
    for w, calls in ((np.zeros(4), 1), (np.ones(4), 2)):
        for d in (np.ones(4), np.arange(4.0)):
            assert np.allclose(estimators._curved(held, w, d)[:3], 2 * (w[:3] + w[3] + 2) * (d[:3] + d[3]))
        assert len(asked) == calls


def test_grid_is_fitted_side_by_side(small):
    """Fits that wait for each other end, and the scores are those of fits one by one."""
    together = threading.Barrier(3, timeout=60)

    def fit(data, alpha):
        together.wait()
        return estimators.complement_nb(data, alpha)

    families = {"nb": ("alpha", (0.1, 0.5, 1.0), fit)}
    got = estimators.selection(small, small, families=families).orderBy("position").collect()
    data = estimators.prepare(small)
    for r, alpha in zip(got, (0.1, 0.5, 1.0), strict=True):
        alone = metrics.confusion(estimators.complement_nb(data, alpha).predict(small), []).select(metrics.rates("observed")["macro_f1"].alias("f")).first().f
        assert r.value == alpha and r.dev_macro_f1 == pytest.approx(alone)


@pytest.mark.parametrize("whole", [2_000_000, 500, 0])
def test_fits_of_larger_tables(spark, small, monkeypatch, whole):
    """A table too large for one task is held by several, which fit all that is asked for in one job; the weights are those of one task."""
    data = estimators.prepare(small)
    wanted = [(estimators.logistic, 1.0), (estimators.complement_nb, 0.5), (estimators.squared_hinge, 0.25), (estimators.logistic, 4.0)]
    alone = [fit(data, value) for fit, value in wanted]
    assert 500 < data.entries <= 2_000
    monkeypatch.setattr(estimators, "WHOLE", whole)
    led = []
    monkeypatch.setattr(estimators, "_newton", lambda *given, newton=estimators._newton: led.append(1) or newton(*given))
    for model, one in zip(estimators.fits(data, wanted), alone, strict=True):
        assert np.allclose(model.weights, one.weights, atol=1e-6) and model.intercept == pytest.approx(one.intercept, abs=1e-6)
    assert len(led) == (0 if whole else 3)  # the driver takes steps only where no tasks can hold the table


def test_models_score_together(spark, small):
    """Several models score each row at once, rows of equal or missing ids too."""
    data = estimators.prepare(small)
    models = [estimators.complement_nb(data, a) for a in (0.1, 1.0)]
    odd = spark.createDataFrame([("a", "根治秘方春1", 1), ("a", "天气预报秋2", 2), (None, "交通新闻", 3), ("b", None, 4)], "id string, title string, n int")
    got = {r.n: r.f for r in estimators.margins(models, odd).collect()}
    for k, model in enumerate(models):
        assert {r.n: pytest.approx(r.score_yes) for r in model.predict(odd).collect()} == {n: 1 / (1 + np.exp(-f[k])) for n, f in got.items()}
    assert len(got) == 4 and got[4] == [0.0, 0.0]


def test_predict_save_load(spark, small, tmp_path):
    model = estimators.complement_nb(estimators.prepare(small), 0.5)
    odd = spark.createDataFrame([("a", None), ("b", ""), ("c", "zzzz")], "id string, title string")
    assert {r.score_yes for r in model.predict(odd).collect()} == {0.5}
    estimators.save(model, str(tmp_path / "m"))
    again = estimators.load(spark, str(tmp_path / "m"))
    score = lambda m: {r.id: r.score_yes for r in m.predict(small).collect()}
    assert score(model) == pytest.approx(score(again))
    top = estimators.top_features(model, "nb", 3).collect()
    assert [r.rank for r in top if r.direction == "Yes"] == [1, 2, 3] and all(r.weight > 0 for r in top if r.direction == "Yes")
    with pytest.raises(ValueError):
        estimators.make_estimator("nosuch")


def test_vocabulary_is_bounded_and_ordered(small):
    tf = features.term_frequencies(small)
    v = features.vocabulary(features.document_frequencies(tf), 60, max_features=10).orderBy("index").collect()
    assert [r["index"] for r in v] == list(range(10)) and [(-r.tf, r.gram) for r in v] == sorted((-r.tf, r.gram) for r in v)


def test_plans_stay_native(spark, data):
    """No Python in the metric plan, one exchange of counts, only wanted columns read."""
    from titleforge.plans import catalog

    plan = catalog.QUERIES["point_metrics"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "raw_response" not in plan
    assert "PushedFilters: [IsNotNull(status)" in plan or "EqualTo(status,success)" in plan


def test_pair_counts(spark):
    rows = [("s", m, str(i), "Yes", "Yes" if (i + k) % 3 else "No") for k, m in enumerate("abc") for i in range(12)] + [("s", "d", "99", "Yes", "No")]
    df = spark.createDataFrame(rows, "subset string, model_name string, id string, gold_label string, pred_label string")
    pdf = pd.DataFrame(rows, columns=["subset", "model_name", "id", "gold", "pred"])
    pdf["ok"] = pdf.gold == pdf.pred
    for r in paired.pair_counts(df).collect():
        m = pdf[pdf.model_name == r.model_a].merge(pdf[pdf.model_name == r.model_b], on="id")
        assert (r.shared_n, r.model_a_only_correct, r.model_b_only_correct) == (len(m), (m.ok_x & ~m.ok_y).sum(), (~m.ok_x & m.ok_y).sum())


def test_ranks_over_ranges(spark):
    """Area under the curve of scores that are all distinct, over range partitions, with a null group."""
    rng = np.random.default_rng(3)
    rows = [(g, float(rng.normal()), ["No", "Yes"][int(rng.random() < 0.4)]) for g in ("a", "b", None) for _ in range(400)] + [("c", 0.5, "Yes")]
    df = spark.createDataFrame(rows, "g string, s double, gold_label string").withColumn("pred_label", F.lit("Yes")).withColumn("confidence", F.lit(1.0))
    got = {r.g: r.auroc for r in metrics.auroc(df, ["g"], F.col("s")).collect()}
    for g in ("a", "b", None):
        yes, no = ([s for k, s, y in rows if k == g and y == label] for label in ("Yes", "No"))
        assert abs(got[g] - np.mean([(x > y) + (x == y) / 2 for x in yes for y in no])) < 1e-9
    assert got["c"] is None


def test_group_ordinal(spark):
    rows = [("a" if i % 3 else None, i) for i in range(50)]
    got, sizes = tables.group_ordinal(spark.createDataFrame(rows, "g string, i int").repartition(4), ["g"], ["i"], "pos")
    for g in ("a", None):
        own = sorted(i for k, i in rows if k == g)
        assert sorted((r.pos, r.i) for r in got.collect() if r.g == g) == list(enumerate(own))
    assert {r.g: r.n for r in sizes.collect()} == {"a": 33, None: 17}
