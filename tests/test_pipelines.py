"""Files in, tables out; the runner; streams."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from titleforge.__main__ import main
from titleforge.functions import control
from titleforge.operators import state
from titleforge.plans import inputs, pipelines, runner
from titleforge.sources import readers, sinks
from titleforge.streaming import replay


def write(path, content, encoding="utf-8"):
    path.write_text(content, encoding=encoding, newline="")
    return str(path)


def test_labelled_csv(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'title,label,extra\n"x, ""y""",Yes,1\n　z\\ ,No,2\n', "utf-8-sig")
    rows = readers.labelled_csv(spark, path, "core_all").orderBy("ordinal").collect()
    assert [(r.id, r.title, r.gold_label) for r in rows] == [("core_all-0001", 'x, "y"', "Yes"), ("core_all-0002", "z\\", "No")]
    for bad in ("title\nx\n", "title,label\n ,Yes\n", "title,label\nx,yes\n", "title,label\n,No\n"):
        with pytest.raises(ValueError):
            readers.labelled_csv(spark, write(tmp_path / "b.csv", bad), "s")
    compat = readers.labelled_csv(spark, write(tmp_path / "c.csv", "title,label\n,No\n"), "s", pandas_compat=True)
    assert compat.first().title == "nan"


def test_jsonl(spark, tmp_path):
    good = json.dumps({"model_name": "m", "title": "a b", "status": "success"}, ensure_ascii=False)
    log, tail = readers.jsonl(spark, write(tmp_path / "a.jsonl", good + "\n\n" + good + '\n{"model'))
    assert [(r.line_no, r.title) for r in log.collect()] == [(1, "a b"), (3, "a b")]
    assert sinks.quarantine(tail, str(tmp_path / "a.jsonl")) == 1
    with pytest.raises(ValueError):
        readers.jsonl(spark, write(tmp_path / "b.jsonl", '{"model\n' + good + "\n"))
    log, tail = readers.jsonl(spark, write(tmp_path / "c.jsonl", good))
    assert log.count() == 1 and tail.count() == 0


def test_model_configs(tmp_path):
    nested = [{"provider": "siliconflow", "base_url": "u", "model": [{"name": "a", "full_name": "x/glm-5.2"}, {"name": "b", "thinking_profiles": ["p"]}]}]
    got = readers.model_configs(nested)
    assert [(c["name"], c["model"], c["thinking_profiles"]) for c in got] == [("a", "x/glm-5.2", ["thinking_object", "siliconflow_enable"]), ("b", "b", ["p"])]
    flat = write(tmp_path / "m.json", json.dumps({"models": [{"model": "z", "provider": "deepseek"}]}), "utf-8-sig")
    assert readers.model_configs(flat)[0]["thinking_profiles"] == ["deepseek_thinking"]
    for bad in ((nested, "nosuch"), (nested + nested, "")):
        with pytest.raises(ValueError):
            readers.model_configs(*bad)


def test_environment():
    assert readers.environment_configs({"LLM_MODEL_NAME": "m"})[0]["base_url"] == "https://api.openai.com/v1"
    assert readers.environment_configs({}, dry_run=True)[0]["name"] == "example-model"
    assert [c["name"] for c in readers.environment_configs({"LLM_MODELS_JSON": '[{"model": "a"}, {"model": "b"}]'})] == ["a", "b"]
    with pytest.raises(ValueError):
        readers.environment_configs({})
    assert readers.api_key({"api_key": " k "}, {}) == "k" and readers.api_key({"api_key_env": "V"}, {"V": "x"}) == "x"
    with pytest.raises(ValueError):
        readers.api_key({"name": "m"}, {})


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "中"), (2, None)], "a int, b string")
    sinks.write_tables({"t": df, "none": df.limit(0)}, tmp_path)
    assert (tmp_path / "t.csv").read_bytes().startswith(b"\xef\xbb\xbf") and not (tmp_path / "none.csv").exists()
    sinks.mark_complete(tmp_path / "m.json", "s")
    assert sinks.is_current(tmp_path / "m.json", "s", (tmp_path / "t.csv",)) and not sinks.is_current(tmp_path / "m.json", "x") and not sinks.is_current(tmp_path / "no.json", "s")
    sinks.append_jsonl(df, str(tmp_path / "log"))
    sinks.append_jsonl(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    assert readers.local_digest(tmp_path / "m.json") == readers.file_digest(spark, str(tmp_path / "m.json")).first().sha256


def fake(requests: pd.DataFrame) -> pd.DataFrame:
    """Answers by title: a title with `long` is cut off below 8192 tokens, `down` fails, others succeed."""
    cut = requests["title"].str.contains("long") & (requests["token_budget"] < 8192)
    down = requests["title"].str.contains("down")
    return pd.DataFrame({
        "raw_response": ['{"label":"Yes","confidence":0.9}'] * len(requests), "finish_reason": ["length" if c else "stop" for c in cut], "completion_tokens": 10,
        "http_status": [503 if d else None for d in down], "error": ["down" if d else None for d in down],
    })


LOG = "line_no long, condition_signature string, token_plan_signature string, model_name string, subset string, id string, title string, gold_label string, token_budget long, token_stage_index long, status string, pred_label string, confidence double, format_valid boolean"


@pytest.mark.parametrize("item_local", [False, True])
def test_runner(spark, tmp_path, item_local):
    titles = spark.createDataFrame([("s", "1", "plain", "Yes"), ("s", "2", "long one", "No")], "subset string, id string, title string, gold_label string")
    models = spark.createDataFrame([("a", ["thinking_object"]), ("b", None)], "model_name string, thinking_profiles array<string>")
    signatures = models.select("model_name", F.lit("sig").alias("condition_signature"))
    options = dict(signatures=signatures, plan="p", stages=(4096, 8192), item_local=item_local, wait=lambda seconds: None)
    log, outcome = runner.run_stages(titles, models, spark.createDataFrame([], LOG), fake, attempts_path=str(tmp_path / "attempts"), **options)
    assert outcome == "complete"
    rows = log.collect()
    assert sorted((r.id, r.token_stage_index, r.status) for r in rows) == sorted([("1", 0, "success"), ("2", 0, "token_limit"), ("2", 1, "success")] * 2)
    # bought responses stay in the log, whole
    assert all(r.raw_response == '{"label":"Yes","confidence":0.9}' and r.completion_tokens == 10 and r.thinking_profile == "thinking_object" and r.api_attempts == 1 and r.timestamp for r in rows)
    assert {(r.finish_reason, r.error_kind) for r in rows} == {("stop", ""), ("length", "token_limit")}
    assert spark.read.json(str(tmp_path / "attempts")).groupBy("attempt_status").count().collect() and len(rows) == spark.read.json(str(tmp_path / "attempts")).count()
    again, outcome = runner.run_stages(titles, models, log, fake, **options)
    assert outcome == "complete" and again.count() == log.count()
    more = titles.unionByName(spark.createDataFrame([("s", "3", "down", "No")], titles.schema))
    failed, outcome = runner.run_stages(more, models, log, fake, **options)
    assert outcome == "transient" and {(r.error, r.http_status, r.api_attempts) for r in failed.where("id = '3'").collect()} == {("down", 503, 3)}
    assert {r.model_name: r.failed for r in state.worker_counters(failed).collect()} == {"a": True, "b": True}
    assert runner.run_stages(more, models, log, fake, seconds=1e-9, **options)[1] == "time"


def test_ask_goes_on_as_errors_tell():
    """Errors that pass and unusable responses are tried again, a rejected profile gives way, others end it."""
    calls = []

    def scorer(requests):
        calls.append(list(zip(requests["title"], requests["thinking_profile"])))
        turn = len(calls)
        out = []
        for title, profile in calls[-1]:
            answer = {"raw_response": '{"label":"No","confidence":1}', "finish_reason": "stop", "retry_after": 7}
            if title == "flaky" and turn == 1:
                answer = {"error": "busy", "http_status": 503, "retry_after": 7}
            elif title == "odd" and turn < 3:
                answer["raw_response"] = "well"
            elif title == "syntax" and profile == "p":
                answer = {"error": "bad request", "http_status": 400}
            elif title == "broke":
                answer = {"error": "Insufficient Balance", "http_status": 400}
            elif title == "gone":
                answer = {"error": "no such model", "http_status": 404}
            elif title == "never":
                answer["raw_response"] = ""
            elif title == "cut":
                answer |= {"finish_reason": "", "completion_tokens": 100}
            out.append(answer)
        return pd.DataFrame(out, columns=["raw_response", "finish_reason", "error", "http_status", "retry_after", "completion_tokens"])

    waits = []
    titles = ["flaky", "odd", "syntax", "broke", "gone", "never", "cut"]
    got = runner.ask(pd.DataFrame({"title": titles, "token_budget": 100}), scorer, [["p", "q"]] * len(titles), wait=waits.append)
    assert [(g["status"], g["thinking_profile"], g["api_attempts"]) for g in got] == [("success", "p", 2), ("success", "p", 3), ("success", "q", 2), ("balance_exhausted", "p", 1), ("permanent_failure", "p", 1), ("transient_failure", "q", 6), ("token_limit", "p", 1)]
    assert waits[0] == 7 and [len(g["attempts"]) for g in got] == [2, 3, 2, 1, 1, 6, 1] and got[5]["error_kind"] == "invalid_response"


def test_signatures(spark):
    titles = [("s", "2", 'b"é', "No"), ("s", "1", "a", "Yes")]
    schema = "subset string, id string, title string, gold_label string"
    one, two = (control.evaluation_signature(spark.createDataFrame(x, schema).repartition(2)) for x in (titles, titles[::-1]))
    assert one == two != control.evaluation_signature(spark.createDataFrame(titles[:1], schema))
    row = spark.createDataFrame(titles[:1], schema).select(control.row_hash("subset", "id", "title", "gold_label")).first()[0]
    assert row == control.stable_hash(dict(subset="s", id="2", title='b"é', gold_label="No"))
    configs = readers.model_configs([{"provider": "x", "base_url": "u", "model": [{"name": "a"}], "extra_body": {"k": 1}}])
    assert configs[0]["extra_body"] == {"k": 1}
    policy = control.request_policy(stages=(1, 2))
    signed = control.condition_signatures(configs, "prompt", policy)
    assert signed != control.condition_signatures(configs, "prompt!", policy) and signed != control.condition_signatures(configs, "prompt", control.request_policy(stages=(1, 3)))
    assert control.policy_signature(signed, (1, 2)) != control.policy_signature(signed, (1, 2), geometric=True)
    assert control.profiles_of("siliconflow", "x/Kimi-K2.6", "") == ["siliconflow_enable", "thinking_object"]


def test_request_body(spark):
    from titleforge.functions import text

    df = spark.createDataFrame([("m", "max_completion_tokens", "siliconflow_enable", None), ("m", "max_tokens", "thinking_object", '{"k":[1,"x"],"thinking":0}')], "model string, p string, profile string, extra string")
    body = control.request_body(F.col("model"), text.messages(F.lit("s"), F.lit('u"')), F.col("p"), F.lit(5), F.col("profile"), extra=F.col("extra"))
    first, second = (json.loads(r[0]) for r in df.select(body).collect())
    assert first["max_completion_tokens"] == 5 and "max_tokens" not in first and first["stream_options"] == {"include_usage": True} and first["messages"][1]["content"] == 'u"'
    assert first["extra_body"] == {"enable_thinking": True, "thinking_budget": 1024} and second["extra_body"] == {"k": [1, "x"], "thinking": {"type": "enabled"}}
    with pytest.raises(Exception, match="unknown thinking profile"):
        spark.createDataFrame([("m", "p", "nosuch", None)], df.schema).select(body).collect()


def test_log_tables_and_preview(spark, data):
    log, titles = inputs.log(spark, data), inputs.benchmark(spark, data)
    signatures = state.current_signatures(log)
    got = {k: v.count() for k, v in pipelines.log_tables(log, titles, signatures, rounds=50).items()}
    assert got["llm_predictions"] > 100 and got["llm_metrics"] > 10
    seen = pipelines.preview(log, titles, inputs.models(spark, data), signatures).first()
    assert seen.completed == got["llm_predictions"] and seen.remaining == seen.expected - seen.completed and seen.titles == titles.count()


def test_large_tables_are_written_in_parts(spark, tmp_path):
    sinks.write_tables({"t": spark.range(50)}, tmp_path, most_rows=10)
    assert (tmp_path / "t.csv").is_dir() and spark.read.option("header", True).csv(str(tmp_path / "t.csv")).count() == 50


def test_command_line(spark, tmp_path, capsys):
    core = write(tmp_path / "core.csv", "title,label\n" + "".join(f"{'秘方根治' if i % 2 else '天气新闻'}{i},{'Yes' if i % 2 else 'No'}\n" for i in range(40)))
    args = ["classify", "--core", core, "--output", str(tmp_path / "out"), "--dev", "8", "--test", "8", "--rounds", "20", "--families", "char_tfidf_complement_nb", "--save-models"]
    assert main(args) == 0 and "keyword_rule" in capsys.readouterr().out
    table = pd.read_csv(tmp_path / "out/ml_metrics.csv")
    assert set(table.model_name) == {"keyword_rule", "char_tfidf_complement_nb"}
    before = (tmp_path / "out/complete.json").stat().st_mtime_ns
    main(args)
    assert (tmp_path / "out/complete.json").stat().st_mtime_ns == before
    (tmp_path / "out/ml_predictions.csv").unlink()  # an output is gone: the run is not complete
    main(args)
    assert (tmp_path / "out/complete.json").stat().st_mtime_ns != before and (tmp_path / "out/ml_predictions.csv").exists()


def test_run_command(spark, tmp_path, capsys):
    core = write(tmp_path / "core.csv", "title,label\nplain,Yes\nlong one,No\nother,No\n")
    write(tmp_path / "prompt.txt", "Judge.")
    write(tmp_path / "models.json", json.dumps([{"provider": "x", "base_url": "u", "model": [{"name": "a"}, {"name": "b"}]}]))
    base = ["--core", core, "--log", str(tmp_path / "log"), "--output", str(tmp_path / "out"), "--models", str(tmp_path / "models.json"), "--prompt", str(tmp_path / "prompt.txt"), "--rounds", "20"]
    assert main(["run", *base, "--dry-run"]) == 0
    assert json.loads(capsys.readouterr().out)["remaining"] == 6 and not (tmp_path / "log").exists()
    run = ["run", *base, "--scorer", "test_pipelines:fake"]
    assert main(run) == 0
    progress = json.loads((tmp_path / "out/progress.json").read_text())
    assert progress["status"] == "complete" and progress["completed"] == 6 and progress["counters"]["a"]["token_limits"] == 1 and progress["failed_models"] == []
    assert pd.read_csv(tmp_path / "out/llm_metrics.csv").n.tolist() == [3, 3]
    lines = spark.read.json(str(tmp_path / "log")).count()
    assert main(run) == 0 and spark.read.json(str(tmp_path / "log")).count() == lines  # nothing is asked twice
    assert main(["metrics", *base]) == 0
    write(tmp_path / "prompt.txt", "Judge anew.")  # another prompt: the old answers count no more
    assert main(["run", *base, "--dry-run"]) == 0 and '"completed": 0' in capsys.readouterr().out
    sinks.mark_balance(tmp_path / "out/balance_stop.json", {"error": "x"})
    assert main(run) == 42
    assert not sinks.stopped_for_balance(tmp_path / "out/balance_stop.json", resume=True)


def test_fold_and_checkpoints(spark):
    rows = [("r", i, "x" * n, "", f) for i, (n, f) in enumerate([(60, ""), (10, ""), (30, ""), (40, ""), (1, "stop"), (0, "")])]
    df = spark.createDataFrame(rows, "request string, seq long, content_delta string, reasoning_delta string, finish_reason string").repartition(3)
    got = replay.fold_deltas(df).first()
    assert (len(got.content), got.finish_reason, got.chunks) == (141, "stop", 6)
    used = df.withColumn("usage", F.when(F.col("seq") < 5, F.struct(F.lit(1).alias("prompt_tokens"), F.col("seq").alias("completion_tokens"), F.lit(None).cast("int").alias("reasoning_tokens"), F.lit(None).cast("int").alias("total_tokens"))))
    last = replay.fold_deltas(used).first()
    assert (last.prompt_tokens, last.completion_tokens, last.reasoning_tokens, last.total_tokens, last.content) == (1, 4, 0, 5, got.content)
    assert sorted((r.seq, r.length) for r in replay.content_checkpoints(df).collect()) == [(1, 70), (3, 140)]


def test_stream_resumes(spark, tmp_path):
    """Files that come in turns, with a torn tail and in another order, give the state of the whole log."""
    seen = []
    folder = tmp_path / "log"
    folder.mkdir()
    for turn in range(2):
        write(folder / f"{turn}.jsonl", "".join(json.dumps({"model_name": "m", "id": str(i), "status": "success"}) + "\n" for i in range(turn * 3, turn * 3 + 3)) + '{"torn')
        stream = replay.stream_jsonl(spark, str(folder), "model_name string, id string, status string")
        replay.replay(stream, lambda batch, n: seen.extend(r.id for r in batch.collect()), checkpoint=str(tmp_path / "checkpoint"))
    assert sorted(seen) == [str(i) for i in range(6)]


def test_stream_equals_batch(spark, data):
    from titleforge.plans import catalog

    a, b = (sorted(map(tuple, catalog.QUERIES[n](spark, data).select(*state.KEY, "line_no", "pred_label").collect())) for n in ("latest_success", "stream_latest_success"))
    assert a == b and a
