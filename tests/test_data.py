import functools
import json
import random

import pytest
from pyspark.sql import functions as F

from sparkward.operators import compare, dataset, diversity, trainlog
from sparkward.sources import contracts, json_tables, sinks
from sparkward.streaming import early_stop


def test_plan_adds_up(spark):
    for total in (1, 7, 2200):
        plan = dataset.bucket_plan(spark, total)
        assert plan.count() == 42 and plan.agg(F.sum("n")).first()[0] == total
    assert dataset.split_sizes(25, 0.1) == (23, 2) and dataset.split_sizes(2, 0.9) == (1, 1)


@pytest.mark.parametrize("k", [0, 1, 5, 37, 100])
def test_smallest_is_exact_for_any_partitioning(spark, k):
    rows = spark.range(100).withColumn("h", dataset.draw(1, F.col("id")))
    expected = {r["id"] for r in rows.orderBy("h").limit(k).collect()}
    for n in (1, 7):
        assert {r["id"] for r in dataset.smallest(rows.repartition(n), "h", k).where("chosen").collect()} == expected


def test_merge_keeps_first(spark):
    schema = "id string, instruction string, input string, expected_vulnerable boolean, ord int"
    a = spark.createDataFrame([("1", "a", "", True, 0), ("1", "b", "", False, 1), (None, "c", "x", True, 2)], schema)
    b = spark.createDataFrame([("1", "z", "", True, 0), (None, "c", "x", False, 1), ("c", "q", "", False, 2)], schema)
    kept, told = dataset.merge_splits([a, b])
    assert sorted(r["instruction"] for r in kept.collect()) == ["a", "c", "q"]
    assert sorted(tuple(r) for r in told.collect()) == [(0, 2, 1, 2, 0), (1, 1, 2, 0, 1)]


def test_split_and_tiers(spark):
    rows = spark.range(50)
    split = dataset.train_val_split(rows, F.col("id"), 0.12)
    assert split.groupBy("split").count().orderBy("split").collect()[1]["count"] == 6
    tiers = rows.select("id", F.when(F.col("id") < 2, "easy").otherwise("hard").alias("tier"))
    got = dataset.tier_sample(tiers, "tier", [F.col("id")], 10)
    assert got.count() == 10 and got.where("tier = 'easy'").count() == 2


def test_records(spark):
    rows = spark.createDataFrame([(None, " ", "say", True)], "id string, input string, instruction string, expected_vulnerable boolean")
    r = dataset.research_record(rows, with_output=False).first()
    assert r["id"].startswith("sqlsec-") and r["input_code"] is None and (r["task_type"], r["difficulty"], r["vulnerability_type"]) == ("generation", "medium", "unknown")
    assert dataset.synthetic_rows(spark, 20).distinct().count() == 20


def test_degenerate_models(spark):
    rows = spark.createDataFrame([(m, i, v) for m, vs in {"a": [1, 0, 1], "b": [1, 0, 1], "c": [0, 1, 1], "d": []}.items() for i, v in enumerate(vs)], "model string, i int, v int")
    assert [(r["model"], r["same_as"]) for r in compare.degenerate(rows, "model", ["i"], ["v"], F.col("model")).collect()] == [("b", "a")]


def test_uniqueness_and_compliance_of_empty(spark):
    none = spark.createDataFrame([], "t string, i int")
    assert diversity.uniqueness(none, F.col("t"), F.col("i")).first()[:2] == (0, 0)
    assert diversity.compliance(none, F.col("t"), F.lit(True), F.array()).first()["parse_pass_pct"] == 100.0


def fold_by_hand(losses, patience, delta):
    best, at, bad = float("inf"), None, 0
    for step, x in enumerate(losses, 1):
        if x < best - delta:
            best, at, bad = x, step, 0
        else:
            bad += 1
        if bad >= patience:
            return best, at, step
    return best, at, None


def test_early_stop_batch_and_stream_agree(spark, tmp_path):
    runs = {1: [5, 4, 4, 4, 4, 4, 4, 1], 2: [1.0, 0.99995, 0.9999, 0.99985, 0.9, 0.8], 3: [3.0], 4: [2, 2, 2, 2, 2, 2]}
    rows = [(r, i, float(x)) for r, xs in runs.items() for i, x in enumerate(xs, 1)]
    log = spark.createDataFrame(rows, "run_id long, step long, val_loss double")
    got = {r["run_id"]: (r["best_loss"], r["best_step"], r["stopped_at"]) for r in trainlog.early_stop(log).collect()}
    assert got == {r: fold_by_hand(xs, 5, 1e-4) for r, xs in runs.items()}


def pieces(spark, tmp_path, log, cuts):
    """Write the rows of a log in pieces, one after the other, and give their folder."""
    for low, high in zip(cuts, cuts[1:], strict=False):
        log.where(f"step > {low} and step <= {high}").repartition(2, "run_id").write.mode("append").parquet(str(tmp_path / "log"))
        yield str(tmp_path / "log")


def timed(spark, rows, columns):
    log = spark.createDataFrame(rows, f"run_id long, step long, {columns}")
    return log.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("step") * 3600))


def test_early_stop_stream_goes_on_after_a_restart(spark, tmp_path):
    runs = {1: [5, 4, 4, 4, 4, 4, 4, 1], 2: [1.0, 0.99995, 0.9999, 0.99985, 0.9, 0.8], 3: [3.0], 4: [2, 2, 2, 2, 2, 2], 5: [None, 2.0, None, 1.0]}
    log = timed(spark, [(r, i, None if x is None else float(x)) for r, xs in runs.items() for i, x in enumerate(xs, 1)], "val_loss double")
    for folder in pieces(spark, tmp_path, log, [0, 2, 5, 9]):  # each piece is a query of its own over the same checkpoint
        rows = early_stop.run_available(spark, folder, log.schema, early_stop.early_stop_stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    want = sorted(map(tuple, trainlog.early_stop(log).collect()))
    assert sorted(map(tuple, early_stop.last_states(rows).collect())) == want
    # the last file again: nothing new is read, nothing changes
    rows = early_stop.run_available(spark, folder, log.schema, early_stop.early_stop_stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    assert sorted(map(tuple, early_stop.last_states(rows).collect())) == want


def test_idle_runs_are_closed_and_late_rows_dropped(spark, tmp_path):
    stream = functools.partial(early_stop.early_stop_stream, idle="10 hours", late="2 hours")
    steps = [[(1, 1, 3.0), (2, 1, 5.0)], [(1, 40, 2.0)], [(1, 41, 1.5), (2, 2, 4.0)], [(1, 60, 1.0)]]
    for piece in steps:
        log = timed(spark, piece, "val_loss double")
        log.coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        rows = early_stop.run_available(spark, str(tmp_path / "log"), log.schema, stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    told = [tuple(r) for r in rows.where("run_id = 2").collect()]
    assert sorted(t[-1] for t in told) == [False, True]  # closed; its second row is later than the watermark
    assert {r["run_id"]: (r["evals"], r["best_loss"]) for r in early_stop.last_states(rows).collect()}[2] == (1, 5.0)


def test_collapse_stream_tells_a_run_once(spark, tmp_path):
    values = {1: [(5.0, 0.0, 10.0), (5.0, -3000.0, 10.0), (1.0, 0.0, 0.0)], 2: [(9.0, 0.0, 9.0)] * 4 + [(None, None, 1.0)], 3: [(9.0, 0.0, 9.0)] * 3, 4: [(1.0, 0.0, 9.0)] * 6}
    log = timed(spark, [(r, i, *x) for r, xs in values.items() for i, x in enumerate(xs, 1)], "entropy double, logps double, logits double")
    for folder in pieces(spark, tmp_path, log, [0, 2, 4, 9]):
        rows = early_stop.run_available(spark, folder, log.schema, early_stop.collapse_stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, trainlog.collapse_guard(log).collect())) == [(1, 2, "logps"), (2, 5, "logits"), (4, 1, "entropy")]


def test_late_steps_are_ignored():
    state = early_stop.fold((3, 2.5, 1, 0, None, 5), [(4, 1.0), (6, 2.0), (7, None)])
    assert state == (4, 2.0, 6, 0, None, 6)


def test_collapse_and_streaks(spark):
    log = spark.createDataFrame([(1, 1, 5.0, 0.0, 10.0), (1, 2, 5.0, -3000.0, 10.0), (1, 3, 1.0, 0.0, 0.0), (2, 1, None, None, 1.0)], "run_id int, step int, entropy double, logps double, logits double")
    assert sorted(tuple(r) for r in trainlog.collapse_guard(log).collect()) == [(1, 2, "logps"), (2, 1, "logits")]
    steps = spark.createDataFrame([(1, i, v, t) for i, (v, t) in enumerate([(1.0, 0.4), (1.0, None), (0.0, None), (1.0, 0.2), (1.0, 0.9), (1.0, 0.1)])], "run_id int, step int, val_loss double, train_loss double")
    got = trainlog.overfit_streaks(trainlog.with_last_train_loss(steps)).orderBy("step").collect()
    assert [r["streak"] for r in got] == [1, 2, 2, 3, 0, 1] and got[3]["status"] == "severe"
    assert trainlog.nan_rows(spark.createDataFrame([(float("nan"),), (1.0,), (None,)], "x double"), "x").count() == 1


def test_json_sources(spark, tmp_path):
    records = [{"id": "1", "expected_vulnerable": True}, {"id": "2", "expected_vulnerable": "true"}, {"id": "3", "expected_vulnerable": 1}, {"id": "4", "expected_vulnerable": None}, {"id": "5"}]
    (tmp_path / "a.json").write_text("﻿" + json.dumps(records), encoding="utf-8")
    (tmp_path / "b.jsonl").write_text("﻿" + "\n\n".join(map(json.dumps, records)), encoding="utf-8")
    for name in ("a.json", "b.jsonl"):
        rows = json_tables.load_rows(spark, str(tmp_path / name))
        kinds = [r[0] for r in rows.orderBy("ord").select(contracts.token_type(F.col("value"), "expected_vulnerable")).collect()]
        assert kinds == ["BOOLEAN", "STRING", "BIGINT", "VOID", None]
        assert rows.where(contracts.strict_boolean(F.col("value"), "expected_vulnerable")).count() == 1
        assert [r["id"] for r in json_tables.fields(rows, {"id": "string"}).orderBy("ord").collect()] == ["1", "2", "3", "4", "5"]
    with pytest.raises(contracts.ContractError):
        json_tables.load_array(spark, str(tmp_path / "b.jsonl"))
    (tmp_path / "empty").write_text("\n")
    with pytest.raises(contracts.ContractError):
        json_tables.load_rows(spark, str(tmp_path / "empty"))
    (tmp_path / "bad.jsonl").write_text('{"id": "1"}\nnot json')
    assert json_tables.bad_rows(json_tables.load_rows(spark, str(tmp_path / "bad.jsonl"))).count() == 1


def test_ordinals_over_files_and_blocks(spark, tmp_path):
    """Numbers follow files, blocks and lines, whatever the size of a block."""
    lines = [[json.dumps({"k": f"{f}-{i}", "pad": "x" * (i * 7 % 90)}) for i in range(n)] for f, n in enumerate((40, 0, 1, 300))]
    (tmp_path / "many").mkdir()
    for f, part in enumerate(lines):
        (tmp_path / "many" / f"part-{f}.json").write_text("\n\n".join(part) + "\n" * (f % 2), encoding="utf-8")
    (tmp_path / "more.jsonl").write_text("\n".join(lines[0]), encoding="utf-8")
    want = [json.loads(x)["k"] for part in [*lines, lines[0]] for x in part]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("1000", "7777", old):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = json_tables.fields(json_tables.load_rows(spark, str(tmp_path / "many"), str(tmp_path / "more.jsonl")), {"k": "string"}).orderBy("ord").collect()
            assert [r["ord"] for r in rows] == list(range(len(want))) and [r["k"] for r in rows] == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize("text", ['[1, 2, 3]', '[\n1\n,2\n,3\n]', '[\n1,\n2,\n3\n]\n', '[\n 1,\n\n 2,\n 3\n]', '[\n1,\n2, 3\n]', ' [1,\n2,\n3]'])
def test_arrays_by_lines_or_as_a_whole(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    rows = json_tables.load_array(spark, str(tmp_path / "a.json"))
    assert sorted(rows.select("ord", F.variant_get("value", "$", "int")).collect()) == [(0, 1), (1, 2), (2, 3)]


@pytest.mark.parametrize("text", ["[\n1\n2\n]", "[\n,1\n,2\n]", "[\n1,\n2,\n]", "[\n1,\n2", '[\n{"a": \n]'])
def test_broken_arrays(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(contracts.ContractError):
        json_tables.load_rows(spark, str(tmp_path / "a.json")).count()


def test_arrays_of_many_files(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.json").write_text(json.dumps([10 * i, 10 * i + 1]))
    rows = json_tables.load_rows(spark, str(tmp_path)).orderBy("ord").select("ord", F.variant_get("value", "$", "int")).collect()
    assert [tuple(r) for r in rows] == list(enumerate([0, 1, 10, 11, 20, 21]))
    empty = spark.range(0).select(F.col("id").alias("k"))
    sinks.write_array(empty, str(tmp_path / "none"), "k")
    assert json_tables.load_array(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(contracts.ContractError):
        sinks.write_array(spark.createDataFrame([(1,), (1,), (2,)], "k int"), str(tmp_path / "twice"), "k")


def test_legacy_sections_and_overlay(spark):
    rows = spark.createDataFrame([("### Instruction:\nA\n### Input:\nB\n### Response:\nC",), ("plain",)], "prompt string")
    assert [r[1:] for r in json_tables.legacy_sections(rows).collect()] == [("A", "B", "C"), ("plain", "", "")]
    assert json_tables.deep_merge({"a": {"b": 1, "c": 2}, "d": 3}, {"a": {"b": 9}, "d": {"e": 1}}) == {"a": {"b": 9, "c": 2}, "d": {"e": 1}}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("1", "fix", "say", "string_concat", "easy", True), ("2", "generation", "say", "fstring", "hard", False)], "id string, task_type string, instruction string, vulnerability_type string, difficulty string, expected_vulnerable boolean")
    sinks.write_splits(rows, str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).where("task_type = 'fix'").count() == 1
    assert sinks.write_checked(spark, rows, str(tmp_path / "c")).count() == 2
    with pytest.raises(contracts.ContractError):
        sinks.write_splits(rows.withColumn("id", F.lit(" ")), str(tmp_path / "t"))
    sinks.write_array(rows, str(tmp_path / "a"), "id")
    assert [x["id"] for x in json.loads("".join(r[0] for r in spark.read.text(str(tmp_path / "a"), wholetext=True).collect()))] == ["1", "2"]
    sinks.write_rejects(rows, "expected_vulnerable", "id", str(tmp_path / "r"), 20)
    assert spark.read.json(str(tmp_path / "r")).count() == 1
    assert sinks.text_table(spark.createDataFrame([("m", 0.5, None)], "m string, a double, b double"), "m", ["a", "b"], "m") == ["m" + " " * 19 + "     50.0%" + "       N/A"]
    sinks.write_result({"model": "m"}, spark.createDataFrame([(1, 1, 0, 0.0, 0.0)], "n_samples int, n_valid int, n_invalid int, extraction_failure_rate double, sql_injection_rate_valid double"), rows, str(tmp_path / "d"))
    keys = ("n_samples", "n_valid", "n_invalid")
    told = json_tables.load_results(spark, str(tmp_path / "d/document"), required=keys)
    assert told.select(F.try_variant_get("doc", "$.meta.model", "string")).first()[0] == "m" and spark.read.json(str(tmp_path / "d/per_sample")).count() == 2
    with pytest.raises(contracts.ContractError, match="safe_rate_valid"):
        json_tables.load_results(spark, str(tmp_path / "d/document"))
    assert json_tables.load_results(spark, str(tmp_path / "d/document"), str(tmp_path / "none"), tolerant=True).count() == 0
    sinks.write_training(rows, rows, rows.select("id"), str(tmp_path / "w"), "id")
    assert spark.read.json(str(tmp_path / "w/pairs")).count() == 2 and json_tables.load_array(spark, str(tmp_path / "w/eval")).count() == 2


def test_preferences_and_markers(spark, tmp_path):
    good = {"prompt": "p", "chosen": "c", "rejected": "r", "expected_vulnerable": True, "dpo_difficulty_tier": "hard"}
    (tmp_path / "p.jsonl").write_text(json.dumps(good) + "\n\n" + json.dumps({**good, "attack_type": "fstring"}))
    got = json_tables.load_preferences(spark, str(tmp_path / "p.jsonl"))
    assert len(got.columns) == 10 and "dpo_difficulty_tier" not in got.columns and sorted(r["attack_type"] or "" for r in got.collect()) == ["", "fstring"]
    (tmp_path / "bad.jsonl").write_text(json.dumps({"prompt": "p"}))
    with pytest.raises(contracts.ContractError, match="chosen"):
        json_tables.load_preferences(spark, str(tmp_path / "bad.jsonl"))
    run = tmp_path / "run"
    (run / "best").mkdir(parents=True)
    assert json_tables.best_checkpoint(str(run)) == (str(run), None)
    (run / "best_checkpoint.json").write_text(json.dumps({"output_dir": str(run / "best"), "best_step": 3}))
    assert json_tables.best_checkpoint(str(run)) == (str(run), None)  # empty
    (run / "best" / "x").write_text("")
    assert json_tables.best_checkpoint(str(run))[0] == str(run / "best") and json_tables.best_checkpoint(str(run))[1]["best_step"] == 3
    (run / "best_checkpoint.json").write_text("{")
    assert json_tables.best_checkpoint(str(run)) == (str(run), None)


def test_yaml_overlay(tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "a.yaml").write_text("train:\n  steps: 5\n  rate: 0.1\nname: base\n")
    (tmp_path / "b.yaml").write_text("train:\n  steps: 9\n")
    assert json_tables.load_config(str(tmp_path / "a.yaml"), str(tmp_path / "b.yaml")) == {"train": {"steps": 9, "rate": 0.1}, "name": "base"}


def test_log_files(tmp_path):
    import logging

    from sparkward import logs

    path = logs.file_logging(str(tmp_path / "logs"), "try")
    logging.getLogger("x").info("said")
    logging.getLogger().handlers[-1].close()
    logging.getLogger().removeHandler(logging.getLogger().handlers[-1])
    assert path.name.startswith("try_") and "INFO [x] said" in path.read_text()


def test_unused_keeps_the_first(spark):
    rows = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (5, "c")], "id int, k string")
    assert {r["id"] for r in dataset.unused(rows, spark.createDataFrame([("b",), ("b",)], "k string"), "k", "id").collect()} == {1, 5}


def test_plans_and_recomputed(spark):
    models = spark.createDataFrame([("baseline",), ("qlora_dpo",)], "model string")
    assert {tuple(r) for r in compare.run_plan(models).collect()} == {("baseline", None, False, "baseline_results"), ("qlora_dpo", "qlora_dpo_dir", True, "qlora_dpo_results")}
    with pytest.raises(Exception, match="unknown model"):
        compare.run_plan(spark.createDataFrame([("x",)], "model string")).collect()
    assert compare.without(models, "model", ("baseline",)).count() == 1 and compare.without(models, "model", ()).count() == 2
    with pytest.raises(Exception, match="expected_vulnerable"):
        dataset.normalised_rows(spark.createDataFrame([(None,)], "expected_vulnerable boolean")).collect()


SAMPLE = "id string, task_type string, instruction string, vulnerability_type string, difficulty string, expected_vulnerable boolean"


def test_checked_write_is_one_pass_and_all_or_nothing(spark, tmp_path):
    good = [(str(i), "fix", "say", "fstring", "easy", True) for i in range(30)]
    rows, path = spark.createDataFrame(good, SAMPLE), str(tmp_path / "out")
    scans = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            scans.add(b.num_rows)
            yield b

    once = rows.mapInArrow(counted, rows.schema)
    assert sinks.publish(once, path, contracts.sample_rules(rows), "test") == 30 and scans.value == 30
    bad = spark.createDataFrame([*good[:9], (" ", "fix", "say", "fstring", "easy", None)], SAMPLE)
    with pytest.raises(contracts.ContractError, match="id: blank"):
        sinks.write_checked(spark, bad, path)
    assert spark.read.json(path).count() == 30 and [p.name for p in tmp_path.iterdir()] == ["out"]
    with pytest.raises(contracts.ContractError):
        sinks.write_splits(bad, str(tmp_path / "none"))
    assert [p.name for p in tmp_path.iterdir()] == ["out"]
    assert sinks.publish(rows.limit(0), path, contracts.sample_rules(rows), "test") == 0
    assert sinks.publish(rows, path, contracts.sample_rules(rows), "test", by=("task_type",)) == 30 and (tmp_path / "out/task_type=fix").exists()


def test_a_replayed_batch_leaves_the_log_equal(spark, tmp_path):
    for i in range(3):
        spark.range(10 * i, 10 * i + 10).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 3).parquet(str(tmp_path / "in"))
    log, check = str(tmp_path / "log"), tmp_path / "check"
    sinks.log_stream(stream, log, str(check), "id % 2 = 0").awaitTermination()
    read = lambda: sorted(r["id"] for r in spark.read.schema("id long").json(f"{log}/batch=*").collect())
    assert read() == list(range(0, 30, 2))
    last = max((check / "commits").iterdir(), key=lambda p: int(p.name) if p.name.isdigit() else -1)
    for f in (last, check / "commits" / f".{last.name}.crc"):  # as if the query had died before it noted the batch
        f.unlink(missing_ok=True)
    sinks.log_stream(stream, log, str(check), "id % 2 = 0").awaitTermination()
    assert read() == list(range(0, 30, 2))


@pytest.mark.parametrize("counts", [[50, 30, 30, 1], [1] * 60, [2] * 50, [90] + [1] * 80, [3, 3, 2], []])
def test_top_texts_are_exact(spark, monkeypatch, counts):
    """With and without frequent texts, with ties at the last place, and with a sketch that is far too small."""
    rows = [(f"t{i}", k * 1000 + i) for i, n in enumerate(counts) for k in range(n)]
    df = spark.createDataFrame(rows, "t string, o long").repartition(5)
    want = sorted(((f"t{i}", n, i) for i, n in enumerate(counts)), key=lambda r: (-r[1], r[2]))
    monkeypatch.setattr(diversity, "SPARE", 4)
    for tracked in (10_000, 8):
        monkeypatch.setattr(diversity, "TRACKED", tracked)
        for k in (1, 2, 3):
            got = sorted(map(tuple, diversity.top_texts(df, F.col("t"), F.col("o"), k).collect()), key=lambda r: (-r[1], r[2]))
            assert got == want[:k]


@pytest.mark.parametrize("k", [1, 7, 60, 5000])
def test_exact_overlap_by_all_pairs(spark, k):
    rng = random.Random(k)
    words = [f"w{i}" for i in range(25)]
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([1, 3, 6, 9])))) for i in range(60)] + [(60 + i, "w1 w2 w3 w4") for i in range(9)] + [(80, None), (81, "")]
    sets = {i: set(t.split()) for i, t in rows if t}
    pairs = sorted(((len(sets[i] & sets[j]) / len(sets[i] | sets[j]), i, j) for i in sets for j in sets if i < j and sets[i] & sets[j]), key=lambda p: (-p[0], p[1], p[2]))
    got = diversity.exact_overlap(spark, spark.createDataFrame(rows, "i long, t string"), "i", F.col("t"), k).collect()
    assert sorted(((r["overlap"], r["i"], r["j"]) for r in got), key=lambda p: (-p[0], p[1], p[2])) == pairs[:k]


def test_exact_overlap_of_many_copies(spark, monkeypatch):
    """The copies of a text are not expanded into all pairs: of 40 texts 400 times over, few pairs are listed."""
    listed = []
    monkeypatch.setattr(diversity, "written", lambda spark, rows, name: listed.append((name, rows)) or rows)
    rows = spark.range(16_000, numPartitions=4).select(F.col("id").alias("i"), F.concat(F.lit("w"), F.col("id") % 40, F.lit(" of")).alias("t"))
    got = [(r["i"], r["j"], r["overlap"]) for r in diversity.exact_overlap(spark, rows, "i", F.col("t"), 50).collect()]
    assert got == [(0, 40 * x, 1.0) for x in range(1, 51)]
    assert [name for name, _ in listed][-1] == "own"  # no pair of unequal texts was looked for


def test_rows_of_tiers_are_limited_in_each_task(spark):
    rows = spark.range(5000, numPartitions=4).select("id", F.when(F.col("id") % 5 == 0, "easy").when(F.col("id") % 5 == 1, "other").otherwise("hard").alias("tier"))
    made = dataset.tier_sample(rows, "tier", [F.col("id")], 2000)
    assert made._jdf.queryExecution().executedPlan().toString().count("TakeOrderedAndProject") >= 3  # no row is medium
    got = {r["tier"]: r["n"] for r in made.groupBy("tier").agg(F.count("*").alias("n")).collect()}
    assert sum(got.values()) == 2000 and got["easy"] >= 600 and got["hard"] >= 600
