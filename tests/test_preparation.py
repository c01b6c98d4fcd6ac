import json
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkward.functions import text as T
from sparkward.operators import detection, evaluate, generate, preparation
from sparkward.operators import metrics as M
from sparkward.sources.contracts import ContractError

SAFE = 'import sqlite3\n\ndef find(conn, value):\n    sql = "SELECT * FROM t WHERE a = ?"\n    return conn.execute(sql, (value,))'


def encode(text, special):
    return [256] * special + list(text.encode())


def test_masks():
    assert preparation.masked_ids("ab", "cd", encode, 10) == ([256, 97, 98, 99, 100], [0, 0, 0, 1, 1])
    assert preparation.masked_ids("ab", "cd", encode, 2) == ([99, 100], [1, 1])
    assert preparation.masked_ids("ab", "", encode, 2) == ([97, 98], [0, 1])  # one id is always trained on
    merged = lambda text, special: [1] * special + [len(w) for w in text.split("|")]
    assert preparation.masked_ids("ab", "c|d", merged, 9) == ([1, 3, 1], [0, 1, 1])  # the border moved into the prompt


def test_masks_of_wholes_that_are_not_cut():
    assert preparation.masked_ids("ab", "", encode, 9, always=False) == ([256, 97, 98], [0, 0, 0])
    assert preparation.masked_ids("ab", "", encode, 2, always=False) == ([97, 98], [0, 1])
    assert preparation.masked_ids("ab", "c", encode, 9, always=False) == preparation.masked_ids("ab", "c", encode, 9)


def test_pair_ids():
    assert preparation.pair_ids("p", "a", "b</s>", encode, "</s>", None, None)[3:] == (None, 1)
    head, chosen, rejected, why, _ = preparation.pair_ids("prompt", "aa", "bbbb", encode, "", 3, 5)
    assert (head, chosen, rejected, why) == ([256, ord("p"), ord("t")], [97, 97], [98, 98], None)
    assert preparation.pair_ids("prompt", "a", "b", encode, "", None, 4)[3] == "prompt_too_long"
    assert preparation.pair_ids("prompt", "", "b", encode, "", None, None)[3] == "empty_completion"


def test_preflight(spark):
    rows = spark.createDataFrame([(f"```python\n{SAFE}\n```",), ("no code here",), (None,), ("x = (",)], "output string")
    assert preparation.preflight(rows).count() == 1
    assert sorted(str(r[0]) for r in preparation.code_only_targets(rows).select("dropped_reason").collect()) == ["None", "no_code", "no_code", "no_code"]
    with pytest.raises(ContractError, match="no row"):
        preparation.preflight(rows.where("output is null"))
    with pytest.raises(ContractError, match="scaffold"):
        preparation.preflight(spark.createDataFrame([("x = 1  # ref= 3",)], "output string"))
    with pytest.raises(ContractError, match="unsafe"):
        preparation.preflight(spark.createDataFrame([('c.execute(f"a")',)], "output string"), check_patterns=True)
    flags = spark.createDataFrame([(SAFE,), ('c.execute(f"a")',), ("(",), (" ",)], "o string").select(preparation.valid_target(F.col("o")))
    assert [r[0] for r in flags.collect()] == [True, False, False, False]


def test_pairs(spark):
    schema = "i int, instruction string, input string, output string, expected_vulnerable boolean"
    rows = spark.createDataFrame([(0, "say", "", SAFE, True), (1, "say", "", SAFE, False), (2, "say", "", "x = 1", True), (3, "say", "", None, True)], schema)
    pairs = preparation.build_pairs(rows, "i")
    ok = pairs.where("outcome = 'ok'")
    assert ok.count() == 7 and ok.where("i <> 0").count() == 0 and ok.select("tier").distinct().count() == 3
    assert pairs.where("i = 2 and outcome = 'no_variant'").count() == 7
    assert preparation.pair_stats(pairs).agg(F.sum("n")).first()[0] == 14


def test_quota_of_tiers(spark):
    rows = spark.createDataFrame([(i, t, a) for i in range(30) for t, n in (("easy", 1), ("hard", 4)) for a in range(n)], "i int, tier string, a int")
    kept = preparation.quota_of_tiers(rows, "i", total=30)  # 9 easy, 9 hard pairs
    counts = {r["tier"]: r["count"] for r in kept.groupBy("tier").count().collect()}
    assert counts == {"easy": 9, "hard": 12}  # the third row passes the quota
    assert preparation.sampled_pairs(kept, [F.col("i"), F.col("a")], 10).count() == 10


def test_verdicts_from_answers(spark, tmp_path):
    samples = spark.createDataFrame([(i, f"s{i}", "ask", "fstring", None if i == 3 else "easy", "fix", i % 2 == 0) for i in range(6)], "sample_ord int, id string, prompt string, attack_type string, difficulty string, task_type string, expected_vulnerable boolean")
    answers = ["```python\n" + SAFE + "\n```", 'cur.execute(f"SELECT {v}")', "no code here, sorry", None, "[SECURITY WARNING]\n```python\nx = 1\n```", SAFE]
    outputs = spark.createDataFrame([*enumerate(answers), (99, "x = 1")], "sample_ord int, raw_output string")
    rows = {r["sample_ord"]: r for r in evaluate.verdict_rows(outputs, samples, use_taint=True).collect()}
    assert sorted(rows) == list(range(6))  # an answer to no sample gives no row
    assert [rows[i]["is_vulnerable"] for i in range(6)] == [False, True, None, None, False, False]
    assert [rows[i]["invalid_extraction"] for i in range(6)] == [False, False, True, True, False, False]
    assert rows[1]["detection_sources"] == ["rule_based"] and rows[2]["detection_sources"] == [] and rows[2]["code"] == "" and not rows[2]["rule_based_detected"]
    assert rows[4]["has_warning"] and not rows[3]["has_warning"] and rows[3]["difficulty"] == "unknown" and rows[0]["vulnerability_type"] == "fstring"
    samples = samples.fillna("easy")  # the run holds samples to the contract
    bundle = evaluate.run(spark, outputs, samples, str(tmp_path / "run"), model="m").first().asDict()
    assert (bundle["n_samples"], bundle["n_valid"], bundle["valid_only_fp"]) == (6, 4, 1) and any("defense_success_rate" in x for x in evaluate.summary_lines(bundle))
    control = M.bundle(evaluate.verdict_rows(evaluate.constant_answers(samples), samples, use_taint=True)).first()
    assert (control["valid_only_tp"], control["valid_only_fp"], control["valid_only_fn"], control["valid_only_tn"]) == (0, 0, 3, 3)
    with pytest.raises(M.UnreliableEvaluation):
        evaluate.run(spark, spark.createDataFrame([(i, "no code here, sorry") for i in range(6)], "sample_ord int, raw_output string"), samples, str(tmp_path / "bad"), model="m")


TOOL = """#!/usr/bin/env python3
import json, sys, time
paths = [a for a in sys.argv[1:] if a.endswith(".py")]
texts = [open(p).read() for p in paths]
if len(paths) > 1 and any("crash" in t for t in texts):
    sys.exit("broken")
if any("hang" in t for t in texts):
    time.sleep(60)
print(json.dumps({"results": [{"filename": p, "test_id": "B608"} for p, t in zip(paths, texts) if "SELECT" in t]}))
"""


def test_analyser_in_batches(monkeypatch, tmp_path):
    tool = tmp_path / "bandit"
    tool.write_text(TOOL)
    tool.chmod(0o755)
    monkeypatch.setenv("PATH", f"{tmp_path}:{os.environ['PATH']}")
    monkeypatch.setattr(detection, "TIMEOUT", 1)
    count = lambda codes: [len(json.loads(x)["results"]) for x in detection._reports(pd.Series(codes, dtype=object))]
    assert count(["SELECT 1", "x", None]) == [1, 0, 0] and count([]) == []
    assert count(["SELECT 1", "crash"]) == [1, 0]  # the batch fails, its rows are run one by one
    told = detection._reports(pd.Series(["SELECT 1", "hang", "x"], dtype=object))
    assert [len(json.loads(x)["results"]) for x in told] == [1, 0, 0] and "no report" in told[1]


def test_template_bank(spark):
    rows = generate.template_rows()
    assert len(rows) == 56 and len({r[3] for r in rows}) == 56 and abs(sum(r[4] for r in rows) - 1) < 1e-12
    bank = generate.template_bank(spark)
    assert bank.where(~preparation.valid_target(F.col("code"))).count() == 0
    assert bank.where(T.driver_of(F.col("code")) != F.col("driver")).count() == 0
    assert generate.template_quota(spark, 100, generate.BASIC).agg(F.sum("n"), F.countDistinct("structure")).first()[:] == (100, 3)
    assert generate.template_rows_of(spark, 500).select("code").distinct().count() > 450


def test_detectors(spark):
    report = json.dumps({"results": [{"test_id": "B608", "issue_severity": "LOW", "line_number": "7"}, {"test_id": "B101", "line_number": "x"}]})
    rows = spark.createDataFrame([("x = 1", report), ('c.execute(f"a")', "nonsense"), (None, None)], "code string, report string")
    got = detection.detect(rows, report=F.col("report"), use_taint=True).collect()
    assert [(i["test_id"], i["severity"], i["line_number"]) for i in got[0]["issues"]] == [("B608", "LOW", 7), ("B101", "UNKNOWN", -1)]
    assert [r["is_vulnerable"] for r in got] == [True, True, False] and [r["analyser_skipped"] for r in got] == [False, False, True]
    assert [r["detection_sources"] for r in got] == [["bandit_b608"], ["rule_based"], []]
    assert detection.detect(rows, use_rules=False).where("is_vulnerable").count() == 0
    skipped = detection.detect(rows, report=detection.analyser_report(F.col("code")))
    assert skipped.where("analyser_skipped").count() in (0, 3)
    made = spark.createDataFrame([("t", "c", ""), (None, None, "DB table `a`, column `b`"), ("", None, "select * from x where y = 1"), (None, None, "?")], "t string, c string, g string")
    assert [tuple(r) for r in made.select(*detection.schema_of(F.col("t"), F.col("c"), F.col("g"))).collect()] == [("t", "c"), ("a", "b"), ("x", "y"), (None, None)]
    assert made.select(detection.execute_parameter(F.lit("cur.execute(sql, (uid,))"))).first()[0] == "uid"


def test_generated_rows(spark):
    rows = generate.fill_plan(spark, 500)
    assert rows.count() == 500 and 0.4 < rows.where("expected_vulnerable").count() / 500 < 0.6
    assert rows.where(~preparation.valid_target(F.col("output"))).count() == 0
    assert rows.exceptAll(generate.fill_plan(spark, 500)).count() == 0
    many = generate.fill_plan(spark, 300_000).select("instruction", "input")
    assert many.distinct().count() == 300_000  # beyond the number of combinations too
    held = generate.fill_plan(spark, 300, "eval", used=500).select("instruction", "input")
    assert held.join(rows.select("instruction", "input"), ["instruction", "input"], "left_semi").count() == 0 and held.distinct().count() == 300
    four = generate.four_categories(spark, 40)
    assert four.count() == 40 and four.select("category").distinct().count() == 4


def test_tokens_are_made_in_slices(spark):
    """A worker holds the ids of few rows at a time."""
    rows = spark.range(1500, numPartitions=1).select("id", F.lit("ask ").alias("prompt"), F.repeat(F.lit("x"), F.col("id").cast("int") % 7).alias("completion"))
    ids = preparation.tokenise(rows, lambda text, special: list(text.encode()), 8, ("id",))
    got = {r["id"]: (r["input_ids"], r["completion_mask"]) for r in ids.collect()}
    assert all(len(a) == min(8, 4 + i % 7) == len(m) and sum(m) == max(i % 7, 1) for i, (a, m) in got.items())
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(1500))], ["id"])
    assert [b.num_rows for b in preparation.slices([batch])] == [preparation.SLICE] * 5 + [1500 - 5 * preparation.SLICE]
