import json

import pytest
from pyspark.sql import functions as F

from sparkward import cli, config
from sparkward.operators import metrics as M
from sparkward.sources import json_tables, sinks
from sparkward.sources.contracts import ContractError


def test_check(spark, tmp_path, capsys):
    (tmp_path / "good.json").write_text(json.dumps([{"output": "x = 1"}, {"output": "y = 2"}]))
    (tmp_path / "bad.json").write_text(json.dumps([{"output": "x = ("}, {"output": " "}]))
    good, bad = str(tmp_path / "good.json"), str(tmp_path / "bad.json")
    assert cli.main(["check", good], spark) == 0 and "2 rows, 0 empty" in capsys.readouterr().out
    assert cli.main(["check", good, bad], spark) == 1 and "1 empty, 1 that do not parse" in capsys.readouterr().out
    assert cli.main(["check", good, "--quiet"], spark) == 0 and not capsys.readouterr().out
    (tmp_path / "lines.json").write_text('{"output": "x"}')
    assert cli.main(["check", str(tmp_path / "lines.json")], spark) == 1 and cli.main(["nothing"], spark) == 2


def test_build(spark, tmp_path):
    sizes = cli.build(spark, str(tmp_path / "out"), 200, 0.1)
    assert sizes["train"] == 180 and sizes["eval"] == 20 and sizes["pairs"] > 100
    pairs = json_tables.load_preferences(spark, str(tmp_path / "out/pairs"))
    assert pairs.where(F.col("chosen") == F.col("rejected")).count() == 0 and pairs.select("attack_type").distinct().count() == 7
    assert json_tables.load_array(spark, str(tmp_path / "out/train")).count() == 180
    assert cli.main(["build", str(tmp_path / "x"), "--total", "5"], spark) == 1


def test_migrate(spark, tmp_path):
    (tmp_path / "old.json").write_text(json.dumps([{"instruction": "say", "input": "i", "output": "x", "attack_type": "fstring", "expected_vulnerable": True, "difficulty": "easy", "task_type": "fix"}, 7, [1]]))
    assert cli.migrate(spark, str(tmp_path / "old.json"), str(tmp_path / "new")) == 1
    r = spark.read.json(str(tmp_path / "new")).first()
    assert r["task_type"] == "fix" and r["id"].startswith("sqlsec-") and r["vulnerability_type"] == "fstring"


def test_compare(spark, tmp_path):
    paths = []
    for model, hits in (("baseline", 4), ("lora_sft", 1)):
        rows = spark.range(8).select("id", F.lit(True).alias("expected_vulnerable"), F.lit(False).alias("invalid_extraction"), (F.col("id") < hits).alias("is_vulnerable"))
        paths.append(str(tmp_path / model))
        sinks.write_document({"model": model}, M.bundle(rows), rows, paths[-1], "id")
    got = {r["model"]: r for r in cli.compared(spark, paths).collect()}
    assert got["lora_sft"]["pct_drop"] == 75.0 and got["baseline"]["pct_drop"] == 0.0 and got["baseline"]["strict_f1"] == pytest.approx(2 / 3)
    with pytest.raises(ContractError, match="baseline"):
        cli.compared(spark, paths[1:])
    assert cli.main(["compare", *paths], spark) == 0
    samples = json_tables.per_sample(json_tables.load_results(spark, *paths), {"is_vulnerable": "boolean"})
    assert samples.groupBy("path").count().count() == 2 and samples.where("is_vulnerable").count() == 5


def test_configurations():
    base = {"generation": {"temperature": 1, "n": 2}, "outputs": {"a": "x.json", "b": 3}}
    run = config.default_run(base)
    assert run["generation"] == {"temperature": 0, "n": 2} and run["eval"] == {"enable_taint": True} and base["generation"]["temperature"] == 1
    assert config.analyser_only_run(run)["outputs"] == {"a": "x_bandit_only.json", "b": 3}
    with pytest.raises(ContractError):
        config.analyser_only_run({"outputs": []})
