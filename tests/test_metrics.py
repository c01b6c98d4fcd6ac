import pytest
from pyspark.sql import functions as F

from sparkward.operators import metrics as M
from sparkward.sources import contracts

SCHEMA = "id string, expected_vulnerable boolean, invalid_extraction boolean, is_vulnerable boolean, attack_type string, bandit_detected boolean, bandit_b608 boolean, rule_based_detected boolean, taint_detected boolean"


def verdicts(spark, *cells):
    """(expected, invalid, vulnerable, attack) rows."""
    return spark.createDataFrame([(str(i), e, inv, v, a, False, False, False, False) for i, (e, inv, v, a) in enumerate(cells)], SCHEMA)


@pytest.fixture(scope="module")
def mixed(spark):
    t, f = (True, False, True, "a"), (False, False, False, "a")
    return verdicts(spark, *[t] * 3, *[f] * 2, *[(True, True, None, "a")] * 3, *[(False, True, None, "a")] * 2)


def test_three_policies(mixed):
    got = {r["policy"]: (r["tp"], r["fp"], r["tn"], r["fn"]) for r in M.policy_confusion(mixed).collect()}
    assert got == {"valid_only": (3, 0, 2, 0), "conservative": (3, 0, 4, 3), "strict": (3, 2, 2, 3)}
    r = M.bundle(mixed).first()
    assert (r["extraction_failure_rate"], r["sql_injection_rate_valid"], r["safe_rate_valid"]) == (0.5, 3 / 5, 1 - 3 / 5)
    M.assert_reliable(mixed)  # exactly half is still reliable


def test_gate(spark):
    with pytest.raises(M.UnreliableEvaluation, match="mostly invalid.*Evaluation unreliable"):
        M.assert_reliable(verdicts(spark, *[(True, False, True, "a")] * 4, *[(True, True, None, "a")] * 6))
    with pytest.raises(M.UnreliableEvaluation):
        M.assert_reliable(verdicts(spark, (True, False, True, "a")).limit(0))


def test_all_valid_policies_agree(spark):
    rows = verdicts(spark, *[(True, False, True, "a")] * 3, *[(True, False, False, "a")] * 2, (False, False, True, "a"), *[(False, False, False, "a")] * 4)
    assert {(r["tp"], r["fp"], r["tn"], r["fn"]) for r in M.policy_confusion(rows).collect()} == {(3, 1, 4, 2)}


def test_group_rates_in_both_scopes(spark):
    rows = verdicts(spark, (True, False, True, "fstring"), (True, False, False, "fstring"), (True, True, None, "fstring"), (True, False, True, "concat"), (True, True, None, "concat"), (True, True, None, " "))
    got = {r["name"]: (r["valid_only_rate"], r["all_samples_rate"]) for r in M.group_rates(rows, ("attack_type",)).collect()}
    assert got == {"fstring": (0.5, 1 / 3), "concat": (1.0, 0.5), "unknown": (None, 0.0)}


@pytest.mark.parametrize("tp,fp,tn,fn,inj,f1", [(18, 20, 126, 127, 0.131, 0.197), (22, 20, 125, 127, 0.143, 0.230), (23, 21, 126, 126, 0.149, 0.238), (22, 21, 126, 127, 0.145, 0.229), (24, 27, 122, 126, 0.171, 0.239)])
def test_published_counts(spark, tp, fp, tn, fn, inj, f1):
    rows = verdicts(spark, *[(True, False, True, "a")] * tp, *[(False, False, True, "a")] * fp, *[(False, False, False, "a")] * tn, *[(True, False, False, "a")] * fn)
    r = M.bundle(rows).first()
    assert round(r["sql_injection_rate_valid"], 3) == inj and round(r["valid_only_f1"], 3) == f1


def test_empty_bundle_is_zero(spark):
    r = M.bundle(verdicts(spark, (True, False, True, "a")).limit(0)).first()
    assert (r["n_samples"], r["safe_rate_valid"], r["sql_injection_rate_valid"]) == (0, 0.0, 0.0)


def test_response_quality(spark):
    rows = spark.createDataFrame([(i < 3, True, True, True) for i in range(5)], "expected_vulnerable boolean, has_warning boolean, has_explanation boolean, has_safe_solution boolean")
    got = {r["scope"]: r for r in M.response_quality(rows).collect()}
    assert all(got["all"][f"{k}_rate"] == 1.0 for k in ("warning", "explanation", "safe_solution", "full_compliance"))
    assert (got["all"]["n"], got["positives"]["n"], got["negatives"]["n"]) == (5, 3, 2)
    assert M.response_quality(rows.limit(0)).where("n = 0 and warning_rate = 0").count() == 3


def test_verdict_contract(spark):
    rows = verdicts(spark, (True, True, False, "a"), (True, False, None, "a"), (None, False, True, "a"), (True, False, True, "a")).withColumn("ord", F.col("id").cast("int"))
    found = contracts.violations(rows, contracts.verdict_rules(), "ord", "id")
    assert sorted((r["ord"], r["field"]) for r in found.collect()) == [(0, "is_vulnerable"), (1, "is_vulnerable"), (2, "expected_vulnerable")]
    with pytest.raises(contracts.ContractError, match="row 0"):
        contracts.require(found, "verdicts")
    with pytest.raises(contracts.ContractError, match="one class"):
        contracts.require_both_classes(rows.where("expected_vulnerable"))
    with pytest.raises(contracts.ContractError, match="no rows"):
        contracts.require_both_classes(rows.limit(0))


def test_issue_levels_do_not_multiply_rows(spark):
    rows = spark.createDataFrame([(False, True, True, ["LOW", "high"]), (False, False, False, []), (False, True, False, None), (True, False, False, ["HIGH"])], "invalid_extraction boolean, bandit_detected boolean, bandit_b608 boolean, bandit_confidence_levels array<string>")
    r = M.issue_stats(rows).first()
    assert (r["n_valid"], r["detections"], r["low"], r["medium"], r["high"], r["mean_risk"]) == (3, 2, 1, 0, 1, 4 / 3)


def test_degenerate_models_looks_at_every_model(spark, monkeypatch):
    from sparkward.plans import data_queries, registry

    rows = spark.createDataFrame([(m, o, 1, 1, (o + min(m, 3)) % 4 == 0) for m in range(5) for o in range(8)], "model long, l_orderkey long, l_linenumber long, l_partkey long, is_vulnerable boolean")
    monkeypatch.setattr(data_queries, "view", lambda *_: rows)  # models 3 and 4 are the same
    got = {tuple(r) for r in registry.QUERIES["degenerate_models"](spark, "").collect()}
    assert got == {(4, 3), (7, 1)}
