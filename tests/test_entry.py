import pytest

import __spark_entry__
from sparkward.plans import registry
from tests.duck import duck, rows


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() == 1


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf_dir, name):
    got = registry.QUERIES[name](spark, sf_dir).toPandas()
    if name in registry.ORACLE_SQL:
        expected = duck(registry.ORACLE_SQL[name], sf_dir)
        assert sorted(got.columns) == sorted(expected.columns)
        assert rows(got) == rows(expected)
    else:
        assert got.shape[1] > 0


def test_masked_tokens_of_odd_texts(spark, tmp_path):
    """Null, blank and long texts, and white space of every kind alone, at either end and inside."""
    spaces = [chr(i) for i in (*range(1, 33), 0x7F, 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF)]
    texts = [None, "", "  ", " \n", "\n ", "\r\n", "ab \n\u2028\n", "\n\x0b\nab", " \n" * 300, " " * 600 + "x" * 500 + "\n" * 30, *("x" * n for n in range(480, 488))]
    texts += [t for s in spaces for t in (s, s + "ab", "ab" + s, f"{s} ab\n{s}", f"a{s}b")]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").toPandas().to_parquet(tmp_path / "documents.parquet")
    got = registry.QUERIES["masked_tokens"](spark, str(tmp_path)).toPandas()
    assert rows(got) == rows(duck(registry.ORACLE_SQL["masked_tokens"], str(tmp_path)))


def test_plans_have_no_cartesian_product_and_prune_columns(spark, sf_dir):
    for name in ("bundle_overall", "group_rates", "detector_vs_truth", "rule_hits", "dedup_keep_first"):
        plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BatchEvalPython" not in plan
    plan = registry.QUERIES["bundle_overall"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan.split("ReadSchema")[1]
