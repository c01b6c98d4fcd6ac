"""Queries of sources, sinks, contracts, dataset building and reports, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkward.functions import rules
from sparkward.functions import text as T
from sparkward.operators import compare, dataset, detection, diversity, generate, trainlog
from sparkward.operators import metrics as M
from sparkward.plans.metric_sql import FLAT, bundle_sql, counts, prf
from sparkward.plans.registering import div, matches_any, register, values
from sparkward.plans.views import table, view
from sparkward.scratch import scratch_path
from sparkward.sources import contracts, json_tables, sinks

# ---- files: written by a sink, read again by a source


@register("json_lines_round_trip", "SELECT c_custkey, c_name, c_acctbal, c_acctbal > 0 AS positive FROM customer")
def json_lines_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "lines")
    sinks.write_lines(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", (F.col("c_acctbal") > 0).alias("positive")), path)
    return json_tables.fields(json_tables.load_rows(spark, path), {"c_custkey": "bigint", "c_name": "string", "c_acctbal": "double", "positive": "boolean"}).drop("ord")


@register("json_array_round_trip", "SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS ord, s_suppkey, s_name FROM supplier")
def json_array_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "array")
    sinks.write_array(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), path, "s_suppkey")
    return json_tables.fields(json_tables.load_array(spark, path), {"s_suppkey": "bigint", "s_name": "string"})


@register("positional_join", "SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS ord, c_custkey, c_name, c_acctbal, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS answer FROM customer")
def positional_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources of many files each, one of lines and one an array, joined by the position of their records."""
    rows, samples, outputs = table(spark, sf_dir, "customer"), scratch_path(spark, "samples"), scratch_path(spark, "outputs")
    rows.select("c_custkey", "c_name").repartitionByRange(5, "c_custkey").sortWithinPartitions("c_custkey").write.json(samples)
    sinks.write_array(rows.select("c_custkey", "c_acctbal", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("answer")).repartition(3), outputs, "c_custkey")
    left = json_tables.fields(json_tables.load_rows(spark, samples), {"c_custkey": "bigint", "c_name": "string"})
    right = json_tables.fields(json_tables.load_array(spark, outputs), {"c_acctbal": "double", "answer": "string"})
    return left.join(right, "ord")


@register("legacy_rows", r"""SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'find ' || s_name ELSE 'whole ' || s_name END AS instruction, CASE s_suppkey % 3 WHEN 0 THEN 'in' ELSE '' END AS input, CASE s_suppkey % 3 WHEN 0 THEN 'out' ELSE '' END AS response FROM supplier WHERE s_suppkey % 3 <> 1""")
def legacy_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old files: elements that are no objects go, prompts with sections are split."""
    path = scratch_path(spark, "legacy")
    prompt = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("### Instruction:\nfind "), "s_name", F.lit("\n### Input:\nin\n### Response:\nout"))).otherwise(F.concat(F.lit("whole "), "s_name"))
    record = F.to_json(F.struct("s_suppkey", prompt.alias("prompt")))
    table(spark, sf_dir, "supplier").select(F.when(F.col("s_suppkey") % 3 == 1, F.to_json(F.array("s_suppkey"))).otherwise(record).alias("value")).write.text(path)
    rows = json_tables.fields(json_tables.records_only(json_tables.load_rows(spark, path)), {"s_suppkey": "bigint", "prompt": "string"})
    return json_tables.legacy_sections(rows).select("s_suppkey", "instruction", "input", "response")


@register("preference_rows", "SELECT 'p' || o_orderkey AS prompt, 'c' AS chosen, 'r' AS rejected, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS attack_type, CAST(NULL AS VARCHAR) AS difficulty, 'fix' AS task_type, o_orderkey % 3 = 0 AS expected_vulnerable, CAST(NULL AS VARCHAR) AS schema_table, CAST(NULL AS VARCHAR) AS schema_column, CAST(NULL AS VARCHAR) AS chosen_framework FROM orders")
def preference_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "pairs")
    tag = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority"))
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit("p"), "o_orderkey").alias("prompt"), F.lit("c").alias("chosen"), F.lit("r").alias("rejected"), tag.alias("attack_type"), F.lit("fix").alias("task_type"), (F.col("o_orderkey") % 3 == 0).alias("expected_vulnerable"), F.lit("hard").alias("dpo_difficulty_tier"))
    sinks.write_lines(rows, path)
    return json_tables.load_preferences(spark, path)


_SAMPLES = "SELECT s_suppkey, s_suppkey % 5 = 0 AS inv, s_suppkey % 2 = 0 AS ev, s_suppkey % 3 = 0 AS hit FROM supplier"


def _result(spark: SparkSession, sf_dir: str) -> str:
    """Where a result document of the suppliers as samples stands, with its rows as lines beside it."""
    path = scratch_path(spark, "result")
    key = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(key, (key % 2 == 0).alias("expected_vulnerable"), (key % 5 == 0).alias("invalid_extraction"), F.when(key % 5 != 0, key % 3 == 0).alias("is_vulnerable"))
    bundle = M.bundle(rows)
    sinks.write_result({"model": "m"}, bundle.select(sinks.nested_summary(bundle).alias("s")).select("s.*"), rows.orderBy("s_suppkey"), path)
    return path


@register("result_summary", f"WITH f AS ({_SAMPLES}), c AS (SELECT count(*) AS n_samples, count(*) FILTER (WHERE inv) AS n_invalid, {counts('strict')} FROM f) SELECT 'm' AS model, n_samples, {div('n_invalid', 'n_samples')} AS extraction_failure_rate, tp AS strict_tp, fp AS strict_fp, CAST(NULL AS DOUBLE) AS warning_rate FROM c")
def result_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = json_tables.load_results(spark, f"{_result(spark, sf_dir)}/document")
    got = json_tables.summaries(results, n_samples="n_samples bigint", extraction_failure_rate="extraction_failure_rate double", strict_tp="strict_metrics.tp bigint", strict_fp="strict_metrics.fp bigint", warning_rate="warning_rate double")
    return results.select("path", F.try_variant_get("doc", "$.meta.model", "string").alias("model")).join(got, "path").drop("path")


@register("result_samples", f"WITH f AS ({_SAMPLES}) SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS pos, s_suppkey, ev AS expected_vulnerable, inv AS invalid_extraction, CASE WHEN NOT inv THEN hit END AS is_vulnerable FROM f")
def result_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a result, numbered over all files that hold them."""
    rows = json_tables.load_rows(spark, f"{_result(spark, sf_dir)}/per_sample")
    return json_tables.fields(rows, {"s_suppkey": "bigint", "expected_vulnerable": "boolean", "invalid_extraction": "boolean", "is_vulnerable": "boolean"}).withColumnRenamed("ord", "pos")


@register("tolerant_results", "SELECT l_suppkey % 5 AS model, count(*) AS n_samples FROM lineitem WHERE l_suppkey % 5 <> 3 GROUP BY 1")
def tolerant_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each model, of which one is broken and one more is missing: the others are read."""
    verdicts = view(spark, sf_dir, "verdicts")
    paths = [scratch_path(spark, f"model-{m}") for m in range(5)]
    blocks = M.bundle(verdicts, "model")
    for m, path in enumerate(paths):
        if m == 3:
            spark.range(1).select(F.lit('{"summary": {').alias("value")).write.text(path)
        else:
            own = blocks.where(f"model = {m}").drop("model")
            own.select(F.concat(F.lit(f'{{"meta": {{"model": {m}}}, "summary": '), F.to_json(sinks.nested_summary(own)), F.lit("}")).alias("value")).coalesce(1).write.text(path)
    read = json_tables.load_results(spark, *paths, scratch_path(spark, "none"), required=json_tables.PLOT_KEYS, tolerant=True)
    return read.select(F.try_variant_get("doc", "$.meta.model", "bigint").alias("model"), F.try_variant_get("doc", "$.summary.n_samples", "bigint").alias("n_samples"))


@register("reject_preview", "SELECT doc_id FROM documents WHERE n_chars < 100 ORDER BY doc_id LIMIT 20")
def reject_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 rejected rows, as the debug sink keeps them."""
    path = scratch_path(spark, "rejects")
    sinks.write_rejects(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars < 100", "doc_id", path, 20)
    return spark.read.schema("doc_id long").json(path)


@register("checked_copy", "SELECT count(*) AS n, count(*) FILTER (WHERE doc_id % 2 = 0) AS positives FROM documents")
def checked_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written, read back, held to the contract and counted."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").cast("string").alias("id"), F.lit("ask").alias("instruction"), F.lit("fstring").alias("attack_type"), F.lit("easy").alias("difficulty"), F.lit("fix").alias("task_type"), (F.col("doc_id") % 2 == 0).alias("expected_vulnerable"))
    return sinks.write_checked(spark, rows, scratch_path(spark, "copy")).agg(F.count("*").alias("n"), F.count_if("expected_vulnerable").alias("positives"))


@register("task_folders", "SELECT task_type, count(*) AS n FROM (SELECT CASE doc_id % 2 WHEN 0 THEN 'fix' ELSE 'generation' END AS task_type FROM documents) GROUP BY 1")
def task_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "splits")
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").cast("string").alias("id"), F.lit("ask").alias("instruction"), F.lit("fstring").alias("attack_type"), F.lit("easy").alias("difficulty"), F.when(F.col("doc_id") % 2 == 0, "fix").otherwise("generation").alias("task_type"), F.lit(True).alias("expected_vulnerable"))
    sinks.write_splits(rows, path)
    return spark.read.schema("id string, task_type string").json(path).groupBy("task_type").agg(F.count("*").alias("n"))


# ---- contracts and projections

_RAW = "SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN ' ' ELSE 'd' || doc_id END AS id, CASE WHEN doc_id % 13 = 0 THEN '' ELSE 'ask' END AS instruction, CASE WHEN doc_id % 17 <> 0 THEN source END AS attack_type, CASE WHEN doc_id % 5 <> 0 THEN lang END AS vulnerability_type, 'hard' AS difficulty, 'fix' AS task_type, CASE WHEN doc_id % 19 <> 0 THEN doc_id % 2 = 0 END AS expected_vulnerable FROM documents"


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(d, F.when(d % 11 == 0, " ").otherwise(F.concat(F.lit("d"), d)).alias("id"), F.when(d % 13 == 0, "").otherwise("ask").alias("instruction"), F.when(d % 17 != 0, F.col("source")).alias("attack_type"), F.when(d % 5 != 0, F.col("lang")).alias("vulnerability_type"), F.lit("hard").alias("difficulty"), F.lit("fix").alias("task_type"), F.when(d % 19 != 0, d % 2 == 0).alias("expected_vulnerable"))


_GOOD = "trim(id) <> '' AND instruction <> '' AND (attack_type IS NOT NULL OR vulnerability_type IS NOT NULL) AND expected_vulnerable IS NOT NULL"


@register("sample_report", f"WITH r AS ({_RAW}), c AS (SELECT count(*) AS total, count(*) FILTER (WHERE {_GOOD}) AS valid, count(*) FILTER (WHERE {_GOOD} AND expected_vulnerable) AS pos, count(*) FILTER (WHERE {_GOOD} AND NOT expected_vulnerable) AS neg FROM r) SELECT total, valid, {div('100.0 * valid', 'total')} AS pct_valid, pos, neg FROM c")
def sample_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.sample_report(_raw(spark, sf_dir))


@register("sample_violations", f"WITH r AS ({_RAW}) SELECT doc_id AS ord, id, 'id' AS field, 'blank' AS reason FROM r WHERE trim(id) = '' UNION ALL SELECT doc_id, id, 'prompt', 'cannot be built' FROM r WHERE instruction = '' UNION ALL SELECT doc_id, id, 'vulnerability_type', 'blank' FROM r WHERE attack_type IS NULL AND vulnerability_type IS NULL UNION ALL SELECT doc_id, id, 'expected_vulnerable', 'missing' FROM r WHERE expected_vulnerable IS NULL")
def sample_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _raw(spark, sf_dir)
    return contracts.violations(rows, contracts.sample_rules(rows), "doc_id", "id")


@register("violation_preview", f"WITH r AS ({_RAW}) SELECT doc_id AS ord, id FROM r WHERE trim(id) = '' ORDER BY doc_id LIMIT 5")
def violation_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five violations of a kind, as the error message shows them."""
    return sample_violations(spark, sf_dir).where("field = 'id'").orderBy("ord").limit(contracts.PREVIEW).select("ord", "id")


@register("normalised_samples", rf"WITH r AS ({_RAW}) SELECT doc_id, E'Instruction:\n' || instruction || E'\n\nInput:\n\n\n' AS prompt, coalesce(vulnerability_type, attack_type) AS attack_type, coalesce(vulnerability_type, attack_type) AS vulnerability_type, expected_vulnerable FROM r")
def normalised_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _raw(spark, sf_dir).withColumn("id", F.col("doc_id").cast("string"))
    return contracts.normalised_sample(rows).select(F.col("id").cast("long").alias("doc_id"), "prompt", "attack_type", "vulnerability_type", "expected_vulnerable")


@register("normalised_rows", "SELECT doc_id, source AS attack_type, source AS vulnerability_type, 'generation' AS task_type, 'hard' AS difficulty, 'in' AS input_code, doc_id % 2 = 0 AS expected_vulnerable FROM documents")
def normalised_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("attack_type"), F.lit("hard").alias("difficulty"), F.lit("in").alias("input"), (F.col("doc_id") % 2 == 0).alias("expected_vulnerable"))
    return dataset.normalised_rows(rows).drop("input")


@register("eval_prompt_rows", r"""SELECT 'sqlsec-' || substr(sha256(concat('fix', E'\n', source, E'\n', 'ask ' || doc_id, E'\n', lang)), 1, 20) AS id, sha256(E'Instruction:\nask ' || doc_id || E'\n\nInput:\n' || lang || E'\n\n') AS prompt_hash, source AS vulnerability_type, source AS attack_type, 'easy' AS difficulty, 'fix' AS task_type, doc_id % 2 = 0 AS expected_vulnerable FROM documents""")
def eval_prompt_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.concat(F.lit("ask "), "doc_id").alias("instruction"), F.col("lang").alias("input"), F.col("source").alias("attack_type"), F.lit("easy").alias("difficulty"), F.lit("fix").alias("task_type"), (F.col("doc_id") % 2 == 0).alias("expected_vulnerable"))
    return dataset.eval_prompt_row(rows).select("id", T.prompt_hash(F.col("prompt")).alias("prompt_hash"), "vulnerability_type", "attack_type", "difficulty", "task_type", "expected_vulnerable")


@register("reliability_gate", f"WITH f AS ({FLAT}), c AS (SELECT model, count(*) AS n, {div('count(*) FILTER (WHERE inv)', 'count(*)')} AS failure_rate FROM f GROUP BY 1) SELECT model, n, failure_rate, n > 0 AND failure_rate <= 0.5 AS reliable FROM c")
def reliability_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.reliability(view(spark, sf_dir, "verdicts"), "model")


_PLANNED = ("baseline", "lora_sft", "lora_dpo", "qlora_sft", "qlora_dpo")


@register("run_plan", f"WITH m AS (SELECT {list(_PLANNED)}[model + 1] AS model, count(*) AS verdicts FROM verdicts GROUP BY 1) SELECT m.model, verdicts, adapter, four_bit, output FROM m JOIN ({values([(n, *r) for n, r in compare.RUNS.items()])}) r(model, adapter, four_bit, output) USING (model)")
def run_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The configuration of each model that has verdicts."""
    models = view(spark, sf_dir, "verdicts").select(F.element_at(F.array(*map(F.lit, _PLANNED)), (F.col("model") + 1).cast("int")).alias("model"))
    return compare.run_plan(models.groupBy("model").agg(F.count("*").alias("verdicts")))


_ASKED = "replace(code, 'cur.execute(sql)', 'cur.execute(sql, (value,))')"
_FROM_SQL = lambda i: f"nullif(regexp_extract({_ASKED}, '(?i)SELECT\\s+\\*\\s+FROM\\s+(\\w+)\\s+WHERE\\s+(\\w+)\\s*=', {i}), '')"


@register("schema_inference", f"SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'given' ELSE {_FROM_SQL(1)} END AS schema_table, CASE WHEN o_orderkey % 7 = 0 THEN 'col' ELSE {_FROM_SQL(2)} END AS schema_column, CASE WHEN kind = 1 THEN 'value' ELSE '' END AS parameter FROM code_samples")
def schema_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table, column and parameter of code texts; some rows have the names in fields of their own."""
    k, text = F.col("o_orderkey") % 7 == 0, F.replace("code", F.lit("cur.execute(sql)"), F.lit("cur.execute(sql, (value,))"))
    found = detection.schema_of(F.when(k, " given "), F.when(k, "col"), text)
    return view(spark, sf_dir, "code_samples").select("o_orderkey", found[0].alias("schema_table"), found[1].alias("schema_column"), detection.execute_parameter(text).alias("parameter"))


@register("frameworks", "SELECT o_orderkey, CASE WHEN contains(lower(code), 'sqlalchemy') OR contains(lower(code), 'session.execute') THEN 'sqlalchemy' WHEN contains(lower(code), 'sqlite') THEN 'sqlite3' ELSE 'pymysql' END AS framework FROM code_samples")
def frameworks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "code_samples").select("o_orderkey", T.framework_of(F.col("code")).alias("framework"))


@register("optional_numbers", "SELECT p_partkey, TRY_CAST(CASE p_partkey % 3 WHEN 0 THEN p_retailprice::VARCHAR WHEN 1 THEN 'n/a' END AS DOUBLE) AS price FROM part")
def optional_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("p_partkey") % 3 == 0, F.col("p_retailprice").cast("string")).when(F.col("p_partkey") % 3 == 1, "n/a")
    return table(spark, sf_dir, "part").select("p_partkey", T.optional_double(text).alias("price"))


# ---- dataset building


@register("split_sizes", "WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), e AS (SELECT source, n, least(greatest(round_even(n * 0.12, 0)::BIGINT, 1), n - 1) AS n_eval FROM s) SELECT source, n - n_eval AS n_train, n_eval FROM e")
def split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, held = dataset.split_sizes_of(F.col("n"), 0.12)
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n")).select("source", train.alias("n_train"), held.alias("n_eval"))


@register("unused_prompts", "WITH f AS (SELECT doc_id, text FROM documents d WHERE lang IS DISTINCT FROM 'en' AND NOT EXISTS (SELECT 1 FROM documents u WHERE u.lang = 'en' AND u.text = d.text)) SELECT min(doc_id) AS doc_id FROM f GROUP BY text")
def unused_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of other languages whose text is not in use in English ones, the first of each text."""
    hashed = table(spark, sf_dir, "documents").select("doc_id", "lang", T.prompt_hash(F.col("text")).alias("h"))
    return dataset.unused(hashed.where(~F.col("lang").eqNullSafe("en")), hashed.where("lang = 'en'"), "h", "doc_id").select("doc_id")


_WEIGHTS = ", ".join(f"({i}, '{a}', {w}::DOUBLE)" for i, (a, w) in enumerate(dataset.ATTACKS))


@register("roulette", f"WITH w AS (SELECT *, sum(w) OVER (ORDER BY i) AS c, sum(w) OVER () AS total FROM (VALUES {_WEIGHTS}) v(i, a, w)), d AS (SELECT o_orderkey, ('0x' || substr(sha256('42|' || o_orderkey), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM orders) SELECT o_orderkey, arg_min(a, i) AS attack_type FROM d JOIN w ON u * total <= c GROUP BY 1")
def roulette(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = dataset.uniform(dataset.draw(42, F.col("o_orderkey")))
    return table(spark, sf_dir, "orders").select("o_orderkey", dataset.roulette(dataset.ATTACKS, drawn).alias("attack_type"))


_HARD = "count(*) FILTER (WHERE difficulty = 'hard')"


@register("label_ratios", f"SELECT attack_type, count(*) AS n, {div('count(*) FILTER (WHERE expected_vulnerable)', 'count(*)')} AS vulnerable_share, {div(_HARD, 'count(*)')} AS hard_share FROM verdicts GROUP BY 1")
def label_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.label_ratios(view(spark, sf_dir, "verdicts"), "expected_vulnerable", "difficulty", "attack_type")


#: Sizes of the generated sets: as many rows as these tables have.
CUSTOMERS, SUPPLIERS = "(SELECT count(*) FROM customer)", "(SELECT count(*) FROM supplier)"


def size_of(spark: SparkSession, sf_dir: str, name: str) -> int:
    return table(spark, sf_dir, name).count()


def plan_sql(split: str, total: str) -> str:
    rows = lambda xs: ", ".join(f"({i}, '{n}', {w}::DOUBLE)" for i, (n, w) in enumerate(xs))
    return f"""WITH a(ao, attack_type, aw) AS (VALUES {rows(dataset.ATTACKS)}), d(do_, difficulty, dw) AS (VALUES {rows(dataset.DIFFICULTIES[split])}), t(t_o, task_type, tw) AS (VALUES {rows(dataset.TASKS)}),
p AS (SELECT (ao * 3 + do_) * 2 + t_o AS bucket, attack_type, difficulty, task_type, {total} * (aw * dw * tw) / sum(aw * dw * tw) OVER () AS e FROM a, d, t),
r AS (SELECT *, floor(e) AS low, row_number() OVER (ORDER BY round(e - floor(e), 9) DESC, bucket) AS rk FROM p)
SELECT bucket, attack_type, difficulty, task_type, CAST(low + CASE WHEN rk <= {total} - sum(low) OVER () THEN 1 ELSE 0 END AS BIGINT) AS n FROM r"""


@register("bucket_fill", f"WITH p AS ({plan_sql('train', CUSTOMERS)}), i AS (SELECT bucket, attack_type, difficulty, task_type, unnest(range(1, n + 1)) AS i FROM p) SELECT bucket, attack_type, difficulty, task_type, i, (i + bucket) % 2 = 0 AS expected_vulnerable, true AS new_prompt FROM i")
def bucket_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filled plan; new_prompt says whether no other row has the row's prompt."""
    rows = generate.fill_plan(spark, size_of(spark, sf_dir, "customer")).withColumn("h", T.prompt_hash(T.prompt(F.col("instruction"), F.col("input"))))
    once = rows.groupBy("h").agg(F.count("*").alias("k"))
    return rows.join(once, "h").select("bucket", "attack_type", "difficulty", "task_type", "i", "expected_vulnerable", (F.col("k") == 1).alias("new_prompt"))


@register("bucket_fill_shape", f"WITH p AS ({plan_sql('eval', SUPPLIERS)}) SELECT attack_type, difficulty, task_type, sum(n)::BIGINT AS n, 0::BIGINT AS in_training FROM p WHERE n > 0 GROUP BY ALL")
def bucket_fill_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluation split by group, and how many of its prompts the training split has."""
    asked = lambda rows: rows.withColumn("h", T.prompt_hash(T.prompt(F.col("instruction"), F.col("input"))))
    n = size_of(spark, sf_dir, "customer")
    train = asked(generate.fill_plan(spark, n)).select("h", F.lit(1).alias("seen")).distinct()
    rows = asked(generate.fill_plan(spark, size_of(spark, sf_dir, "supplier"), "eval", used=n)).join(train, "h", "left")
    return rows.groupBy("attack_type", "difficulty", "task_type").agg(F.count("*").alias("n"), F.count("seen").alias("in_training"))


_BANK = values([(t, d, s, w) for t, d, s, _, w in generate.template_rows()])
_TEMPLATES = f"p AS (SELECT template, driver, structure, {CUSTOMERS} * w / sum(w) OVER () AS e FROM ({_BANK}) b(template, driver, structure, w)), r AS (SELECT *, floor(e) AS low, row_number() OVER (ORDER BY round(e - floor(e), 9) DESC, template) AS rk FROM p), q AS (SELECT template, driver, structure, CAST(low + CASE WHEN rk <= {CUSTOMERS} - sum(low) OVER () THEN 1 ELSE 0 END AS BIGINT) AS n FROM r)"


@register("template_quota", f"WITH {_TEMPLATES} SELECT * FROM q")
def template_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.template_quota(spark, size_of(spark, sf_dir, "customer"))


@register("template_mix", f"WITH {_TEMPLATES} SELECT driver, sum(n)::BIGINT AS n, sum(n)::BIGINT AS read_as_driver, sum(n)::BIGINT AS safe FROM q GROUP BY 1")
def template_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the bank by driver: how many, how many the audit reads as that driver, how many match no unsafe pattern."""
    rows = generate.template_rows_of(spark, size_of(spark, sf_dir, "customer"))
    return rows.groupBy("driver").agg(F.count("*").alias("n"), F.count_if(T.driver_of(F.col("code")) == F.col("driver")).alias("read_as_driver"), F.count_if(rules.target_is_safe(F.col("code"))).alias("safe"))


@register("synthetic_splits", "SELECT count(*) AS n, count(*) AS safe_is_bound, count(*) AS unsafe_is_joined, 48::BIGINT AS most_kinds FROM orders")
def synthetic_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many rows as there are orders; 48 combinations of names, all of which come up."""
    rows = dataset.synthetic_rows(spark, size_of(spark, sf_dir, "orders"))
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("chosen").contains(" = ?")).alias("safe_is_bound"), F.count_if(F.col("rejected").contains('" + value')).alias("unsafe_is_joined"), F.countDistinct("db", "tbl", "field").alias("most_kinds"))


@register("four_categories", "SELECT category, count(*) AS n, count(*) AS safe_answers, CASE category WHEN 'repair' THEN count(*) ELSE 0 END AS unsafe_inputs FROM supplier, (VALUES ('normal'), ('ambiguous'), ('adversarial'), ('repair')) v(category) GROUP BY category")
def four_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many requests of each category as there are suppliers."""
    n = size_of(spark, sf_dir, "supplier")
    rows = generate.four_categories(spark, 4 * n, each=n)
    return rows.groupBy("category").agg(F.count("*").alias("n"), F.count_if(rules.target_is_safe(F.col("output"))).alias("safe_answers"), F.count_if(~rules.target_is_safe(F.col("input"))).alias("unsafe_inputs"))


# ---- comparison and reports

_MODELS = "(SELECT *, ['baseline', 'prompt_only', 'lora_sft', 'lora_dpo', 'qlora_sft'][model + 1] AS method FROM verdicts)"


def _methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "verdicts").withColumn("method", F.element_at(F.array(*map(F.lit, compare.METHODS[:5])), (F.col("model") + 1).cast("int")))


@register("sorted_verdicts", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, is_vulnerable FROM verdicts")
def sorted_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts in the order of their id as text: a range-partitioned sort."""
    rows = view(spark, sf_dir, "verdicts").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "is_vulnerable")
    return rows.orderBy(F.col("l_orderkey").cast("string"), "l_linenumber", "l_partkey", "l_suppkey")


@register("group_names", "SELECT DISTINCT attack_type, (dense_rank() OVER (ORDER BY attack_type))::INT AS place FROM verdicts")
def group_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups in the order of reports; a handful of rows after the aggregate."""
    names = view(spark, sf_dir, "verdicts").groupBy().agg(F.array_sort(F.collect_set("attack_type")).alias("names"))
    return names.select(F.posexplode("names").alias("place", "attack_type")).select("attack_type", (F.col("place") + 1).alias("place"))


@register("method_order", f"SELECT method, CASE method WHEN 'baseline' THEN 1 WHEN 'prompt_only' THEN 2 WHEN 'lora_sft' THEN 3 WHEN 'lora_dpo' THEN 4 ELSE 5 END::BIGINT AS place, count(*) AS n FROM {_MODELS} GROUP BY 1")
def method_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _methods(spark, sf_dir).groupBy("method").agg(F.count("*").alias("n")).select("method", compare.method_order(F.col("method")).cast("long").alias("place"), "n")


@register("excluded_methods", f"SELECT method, count(*) AS n FROM {_MODELS} WHERE method NOT IN ('prompt_only', 'lora_dpo') GROUP BY 1")
def excluded_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.without(_methods(spark, sf_dir), "method", ("prompt_only", "lora_dpo")).groupBy("method").agg(F.count("*").alias("n"))


@register("missing_methods", f"SELECT m AS method FROM (VALUES ('baseline'), ('prompt_only'), ('lora_sft'), ('lora_dpo'), ('qlora_sft'), ('qlora_dpo')) e(m) WHERE m NOT IN (SELECT method FROM {_MODELS})")
def missing_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.missing(spark.createDataFrame([(m,) for m in compare.METHODS], "method string"), _methods(spark, sf_dir), "method")


@register("degenerate_models", """WITH m AS (SELECT model, l_orderkey, l_linenumber, l_partkey, is_vulnerable FROM verdicts UNION ALL SELECT 7, l_orderkey, l_linenumber, l_partkey, is_vulnerable FROM verdicts WHERE model = 1),
s AS (SELECT model, string_agg(concat_ws(':', l_orderkey, l_linenumber, l_partkey, is_vulnerable), ',' ORDER BY l_orderkey, l_linenumber, l_partkey, is_vulnerable) AS g FROM m GROUP BY 1)
SELECT b.model, min(a.model) AS same_as FROM s a JOIN s b ON a.g = b.g AND a.model < b.model GROUP BY 1""")
def degenerate_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All models, and a copy of one of them as model 7, which is to be found."""
    rows = view(spark, sf_dir, "verdicts").select("model", "l_orderkey", "l_linenumber", "l_partkey", "is_vulnerable")
    every = rows.unionByName(rows.where("model = 1").withColumn("model", F.lit(7).cast("long")))
    return compare.degenerate(every, "model", ["l_orderkey", "l_linenumber", "l_partkey"], ["is_vulnerable"], F.col("model")).select("model", "same_as")


_RECOMPUTED = ("n_valid", "sql_injection_rate_valid", "strict_f1")


@register("recomputed_metrics", f"WITH b AS ({bundle_sql('model')}), s AS (SELECT model, metric, value FROM (SELECT model, n_valid::DOUBLE AS n_valid, sql_injection_rate_valid, strict_f1 FROM b) UNPIVOT (value FOR metric IN (n_valid, sql_injection_rate_valid, strict_f1))) SELECT model, metric, CASE WHEN model = 3 AND metric = 'n_valid' THEN value + 1 ELSE value END AS stored, value AS recomputed, NOT (model = 3 AND metric = 'n_valid') AS agrees FROM s")
def recomputed_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored figures, one of them wrong, against those of the rows."""
    verdicts = view(spark, sf_dir, "verdicts")
    stored = compare.model_blocks(verdicts).withColumn("n_valid", F.col("n_valid") + (F.col("model") == 3).cast("long"))
    return compare.recomputed(stored, verdicts, "model", list(_RECOMPUTED))


@register("wide_summary", f"WITH f AS (SELECT *, expected_vulnerable AS ev, invalid_extraction AS inv, coalesce(is_vulnerable, false) AS hit FROM {_MODELS}), r AS (SELECT method, count(*) AS n_samples, {div('count(*) FILTER (WHERE inv)', 'count(*)')} AS extraction_failure_rate FROM f GROUP BY 1) SELECT "
    + ", ".join(f"max(CASE WHEN method = '{m}' THEN {c} END) AS {m}_{c}" for m in compare.METHODS[:5] for c in ("n_samples", "extraction_failure_rate")) + " FROM r")
def wide_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.wide_summary(M.bundle(_methods(spark, sf_dir), "method"), "method", ["n_samples", "extraction_failure_rate"])


@register("report_lines", f"WITH f AS ({FLAT}), c AS (SELECT model, {counts('valid_only')} FROM f GROUP BY 1), m AS (SELECT model, {prf()} FROM c) SELECT model, rpad(model::VARCHAR, 20, ' ') || lpad(printf('%.1f%%', precision * 100), 10, ' ') || lpad(CASE WHEN model = 2 THEN 'N/A' ELSE printf('%.1f%%', recall * 100) END, 10, ' ') AS line FROM m")
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = view(spark, sf_dir, "verdicts")
    rated = M.with_rates(verdicts.groupBy("model").agg(*M.confusion().values())).withColumn("recall", F.when(F.col("model") != 2, F.col("recall")))
    return sinks.table_lines(rated, "model", ["precision", "recall"])


@register("ablation_zero_report", f"WITH f AS ({FLAT}), c AS (SELECT model, {counts('valid_only')} FROM f GROUP BY 1), m AS (SELECT model, {prf()} FROM c) SELECT g.range AS \"group\", '| ' || g.range || ' | ' || coalesce(printf('%.4f', m.f1), '0.0000') || ' |' AS line FROM range(0, 7) g LEFT JOIN m ON m.model = g.range")
def ablation_zero_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second form of the ablation report, where a missing figure reads 0.0000."""
    rated = M.with_rates(view(spark, sf_dir, "verdicts").groupBy(F.col("model").alias("group")).agg(*M.confusion().values()))
    rows = spark.range(7).select(F.col("id").alias("group")).join(rated, "group", "left")
    return compare.markdown_rows(rows, ["group"], ["f1"], missing="0.0000")


@register("distribution_json", "WITH c AS (SELECT attack_type, count(*) AS n FROM verdicts GROUP BY 1) SELECT '{' || string_agg('\"' || attack_type || '\":' || n, ',' ORDER BY attack_type) || '}' AS counts, sum(n)::BIGINT AS total FROM c")
def distribution_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A distribution as a map, told as JSON."""
    rows = view(spark, sf_dir, "verdicts").groupBy("attack_type").agg(F.count("*").alias("n"))
    entries = F.array_sort(F.collect_list(F.struct("attack_type", "n")))
    return rows.agg(F.to_json(F.map_from_entries(entries)).alias("counts"), F.sum("n").alias("total"))


def _reported(rows: DataFrame) -> DataFrame:
    """code_samples with an analyser's report made of the row's numbers; some issues lack a field, some reports are no JSON."""
    c = F.col("o_custkey")
    issue = F.struct(F.concat(F.lit("B"), (c % 10 + 600).cast("string")).alias("test_id"), F.when(c % 3 > 0, "MEDIUM").alias("issue_severity"), F.concat(F.lit("issue "), c).alias("issue_text"), F.when(c % 4 == 0, F.lit("?")).otherwise(c.cast("string")).alias("line_number"))
    return rows.withColumn("report", F.when(c % 11 == 0, F.lit("no report")).otherwise(F.to_json(F.struct(F.array(issue).alias("results")))))


_RULED = "(" + matches_any("code", rules.DETECTOR_RULES, True) + ")"
_B608 = "(o_custkey % 11 <> 0 AND o_custkey % 10 = 8)"


@register("detection_json", f"""SELECT o_orderkey, '{{"is_vulnerable":' || ({_B608} OR {_RULED})::VARCHAR || ',"detection_sources":[' || concat_ws(',', CASE WHEN {_B608} THEN '"bandit_b608"' END, CASE WHEN {_RULED} THEN '"rule_based"' END) || ']}}' AS told FROM code_samples""")
def detection_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = detection.detect(_reported(view(spark, sf_dir, "code_samples")), report=F.col("report"))
    return told.select("o_orderkey", F.to_json(F.struct("is_vulnerable", "detection_sources")).alias("told"))


@register("normalised_issues", "SELECT o_orderkey, 'B' || (o_custkey % 10 + 600) AS test_id, CASE WHEN o_custkey % 3 > 0 THEN 'MEDIUM' ELSE 'UNKNOWN' END AS severity, 'UNKNOWN' AS confidence, 'issue ' || o_custkey AS text, CASE WHEN o_custkey % 4 = 0 THEN -1 ELSE o_custkey END::INT AS line_number FROM orders WHERE o_custkey % 11 <> 0")
def normalised_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _reported(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"))
    return rows.select("o_orderkey", F.inline(detection.normalised_issues(F.col("report"))))


@register("nan_rows", "SELECT run_id, step FROM trainlog WHERE step % 5 = 0")
def nan_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = view(spark, sf_dir, "trainlog").withColumn("loss", F.when(F.col("step") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("val_loss")))
    return trainlog.nan_rows(log, "loss").select("run_id", "step")


@register("repeated_code", "SELECT sha256(code) AS key, count(*) AS n FROM code_samples GROUP BY 1 HAVING count(*) > 1")
def repeated_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read-only diagnostics: code texts that more than one row has."""
    return diversity.repeated(view(spark, sf_dir, "code_samples"), F.sha2("code", 256))
