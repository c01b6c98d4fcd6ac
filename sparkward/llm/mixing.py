"""Mixing sources to target weights by entropy balancing.

Targets: sources in code-point order (null last) have weights that repeat, share all words, and stop at a multiple of
their own size; what is cut is shared again by weight. Rates: of all document rates between 0 and the cap whose words
add up to the source's target, those of least relative entropy to one copy each; by duality they are
min(cap, exp(lambda * size / mean size)), and lambda solves the convex dual of its source. Newton steps, kept inside a
bracket, run for all sources together, each step being one aggregation over the distinct (source, size) pairs. Rates
become copies by a hash of the document and one offset per source, which a histogram search sets so that the words taken
meet the target up to about one document. Then a source's largest documents choose anew between the floor and the ceiling of
their rates, all choices of them being compared, so that the words taken come as near to the target as these can.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkward.llm import base

WEIGHTS = (5, 2, 1)
CAP = 3
WORD = r"[^\x20\x09-\x0D]+"
#: Newton steps at most, relative residual that ends them, buckets and passes of the offset search.
STEPS, NEAR, BUCKETS, PASSES = 120, 1e-9, 1024, 4
#: Documents of a source that are chosen anew at the end.
LAST = 32


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> dict[str | None, float]:
    """Target words of each source. The sum is that of the sizes; none exceeds cap times its source's size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out: dict[str | None, float] = {}
    open_, left = list(order), float(sum(sizes.values()))
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if share * weight[s] > cap * sizes[s]]
        if not full:
            out.update((s, share * weight[s]) for s in open_)
            break
        for s in full:
            out[s] = float(cap * sizes[s])
        left -= sum(out[s] for s in full)
        open_ = [s for s in open_ if s not in out]
    return out


#: Rows of a source table that is broadcast; beyond it, Spark shuffles.
BROADCAST_ROWS = 200_000


def _source_frame(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A table with a row for each source, broadcast where its size is small."""
    frame = spark.createDataFrame(rows, columns)
    return F.broadcast(frame) if len(rows) <= BROADCAST_ROWS else frame


def source_totals(pairs: DataFrame) -> dict[str | None, tuple[int, int]]:
    """(words, documents) of each source from pairs (source, size, n)."""
    sums = pairs.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.sum("n").alias("docs"))
    return {r["source"]: (int(r["words"]), int(r["docs"])) for r in sums.collect()}


def solve_dual(spark: SparkSession, pairs: DataFrame, totals: dict[str | None, tuple[int, int]], targets: dict[str | None, float], cap: int = CAP) -> dict[str | None, tuple[float, float]]:
    """(lambda, scale) of each source from pairs (source, size, n); lambda is infinite where every document gets the cap.

    The dual of a source is convex and its gradient is the words at lambda less the target. Sums are of decimals, so
    they do not depend on the order in which tasks end.
    """
    out: dict[str | None, tuple[float, float]] = {}
    state: dict[str | None, list[float]] = {}
    for s, (words, docs) in totals.items():
        scale = max(1.0, words / docs)
        if targets[s] >= cap * words * (1 - 1e-12) or words == 0:
            out[s] = (math.inf, scale)
        else:
            state[s] = [0.0, -math.inf, math.inf, scale]  # lambda, bracket
    for _ in range(STEPS):
        if not state:
            break
        now = _source_frame(spark, [(s, v[0], v[3]) for s, v in state.items()], "source string, lam double, scale double")
        both = pairs.join(now, pairs["source"].eqNullSafe(now["source"])).select(pairs["source"], "size", "n", "lam", (F.col("size") / F.col("scale")).alias("x"))
        e = F.exp(F.least(F.col("lam") * F.col("x"), F.lit(math.log(cap))))
        words = (F.col("n") * F.col("size")).cast("double") * F.least(e, F.lit(float(cap)))
        slope = F.when(F.col("lam") * F.col("x") < math.log(cap), words * F.col("x")).otherwise(0.0)
        sums = both.groupBy("source").agg(F.sum(words.cast("decimal(30,6)")).alias("f"), F.sum(slope.cast("decimal(30,6)")).alias("g")).collect()
        for r in sums:
            s, f, g = r["source"], float(r["f"]) - targets[r["source"]], float(r["g"])
            lam, low, high, scale = state[s]
            if abs(f) <= NEAR * max(1.0, targets[s]):
                out[s] = (lam, scale)
                del state[s]
                continue
            low, high = (lam, high) if f < 0 else (low, lam)
            step = lam - f / g if g > 0 else math.nan
            if not low < step < high:
                step = (low + high) / 2 if math.isfinite(low + high) else (2 * lam + 1 if f < 0 else 2 * lam - 1)
            if step == lam or high - low < 1e-13 * max(1.0, abs(lam)):
                out[s] = (lam, scale)
                del state[s]
            else:
                state[s] = [step, low, high, scale]
    if state:
        raise RuntimeError(f"the dual of {len(state)} sources did not settle in {STEPS} steps")
    return out


def mix(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies (and the columns in keep) for each row of docs.

    taken = copies * size and copies lies between 0 and cap, always. A null text has size 0 and takes nothing; a null
    source is a source of its own, the last. Rows that repeat an id and a size get the same copies, and only a row whose
    id no other row has may be adjusted at the end. A table of the sources (one row for each,
    a configured dimension and not a property of documents) is held by the driver and broadcast.
    """
    draw = F.shiftrightunsigned(F.xxhash64(F.col(id_col).cast("long"), F.lit("mix")), 11) / float(1 << 53)
    kept = [F.col(c) for c in keep if c != id_col]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("__source"), word_count(F.col(text_col)).alias("__size"), draw.alias("__u"), *kept)
    narrow, _ = base.written(spark, rows.select("doc_id", F.col("__source").alias("source"), F.col("__size").alias("size"), F.col("__u").alias("u")), "sizes")
    pairs, _ = base.written(spark, narrow.groupBy("source", "size").agg(F.count("*").alias("n")), "pairs")
    sums = source_totals(pairs)
    totals = {s: words for s, (words, _) in sums.items()}
    targets = source_targets(totals, weights, cap)
    dual = solve_dual(spark, pairs, sums, targets, cap)
    plan = _source_frame(spark, [(s, targets[s], *dual[s]) for s in totals], "source string, target double, lam double, scale double")
    rate = _rate(F.col("lam"), F.col("size"), F.col("scale"), cap)
    rated = narrow.join(plan, narrow["source"].eqNullSafe(plan["source"])).select("doc_id", plan["source"], "size", "target", rate.alias("rate"), "u")
    shifts = _offsets(spark, rated, cap)
    settled = _source_frame(spark, [(s, shifts.get(s, 0.0)) for s in totals], "source string, shift double")
    swaps = _last_documents(spark, rated.join(settled, rated["source"].eqNullSafe(settled["source"])).select(rated["source"], "doc_id", "size", "target", "rate", _copies(F.col("rate"), F.col("u"), F.col("shift"), cap).alias("copies")), cap)
    told = _source_frame(spark, [(s, totals[s], targets[s], *dual[s], shifts.get(s, 0.0), swaps.get(s, {})) for s in totals], "__of string, __source_size long, __target double, __lam double, __scale double, __shift double, __swaps map<bigint, int>")
    full = (rows if keep else narrow.select("doc_id", F.col("source").alias("__source"), F.col("size").alias("__size"), F.col("u").alias("__u"))).join(told, F.col("__source").eqNullSafe(F.col("__of")))
    copies = _copies(_rate(F.col("__lam"), F.col("__size"), F.col("__scale"), cap), F.col("__u"), F.col("__shift"), cap)
    copies = copies + F.coalesce(F.try_element_at("__swaps", F.col("doc_id")), F.lit(0))  # a row for each: their ids are unique
    said = {"size": F.col("__size"), "source_size": F.col("__source_size"), "target": F.col("__target"), "taken": copies * F.col("__size"), "copies": copies}
    return full.select("doc_id", *(c.alias(n) for n, c in said.items() if n not in keep), *kept)


def _rate(lam: Column, size: Column, scale: Column, cap: int) -> Column:
    """min(cap, exp(lam * size / scale)), without overflow; the cap where lam is infinite."""
    tilted = F.exp(F.least(lam * size / scale, F.lit(math.log(cap))))
    return F.when(lam == math.inf, float(cap)).otherwise(F.least(F.lit(float(cap)), tilted))


def best_choice(gap: float, rows: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int]]:
    """(id, change of copies) of rows (id, size, copies, least, most) whose words come nearest to the gap.

    Each row has least or most copies in the end, which are the floor and the ceiling of its rate. All choices of two
    halves are summed, and for each sum of one half the best partner among the other's is found by search.
    """
    start = [min(max(c, lo), hi) for _, _, c, lo, hi in rows]
    gap -= sum((b - r[2]) * r[1] for b, r in zip(start, rows, strict=True))
    turn = np.array([(r[3] + r[4] - 2 * b) * r[1] for b, r in zip(start, rows, strict=True)], np.int64)

    def sums(values: np.ndarray) -> np.ndarray:
        out = np.zeros(1, np.int64)
        for v in values:
            out = np.concatenate((out, out + v))
        return out

    half = len(turn) // 2
    left, right = sums(turn[:half]), sums(turn[half:])
    order = np.argsort(right, kind="stable")
    at = np.searchsorted(right[order], gap - left)
    near = np.stack([np.clip(at - 1, 0, len(right) - 1), np.clip(at, 0, len(right) - 1)])
    far = np.abs(left + right[order][near] - gap)
    k, i = np.unravel_index(int(far.argmin()), far.shape)
    mask = int(i) | int(order[near[k, i]]) << half
    final = [lo + hi - b if mask >> j & 1 else b for j, (b, (_, _, _, lo, hi)) in enumerate(zip(start, rows, strict=True))]
    return [(r[0], f - r[2]) for f, r in zip(final, rows, strict=True) if f != r[2]]


def _last_documents(spark: SparkSession, taken: DataFrame, cap: int) -> dict[str | None, dict[int, int]]:
    """For each source the changes of copies, by document, that bring the words taken nearest to the target.

    The LAST largest documents whose rate is no whole number are chosen anew between floor and ceiling. Documents whose id
    is repeated anywhere are left out, so an id names one row. A source has LAST rows here at most, however many it has.
    """
    sums = taken.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("w"), F.max("target").alias("target")).collect()
    gaps = {r["source"]: r["target"] - r["w"] for r in sums}
    open_ = _source_frame(spark, [(s,) for s, g in gaps.items() if abs(g) >= 1], "source string")
    repeated = taken.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1 and doc_id is not null").select("doc_id")
    low, high = F.floor("rate").cast("int"), F.least(F.lit(cap), F.ceil("rate")).cast("int")
    near = taken.join(open_, taken["source"].eqNullSafe(open_["source"])).select(taken["source"], "doc_id", "size", F.col("copies").cast("int").alias("copies"), low.alias("lo"), high.alias("hi"))
    near = near.where("doc_id is not null and size > 0 and lo < hi").join(base.written(spark, repeated, "repeated-ids")[0], "doc_id", "left_anti")
    first = near.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("size"), "doc_id"))).where(F.col("r") <= LAST)
    found = first.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("r", "doc_id", "size", "copies", "lo", "hi"))).alias("rows")).collect()
    return {r["source"]: dict(best_choice(gaps[r["source"]], [tuple(x)[1:] for x in r["rows"]])) for r in found}


def _copies(rate: Column, u: Column, shift: Column, cap: int) -> Column:
    """The floor or the ceiling of the rate: the ceiling where the fraction, the draw and the offset reach one."""
    return F.least(F.lit(cap), F.greatest(F.floor(rate), F.least(F.ceil(rate), F.floor(rate + u + shift)))).cast("long")


def _offsets(spark: SparkSession, rated: DataFrame, cap: int) -> dict[str | None, float]:
    """For each source the offset in [-1, 1] at which floor(rate + u + offset) copies take the words nearest to its target.

    Words taken are a step function of the offset that rises by a document's size where its copies do: from floors at -1 to
    ceilings at 1. Each pass adds
    up, for each source and bucket of the current bracket, the words that rise there; it then keeps the bucket in which
    the target is passed. A source has at most BUCKETS rows in a pass, whatever its number of documents.
    """
    base_words = F.sum((_copies(F.col("rate"), F.col("u"), F.lit(-1.0), cap) * F.col("size")).cast("decimal(38,0)"))
    start = rated.groupBy("source").agg(base_words.alias("w"), F.max("target").alias("target")).collect()
    state = {r["source"]: (-1.0, 1.0, float(r["w"]), r["target"]) for r in start}
    # a document's copies rise once, at the offset that brings it to the ceiling of its rate; whole rates do not rise
    steps = F.when(F.ceil("rate") > F.floor("rate"), F.array(F.ceil("rate") - F.col("rate") - F.col("u"))).otherwise(F.array().cast("array<double>"))
    for _ in range(PASSES):
        now = _source_frame(spark, [(s, v[0], v[1]) for s, v in state.items()], "source string, low double, high double")
        near = rated.join(now, rated["source"].eqNullSafe(now["source"])).select(rated["source"], "size", "low", "high", F.explode(F.filter(steps, lambda x: (x > F.col("low")) & (x <= F.col("high")))).alias("at"))
        bucket = F.least(F.lit(BUCKETS - 1), F.greatest(F.lit(0), F.ceil((F.col("at") - F.col("low")) / (F.col("high") - F.col("low")) * BUCKETS) - 1)).cast("int")
        rises = near.groupBy("source", "low", "high", bucket.alias("b")).agg(F.sum("size").cast("double").alias("w"))
        order = Window.partitionBy("source").orderBy("b")
        goals = _source_frame(spark, [(s, v[3] - v[2]) for s, v in state.items()], "source string, goal double")
        cum = rises.withColumn("to", F.sum("w").over(order)).join(goals, rises["source"].eqNullSafe(goals["source"])).select(rises["source"], "b", "w", "to", "goal")
        found = cum.groupBy("source").agg(F.min(F.when(F.col("to") >= F.col("goal"), F.struct("b", "w", "to"))).alias("hit"), F.max(F.col("to")).alias("all")).collect()
        done = {r["source"]: r for r in found}
        for s, (low, high, at, target) in list(state.items()):
            r = done.get(s)
            if r is None:
                continue
            if r["hit"] is None:  # all rises together stay below the target
                state[s] = (high, high, at + r["all"], target)
                continue
            width = (high - low) / BUCKETS
            b = r["hit"]["b"]
            state[s] = (low + b * width, low + (b + 1) * width, at + r["hit"]["to"] - r["hit"]["w"], target)
    # the last bucket holds the step that passes the target: stop before or after it, whichever is nearer
    last = _source_frame(spark, [(s, v[0], v[1]) for s, v in state.items()], "source string, low double, high double")
    step = rated.join(last, rated["source"].eqNullSafe(last["source"])).select(rated["source"], "size", "low", "high", F.explode(F.filter(steps, lambda x: (x > F.col("low")) & (x <= F.col("high")))).alias("at"))
    rise = {r["source"]: float(r["w"]) for r in step.groupBy("source").agg(F.sum("size").alias("w")).collect()}
    return {s: (high if abs(at + rise.get(s, 0.0) - target) < abs(at - target) else low) for s, (low, high, at, target) in state.items()}


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; hard rows as mix() states."""
    base.tune(spark)
    return mix(spark, base.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")
