"""Near-duplicate embeddings by cross-polytope hashing.

A vector is turned by a pseudo-random rotation (three rounds of random signs and a fast Hadamard transform); the axis it
is then nearest to, with its sign, is its hash. A table's code joins the hashes of several rotations. Multiprobe: a
vector enters the bucket of its own code and those of the next best codes, taken by what a change of axis loses. Vectors
that share a bucket are candidates, and their cosine decides. Exact copies are one class from the start.

Pairs are never listed. A bucket's vectors are compared in blocks of at most two chunks, and a block gives a number of
links for each of its vectors and a spanning forest. A pair that shares several buckets counts in the least of them. A
crowded bucket gets a centre; vectors nearer to it than half the threshold's angle are a core, whose members are linked
with one another by the triangle inequality, so they need no comparison, however many they are.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkward.llm import base
from sparkward.llm.vectors import matrices, stacked

COSINE = 0.95
#: Buckets that a vector enters in each table, axes of a rotation that probes may take, rotations of a code at most.
PROBES, AXES, MOST = 8, 4, 5
#: Recall at the threshold that the number of tables is set by, in a simulation of so many pairs; tables at most.
RECALL, PAIRS, TABLES = 0.995, 2000, 40
#: Vectors of a bucket beyond which it gets a core, and vectors of a chunk.
HOT, CHUNK = 256, 512


def _padded(d: int) -> int:
    """The length that a rotation works on; short vectors get room, or there would be few different rotations."""
    return max(16, 1 << max(0, d - 1).bit_length())


@functools.lru_cache(maxsize=64)
def _signs(d: int, table: int, k: int) -> np.ndarray:
    rng = np.random.default_rng([d, table, k])
    return rng.choice(np.array([-1.0, 1.0]), (k, 3, _padded(d)))


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Hadamard transform of each row, whose length is a power of two."""
    n, size = x.shape
    h = 1
    while h < size:
        y = x.reshape(n, size // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), 2).reshape(n, size)
        h *= 2
    return x / math.sqrt(size)


def table_keys(x: np.ndarray, t: int, k: int, probes: int = PROBES) -> np.ndarray:
    """The keys of the buckets of table t that each row of x enters, best first."""
    n, d = x.shape
    size = _padded(d)
    axes = min(AXES, size)
    combos = np.array(list(itertools.product(range(axes), repeat=k)))
    probes = min(probes, len(combos))
    wide = np.zeros((n, size))
    wide[:, :d] = x
    loss, hashes = np.zeros((n, len(combos))), []
    for i, signs in enumerate(_signs(d, t, k)):
        y = wide
        for s in signs:
            y = hadamard(y * s)
        size_of = np.abs(y)
        best = np.argsort(-size_of, axis=1, kind="stable")[:, :axes]
        top = np.take_along_axis(size_of, best, 1)
        hashes.append(best * 2 + (np.take_along_axis(y, best, 1) < 0))
        loss += ((top[:, :1] - top) ** 2)[:, combos[:, i]]
    chosen = combos[np.argsort(loss, axis=1, kind="stable")[:, :probes]]
    code = np.full((n, probes), d, np.uint64)  # codes differ by length, too
    for i in range(k):
        code = code * np.uint64(2 * size) + np.take_along_axis(hashes[i], chosen[:, :, i], 1).astype(np.uint64)
    code = (code ^ (code >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return ((np.uint64(t) << np.uint64(56)) | (code >> np.uint64(8))).astype(np.int64)


@functools.lru_cache(maxsize=64)
def layout(n: int, d: int, cosine: float = COSINE) -> tuple[int, int]:
    """(rotations of a code, tables) for n vectors of length d.

    Rotations: so many that unrelated vectors seldom share a bucket. Tables: so many that of simulated pairs at the very
    threshold the set share is found; nearer pairs are found more often.
    """
    size, k = _padded(max(1, d)), 1
    while k < MOST and n * PROBES > 2 * (2 * size) ** k:
        k += 1
    rng = np.random.default_rng(d)
    a, b = rng.standard_normal((2, PAIRS, max(1, d)))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    norm = np.linalg.norm(b, axis=1, keepdims=True)
    b = np.where(norm > 1e-9, cosine * a + math.sqrt(max(0.0, 1 - cosine * cosine)) * b / np.maximum(norm, 1e-9), a)
    found = np.zeros(PAIRS, bool)
    for t in range(TABLES):
        found |= (table_keys(a, t, k)[:, :, None] == table_keys(b, t, k)[:, None, :]).any((1, 2))
        if found.mean() >= RECALL:
            return k, t + 1
    return k, TABLES


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, v): the unit vector's doubles; null where the vector is null, zero or not finite."""
    for batch in batches:
        out: list[bytes | None] = [None] * batch.num_rows
        for rows, x in matrices(batch.column(1)):
            if x.shape[1]:
                scale = np.abs(x).max(1)
                good = np.isfinite(scale) & (scale > 0)
                y = x[good] / scale[good, None]
                y /= np.sqrt((y * y).sum(1))[:, None]
                y += 0.0  # -0.0 is 0.0
                for i, v in zip(rows[good].tolist(), y, strict=True):
                    out[i] = v.tobytes()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["vec_id", "v"])


def _keyed(k: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(batch.schema.get_field_index("v")).to_pylist()
            out: list[list[int]] = [[]] * len(values)
            for rows, x in stacked(values):
                for i, keys in zip(rows.tolist(), np.concatenate([table_keys(x, t, k) for t in range(tables)], axis=1), strict=True):
                    out[i] = np.unique(keys).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int64()))], [*batch.schema.names, "keys"])

    return run


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, s) with the sum of the vectors of each key, kept small: what has gathered is passed on now and then."""
    held: dict[tuple[int, int], np.ndarray] = {}

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in held], pa.int64()), pa.array([s.tobytes() for s in held.values()], pa.binary())], ["key", "s"])

    for batch in batches:
        for key, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            at = (key, len(v))
            held[at] = held.get(at, 0.0) + np.frombuffer(v, np.float64)
        if len(held) > 4096:
            yield told()
            held = {}
    if held:
        yield told()


def _centred(cosine: float):
    """(node, core) from (node, v, key, parts of the sum): core is the key where v is within half the threshold's angle."""
    least = math.cos(math.acos(cosine) / 2) + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, centres = ([], []), {}
            for node, v, key, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, len(v)) not in centres:
                    s = sum((np.frombuffer(p, np.float64) for p in parts if len(p) == len(v)), np.zeros(len(v) // 8))
                    norm = math.sqrt(float(s @ s))
                    centres[key, len(v)] = s / norm if norm > 0 else None
                c = centres[key, len(v)]
                if c is not None and float(c @ np.frombuffer(v, np.float64)) >= least:
                    out[0].append(node)
                    out[1].append(f"{key}:{len(v)}")
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string())], ["node", "core"])

    return run


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For n things that the pairs (a, b) link: the least thing of each one's component."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _first_meeting(x: np.ndarray, y: np.ndarray, key: int) -> np.ndarray:
    """Which pairs of key rows (padded by -1 and -2) share no key below this one."""
    out = np.empty(len(x), bool)
    for i in range(0, len(x), 2048):
        a, b = x[i : i + 2048], y[i : i + 2048]
        both = (a[:, :, None] == b[:, None, :]) & (a < key)[:, :, None]
        out[i : i + 2048] = ~both.any((1, 2))
    return out


def _compare(cosine: float):
    """Blocks, sorted by (key, bi, bj), to rows (node, links, root): what each vector gains, and the forest's edges."""

    def solve(block: list[tuple]) -> Iterator[tuple[int, int, int]]:
        key, bi, bj = block[0][:3]
        for at, x in stacked([r[7] for r in block]):
            if len(at) < 2:
                continue
            rows = [block[i] for i in at]
            near = np.triu(x @ x.T >= cosine, 1)
            if bi != bj:
                part = np.array([r[3] == bj for r in rows])
                near &= part[:, None] != part
            core = np.unique([r[6] or "" for r in rows], return_inverse=True)[1]
            known = np.array([r[6] is not None for r in rows])
            near &= ~((core[:, None] == core) & known[:, None])
            a, b = np.nonzero(near)
            if not len(a):
                continue
            width = max(len(r[8]) for r in rows)
            keys = np.full((2, len(rows), width), -1, np.int64)
            keys[1] = -2
            for i, r in enumerate(rows):
                keys[:, i, : len(r[8])] = r[8]
            new = _first_meeting(keys[0][a], keys[1][b], key)
            a, b = a[new], b[new]
            copies = np.array([r[5] for r in rows], np.int64)
            links = np.bincount(a, copies[b], len(rows)) + np.bincount(b, copies[a], len(rows))
            root = _forest(a, b, len(rows))
            for i in np.flatnonzero(links):
                yield rows[i][4], int(links[i]), rows[root[i]][4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][:3] != row[:3]:
                    out += solve(held)
                    held = []
                held.append(row)
            yield _linked(out)
        yield _linked(list(solve(held)) if held else [])

    return run


def _linked(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["node", "links", "root"])


def _cores(spark: SparkSession, classes: DataFrame, seats: DataFrame, hot: int, cosine: float) -> DataFrame:
    """(node, core) of the vectors near the centre of the fullest crowded bucket they are in."""
    crowded, _ = base.written(spark, seats.groupBy("key").agg(F.count("*").alias("k")).where(F.col("k") > hot), "crowded")
    chosen, _ = base.written(spark, seats.join(crowded, "key").groupBy("node").agg(F.max_by("key", F.struct("k", "key")).alias("key")), "chosen")
    placed, _ = base.written(spark, classes.select("node", "v").join(chosen, "node"), "placed")
    sums, _ = base.written(spark, placed.select("key", "v").mapInArrow(_sums, "key long, s binary").groupBy("key").agg(F.collect_list("s").alias("parts")), "centres")
    return placed.join(sums, "key").select("node", "v", "key", "parts").mapInArrow(_centred(cosine), "node long, core string")


def _blocks(seats: DataFrame, per: DataFrame, chunk: int) -> DataFrame:
    """(key, bi, bj, own, node): which chunks of a bucket meet where.

    The largest core of a crowded bucket stands in chunks below zero, which meet the other chunks and not one another.
    """
    own = F.when(F.col("total") <= chunk, 0).when(F.col("core") == F.col("main"), -1 - F.pmod(F.xxhash64("node"), F.ceil(F.col("most") / chunk))).otherwise(F.pmod(F.xxhash64("node"), F.ceil((F.col("total") - F.col("most")) / chunk)))
    a, o = F.ceil(F.col("most") / chunk).cast("int"), F.ceil((F.col("total") - F.col("most")) / chunk).cast("int")
    met = seats.join(per, "key").withColumn("own", own.cast("int")).withColumn("a", F.when(F.col("total") <= chunk, 0).otherwise(a)).withColumn("o", F.when(F.col("total") <= chunk, 1).otherwise(o))
    others = F.transform(F.sequence(F.lit(0), F.col("o") - 1), lambda j: F.when(F.col("own") < 0, F.struct(F.col("own").alias("bi"), j.alias("bj"))).otherwise(F.struct(F.least("own", j).alias("bi"), F.greatest("own", j).alias("bj"))))
    cores = F.when((F.col("own") >= 0) & (F.col("a") > 0), F.transform(F.sequence(F.lit(1), F.greatest(F.col("a"), F.lit(1))), lambda i: F.struct((-i).alias("bi"), F.col("own").alias("bj")))).otherwise(F.array().cast("array<struct<bi:int,bj:int>>"))
    return met.select("key", "node", "core", "own", F.explode(F.concat(others, cores)).alias("b")).select("key", "b.bi", "b.bj", "own", "node", "core")


def link(spark: SparkSession, rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, hot: int = HOT, chunk: int = CHUNK) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row: the rows linked with it directly, and the least id reachable.

    Vectors that are null, empty, zero or hold null, NaN or infinite entries link with nothing. Vectors of different
    lengths don't link. Copies link with one another, so a row that repeats has its copies among its links. Rows without
    an id link like others and take no part in the least id; they are kept only if they have no id and no link. Only ids
    and vectors are read, so other columns may have any name. An empty table gives an empty one.
    """
    given = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    units, _ = base.written(spark, given.mapInArrow(_unit, "vec_id long, v binary"), "units")
    kinds = units.where("v is not null").groupBy("v").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))
    classes, _ = base.written(spark, kinds.withColumn("node", F.monotonically_increasing_id()), "classes")
    sizes = classes.groupBy((F.length("v") / 8).cast("int").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return units.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    k, tables = layout(1 << int(sizes["count"]).bit_length(), sizes["d"], cosine)
    keyed, _ = base.written(spark, classes.select("node", "n", "v").mapInArrow(_keyed(k, tables), "node long, n long, v binary, keys array<long>"), "keyed")
    seats = keyed.select("node", F.explode("keys").alias("key"))
    cores, _ = base.written(spark, _cores(spark, keyed, seats, hot, cosine), "cores")
    seats = seats.join(cores, "node", "left")
    by_core = seats.groupBy("key", "core").agg(F.count("*").alias("k"))
    main = F.max(F.when(F.col("core").isNotNull(), F.struct("k", "core")))
    per = by_core.groupBy("key").agg(F.sum("k").alias("total"), main.alias("main")).select("key", "total", F.col("main.core").alias("main"), F.coalesce("main.k", F.lit(0)).alias("most"))
    per, _ = base.written(spark, per.where("total > 1 and total > most"), "buckets")  # a bucket of one core has nothing to compare
    blocks, _ = base.written(spark, _blocks(seats, per, chunk), "blocks")
    full = blocks.join(keyed, "node").select("key", "bi", "bj", "own", "node", "n", "core", "v", "keys")
    full = full.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
    found, _ = base.written(spark, full.mapInArrow(_compare(cosine), "node long, links long, root long"), "links")
    in_core, _ = base.written(spark, cores.join(classes.select("node", "n"), "node").groupBy("core").agg(F.sum("n").alias("all"), F.min("node").alias("root")), "core-sizes")
    members, _ = base.written(spark, cores.join(in_core, "core").join(classes.select("node", "n"), "node").select("node", (F.col("all") - F.col("n")).alias("links"), "root"), "members")
    both = found.unionByName(members)
    roots = base.components(spark, both.select(F.col("node").alias("u"), F.col("root").alias("v")))
    roots, _ = base.written(spark, roots, "roots")
    lead, _ = base.written(spark, classes.select("node", "least").join(roots, "node").groupBy("component").agg(F.min("least").alias("lead")), "leads")
    gained, _ = base.written(spark, both.groupBy("node").agg(F.sum("links").alias("links")), "gained")
    told = classes.join(gained, "node", "left").join(roots.join(lead, "component").select("node", "lead"), "node", "left")
    told = told.select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("lead", "least").alias("lead"))
    told, _ = base.written(spark, told, "told")
    joined = units.join(told, "v", "left")
    component = F.when(F.col("v").isNull(), F.col("vec_id")).otherwise(F.col("lead"))
    return joined.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of embeddings by cosine; hard rows as link() states."""
    base.tune(spark)
    return link(spark, base.table(spark, sf_dir, "embeddings"))


OP11_SQL = """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
g AS (SELECT * FROM v WHERE x IS NOT NULL AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a), n AS (SELECT a AS vec_id, count(*) AS n_links FROM e GROUP BY a)
SELECT c.vec_id, coalesce(n_links, 0) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)"""
