"""Hard negatives of anchors by bit-sliced integer products.

Components are integers, x = -2^B s + sum of 2^b p_b with bits s, p_b: planes. Each task holds a block of rows and streams
the anchors from a written table. A block's products with an anchor grow plane by plane, the most significant first:
after plane b the rest of a row's product lies between (2^b - 1) times the sum of the anchor's negative and the sum of
its positive components, so every score has an interval that halves with each plane. A row is dropped as soon as its
interval cannot reach the k-th best one so far, or cannot meet the window of any positive. While most rows are alive, a
plane is one matrix product for a group of anchors; later only the living pairs are carried on. Blocks give at most k rows
for each anchor (and positive), and these partial lists are combined by a window over the anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkward.llm import base
from sparkward.llm.vectors import matrices

EVERY, SHIFT_EVERY, LABELS, SCALE = 100, 7, 10, 256
POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
#: Rows of a block, anchors that are multiplied at once, share of living pairs under which pairs are carried one by one.
BLOCK, GROUP, DENSE = 16384, 128, 0.02
#: Components beyond this are clipped, so that a product fits 64 bits up to a length of 2,048.
MOST = (1 << 26) - 1


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uid, vec_id, label, x) with x the integer components as 32-bit numbers; unusable vectors are left out."""
    for batch in batches:
        out: list[bytes | None] = [None] * batch.num_rows
        for rows, v in matrices(batch.column(3)):
            good = np.isfinite(v).all(1) if v.shape[1] else np.ones(len(v), bool)
            x = np.clip(np.floor(SCALE * np.clip(v[good], -MOST, MOST)), -MOST, MOST).astype(np.int32)
            for i, r in zip(rows[good].tolist(), x, strict=True):
                out[i] = r.tobytes()
        coded = pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.binary())], ["uid", "vec_id", "label", "x"])
        yield coded.filter(coded.column(3).is_valid())


class Block:
    """A block of rows of one length, by planes: 0 is the sign's, whose weight is -2^bits, then 2^(bits-1) down to 1."""

    def __init__(self, x: np.ndarray):
        self.bits = max(1, int(np.abs(x).max(initial=0)).bit_length())
        self.x = x
        self.weights = [-(1 << self.bits), *(1 << b for b in range(self.bits - 1, -1, -1))]

    def plane(self, k: int) -> np.ndarray:
        return (self.x < 0 if k == 0 else (self.x >> (self.bits - k)) & 1).astype(np.float64)

    def scores(self, anchors: np.ndarray, alive: np.ndarray, prune) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, anchor, exact product) of the pairs that are still alive after the last plane.

        prune(row, anchor, low, high) says which pairs of those with these intervals stay; rows and anchors come sorted
        by anchor.
        """
        a = anchors.astype(np.float64)
        down, up = np.minimum(a, 0).sum(1), np.maximum(a, 0).sum(1)
        pair_a, pair_r = np.nonzero(alive.T)
        exact = 2.0 ** self.bits * np.abs(a).sum(1).max(initial=0) * 2 < 2.0**53
        s = np.zeros(len(pair_r), np.float64 if exact else np.int64)
        whole, slack = anchors.astype(np.int64), 0.0 if exact else 4096.0  # bounds are doubles, which round beyond 2^53
        for k, w in enumerate(self.weights):
            if not len(pair_r):
                break
            plane = self.plane(k)
            if not exact:  # sums of whole numbers, which doubles would round
                p = plane.astype(np.int64)
                for i in range(0, len(pair_r), 1 << 15):
                    part = slice(i, i + (1 << 15))
                    s[part] += w * (p[pair_r[part]] * whole[pair_a[part]]).sum(1)
            elif len(pair_r) > DENSE * alive.size:
                s += w * (a @ plane.T)[pair_a, pair_r]
            else:
                for i in range(0, len(pair_r), 1 << 15):
                    part = slice(i, i + (1 << 15))
                    s[part] += w * np.einsum("ij,ij->i", plane[pair_r[part]], a[pair_a[part]])
            rest = (1 << (self.bits - k)) - 1  # the most that the planes to come add to a component
            if k + 1 < len(self.weights):
                low, high = s + rest * down[pair_a] - slack, s + rest * up[pair_a] + slack
                stays = prune(pair_r, pair_a, low, high)
                if not stays.all():
                    pair_r, pair_a, s = pair_r[stays], pair_a[stays], s[stays]
        return pair_r, pair_a, s.astype(np.int64)


def _kth_largest(groups: np.ndarray, values: np.ndarray, k: int, n: int) -> np.ndarray:
    """For groups 0 to n-1, given in ascending order: the k-th largest value, -inf for groups with fewer."""
    out = np.full(n, -np.inf)
    starts = np.searchsorted(groups, np.arange(n + 1))
    for g in np.flatnonzero(np.diff(starts) >= k):
        part = values[starts[g] : starts[g + 1]]
        out[g] = np.partition(part, len(part) - k)[len(part) - k]
    return out


def _streamed(uri: str, columns: list[str]) -> Iterator[list[tuple]]:
    """Groups of rows of a written table, read on an executor."""
    import pyarrow.dataset as ds

    fs, path = base.executor_file_system(uri)
    for batch in ds.dataset(path, filesystem=fs, format="parquet").to_batches(columns=columns, batch_size=GROUP):
        if batch.num_rows:
            yield list(zip(*(batch.column(c).to_pylist() for c in columns), strict=True))


def _best(rows: np.ndarray, score: np.ndarray, ids: list[int | None], k: int) -> list[int]:
    """Places of the k first: by falling score, then id (null last), then row."""
    if len(rows) > 4 * k:
        near = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    else:
        near = np.arange(len(rows))
    order = sorted(near.tolist(), key=lambda i: (-score[i], ids[rows[i]] is None, ids[rows[i]] or 0, rows[i]))
    return order[:k]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, np.ndarray, Block]]:
    """(uids, ids, labels, block) from batches of (uid, vec_id, label, x), a few thousand rows at a time."""
    held: list[list] = [[], [], [], []]

    def flush():
        sizes: dict[int, list[int]] = {}
        for i, x in enumerate(held[3]):
            sizes.setdefault(len(x), []).append(i)
        for size, at in sizes.items():
            x = np.frombuffer(b"".join(held[3][i] for i in at), np.int32).reshape(len(at), size // 4)
            yield [held[0][i] for i in at], [held[1][i] for i in at], np.array([held[2][i] for i in at], np.int64), Block(x)

    for batch in batches:
        for c, col in zip(held, batch.columns, strict=True):
            c.extend(col.to_pylist())
        if len(held[0]) >= BLOCK:
            yield from flush()
            held = [[], [], [], []]
    if held[0]:
        yield from flush()


def _positives(uri: str, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for uids, ids, labels, block in _blocks(batches):
            size, order = block.x.shape[1], np.array(uids)
            for group in _streamed(uri, ["uid", "label", "x"]):
                group = [g for g in group if len(g[2]) == 4 * size]
                if not group:
                    continue
                a = np.frombuffer(b"".join(g[2] for g in group), np.int32).reshape(len(group), size)
                alive = (labels[:, None] == np.array([g[1] for g in group])) & (order[:, None] != np.array([g[0] for g in group]))

                def prune(rows, anchors, low, high, n=len(group)):
                    return high >= _kth_largest(anchors, low, k, n)[anchors]

                rows, anchors, score = block.scores(a, alive, prune)
                out = []
                starts = np.searchsorted(anchors, np.arange(len(group) + 1))
                for g in range(len(group)):
                    part = slice(starts[g], starts[g + 1])
                    out += [(group[g][0], uids[rows[part][i]], ids[rows[part][i]], int(score[part][i])) for i in _best(rows[part], score[part], ids, k)]
                yield _table(out, "anchor uid vec_id score")

    return run


def _negatives(uri: str, k: int, low_share: int, high_share: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for uids, ids, labels, block in _blocks(batches):
            size = block.x.shape[1]
            for group in _streamed(uri, ["uid", "label", "x", "positives"]):
                group = [g for g in group if len(g[2]) == 4 * size]
                if not group:
                    continue
                a = np.frombuffer(b"".join(g[2] for g in group), np.int32).reshape(len(group), size)
                alive = labels[:, None] != np.array([g[1] for g in group])
                width = max(len(g[3]) for g in group)
                # a window of scores for each positive; a missing one has none
                least, most = np.full((len(group), width), np.inf), np.full((len(group), width), -np.inf)
                for i, g in enumerate(group):
                    for j, p in enumerate(g[3]):
                        least[i, j], most[i, j] = -(-low_share * p["score"] // 100), high_share * p["score"] // 100

                def prune(rows, anchors, low, high, n=len(group), least=least, most=most):
                    stays = np.zeros(len(rows), bool)
                    for j in range(least.shape[1]):
                        from_, to = least[:, j], most[:, j]
                        sure = (low >= from_[anchors]) & (high <= to[anchors])
                        bar = np.maximum(from_, _kth_largest(anchors[sure], low[sure], k, n))
                        stays |= (high >= bar[anchors]) & (low <= to[anchors])
                    return stays

                rows, anchors, score = block.scores(a, alive, prune)
                out = []
                starts = np.searchsorted(anchors, np.arange(len(group) + 1))
                for g, (uid, _, _, positives) in enumerate(group):
                    r, s = rows[starts[g] : starts[g + 1]], score[starts[g] : starts[g + 1]]
                    for p in positives:
                        at = np.flatnonzero((100 * s.astype(object) >= low_share * p["score"]) & (100 * s.astype(object) <= high_share * p["score"])) if len(s) else np.arange(0)
                        out += [(uid, p["uid"], uids[r[at][i]], ids[r[at][i]], int(s[at][i])) for i in _best(r[at], s[at], ids, k)]
                yield _table(out, "anchor positive uid vec_id score")

    return run


def _table(rows: list[tuple], names: str) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names.split())
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names.split())


def _first(partial: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first k rows of each group with their rank; Spark keeps k rows of a task's group before the shuffle, too."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "uid")
    return partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    spark: SparkSession, rows: DataFrame, anchor: Column, label: Column, *, id_col: str = "vec_id", vector_col: str = "embedding",
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows that anchor (a condition) names.

    A score is the inner product of the integer components floor(256 * x). An anchor's positives are its first other rows
    of the same label; for each, the first rows of other labels whose score lies between low and high hundredths of the
    positive's. Higher scores come first, then smaller ids; null ids come last.

    Rows with a null label, a null vector or entries that are null, NaN or infinite take no part. Vectors meet those of
    their own length only; empty ones score 0. Components beyond 2^26 are clipped. Rows that repeat are rows of their own:
    a repeated anchor has its copy among its positives, and each gives its results. An empty table gives an empty one.
    """
    given = rows.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    named, _ = base.written(spark, given.where("label is not null and v is not null"), "named")
    coded, _ = base.written(spark, named.select("uid", "vec_id", "label", "v").mapInArrow(_coded, "uid long, vec_id long, label long, x binary"), "coded")
    chosen = named.where("anchor").select("uid")
    anchors, uri = base.written(spark, coded.join(chosen, "uid", "left_semi"), "anchors")
    found = coded.mapInArrow(_positives(uri, positives), "anchor long, uid long, vec_id long, score long")
    first, _ = base.written(spark, _first(found, ["anchor"], positives), "positives")
    wants = first.groupBy("anchor").agg(F.collect_list(F.struct("uid", "score")).alias("positives")).withColumnRenamed("anchor", "uid")
    _, uri = base.written(spark, anchors.join(wants, "uid").select("uid", "label", "x", "positives"), "wants")
    found = coded.mapInArrow(_negatives(uri, negatives, low, high), "anchor long, positive long, uid long, vec_id long, score long")
    told = _first(found, ["anchor", "positive"], negatives).select(F.col("anchor"), F.col("positive"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    about = first.select("anchor", F.col("uid").alias("positive"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    ids = anchors.select(F.col("uid").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return told.join(about, ["anchor", "positive"]).join(ids, "anchor").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the ids divisible by 100; labels of ids divisible by 7 are moved on by one. Hard rows as mine() states."""
    base.tune(spark)
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % SHIFT_EVERY == 0, (label + 1) % LABELS).otherwise(label)
    return mine(spark, base.table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0, moved)


OP12_SQL = """WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS x FROM embeddings
WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, r.vec_id, r.label, list_sum(list_transform(list_zip(a.x, r.x), lambda p: p[1] * p[2]))::BIGINT AS score FROM r a JOIN r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS k
FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> s.own WHERE 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, k::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE k <= 10"""
