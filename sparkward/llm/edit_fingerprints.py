"""Document fingerprints by a randomised embedding of edit distance into Hamming distance.

A text is cut into segments where its content says so, so an insertion moves the borders along and later segments stay as
they were. A walk goes through each segment's characters and, at every step, either stays or moves on as a shared random
bit of (step, character) says. Two walks that differ by few edits fall into step again, so the letters read at equal steps
differ in few places. The fingerprint keeps one shared random bit of the letter read at sampled steps, as many from every
doubling of the step number, so short and long segments are covered from end to end. Segments of two texts are aligned by
what stands at their borders. Bands of sampled bits find candidates; the likeness of the whole fingerprints verifies them.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkward.llm import base

#: Characters of a segment at most, letter classes, sampled steps in each doubling, seed of the shared bits.
SEGMENT, CLASSES, GROUP, SEED = 2048, 1024, 32, 20240607
#: A border is where the hash of so many characters is the least within so many places on both sides.
MARK, REACH = 16, 320
#: A key of which two texts have more pairs than this is aligned in order of occurrence.
PAIRS = 64
#: Bands, bits in each, and the likeness from which a candidate is a link.
BANDS, BAND_BITS, THRESHOLD = 16, 12, 0.8
#: Bits of a link band by the size of the corpus; share of equal bits at which a link is missed with the given chance; rows of a block.
LINK_BITS, ALIKE, MISS, BLOCK = (20, 32), 0.9, 0.005, 1024
#: Sampled bits between the ends of two levels of link bands.
LEVEL = 8


def _end(length):
    """A step by which a walk over so many characters has ended but for rare cases."""
    return (2 * length + 4 * np.sqrt(2 * length) + 16).astype(np.int64) * (length > 0)


#: Above any 64-bit hash.
_ALL = 1 << 63
STEPS = int(_end(np.array([SEGMENT]))[0])


def _plan() -> tuple[np.ndarray, np.ndarray]:
    """Sampled steps in ascending order and the number of steps that each stands for."""
    rng = np.random.Generator(np.random.PCG64(SEED + 1))
    steps, weight, low = [np.arange(GROUP)], [np.ones(GROUP)], GROUP
    while low < STEPS:
        high = STEPS if low * 4 > STEPS else low * 2
        steps.append(np.sort(rng.choice(np.arange(low, high), GROUP, replace=False)))
        weight.append(np.full(GROUP, (high - low) / GROUP))
        low = high
    return np.concatenate(steps), np.concatenate(weight)


SAMPLED, WEIGHT = _plan()
WIDTH = len(SAMPLED)


def segments(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of a text's segments, and a 32-bit hash of what each begins with. A text of SEGMENT characters is one."""
    n = len(letters)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.uint32)
    h = np.zeros(max(n - MARK + 1, 0), np.uint64)
    for k in range(MARK):
        h = (h + letters[k : k + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    starts = [0]
    if n > SEGMENT:
        least = base.sliding_min(h, 2 * REACH + 1)
        at = np.flatnonzero(h[REACH : len(h) - REACH] == least)
        # of equal hashes within reach none is a border, as their order says nothing
        gaps = np.diff(at)
        alone = np.ones(len(at), bool)
        alone[1:] &= gaps > REACH
        alone[:-1] &= gaps > REACH
        for border in [*(at[alone] + REACH).tolist(), n]:
            starts += range(starts[-1] + SEGMENT, border, SEGMENT)
            starts.append(border)
        starts.pop()
    begin = np.array(starts, np.int64)
    keys = h[np.minimum(begin, len(h) - 1)] if len(h) else np.zeros(len(begin), np.uint64)
    return np.diff(begin, append=n), (keys >> np.uint64(32)).astype(np.uint32)


class Print(NamedTuple):
    """A fingerprint: sizes and keys of the segments, and their bits, a row for each."""

    sizes: np.ndarray
    keys: np.ndarray
    bits: np.ndarray


class Walks:
    """The shared bits: whether a walk moves on, and the bit that a letter shows at a sampled step."""

    def __init__(self):
        rng = np.random.Generator(np.random.PCG64(SEED))
        self.moves = rng.integers(0, 2, (STEPS, CLASSES), np.uint8)
        self.moves[:, 0] = 0  # a walk stays at the end of its segment
        self.shows = rng.integers(0, 2, (WIDTH, CLASSES), np.uint8)
        self.shows[:, 0] = 0
        # a band samples the bits of one doubling and those before it, so texts of every length have bands
        self.bands = [np.sort(rng.choice(GROUP * (2 + b % (WIDTH // GROUP - 1)), BAND_BITS, replace=False)) for b in range(BANDS)]

    def prints(self, texts: list[str]) -> list[Print]:
        """The fingerprint of each text. All segments walk together, the longest first."""
        every = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        cut = [segments(x) for x in every]
        letters = np.concatenate(every) if every else np.empty(0, np.uint32)
        size = np.concatenate([c[0] for c in cut]) if cut else np.empty(0, np.int64)
        flat = np.zeros(len(letters) + len(size), np.uint16)
        flat[np.arange(len(letters)) + np.repeat(np.arange(len(size)), size)] = 1 + letters % (CLASSES - 1)
        starts = np.cumsum(size + 1) - size - 1
        order = np.argsort(-size, kind="stable")
        at, ends = starts[order].astype(np.int64), _end(size[order])
        out = np.zeros((len(size), WIDTH), np.uint8)
        # how many walks, longest first, are still under way at each step
        active = np.searchsorted(-ends, -np.arange(int(ends.max(initial=0))), side="left")
        column = {int(s): k for k, s in enumerate(SAMPLED)}
        for step, live in enumerate(active.tolist()):
            here = at[:live]
            c = flat.take(here)
            if (k := column.get(step)) is not None:
                out[:live, k] = self.shows[k].take(c)
            here += self.moves[step].take(c)
        back = np.empty_like(out)
        back[order] = out
        parts = np.split(back, np.cumsum([len(c[0]) for c in cut])[:-1]) if cut else []
        return [Print(n, k, bits) for (n, k), bits in zip(cut, parts, strict=True)]

    def band_keys(self, p: Print) -> np.ndarray:
        """A key for each segment and band; -1 where the segment ends before the band's bits."""
        keys = p.bits[:, np.stack(self.bands)].astype(np.int64) @ (1 << np.arange(BAND_BITS))
        return np.where(SAMPLED[[b[-1] for b in self.bands]] < 2 * p.sizes[:, None], keys, -1)

    def equal_bands(self, a: Print, b: Print) -> int:
        """The number of bands whose key is the same in any two segments that are aligned."""
        i, j = aligned(a, b)
        x, y = self.band_keys(a)[i], self.band_keys(b)[j]
        return int(((x == y) & (x >= 0)).any(axis=0).sum())

    def link_bands(self, segments: int) -> np.ndarray:
        """Places of the bits of each link band, counted from the end of its 64 bits.

        A band has about as many keys as there are segments; how many bands follows from ALIKE and MISS.
        """
        size = min(LINK_BITS[1], max(LINK_BITS[0], math.ceil(math.log2(segments + 1))))
        rng = np.random.Generator(np.random.PCG64(SEED + 2))
        n = math.ceil(math.log(MISS) / math.log1p(-(ALIKE**size)))
        return np.stack([rng.choice(2 * GROUP, size, replace=False) - 2 * GROUP for _ in range(n)])

    def link_keys(self, p: Print, bands: np.ndarray) -> list[int]:
        """Keys of band, level and bits, from every segment wherever it stands.

        A level is a run of 64 sampled bits, three quarters of the steps up to its end, as the likeness weighs steps. A
        segment has the last two levels that it fills, the one at a text's end the last three, so that segments of
        somewhat different length share one. A segment of under some 32 characters has none.
        """
        out = []
        for k, size in enumerate(p.sizes.tolist()):
            top = int(np.searchsorted(SAMPLED, 2 * size)) // LEVEL
            for level in range(max(2 * GROUP // LEVEL, top - (2 if k == len(p.sizes) - 1 else 1)), top + 1):
                value = p.bits[k][level * LEVEL + bands].astype(np.uint64) @ (np.uint64(1) << np.arange(bands.shape[1], dtype=np.uint64))
                place = np.arange(len(bands), dtype=np.uint64) << np.uint64(40) | np.uint64((level - 1) << 32)
                out.extend((place | value).view(np.int64).tolist())
        return sorted(set(out))


def printed(p: Print) -> str:
    """The fingerprint as text: the number of characters, then size, key and 64 hex digits of bits for each segment."""
    rows = (f"{n:x}.{k:x}.{b.tobytes().hex()}" for n, k, b in zip(p.sizes.tolist(), p.keys.tolist(), np.packbits(p.bits, axis=1), strict=True))
    return f"{int(p.sizes.sum()):x}:{','.join(rows)}"


def parsed(fingerprint: str) -> Print:
    rows = [x.split(".") for x in fingerprint.partition(":")[2].split(",") if x]
    raw = np.frombuffer(bytes.fromhex("".join(r[2] for r in rows)), np.uint8)
    return Print(np.array([int(r[0], 16) for r in rows], np.int64), np.array([int(r[1], 16) for r in rows], np.uint32), np.unpackbits(raw.reshape(-1, WIDTH // 8), axis=1))


def aligned(a: Print, b: Print) -> tuple[np.ndarray, np.ndarray]:
    """Segments of two texts that belong together, in order: the longest chain of equal keys, and what lies between its
    links, first with first."""
    if len(a.keys) == len(b.keys) and (a.keys == b.keys).all():
        every = np.arange(len(a.keys))
        return every, every
    where: dict[int, list[list[int]]] = {}
    for side, keys in enumerate((a.keys, b.keys)):
        for k, key in enumerate(keys.tolist()):
            where.setdefault(key, [[], []])[side].append(k)
    pairs = [p for x, y in where.values() for p in (zip(x, y) if len(x) * len(y) > PAIRS else ((i, j) for i in x for j in y))]
    tails: list[int] = []  # least end of a chain of each length, and the pair that ends it
    ends: list[int] = []
    before = [-1] * len(pairs)
    pairs.sort(key=lambda p: (p[0], -p[1]))
    for n, (_, j) in enumerate(pairs):
        k = bisect_left(tails, j)
        before[n] = ends[k - 1] if k else -1
        tails[k : k + 1], ends[k : k + 1] = [j], [n]
    chain = []
    n = ends[-1] if ends else -1
    while n >= 0:
        chain.append(pairs[n])
        n = before[n]
    out, i, j = [], 0, 0
    for x, y in [*reversed(chain), (len(a.keys), len(b.keys))]:
        out += zip(range(i, x), range(j, y))
        out.append((x, y))
        i, j = x + 1, y + 1
    x, y = np.array(out[:-1], np.int64).reshape(-1, 2).T
    return x, y


def likeness(a: Print, b: Print) -> float:
    """From 0 (as unrelated texts) to 1 (no sampled step differs); two empty texts are alike.

    Unrelated letters agree in half of their bits. Aligned segments count by the longer one's characters, and steps beyond
    the end of both not at all; a segment without a partner counts as unrelated.
    """
    if not len(a.sizes) or not len(b.sizes):
        return float(len(a.sizes) == len(b.sizes))
    i, j = aligned(a, b)
    longer = np.maximum(a.sizes[i], b.sizes[j])
    counts = np.where(SAMPLED[None, :] < 2 * longer[:, None], WEIGHT[None, :], 0.0)
    agree = (counts * (a.bits[i] == b.bits[j])).sum(axis=1) / counts.sum(axis=1)
    alone = a.sizes.sum() - a.sizes[i].sum() + b.sizes.sum() - b.sizes[j].sum()
    return max(0.0, float(((2 * agree - 1) * longer).sum() / (longer.sum() + alone)))


def edited_text(text: str, other: str) -> str:
    """text with its last half replaced by the first as many characters of the other."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order, the first row of the next partition last (look): each row is set against the row after it."""
    walks = Walks()
    held: list[tuple[int | None, str]] = []
    ended = False
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "bands_edited", "linked_edited", "linked_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.bool_(), pa.bool_()]
    for b in batches:
        for i, text, look in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            if not (look and ended):
                held.append((i, text or ""))
            ended |= look
        if len(held) < 2:
            continue
        texts = [t for _, t in held]
        edits = [edited_text(t, o) for t, o in zip(texts, texts[1:])]
        every = walks.prints(texts + edits)
        own, other = every[: len(texts)], every[len(texts) :]
        cols: list[list] = [[] for _ in names]
        for k, e in enumerate(edits):
            edited, after = likeness(own[k], other[k]), likeness(own[k], own[k + 1])
            bands, next_bands = walks.equal_bands(own[k], other[k]), walks.equal_bands(own[k], own[k + 1])
            row = (held[k][0], len(texts[k]), hashlib.sha256(e.encode()).hexdigest(), printed(own[k]), printed(other[k]), edited, after, bands, bands > 0 and edited >= THRESHOLD, next_bands > 0 and after >= THRESHOLD)
            for c, v in zip(cols, row, strict=True):
                c.append(v)
        held = held[-1:]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)


def against_next(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, whose end comes from the next document.

    Documents stand in order of descending id, null ids last and repeated ids by the hash of their text; after the last
    comes the first, and a single document follows itself. Null texts are empty. The texts are shuffled once, into
    ranges of ids; the first row of each range is sent to the range before it as well, so no task needs another's rows.
    The driver holds the borders and first rows of the ranges, a row for each partition.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("h"))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = rows.where("doc_id is not null").stat.approxQuantile("doc_id", [k / n for k in range(1, n)], 1 / (8 * n)) if n > 1 else []
    points = [(False, -int(x), _ALL) for x in cuts]
    # an id that very many rows have, and null, is cut into ranges of text hashes
    total = rows.count()
    often = rows.groupBy("doc_id").count().where(F.col("count") > max(1000, total // n)).collect()  # n rows at most
    for r in often:
        parts = -(-r["count"] * n // total)
        points += [(r["doc_id"] is None, -(r["doc_id"] or 0), (_ALL * 2 * k // parts) - _ALL) for k in range(parts)]
    points = sorted(set(points))

    def placed(ids: pd.Series, none: pd.Series, hashes: pd.Series) -> pd.Series:
        # ranges are numbered from the largest ids on; null ids go last
        return pd.Series([bisect_right(points, (z, -d, h)) for d, z, h in zip(ids.tolist(), none.tolist(), hashes.tolist(), strict=True)], dtype="int32")

    number = F.pandas_udf(placed, "int")

    def range_of(name: str) -> Column:
        return number(F.coalesce(name, F.lit(0).cast("long")), F.col(name).isNull(), F.col("h"))

    order = F.struct(F.col("doc_id").isNull().alias("z"), (-F.col("doc_id")).alias("d"), "h")
    heads = rows.select("doc_id", "h").withColumn("range", range_of("doc_id")).groupBy("range").agg(F.min(order).alias("head")).orderBy("range").collect()
    if not heads:
        return rows.where("false").mapInArrow(_judge, _JUDGED)
    before = {r["range"]: heads[k - 1]["range"] for k, r in enumerate(heads)}  # of the first range: the last one
    first = {(r["head"]["z"], r["head"]["d"], r["head"]["h"]): r["range"] for r in heads}
    table = spark.createDataFrame([(*k, before[r]) for k, r in first.items()], "z boolean, d long, hh long, to int")
    table = F.broadcast(table)  # a row for each partition
    here = rows.withColumn("range", range_of("doc_id"))
    found = here.join(table, (F.col("doc_id").isNull() == F.col("z")) & (-F.col("doc_id")).eqNullSafe(F.col("d")) & (F.col("h") == F.col("hh")), "left")
    targets = F.when(F.col("to").isNull(), F.array(F.struct(F.col("range").alias("range"), F.lit(False).alias("look")))).otherwise(F.array(F.struct(F.col("range").alias("range"), F.lit(False).alias("look")), F.struct(F.col("to").alias("range"), F.lit(True).alias("look"))))
    sent = found.select("doc_id", "text", "h", F.inline(targets))
    dealt = sent.repartitionById(len(points) + 1, F.col("range")).sortWithinPartitions("look", F.desc_nulls_last("doc_id"), "h")
    return dealt.select("doc_id", "text", "look").mapInArrow(_judge, _JUDGED)


_JUDGED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, bands_edited int, linked_edited boolean, linked_next boolean"


def _joined_up(threshold: float):
    """Blocks of (task, p, fingerprint, side), sorted by task, to (x, y): a forest of verified links in each block.

    Two texts are compared only while nothing links them yet, so a block of texts that are all alike takes one comparison
    for each, and what comes out is never more than a text's first link. side tells chunks that meet apart; null: all meet.
    """

    def solve(block: list[tuple]) -> Iterator[tuple[int, int]]:
        parent = list(range(len(block)))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        prints = [parsed(r[2]) for r in block]
        for i, x in enumerate(block):
            for j in range(i):
                y = block[j]
                if (x[3] is None or x[3] != y[3]) and root(i) != root(j) and likeness(prints[i], prints[j]) >= threshold:
                    parent[root(i)] = root(j)
                    yield y[1], x[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            out: list[tuple[int, int]] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][0] != row[0]:
                    out += solve(held)
                    held = []
                held.append(row)
            yield _edges(out)
        yield _edges(list(solve(held)) if held else [])

    return run


def _edges(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], ["u", "v"])


def near_classes(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id of every row: the least id that verified links between texts of a common band reach.

    Texts of equal fingerprints are one from the start. A band that more than BLOCK fingerprints have is dealt in salted
    blocks, and each two of its blocks meet in a task of their own. Pairs are not listed: a block gives a forest of its
    links. Null and empty texts have no band, so each is a class of its own, and so is a row without an id.
    """
    text = F.col(text_col).cast("string")
    pieces = docs.agg(F.sum(F.ceil(F.length(text) / REACH))).first()[0] or 0

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walks = Walks()
        bands = walks.link_bands(int(pieces))
        for b in batches:
            found = walks.prints([t or "" for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(printed, found), pa.string()), pa.array([walks.link_keys(x, bands) for x in found], pa.list_(pa.int64()))], ["doc_id", "fingerprint", "bands"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).mapInArrow(keyed, "doc_id long, fingerprint string, bands array<long>")
    linkable = F.when((F.col("fingerprint") != "0:") & F.col("doc_id").isNotNull(), F.xxhash64("fingerprint"))
    rows, _ = base.written(spark, rows.withColumn("p", linkable), "edit-rows")
    prints, _ = base.written(spark, rows.where("p is not null").groupBy("p").agg(F.min("fingerprint").alias("fingerprint"), F.min("doc_id").alias("least"), F.min_by("bands", "doc_id").alias("bands")), "edit-prints")
    bands = prints.select("p", F.explode(F.array_distinct("bands")).alias("band"))
    # copies share most of their bands with one another only: of bands with the same texts (by 128 bits) one is enough
    marks = [F.bit_xor(F.xxhash64("p", F.lit(i))).alias(f"m{i}") for i in range(2)]
    shared, _ = base.written(spark, bands.groupBy("band").agg(F.count("*").alias("k"), *marks).where("k > 1"), "edit-bands")
    sizes, _ = base.written(spark, shared.groupBy("k", "m0", "m1").agg(F.min("band").alias("band")), "edit-sizes")
    dealt = bands.join(sizes.select("band", F.ceil(F.col("k") / BLOCK).cast("int").alias("parts")), "band")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("p"), F.col("parts")).cast("int"))
    dealt = dealt.select("p", "band", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    task = F.xxhash64("band", F.least("own", "other"), F.greatest("own", "other"))
    # a block meets itself in a task of its own, so two of its texts don't meet again where it meets another
    dealt, _ = base.written(spark, dealt.select("p", task.alias("task"), F.when(F.col("own") != F.col("other"), F.col("own")).alias("side")), "edit-blocks")
    full = dealt.join(prints.select("p", "fingerprint"), "p").select("task", "p", "fingerprint", "side")
    links, _ = base.written(spark, full.repartition("task").sortWithinPartitions("task").mapInArrow(_joined_up(threshold), "u long, v long"), "edit-links")
    roots, _ = base.written(spark, base.components(spark, links), "edit-roots")
    lead = prints.join(roots.withColumnRenamed("node", "p"), "p").groupBy("component").agg(F.min("least").alias("lead"))
    told = prints.join(roots.join(lead, "component").select(F.col("node").alias("p"), "lead"), "p", "left").select("p", F.coalesce("lead", "least").alias("lead"))
    told, _ = base.written(spark, told, "edit-classes")
    return rows.select("doc_id", "p").join(told, "p", "left").select("doc_id", F.coalesce("lead", "doc_id").alias("class_id"))


def op2_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents against its edited text and the next; hard rows as against_next() states."""
    base.tune(spark)
    return against_next(spark, base.table(spark, sf_dir, "documents"))
