"""Removal of repeated byte strings by suffix arrays, built with the difference-cover algorithm on content-dealt shards.

Every 400-byte window has an anchor, the 200-byte string in it of least hash (leftmost of equals). Equal windows have
equal anchors at equal places, so the suffixes that start in the windows of one anchor can be sorted apart from all
others. Windows of one anchor that follow one another form a snippet; snippets that follow one another and are equal (a
text with a short period) are given twice, and the starts of the rest are known to repeat. Anchors that occur once are dropped; snippets that
are equal as a whole are repeated without further ado and are kept once. The different snippets of an anchor go to one
shard, whose text gets a suffix array: triples at two of three positions are sorted and named, the names' string is
sorted by recursion, the remaining suffixes are sorted by it and merged in, and the first 400 bytes of suffixes that are
adjacent in the order are compared. Anchors with very many different snippets are dealt on: their snippets fall into
parts of a few windows, equal parts are combined into one with a count before the sort, and parts with the same bytes in
common meet in a shard. So a passage that any number of documents share stands once in its shards. Where these documents
go on in different ways, the last windows of the passage meet ever new bytes; a shard of more than HOT different parts is
not sorted, and its windows are counted by digest. So no shard has more than HOT parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkward.llm import base

LENGTH = 400
#: Bytes of a piece that is hashed at once (20 bits hold a place in it), of a suffix array; snippets of an anchor beyond
#: which its windows are dealt on, in groups of so many starts.
PIECE, SHARD, HOT, FEW = 1 << 20, 1 << 19, 1000, 8
#: Rows of a batch of snippets.
ROWS = 1 << 14
#: Bytes of snippets that a sorting task gets on average.
TASK = 4 << 20
FACTOR = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of FACTOR and of its inverse modulo 2**64."""
    if "up" not in _powers:
        for name, f in (("up", FACTOR), ("down", pow(FACTOR, -1, 1 << 64))):
            steps = np.full(PIECE, f, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"][:n], _powers["down"][:n]


def anchors(piece: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of the piece: the hash of its anchor and the anchor's place."""
    k = length // 2
    up, down = _power(len(piece))
    total = np.zeros(len(piece) + 1, np.uint64)
    np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * down, out=total[1:])
    h = (total[k:] - total[:-k]) * up[: len(piece) - k + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    low = np.uint64((1 << 20) - 1)
    least = base.sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), length - k + 1)
    place = (least & low).astype(np.int64)
    return h[place], place


def _folded(view: np.ndarray, begins: np.ndarray, ends: np.ndarray, h: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Runs (first, last + 1) of three or more snippets that are the same bytes, each beginning where the one before ends.

    Such a run is a text with a period: a rule of dashes, blanks, a repeated word.
    """
    n = ends - begins
    same = np.concatenate(([False], (h[1:] == h[:-1]) & (n[1:] == n[:-1]), [False]))
    edge = np.flatnonzero(same[1:] != same[:-1])
    out = []
    for i, j in zip(edge[::2].tolist(), (edge[1::2] + 1).tolist(), strict=True):
        x, y, step = int(begins[i]), int(ends[j - 1]) + length - 1, int(n[i])
        if j - i > 2 and (view[x : y - step] == view[x + step : y]).all():
            out.append((i, j))
    return out


def snippets(data: bytes, bounds: list[tuple[int, int]], length: int) -> Iterator[tuple[int, int, int, int | None, int]]:
    """(text, first start, number of starts, anchor hash, digest) of every snippet of the texts data[a:b] in bounds.

    Of a run of equal snippets two are given as such; the starts of the others, which repeat for certain, follow as one
    row without an anchor. So a text with a short period has few rows, however long it is.
    """
    import xxhash

    view = np.frombuffer(data, np.uint8)
    digest = xxhash.xxh64_intdigest
    step = PIECE - length + 1
    i = 0
    while i < len(bounds):
        a, b = bounds[i]
        if b - a < length:
            i += 1
            continue
        if b - a > PIECE:  # one text in several pieces that overlap by length - 1
            parts = [(i, i + 1, at, min(b, at + PIECE)) for at in range(a, b - length + 1, step)]
            i += 1
        else:
            j = i + 1
            while j < len(bounds) and bounds[j][1] - a <= PIECE:
                j += 1
            parts, i = [(i, j, a, bounds[j - 1][1])], j
        for first, last, lo, hi in parts:
            if hi - lo < length:
                continue
            h, place = anchors(view[lo:hi], length)
            new = np.ones(len(place), bool)
            new[1:] = place[1:] != place[:-1]
            for t in range(first, last):
                x, y = max(bounds[t][0], lo) - lo, min(bounds[t][1], hi) - lo - length + 1
                if y <= x:
                    continue
                cuts = np.flatnonzero(new[x + 1 : y]) + x + 1
                begins, ends = np.concatenate(([x], cuts)), np.concatenate((cuts, [y]))
                names = h[begins]
                single = np.ones(len(begins), bool)
                for a2, b2 in _folded(view[lo:hi], begins, ends, names, length):
                    single[a2 + 2 : b2] = False
                    start = lo + int(begins[a2 + 2])
                    yield t, start - bounds[t][0], int(ends[b2 - 1] - begins[a2 + 2]), None, 0
                for s, e, name in zip(begins[single].tolist(), ends[single].tolist(), names[single].tolist(), strict=True):
                    start = lo + s
                    yield t, start - bounds[t][0], e - s, name, digest(data[start : start + e - s + length - 1], int(place[s]) - s)


def suffix_order(s: np.ndarray) -> np.ndarray:
    """The suffix array of s (non-negative numbers) by the difference cover of {1, 2} modulo 3."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    m = int(s.max()) + 2
    t = np.concatenate((s.astype(np.int64) + 1, np.zeros(3, np.int64)))
    ones = np.arange(1, n + (n % 3 == 1), 3)  # where n leaves 1, the empty suffix separates the two halves
    twos = np.arange(2, n, 3)
    sample = np.concatenate((ones, twos))
    if m < 1 << 21:
        triple = (t[sample] * m + t[sample + 1]) * m + t[sample + 2]
    else:
        _, pair = np.unique(t[sample] * m + t[sample + 1], return_inverse=True)
        triple = pair * m + t[sample + 2]
    order = np.argsort(triple, kind="stable")
    ranked = triple[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    names = np.cumsum(fresh)
    if names[-1] < len(order):
        name = np.empty(len(order), np.int64)
        name[order] = names - 1
        order = suffix_order(name)
    rank = np.zeros(n + 3, np.int64)
    rank[sample[order]] = np.arange(1, len(order) + 1)
    sorted12 = sample[order]
    sorted12 = sorted12[sorted12 < n]
    zero = np.arange(0, n, 3)
    r = len(sample) + 2
    key0 = t[zero] * r + rank[zero + 1]
    by = np.argsort(key0, kind="stable")
    zero, key0 = zero[by], key0[by]
    one, two = sorted12[sorted12 % 3 == 1], sorted12[sorted12 % 3 == 2]
    under1 = np.searchsorted(t[one] * r + rank[one + 1], key0)
    if m * m < (1 << 62) // r:
        deep2, deep0 = (t[two] * m + t[two + 1]) * r + rank[two + 2], (t[zero] * m + t[zero + 1]) * r + rank[zero + 2]
    else:
        _, both = np.unique(np.concatenate((t[two] * m + t[two + 1], t[zero] * m + t[zero + 1])), return_inverse=True)
        deep2, deep0 = both[: len(two)] * r + rank[two + 2], both[len(two) :] * r + rank[zero + 2]
    under2 = np.searchsorted(deep2, deep0)
    out = np.empty(n, np.int64)
    at = np.arange(len(zero)) + under1 + under2
    taken = np.zeros(n, bool)
    taken[at] = True
    out[at] = zero
    out[~taken] = sorted12
    return out


def repeated_starts(texts: list[bytes], starts: list[int], length: int) -> list[np.ndarray]:
    """For each text: which of its first so many starts have a window that also starts anywhere else in the texts."""
    data = b"".join(texts) + bytes(8)
    size = np.array([len(x) for x in texts], np.int64)
    begin = np.cumsum(size) - size
    order = suffix_order(np.frombuffer(data, np.uint8)[: int(size.sum())])
    valid = np.zeros(len(data), np.int8)
    np.add.at(valid, begin, 1)
    np.add.at(valid, begin + np.array(starts), -1)
    valid = np.cumsum(valid).astype(bool)
    order = order[valid[order]]
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    a, b = order[:-1], order[1:]
    for k in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:  # adjacent suffixes, 8 bytes at a time
        same = words[a + k] == words[b + k]
        a, b = a[same], b[same]
    hit = np.zeros(len(data), bool)
    hit[a] = True
    hit[b] = True
    return [hit[x : x + n] for x, n in zip(begin.tolist(), starts, strict=True)]


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


_FOUND = "d long, t long, s long, n int, a long, g long"


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _scan(length: int):
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, t = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows: list[tuple] = []
            texts = batch.column(2).to_pylist()
            bounds, at = [], 0
            for x in texts:
                bounds.append((at, at + len(x)))
                at += len(x)
            for i, s, n, a, g in snippets(b"".join(texts), bounds, length):
                rows.append((d[i], t[i], s, n, None if a is None else _signed(a), _signed(g)))
                if len(rows) == ROWS:
                    yield _batch(rows, "d t s n a g", kinds)
                    rows = []
            yield _batch(rows, "d t s n a g", kinds)

    return run


_CUT = "a long, g long, starts int, ahead int, bytes binary"


def _batch(rows: list[tuple], names: str, kinds: tuple) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names.split())


def _cut(length: int):
    """Snippets' bytes from the texts that hold their first occurrence; ahead is the anchor's place, -1 if not hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data, wants in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for w in wants:
                    ahead = int(anchors(np.frombuffer(data[w["s"] : w["s"] + length], np.uint8), length)[1][0]) if w["hot"] else -1
                    rows.append((w["a"], w["g"], w["n"], ahead, data[w["s"] : w["s"] + w["n"] + length - 1]))
            yield _batch(rows, "a g starts ahead bytes", (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))

    return run


_PARTS = "a long, g long, at int, starts int, shard long, h long"


def _parts(length: int):
    """The parts of hot snippets, without their bytes: a part's shard is a hash of what all its windows have in common.

    Parts lie on a grid of FEW starts that the anchor's place fixes, so equal windows lie in parts of one shard.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            rows = []
            for a, g, n, ahead, data in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                at = 0
                while at < n:
                    to = min(n, at + (ahead - at) % FEW + 1)
                    grid = (ahead - at) // FEW  # distance to the anchor, in parts
                    last = ahead - grid * FEW
                    shard = xxhash.xxh64_intdigest(data[last : last - FEW + 1 + length], (a + grid) & (1 << 64) - 1)
                    rows.append((a, g, at, to - at, _signed(shard), _signed(xxhash.xxh64_intdigest(data[at : to + length - 1], to - at))))
                    at = to
            yield _batch(rows, "a g at starts shard h", (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))

    return run


_PIECES = "shard long, h long, at int, starts int, w1 long, w2 long, bytes binary"


def _pieces(length: int):
    """From (bytes, wants) of hot snippets: the wanted parts with their bytes; of crowded shards, digests of their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            rows: list[tuple] = []
            for data, wants in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for w in wants:
                    lo, n = w["at"], w["starts"]
                    if not w["crowded"]:
                        rows.append((w["shard"], w["h"], 0, n, None, None, data[lo : lo + n + length - 1]))
                        continue
                    for i in range(n):
                        whole = xxhash.xxh3_128_intdigest(data[lo + i : lo + i + length])
                        rows.append((w["shard"], w["h"], i, 1, _signed(whole >> 64), _signed(whole & (1 << 64) - 1), None))
            yield _batch(rows, "shard h at starts w1 w2 bytes", (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))

    return run


def _sorted_shards(length: int):
    """Suffix arrays over whole shards, several together; rows are (u, v, hot, lo, hi) of repeated starts."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        flags = repeated_starts([r[5] for r in rows], [r[4] for r in rows], length)
        out = [(u, v, hot, x, y) for (_, u, v, hot, _, _), f in zip(rows, flags, strict=True) for x, y in _runs(f)]
        return _batch(out, "u v hot lo hi", (pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= SHARD and row[0] != held[-1][0]:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held:
            yield solve(held)

    return run


def _hot_parts(spark: SparkSession, hot: DataFrame, length: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From the snippets of hot anchors: their parts, the pieces to sort, and (shard, h, lo, hi) of starts known to repeat.

    Parts of equal bytes are one piece with a count, and one that occurs twice repeats as a whole. A shard that still has
    more than HOT different pieces (a passage that very many texts share and then leave in different ways) is not sorted:
    its windows differ in a few bytes at their ends only, and are counted by 128-bit digests, one by one.
    """
    parts, _ = base.written(spark, hot.mapInArrow(_parts(length), _PARTS), "parts")
    seen, _ = base.written(spark, parts.groupBy("shard", "h").agg(F.count("*").alias("k"), F.min(F.struct("a", "g", "at", "starts")).alias("x")), "part-kinds")
    per, _ = base.written(spark, seen.groupBy("shard").agg(F.count("*").alias("kinds")).where("kinds > 1"), "part-shards")
    want = F.struct("shard", "h", F.col("x.at").alias("at"), F.col("x.starts").alias("starts"), (F.col("kinds") > HOT).alias("crowded"))
    wants = seen.join(per, "shard").select("x.a", "x.g", want.alias("want")).groupBy("a", "g").agg(F.collect_list("want").alias("wants"))
    pieces, _ = base.written(spark, hot.join(wants, ["a", "g"]).select("bytes", "wants").mapInArrow(_pieces(length), _PIECES), "pieces")
    windows = pieces.where("bytes is null")
    twice, _ = base.written(spark, windows.groupBy("w1", "w2").agg(F.count("*").alias("k")).where("k > 1").select("w1", "w2"), "windows")
    known = windows.join(twice, ["w1", "w2"], "left_semi").select("shard", "h", F.col("at").alias("lo"), (F.col("at") + 1).alias("hi"))
    known = known.unionByName(seen.where("k > 1").select("shard", "h", F.lit(0).alias("lo"), F.col("x.starts").alias("hi")))
    return parts, pieces.where("bytes is not null").select("shard", "h", "starts", "bytes"), known


def repeated_ranges(spark: SparkSession, texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """From (d, t, bytes), the key of a text and its bytes: (d, t, lo, hi) of starts of repeated windows, per snippet."""
    found, found_path = base.written(spark, texts.mapInArrow(_scan(length), _FOUND), "snippets")
    # counts are written tables: what is joined with them is an exchange of its own, which AQE can split at a hot anchor
    sure, _ = base.written(spark, found.where("a is null").select("d", "t", F.col("s").alias("lo"), (F.col("s") + F.col("n")).alias("hi")), "periodic")
    often, often_path = base.written(spark, found.where("a is not null").groupBy("a").count().where("count > 1").select("a"), "often")
    found, path = base.written(spark, found.join(often, "a", "left_semi"), "repeated-anchors")
    base.drop_path(spark, found_path)
    base.drop_path(spark, often_path)
    kinds, kinds_path = base.written(spark, found.groupBy("a", "g").agg(F.count("*").alias("k"), F.min(F.struct("d", "t", "s", "n")).alias("x")), "kinds")
    # an anchor's snippets meet only if there are several kinds of them
    several, several_path = base.written(spark, kinds.groupBy("a").agg(F.count("*").alias("kinds")).where("kinds > 1"), "several")
    wants = kinds.join(several, "a").select("x.d", "x.t", F.struct("a", "g", F.col("x.s").alias("s"), F.col("x.n").alias("n"), (F.col("kinds") > HOT).alias("hot")).alias("want"))
    wants = wants.groupBy("d", "t").agg(F.collect_list("want").alias("wants")).withColumnsRenamed({"d": "d2", "t": "t2"})
    one = texts.join(wants, (F.col("d") == F.col("d2")) & (F.col("t") == F.col("t2"))).dropDuplicates(["d", "t"])
    cut, cut_path = base.written(spark, one.select("bytes", "wants").mapInArrow(_cut(length), _CUT), "cut")
    base.drop_path(spark, several_path)
    parts, pieces, known = _hot_parts(spark, cut.where("ahead >= 0"), length)
    plain = cut.where("ahead < 0").select(F.col("a").alias("shard"), F.col("a").alias("u"), F.col("g").alias("v"), F.lit(False).alias("hot"), "starts", "bytes")
    shards = plain.unionByName(pieces.select("shard", F.col("shard").alias("u"), F.col("h").alias("v"), F.lit(True).alias("hot"), "starts", "bytes"))
    # sorting costs far more than its bytes tell, so the number of tasks follows the bytes and not Spark's advice
    size = shards.agg(F.sum(F.col("starts").cast("long") + length - 1)).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK))
    dealt = shards.repartition(tasks, "shard").sortWithinPartitions("shard")
    hits, _ = base.written(spark, dealt.mapInArrow(_sorted_shards(length), "u long, v long, hot boolean, lo int, hi int"), "repeats")
    known, _ = base.written(spark, known.unionByName(hits.where("hot").select(F.col("u").alias("shard"), F.col("v").alias("h"), "lo", "hi")), "known-parts")
    in_parts = parts.join(known, ["shard", "h"]).select("a", "g", (F.col("at") + F.col("lo")).alias("lo"), (F.col("at") + F.col("hi")).alias("hi"))
    base.drop_path(spark, cut_path)
    whole = kinds.where("k > 1").select("a", "g", F.lit(0).alias("lo"), F.col("x.n").alias("hi"))
    part = hits.where("not hot").select(F.col("u").alias("a"), F.col("v").alias("g"), "lo", "hi").unionByName(in_parts)
    ranges, ranges_path = base.written(spark, whole.unionByName(part.join(whole.select("a", "g"), ["a", "g"], "left_anti")), "snippet-ranges")
    out = found.join(ranges, ["a", "g"]).select("d", "t", (F.col("s") + F.col("lo")).alias("lo"), (F.col("s") + F.col("hi")).alias("hi")).unionByName(sure)
    out, _ = base.written(spark, out.groupBy("d", "t").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges")), "ranges")
    for old in (path, kinds_path, ranges_path):
        base.drop_path(spark, old)
    return out


def cut_repeats(data: bytes, ranges: list[tuple[int, int]], length: int) -> tuple[int, int, bytes]:
    """(bytes removed, maximal removed runs, what is left) when every window that starts in the ranges goes."""
    runs: list[list[int]] = []
    for lo, hi in sorted(ranges):
        if runs and lo <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], hi + length - 1)
        else:
            runs.append([lo, hi + length - 1])
    kept, at = [], 0
    for lo, hi in runs:
        kept.append(data[at:lo])
        at = hi
    return sum(hi - lo for lo, hi in runs), len(runs), b"".join([*kept, data[at:]])


def remove_repeats(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row, with texts also the bytes that are left.

    A byte goes if a string of the length that covers it starts anywhere else too, in the same text or another; matches
    don't cross texts. Null texts are empty; texts shorter than the length keep all. Rows that repeat are documents of
    their own, so they remove each other where they are long enough. Null ids are kept as such.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("d"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("t"), F.coalesce(text, F.lit("")).cast("binary").alias("bytes"), F.col(id_col).cast("long").alias("doc_id"))
    ranges = repeated_ranges(spark, rows.select("d", "t", "bytes"), length).withColumnsRenamed({"d": "d2", "t": "t2"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * texts
        kinds = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * texts
        for b in batches:
            out = []
            for i, data, found in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                n, spans, kept = cut_repeats(data, [(r["lo"], r["hi"]) for r in found or ()], length)
                out.append((i, len(data), n, spans, hashlib.sha256(kept).hexdigest()) + (kept,) * texts)
            cols = list(zip(*out, strict=True)) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    met = rows.join(ranges, (F.col("d") == F.col("d2")) & (F.col("t") == F.col("t2")), "left")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts
    return met.select("doc_id", "bytes", "ranges").mapInArrow(run, schema)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the contract, then text: what is left, with U+FFFD for what a cut left of a character."""
    base.tune(spark)
    got = remove_repeats(spark, base.table(spark, sf_dir, "documents"), texts=True)
    return got.withColumn("text", F.make_valid_utf8(F.col("kept").cast("string"))).drop("kept")
