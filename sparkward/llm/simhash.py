"""SimHash fingerprints, and their components by Burkhard-Keller trees over shards.

A distinct fingerprint goes to one shard for each set of its bit blocks that two fingerprints with at most four differing
bits are sure to share, so no link is lost; the blocks follow the number of fingerprints. Each shard becomes a BK-tree,
whose children are keyed by their integer Hamming distance to the parent; a search follows only the edges within the
radius. Shards live where their rows are shuffled to. A shard of more than SHARD fingerprints is dealt again by five
interleaved blocks, one of which must agree as well, and what is still too large is split into salted parts: each part is
a tree of its own, and the other parts' fingerprints are sent to it as queries. Links leave a task as a spanning star for
each connected set, at most one row for each row that came in, never as all pairs.

similar_components links texts by a likeness of 0.8 on shingles of five words as well. Shards hold the texts that share
one of their least shingle hashes, trees with a wide radius find who has a neighbour, and their shingle sets decide: that
is quick and connects most. What it missed is found exactly: texts of different components that share a shingle of their
prefixes (without which no two sets are that like) and may be like enough by length, place and the parities of their grams
are compared as well. Long texts have more parities for that, which only the pairs that are still in doubt fetch. Sieves keep
the shingle sets and texts at home that a join would shuffle only to drop or to keep them all.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkward.llm import base

RADIUS = 4
SHINGLE = 4
SEED = 42
#: Fingerprints of a tree at most, pairs in a search front at most, rows that a task gathers before it builds trees.
SHARD, FRONT, GATHER = 4096, 1 << 21, 1 << 18
#: Numbers of blocks: at four differing bits, four fewer agree. More blocks give finer shards and more copies of a row.
BLOCKS = (6, 7, 8)
#: Interleaved blocks by which a crowded shard is dealt again; at four differing bits one of them agrees.
FINER = 5
#: Links of similar texts: words of a shingle, likeness, least shingle hashes that make shards, radius, texts of a tree,
#: bytes of shingle sets that are compared in one task, a row counting for so many more.
WORDS, ALIKE, MARKS, WIDE, CROWD, GRAMS, ROW = 5, 0.8, 4, 16, 4096, 32 << 20, 2048
#: Frequent shingles stand last in the order of the prefixes: from so many texts on, so many of them at most (others follow
#: by hash; any one order of all texts gives the same links); counted in pieces of so many shingles, from so many in a piece on.
FREQUENT, ORDERED, PIECE, IN_PIECE = 4, 1 << 17, 1 << 22, 2
#: Parities of the grams of a text (a power of two, of eight bytes at least), pairs whose parities are compared at once, most
#: parities of a long text.
PARITIES, SLICE, WIDEST = 512, 1 << 16, 1 << 16


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of each run of so many words, repeats included; of all words together where there are fewer."""
    import xxhash

    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-size]))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), (ends[size - 1 :] - 1).tolist(), strict=True)], np.uint64)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def fingerprint_of(hashes: np.ndarray) -> int:
    """Unsigned: a bit is set where over half of the hashes have it; 0 without a hash."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


def simhash(text: str | None) -> int:
    """The unsigned fingerprint of a whole text; 0 where it has no word."""
    return fingerprint_of(shingle_hashes(words_of(text), SHINGLE))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp as a signed long, text_hash) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_signed(simhash(t)) for t in b.column(1).to_pylist()], pa.int64()), b.column(2)], ["doc_id", "fp", "text_hash"])

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash")).mapInArrow(run, "doc_id long, fp long, text_hash long")


class Forest:
    """BK-trees of many shards, built level by level: all pending items of a subtree meet its root at once."""

    def __init__(self, shard: np.ndarray, fp: np.ndarray):
        """shard: numbers from 0 in ascending order; the fingerprints of a shard are distinct."""
        n = len(fp)
        self.fp = fp
        parent, edge = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        first = np.ones(n, bool)
        first[1:] = shard[1:] != shard[:-1]
        self.roots = np.flatnonzero(first)
        owner = self.roots[np.cumsum(first) - 1]
        pending = np.flatnonzero(~first)
        owner = owner[pending]
        while len(pending):
            d = np.bitwise_count(fp[pending] ^ fp[owner]).astype(np.int64)
            label = owner * 65 + d
            order = np.argsort(label, kind="stable")
            pending, owner, d, label = pending[order], owner[order], d[order], label[order]
            first = np.ones(len(pending), bool)
            first[1:] = label[1:] != label[:-1]
            tops = pending[first]
            parent[tops], edge[tops] = owner[first], d[first]
            owner = tops[np.cumsum(first) - 1][~first]
            pending = pending[~first]
        kids = np.flatnonzero(parent >= 0)
        key = parent[kids] * 65 + edge[kids]
        order = np.argsort(key, kind="stable")
        self.kids, self.key = kids[order], key[order]

    def search(self, query: np.ndarray, node: np.ndarray, radius: int, found: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (position in query, node) within the radius, starting at the given roots; in pieces of bounded size.

        A query is not followed any further once the caller has set its flag in found.
        """
        who = np.arange(len(query))
        stack = [(who[i : i + FRONT], node[i : i + FRONT]) for i in range(0, len(who), FRONT)]
        while stack:
            who, node = stack.pop()
            if found is not None:
                who, node = who[~found[who]], node[~found[who]]
            d = np.bitwise_count(query[who] ^ self.fp[node]).astype(np.int64)
            near = d <= radius
            if near.any():
                yield who[near], node[near]
            low = np.searchsorted(self.key, node * 65 + np.maximum(d - radius, 1))
            high = np.searchsorted(self.key, node * 65 + np.minimum(d + radius, 64), side="right")
            count = high - low
            some = count > 0
            who, low, count = who[some], low[some], count[some]
            total = np.cumsum(count)
            at = 0
            while at < len(who):
                done = total[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(total, done + FRONT, side="right")))
                c = count[at:to]
                step = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
                stack.append((np.repeat(who[at:to], c), self.kids[np.repeat(low[at:to], c) + step]))
                at = to


def least_labels(n: int, parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Connected sets of 0..n-1 under the pairs: the least member of each item's set."""
    label = np.arange(n)
    for a, b in parts:
        while True:
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (label[label] != label).any():
                label = label[label]
    return label


def _tasks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Whole tasks (numbered by the first column, ascending) together, at least so many rows but for the last."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            some = pa.Table.from_batches(held)
            task = some.column(0).to_numpy()
            cut = int(np.searchsorted(task, task[-1]))
            if cut:
                yield some.slice(0, cut)
            held, n = some.slice(cut).to_batches(), len(task) - cut
    if n:
        yield pa.Table.from_batches(held)


def _linked(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _tasks(batches, GATHER):
            # tasks ascend; side 0: in the tree and a query, 1: in the tree, 2: a query
            task, side, fp = (some.column(i).to_numpy() for i in range(3))
            fp = fp.view(np.uint64)
            trees, asks = np.flatnonzero(side <= 1), np.flatnonzero(side != 1)
            has, shard = np.unique(task[trees], return_inverse=True)
            forest = Forest(shard, fp[trees])
            at = np.searchsorted(has, task[asks])
            at[at == len(has)] = 0
            met = has[at] == task[asks] if len(has) else np.zeros(len(asks), bool)
            asks, roots = asks[met], forest.roots[at[met]]
            label = least_labels(len(fp), ((asks[q], trees[n]) for q, n in forest.search(fp[asks], roots, radius)))
            moved = np.flatnonzero(label != np.arange(len(fp)))
            yield pa.RecordBatch.from_arrays([pa.array(fp[moved].view(np.int64)), pa.array(fp[label[moved]].view(np.int64))], ["u", "v"])

    return run


def _with_size(spark: SparkSession, shards: DataFrame, most: int, amount: Column) -> DataFrame:
    """shards with column parts: into how many its shard must be split, so that none has more than most of the amount."""
    hot, _ = base.written(spark, shards.groupBy("key").agg(amount.alias("n")).where(F.col("n") > most).select("key", F.ceil(F.col("n") / most).cast("int").alias("parts")), "hot")
    # a written table: broadcast by its size, else both sides of the join can be split
    return shards.join(hot, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))


def _finer(spark: SparkSession, shards: DataFrame, most: int, keys: Column) -> DataFrame:
    """shards, those of more than so many rows dealt again by the finer keys of each row; other columns stay."""
    sized = _with_size(spark, shards, most, F.count("*"))
    others = [c for c in shards.columns if c != "key"]
    return sized.select(*others, F.explode(F.when(F.col("parts") == 1, F.array("key")).otherwise(keys)).alias("key"))


def _dealt(dealt: DataFrame, salt: str) -> DataFrame:
    """(task, side, other columns) of shards with their parts: the salted parts of a shard all meet."""
    others = [c for c in dealt.columns if c not in ("key", "parts")]
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64(salt), F.col("parts")).cast("int"))
    # a part's tree meets its own rows (side 0) and, as queries (side 2), those of every later part
    side = F.when(F.col("other") == F.col("own"), F.lit(0)).when(F.col("other") > F.col("own"), F.lit(1)).otherwise(F.lit(2))
    pairs = dealt.select(*others, "key", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    return pairs.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("task"), side.cast("long").alias("side"), *others)


def block_plan(n: int) -> tuple[list[tuple[int, int]], int]:
    """((shift, bits) of each block, how many agree) for n fingerprints: the fewest blocks whose shards stay small."""
    for blocks in BLOCKS:
        cuts = [64 * k // blocks for k in range(blocks + 1)]
        agree = blocks - RADIUS
        if n <= SHARD // 2 << 64 * agree // blocks:
            break
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])], agree


def link_edges(spark: SparkSession, fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (column fp) that span every set connected at the radius (4 at most)."""
    if not 0 <= radius <= RADIUS:
        raise ValueError("the blocks hold for up to four differing bits")
    blocks, agree = block_plan(fps.count())
    block = [F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << n) - 1)) for s, n in blocks]

    def key(k: int, chosen: tuple[int, ...]) -> Column:
        out = F.lit(k).cast("long")
        for i in chosen:
            out = F.shiftleft(out, blocks[i][1]) + block[i]
        return out

    shards = fps.select("fp", F.explode(F.array(*(key(k, c) for k, c in enumerate(combinations(range(len(blocks)), agree))))).alias("key"))
    masks = [_signed(sum(1 << b for b in range(64) if b % FINER == j)) for j in range(FINER)]
    shards = _finer(spark, shards, SHARD, F.array(*(F.xxhash64("key", F.lit(j), F.col("fp").bitwiseAND(F.lit(m))) for j, m in enumerate(masks))))
    rows = _dealt(_with_size(spark, shards, SHARD, F.count("*")), "fp").select("task", "side", "fp")
    return rows.repartition("task").sortWithinPartitions("task").mapInArrow(_linked(radius), "u long, v long")


def fingerprint_components(spark: SparkSession, prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """From (doc_id, fp, text_hash): (fp, component_id, keep), a row for each distinct fingerprint.

    component_id is the least doc_id of the component; keep the least (doc_id, text_hash), which names the row that stays.
    """
    fps, _ = base.written(spark, prints.groupBy("fp").agg(F.min(F.struct("doc_id", "text_hash")).alias("keep"), F.min("doc_id").alias("low")), "fps")
    linked, _ = base.written(spark, link_edges(spark, fps, radius), "links")
    sets = base.components(spark, linked)
    members = fps.join(sets.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    members, _ = base.written(spark, members.select("fp", "component", "keep", "low"), "members")
    least, _ = base.written(spark, members.groupBy("component").agg(F.min("keep").alias("keep"), F.min("low").alias("component_id")), "least")
    out = members.select("fp", "component").join(least, "component").select("fp", "component_id", "keep")
    return base.written(spark, out, "fp-components")[0]


def near_duplicates(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable) for each row of docs.

    Null and empty texts have fingerprint zero and link like others. Rows with a null doc_id belong to their component
    but never name it, unless all ids in it are null. An empty table gives an empty result.
    """
    prints, _ = base.written(spark, fingerprints(docs, id_col, text_col), "prints")
    found = fingerprint_components(spark, prints, radius).select("fp", "component_id")
    return prints.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def parities_of(grams: np.ndarray, many: int = PARITIES) -> bytes:
    """For each of so many sets of grams (a power of two), whether a text holds an odd number of them.

    Of two texts no more parities differ than there are grams that only one of them holds.
    """
    return np.packbits(np.bincount(grams & np.uint32(many - 1), minlength=many) & 1).tobytes()


def wide_parities(grams: np.ndarray) -> bytes | None:
    """As many parities as a text has grams, up to WIDEST; None where PARITIES are enough."""
    many = min(WIDEST, 1 << (len(grams) - 1).bit_length()) if len(grams) else 0
    return parities_of(grams, many) if many > PARITIES else None


def parities_apart(a: bytes, b: bytes) -> int:
    """How many parities of two texts differ; the longer row is folded to the length of the other."""
    x, y = (np.frombuffer(v, np.uint8) for v in (a, b))
    n = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(v.reshape(-1, n), axis=0) for v in (x, y))
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64))


def may_differ(sizes: np.ndarray) -> np.ndarray:
    """How many grams (and parities) of two sets with a likeness of ALIKE differ at most, by the sum of their sizes."""
    return np.floor(sizes * (1 - ALIKE) / (1 + ALIKE) + 1e-6).astype(np.int64)


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text: fingerprint, hash of its words, least hashes of its shingles, parities (long texts: more of them as well),
    and all of them in four bytes each."""
    import xxhash

    for b in batches:
        rows: list[list] = [[], [], [], [], [], []]
        for text in b.column(1).to_pylist():
            words = words_of(text)
            found = np.unique(shingle_hashes(words, WORDS))
            sets = np.unique((found >> np.uint64(32)).astype(np.uint32))
            row = (_signed(fingerprint_of(shingle_hashes(words, SHINGLE))), _signed(xxhash.xxh64_intdigest(b" ".join(words))), found[:MARKS].view(np.int64).tolist(), parities_of(sets), wide_parities(sets), sets.tobytes())
            for c, v in zip(rows, row, strict=True):
                c.append(v)
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *(pa.array(c, k) for c, k in zip(rows, kinds, strict=True))], ["doc_id", "text_hash", "fp", "node", "marks", "parities", "wide", "grams"])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, node) of the rows that have another within the wide radius in their shard."""
    for some in _tasks(batches, GATHER):
        key, node, fp = (some.column(i).to_numpy() for i in range(3))
        _, first, inverse, count = np.unique(np.stack((key, fp)), axis=1, return_index=True, return_inverse=True, return_counts=True)
        seen = count > 1  # equal fingerprints are neighbours
        _, shard = np.unique(key[first], return_inverse=True)
        forest = Forest(shard, fp[first].view(np.uint64))
        for a, b in forest.search(forest.fp, forest.roots[shard], WIDE, seen):
            seen[a[a != b]] = True
        keep = np.flatnonzero(seen[inverse.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (key, node)], ["key", "node"])


def alike_pairs(side: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs of rows with a Jaccard likeness of ALIKE or more that span each set so connected.

    Rows of side 0 are compared among themselves, those of side 1 with those of side 2.

    Rows are compared if they share one of their rarest grams: of a row with n grams the n - ceil(ALIKE * n) + 1 rarest
    hold one of any row as like it as that. Pairs in one set already are not compared.
    """
    size = np.array([len(x) for x in sets], np.int64)
    start = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(sets)), size)
    grams, every, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.lexsort((every, count[every], owner))
    gram = every[order]
    place = np.arange(len(owner)) - start[owner]
    rare = (place < (size - np.ceil(ALIKE * size - 1e-9).astype(np.int64) + 1)[owner]) & (count[gram] > 1)
    row, gram = owner[rare], gram[rare]  # rows ascend
    by = np.argsort(gram, kind="stable")
    lists, low = np.unique(gram[by], return_index=True)
    groups = np.split(row[by], low[1:])
    group_of = np.searchsorted(lists, gram)
    cuts = np.searchsorted(row, np.arange(len(sets) + 1))
    label, done, own = np.arange(len(sets)), np.zeros(len(groups), bool), np.zeros(len(grams), bool)
    out = []
    for i in range(len(sets)):
        met = np.zeros(len(sets), bool)
        for g in group_of[cuts[i] : cuts[i + 1]].tolist():
            if not done[g]:
                met[groups[g]] = True
                done[g] = groups[g][-1] <= i + 1 or (label[groups[g]] == label[i]).all()
        may = np.flatnonzero(met[i + 1 :]) + i + 1
        n = size[i]
        may = may[(label[may] != label[i]) & (np.minimum(size[may], n) >= ALIKE * np.maximum(size[may], n) - 1e-9) & ((side[may] != side[i]) | (side[i] == 0))]
        if not len(may):
            continue
        own[every[start[i] : start[i] + n]] = True
        ends = np.cumsum(size[may])
        at = np.arange(ends[-1]) + np.repeat(start[may] - ends + size[may], size[may])
        both = np.add.reduceat(own[every[at]].astype(np.int64), ends - size[may])
        own[every[start[i] : start[i] + n]] = False
        for j in may[both >= ALIKE * (n + size[may] - both) - 1e-9].tolist():
            if label[i] != label[j]:
                out.append((i, j))
                a, b = sorted((label[i], label[j]))
                label[label == b] = a
    return out


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for some in _tasks(batches, 2048):
        task, side, node = (some.column(i).to_numpy() for i in range(3))
        grams = some.column(3).to_pylist()
        cuts = [0, *(np.flatnonzero(np.diff(task)) + 1).tolist(), len(task)]
        u, v = [], []
        for lo, hi in zip(cuts, cuts[1:]):
            for a, b in alike_pairs(side[lo:hi], [np.frombuffer(x, np.uint32) for x in grams[lo:hi]]):
                u.append(int(node[lo + a]))
                v.append(int(node[lo + b]))
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def _sets(spark: SparkSession, wanted: DataFrame, nodes: DataFrame, prints: DataFrame, name: str, column: str = "grams") -> DataFrame:
    """(node, grams or another column) of the wanted nodes (each once), from the row that stands for each.

    The sieve lets few other rows be shuffled; the keys of the join are those of the grouping.
    """
    key = lambda doc_id, text_hash: [F.coalesce(doc_id, F.lit(0)).alias("d"), F.isnull(doc_id).alias("none"), F.col(text_hash).alias("t")]
    stand, _ = base.written(spark, wanted.join(nodes, "node").select("node", *key("keep.doc_id", "keep.text_hash")), f"{name}-nodes")
    keys = ["node", "d", "none", "t"]
    held = base.sieve(spark, stand.select(F.xxhash64(*keys)))
    rows = prints.select("node", *key("doc_id", "text_hash"), column)
    sets = rows.where(held(F.xxhash64(*keys))).join(stand, keys, "left_semi").groupBy(*keys).agg(F.min(column).alias(column))
    return base.written(spark, sets.select("node", column), f"{name}-sets")[0]


def quick_edges(spark: SparkSession, nodes: DataFrame, prints: DataFrame) -> DataFrame:
    """Edges (u, v) between texts with a likeness of ALIKE or more on sets of five-word shingles: most, not all of them.

    nodes has (node, keep, fp, marks), a row for each different text, prints (node, doc_id, text_hash, grams). Two texts of
    that likeness share one of their MARKS least hashes but in one case of 5 ** MARKS, and are within WIDE bits but in
    under one of a hundred. A mark that more than CROWD texts share is dealt again by a second mark; what is crowded even
    so has no tree, and all of it is compared. Texts that have a neighbour meet with their shingle sets, and only these
    sets are shuffled: all of a shard in one task, or in salted parts that meet where they have more than GRAMS bytes.
    Pairs without a shared mark, a second shared mark or so near a fingerprint are left to missed_edges.
    """
    shards = nodes.select("node", "fp", "marks", F.explode("marks").alias("key"))
    second = F.transform(F.filter("marks", lambda m: m > F.col("key")), lambda m: F.xxhash64("key", m))
    second = F.when(F.size("marks") > 1, second).otherwise(F.array("key"))
    rows = _with_size(spark, _finer(spark, shards, CROWD, second).drop("marks"), CROWD, F.count("*"))
    rows, _ = base.written(spark, rows.select("key", "node", "fp", (F.col("parts") > 1).alias("crowded")), "similar-shards")
    trees = rows.where("not crowded").select("key", "node", "fp").repartition("key").sortWithinPartitions("key")
    near = trees.mapInArrow(_neighbours, "key long, node long").unionByName(rows.where("crowded").select("key", "node"))
    near, _ = base.written(spark, near, "neighbours")
    sets = _sets(spark, near.select("node").distinct(), nodes, prints, "near")
    sized = near.join(sets.select("node", (F.octet_length("grams").cast("long") + ROW).alias("n")), "node")
    dealt = _dealt(_with_size(spark, sized, GRAMS, F.sum("n")), "node").select("task", "side", "node")
    told = dealt.join(sets, "node").select("task", "side", "node", "grams")
    return told.repartition("task").sortWithinPartitions("task").mapInArrow(_verified, "u long, v long")


def _often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, n) of the shingles that several texts of a piece of a task hold."""
    held: list[np.ndarray] = []

    def told() -> pa.RecordBatch:
        gram, n = np.unique(np.concatenate(held), return_counts=True)
        several = n >= IN_PIECE
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(gram[several].view(np.int32)), pa.array(n[several].astype(np.int64))], ["gram", "n"])

    many = 0
    for b in batches:
        for grams in b.column(0).to_pylist():
            held.append(np.frombuffer(grams, np.uint32))
            many += len(held[-1])
            if many >= PIECE:
                yield told()
                many = 0
    if held:
        yield told()


def prefix_of(grams: np.ndarray, known: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first n - ceil(ALIKE * n) + 1 of n ascending grams, those in known (ascending) last, by their rank.

    Two sets with a likeness of ALIKE or more have the first of their common grams in both prefixes.
    """
    n = len(grams)
    k = n - int(np.ceil(ALIKE * n - 1e-9)) + 1
    if not len(known):
        return grams[:k]
    at = np.searchsorted(known, grams)
    at[at == len(known)] = 0
    last = known[at] == grams
    first = grams[~last][:k]
    if len(first) == k:
        return first
    return np.concatenate((first, grams[last][np.argsort(rank[at[last]])][: k - len(first)]))


def _prefixes(often):
    """(gram, node, size, rest) of the prefix of each different text of a task; rest: grams from this one on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = often.value
        done: set[int] = set()
        for b in batches:
            nodes, sizes, firsts = [], [], []
            for node, grams in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if node not in done:
                    done.add(node)
                    nodes.append(node)
                    sizes.append(len(grams) // 4)
                    firsts.append(prefix_of(np.frombuffer(grams, np.uint32), known, rank))
            if nodes:
                count = np.array([len(x) for x in firsts])
                size = np.repeat(np.array(sizes, np.int32), count)
                place = np.arange(len(size)) - np.repeat(np.cumsum(count) - count, count)
                columns = (np.concatenate(firsts).view(np.int32), np.repeat(np.array(nodes, np.int64), count), size, (size - place).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["gram", "node", "size", "rest"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by gram and node, those of grams that several nodes hold, each gram and node once."""
    before, sent = None, False  # the last row so far, and whether it has left
    for b in batches:
        if not b.num_rows:
            continue
        some = pa.Table.from_batches([b] if before is None else [before, b]).combine_chunks()
        gram, node = some.column(0).to_numpy(), some.column(1).to_numpy()
        new = np.ones(len(gram), bool)
        new[1:] = (gram[1:] != gram[:-1]) | (node[1:] != node[:-1])
        rows = np.flatnonzero(new)
        same = gram[rows[1:]] == gram[rows[:-1]]
        several = np.zeros(len(rows), bool)
        several[0] = sent
        several[1:] |= same
        several[:-1] |= same
        leave = rows[several][1:] if sent else rows[several]
        yield from some.take(pa.array(leave)).to_batches()
        before, sent = some.slice(int(rows[-1]), 1).combine_chunks().to_batches()[0], bool(several[-1])


def partners(
    task: np.ndarray, side: np.ndarray, size: np.ndarray, rest: np.ndarray, component: np.ndarray, parities: np.ndarray | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one task and of different components that may have a likeness of ALIKE, in pieces of bounded size.

    The rows of a task share a gram; where it is the first that both hold, they have at most the lesser rest in common,
    and of sizes n and m they need ALIKE * (n + m) / (1 + ALIKE). What only one of them holds is then at most
    (n + m) * (1 - ALIKE) / (1 + ALIKE), and no more of their parities (a row of words for each) may differ.
    """
    most = np.floor(rest * (1 + 1 / ALIKE) - size + 1e-6).astype(np.int64)  # size of a partner
    _, group = np.unique(task, return_inverse=True)
    key = (group.astype(np.int64) << 32) + size
    order = np.argsort(key, kind="stable")
    key, group = key[order], group[order].astype(np.int64)
    low = np.arange(1, len(key) + 1)
    count = np.searchsorted(key, (group << 32) + np.minimum(most[order], (1 << 32) - 1), side="right") - low
    who = np.flatnonzero(count > 0)
    low, count = low[who], count[who]
    total = np.cumsum(count)
    at = 0
    while at < len(who):
        done = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, done + FRONT, side="right")))
        c = count[at:to]
        a = order[np.repeat(who[at:to], c)]
        b = order[np.repeat(low[at:to], c) + np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)]
        may = (component[a] != component[b]) & (size[a] <= most[b]) & ((side[a] != side[b]) | (side[a] == 0))
        a, b = a[may], b[may]
        if parities is not None:
            may = np.ones(len(a), bool)
            for i in range(0, len(a), SLICE):
                x, y = a[i : i + SLICE], b[i : i + SLICE]
                differ = np.bitwise_count(parities[x] ^ parities[y]).sum(axis=1, dtype=np.int64)
                may[i : i + SLICE] = differ <= may_differ(size[x] + size[y])
            a, b = a[may], b[may]
        yield a, b
        at = to


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a task that are in any of its pairs, by lengths, places and components."""
    for some in _tasks(batches, GATHER):
        task, side, _, size, rest, component = (some.column(i).to_numpy() for i in range(6))
        met = np.zeros(len(task), bool)
        for a, b in partners(task, side, size.astype(np.int64), rest.astype(np.int64), component):
            met[a] = met[b] = True
        yield from some.filter(pa.array(met)).combine_chunks().to_batches()


def _partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for some in _tasks(batches, GATHER):
        task, side, node, size, rest, component = (some.column(i).to_numpy() for i in range(6))
        parities = np.frombuffer(b"".join(some.column(6).to_pylist()), np.uint64).reshape(-1, PARITIES // 64)
        for a, b in partners(task, side, size.astype(np.int64), rest.astype(np.int64), component, parities):
            u, v = np.minimum(node[a], node[b]), np.maximum(node[a], node[b])
            most = may_differ(size[a].astype(np.int64) + size[b])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (u, v, task[a], most)], ["u", "v", "task", "most"])


def _in_doubt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v, task) of the pairs that may be alike by as many parities as long texts have."""
    for b in batches:
        may = [x is None or y is None or parities_apart(x, y) <= most for most, x, y in zip(*(b.column(i).to_pylist() for i in range(3, 6)), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(i).filter(pa.array(may, pa.bool_())) for i in range(3)], ["u", "v", "task"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v) of the pairs of a task that are alike and not connected yet; its sets come before its pairs."""
    now, sets, label = None, {}, {}

    def top(x: int) -> int:
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for b in batches:
        found: list[tuple[int, int]] = []
        for task, u, v, grams in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            if task != now:
                now, sets, label = task, {}, {}
            if grams is not None:
                sets[u], label[u] = np.frombuffer(grams, np.uint32), u
            elif top(u) != top(v):
                both = len(np.intersect1d(sets[u], sets[v], assume_unique=True))
                if both >= ALIKE * (len(sets[u]) + len(sets[v]) - both) - 1e-9:
                    label[top(u)] = top(v)
                    found.append((u, v))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(2)], ["u", "v"])


def missed_edges(spark: SparkSession, prints: DataFrame, members: DataFrame) -> DataFrame:
    """Edges (u, v) that, with the components of members, span all texts connected by a likeness of ALIKE or more.

    members has (node, component, keep, parities), prints (node, doc_id, text_hash, grams). Every two texts so like share a
    gram of their prefixes in any one order of the grams; frequent ones stand last. Of each gram the texts of different
    components that can be like enough are paired, all of them: a gram of more than GRAMS bytes of sets is dealt to salted
    parts that all meet. Texts that meet none there leave no row. The parities of the others are compared where they meet, so
    that few pairs leave the task, and the more parities of long texts after that. A pair is compared once, and a set goes
    once to each task that compares it. No pair is lost.
    """
    texts = prints.where(F.octet_length("grams") > 0).select("node", "grams")
    counts = texts.select("grams").mapInArrow(_often, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    frequent = counts.orderBy(F.desc("n"), "gram").limit(ORDERED).toArrow().column("gram").to_numpy().view(np.uint32)
    by = np.argsort(frequent)
    often = spark.sparkContext.broadcast((frequent[by], -by))  # the most frequent is the very last
    kinds = "gram int, node long, size int, rest int"
    prefixes = texts.mapInArrow(_prefixes(often), kinds).repartition("gram").sortWithinPartitions("gram", "node")
    shared, _ = base.written(spark, prefixes.mapInArrow(_shared, kinds), "shared")
    rows, _ = base.written(spark, shared.join(members.select("node", "component"), "node").withColumnRenamed("gram", "key"), "prefixes")
    cost = F.sum(F.col("size").cast("long") * 4 + ROW)
    several = rows.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("z"), cost.alias("n")).where("a <> z")
    several, _ = base.written(spark, several.select("key", F.ceil(F.col("n") / GRAMS).cast("int").alias("parts")), "several")
    dealt = _dealt(rows.join(several, "key"), "node").select("task", "side", "node", "size", "rest", "component")
    met = dealt.repartition("task").sortWithinPartitions("task").mapInArrow(_met, dealt.schema)
    met, _ = base.written(spark, met, "met")
    dealt = met.join(members.select("node", "parities"), "node").select("task", "side", "node", "size", "rest", "component", "parities")
    dealt = dealt.repartition("task").sortWithinPartitions("task")
    pairs, _ = base.written(spark, dealt.mapInArrow(_partners, "u long, v long, task long, most long"), "partners")
    pairs, _ = base.written(spark, pairs.groupBy("u", "v").agg(F.min("task").alias("task"), F.min("most").alias("most")), "pairs")
    ends = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    wide = _sets(spark, ends, members, prints, "wide", "wide")
    for x in "uv":
        pairs = pairs.join(wide.select(F.col("node").alias(x), F.col("wide").alias(f"wide_{x}")), x)
    pairs = pairs.select("u", "v", "task", "most", "wide_u", "wide_v").mapInArrow(_in_doubt, "u long, v long, task long")
    pairs, _ = base.written(spark, pairs, "in-doubt")
    needs, _ = base.written(spark, pairs.select("task", F.col("u").alias("node")).unionByName(pairs.select("task", F.col("v").alias("node"))).distinct(), "needs")
    sets = _sets(spark, needs.select("node").distinct(), members, prints, "partner")
    told = needs.join(sets, "node").select("task", F.col("node").alias("u"), F.lit(None).cast("long").alias("v"), "grams")
    told = told.unionByName(pairs.select("task", "u", "v", F.lit(None).cast("binary").alias("grams")))
    return told.repartition("task").sortWithinPartitions("task", F.asc_nulls_first("v")).mapInArrow(_compared, "u long, v long")


def similar_components(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, node) of each row, and (node, component, keep) of each different text.

    Texts of equal words are one node. Nodes are linked where their fingerprints are (within the radius, as op8 links
    them) and where they are alike (quick_edges, and missed_edges for all others). keep is the least (doc_id, text_hash)
    of the component.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    prints, _ = base.written(spark, rows.mapInArrow(_marked, "doc_id long, text_hash long, fp long, node long, marks array<long>, parities binary, wide binary, grams binary"), "marked")
    nodes, _ = base.written(spark, prints.groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("keep"), F.min("fp").alias("fp"), F.min("marks").alias("marks"), F.min("parities").alias("parities")), "nodes")
    with base.passing(spark):
        alike, _ = base.written(spark, quick_edges(spark, nodes.where("size(marks) > 0"), prints), "alike", stays=True)
    fps, _ = base.written(spark, nodes.groupBy("fp").agg(F.min("node").alias("stands")), "fps")
    linked, _ = base.written(spark, link_edges(spark, fps.select("fp"), radius), "links")
    by_print = nodes.join(fps, "fp").select(F.col("node").alias("u"), F.col("stands").alias("v"))
    ends = [fps.select(F.col("fp").alias(x), F.col("stands").alias(f"node_{x}")) for x in "uv"]
    between = linked.join(ends[0], "u").join(ends[1], "v").select(F.col("node_u").alias("u"), F.col("node_v").alias("v"))
    sets = base.components(spark, by_print.unionByName(between).unionByName(alike))
    members, _ = base.written(spark, nodes.join(sets, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "keep", "parities"), "members")
    with base.passing(spark):
        missed, _ = base.written(spark, missed_edges(spark, prints, members), "missed", stays=True)
    if missed.head(1):
        ends = [members.select(F.col("node").alias(x), F.col("component").alias(f"component_{x}")) for x in "uv"]
        joined = missed.join(ends[0], "u").join(ends[1], "v").select(F.col("component_u").alias("u"), F.col("component_v").alias("v"))
        joined = base.components(spark, joined).select(F.col("node").alias("component"), F.col("component").alias("low"))
        members, _ = base.written(spark, members.join(joined, "component", "left").select("node", F.coalesce("low", "component").alias("component"), "keep"), "members")
    least, _ = base.written(spark, members.groupBy("component").agg(F.min("keep").alias("keep")), "least")
    found, _ = base.written(spark, members.select("node", "component").join(least, "component"), "similar")
    return prints.select("doc_id", "text_hash", "node"), found


def keep_one(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """docs with one row of each component of similar_components: that of the least doc_id (of repeated ids, the least
    text hash, and of repeated rows one). Null and empty texts are one component."""
    with base.passing(spark):
        prints, found = similar_components(spark, docs, id_col=id_col, text_col=text_col, radius=radius)
        keep = found.select("keep").distinct().select("keep.doc_id", "keep.text_hash")
        keep, _ = base.written(spark, keep, "keep")
        same = prints["doc_id"].eqNullSafe(keep["doc_id"]) & (prints["text_hash"] == keep["text_hash"])
        repeated = bool(prints.join(keep, same, "left_semi").groupBy("doc_id", "text_hash").count().where("count > 1").head(1))
        # most rows stay: those that go are told, and only what the sieve takes for one of them is shuffled with its text
        gone, _ = base.written(spark, prints.select("doc_id", "text_hash").join(keep, same, "left_anti"), "kept-not", stays=True)
    mark = lambda doc_id, text_hash: F.xxhash64(F.coalesce(doc_id, F.lit(0)), text_hash)
    rows = docs.withColumns({"__id": F.col(id_col).cast("long"), "__hash": F.xxhash64(F.col(text_col).cast("string"))})
    held = base.sieve(spark, gone.select(mark("doc_id", "text_hash")))(mark("__id", "__hash"))
    gone = gone.select(F.col("doc_id").alias("__id2"), F.col("text_hash").alias("__hash2"))
    taken = rows.where(held).join(gone, (F.col("__id").eqNullSafe(F.col("__id2"))) & (F.col("__hash") == F.col("__hash2")), "left_anti")
    stays = rows.where(~held).unionByName(taken)
    if repeated:  # the kept row itself is repeated
        stays = stays.dropDuplicates(["__id", "__hash"])
    return stays.select(*docs.columns)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    base.tune(spark)
    return near_duplicates(spark, base.table(spark, sf_dir, "documents"))
