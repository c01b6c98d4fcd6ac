"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders; windows of five template words are hashed on both sides and joined.
Of a document's hits on an item, those that lie on nearly the same alignment count together: the document is contaminated
if they cover at least four fifths of the item's words and the values in the placeholders map consistently from the item
to the document, as they do in a question with new parameters. Where an item repeats a template, hits of other alignments
compete for the same words; each exact alignment and the best chain of hits in order are judged without them.

An item without a window that says something (it has fewer than five words, or hardly any but placeholders) is matched by
its exact words. Items with the same template and the same pattern of equal values are one class and judged once. A class
takes its candidates from its rarer windows only, so many that no document that passes can lack all of them; a window
that very many documents and items share finds nothing alone. A bitmap of the benchmark's hashes, of bounded size whatever
the benchmark, keeps windows that cannot match from leaving the scan; the joins decide.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkward.llm import base

WINDOW, COVERAGE, CONSISTENT = 5, 0.8, 0.8
#: Alignments that differ by less than half of this count together; literal words that a window must hold.
SLACK, LITERALS = 32, 2
#: Bits of the bitmap for each benchmark window, and at most (32 MB); token hashes that a task remembers.
BITS, MOST_BITS, MEMO = 64, 1 << 28, 1 << 19
#: The second bit of a hash is that of its digits from here on.
SECOND = 34
#: Words that are units after a number, signs that are units, and number words.
UNITS = frozenset("km m cm mm mile miles foot feet inch inches yard yards kg g mg pound pounds lb lbs ounce ounces litre litres liter liters ml hour hours minute minutes second seconds day days week weeks month months year years dollar dollars cent cents euro euros percent mph kmh degrees celsius fahrenheit watt watts volt volts".split())
SIGNS = frozenset("%$€£")
NUMBERS = frozenset("two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million".split())
TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|\d+(?:[.,]\d+)*|[%$€£]|[.!?\n]")
LITERAL, TITLE, NUMBER, UNIT, STOP = range(5)
MARKS = np.array([0, 0x6E616D65, 0x6E756D62, 0x756E6974, 0], np.uint64)
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
HITS = "h long, position int, slots array<string>"
#: Items of up to so many words without a template window match only a document that holds no other word.
WHOLE = 2


class Tokens(dict):
    """Token to its hash, the kind in the lowest three bits."""

    def __missing__(self, token: str) -> int:
        import xxhash

        if len(self) > MEMO:
            self.clear()
        low = token.lower()
        if token in ".!?\n":
            kind = STOP
        elif token[0].isdigit() or low in NUMBERS:
            kind = NUMBER
        elif low in UNITS or token in SIGNS:
            kind = UNIT
        elif token[0].isupper() and (len(token) == 1 or not token.isupper()):
            kind = TITLE
        else:
            kind = LITERAL
        out = self[token] = xxhash.xxh64_intdigest(low.encode()) & ~7 | kind
        return out


def _hashes(value: np.ndarray, size: int, start: int = 0) -> np.ndarray:
    """A hash of each run of so many values."""
    n = max(0, len(value) - size + 1)
    h = np.full(n, start, np.uint64)
    for k in range(size):
        h = (h + value[k : k + n]) * FACTORS[k]
        h ^= h >> np.uint64(29)
    return h


def canonical(text: str | None, memo: Tokens) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Of each word: its hash, its kind as canonicalised, and the word."""
    found = TOKEN.findall(text or "")
    packed = np.fromiter(map(memo.__getitem__, found), np.uint64, len(found))
    kind = (packed & np.uint64(7)).astype(np.int64)
    before = np.concatenate(([STOP], kind[:-1]))[: len(kind)]
    kind = np.where((kind == TITLE) & (before == STOP), LITERAL, kind)  # a sentence's first word
    beside = (before == NUMBER) | (np.concatenate((kind[1:], [STOP]))[: len(kind)] == NUMBER)
    kind = np.where((kind == UNIT) & ~beside, LITERAL, kind)
    word = kind != STOP
    words = [w for w, k in zip(found, word.tolist(), strict=True) if k] if not word.all() else found
    return packed[word] & ~np.uint64(7), kind[word], words


def windows(packed: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each template window, and whether it has enough literal words."""
    h = _hashes(np.where(kind == LITERAL, packed, MARKS[kind]), WINDOW)
    total = np.concatenate(([0], np.cumsum(kind == LITERAL)))
    return h, (total[WINDOW:] - total[:-WINDOW])[: len(h)] >= LITERALS if len(h) else np.empty(0, bool)


def exact_windows(packed: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of so many exact words; of up to WHOLE words only if there is no other."""
    return _hashes(packed, size, 1000 + size) if size > WHOLE or len(packed) == size else np.empty(0, np.uint64)


def _emitted(rows: list, first: list, h: list, at: list, slots: list, names: list[str]) -> pa.RecordBatch:
    take = pa.array(rows, pa.int64())
    every = np.concatenate(h) if h else np.empty(0, np.uint64)
    return pa.RecordBatch.from_arrays([*(c.take(take) for c in first), pa.array(every.view(np.int64)), pa.array(at, pa.int32()), pa.array(slots, pa.list_(pa.string()))], [*names, "h", "position", "slots"])


def _slots(words: list[str], kind: np.ndarray, p: int) -> list[str]:
    return [words[k].lower() for k in range(p, p + WINDOW) if kind[k] != LITERAL]


def _scan(bitmap: np.ndarray, bits: int, sizes: list[int]):
    """Windows of the documents that the bitmap holds: of templates, and of exact words for the sizes that items need."""

    def bit(place: np.ndarray) -> np.ndarray:
        place = place & np.uint64(bits - 1)
        return (bitmap[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 != 0

    def held(h: np.ndarray) -> np.ndarray:
        return bit(h) & bit(h >> np.uint64(SECOND))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Tokens()
        for b in batches:
            rows, hs, at, slots = [], [], [], []
            for i, text in enumerate(b.column(2).to_pylist()):
                packed, kind, words = canonical(text, memo)
                h, good = windows(packed, kind)
                for found, keep in [(h, good & held(h)), *((e, held(e)) for e in (exact_windows(packed, n) for n in sizes))]:
                    for p in np.flatnonzero(keep).tolist():
                        rows.append(i)
                        at.append(p)
                        slots.append(_slots(words, kind, p) if found is h else [])
                    hs.append(found[keep])
            yield _emitted(rows, [b.column(0), b.column(1)], hs, at, slots, b.schema.names[:2])

    return run


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of items, with the item's class and the size of its exact windows (null for template windows).

    Slots are numbered by their value's first place, so items that differ in their values only are of one class.
    """
    import xxhash

    memo = Tokens()
    for b in batches:
        rows, hs, at, slots, kinds, sizes = [], [], [], [], [], []
        for i, text in enumerate(b.column(1).to_pylist()):
            packed, kind, words = canonical(text, memo)
            h, good = windows(packed, kind)
            size = None if good.any() else min(len(words), WINDOW)
            if size == 0:
                continue
            if size is not None:
                h = exact_windows(packed, size)
                good = np.ones(len(h), bool)
            places = np.flatnonzero(good).tolist()
            number: dict[str, str] = {}
            own = [[number.setdefault(x, str(len(number))) for x in _slots(words, kind, p)] if size is None else [] for p in places]
            name = xxhash.xxh64_intdigest(repr((h[good].tolist(), places, own)).encode())
            rows += [i] * len(places)
            at += places
            slots += own
            hs.append(h[good])
            kinds += [name - (1 << 64) if name >> 63 else name] * len(places)
            sizes += [size] * len(places)
        out = _emitted(rows, [b.column(0)], hs, at, slots, b.schema.names[:1])
        yield pa.RecordBatch.from_arrays([*out.columns, pa.array(kinds, pa.int64()), pa.array(sizes, pa.int32())], [*out.schema.names, "class", "size"])


def item_windows(spark: SparkSession, benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, list[int]]:
    """Windows (class, h, position, slots, words) of every class of items, its items (class, n_items, item_id), and the
    sizes of exact windows that occur. words is how many words the windows cover."""
    items = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    every, _ = base.written(spark, items.mapInArrow(_items, f"item_id long, {HITS}, class long, size int"), "item-windows")
    known = every.select("item_id", "class", "position").groupBy("class", "item_id").agg(F.count("*").alias("k"), F.countDistinct("position").alias("d"))
    # rows that repeat an item's id and text are items of their own
    known = known.groupBy("class").agg(F.sum((F.col("k") / F.col("d")).cast("long")).alias("n_items"), F.min("item_id").alias("item_id"))
    words = every.groupBy("class").agg(_covered("position").alias("words"))
    one = every.select("class", "h", "position", "slots").distinct().join(words, "class")
    sizes = sorted(r["size"] for r in every.where("size is not null").select("size").distinct().collect())
    return one, known, sizes


def _covered(position: str):
    """Number of words under the windows at the collected positions."""
    spread = F.transform(F.collect_set(position), lambda p: F.sequence(p, p + WINDOW - 1))
    return F.size(F.array_distinct(F.flatten(spread)))


def _bitmap(items: DataFrame) -> tuple[np.ndarray, int]:
    """Two bits of each hash of the items, of a power of two by their number, MOST_BITS at most.

    They come to the driver in words of 64, so in no more bytes than twice the bitmap has.
    """
    distinct = items.select("h").distinct()
    bits = 1 << 16
    while bits < BITS * distinct.count() and bits < MOST_BITS:
        bits *= 2
    places = distinct.select(F.explode(F.array("h", F.shiftrightunsigned("h", SECOND))).alias("h")).select(F.col("h").bitwiseAND(F.lit(bits - 1)).alias("p"))
    words = places.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b"))
    some = words.toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[some.column("w").to_numpy()] = some.column("b").to_numpy().view(np.uint64)
    return out.view(np.uint8), bits


def _judged(hits: list[tuple], words: int) -> tuple[float, int, float]:
    """Coverage of an item by (position, at, slots, values), number of its distinct slot values, consistency of the pairs."""
    covered = {p + k for p, *_ in hits for k in range(WINDOW)}
    pairs = {x for _, _, a, b in hits for x in zip(a, b, strict=True)}
    keys = len({a for a, _ in pairs})
    return len(covered) / words, keys, keys / len(pairs) if pairs else 1.0


def _chain(hits: list[tuple]) -> list[tuple]:
    """The hits of rising position and at that cover most words; of equal ones that of fewest shifts."""
    hits = sorted(hits, key=lambda h: (h[1], h[0]))
    shifts: dict[int, tuple[list, list]] = {}  # positions of the hits on each shift, and their numbers
    scores: list[tuple[int, int]] = []
    back: list[int] = []
    for i, (p, at, _, _) in enumerate(hits):
        score, before = (WINDOW, 0), -1
        for shift, (places, numbers) in shifts.items():
            # of the hits on one shift that may come before, the latest ends a chain at least as good as any
            k = bisect_left(places, min(p, at - shift)) - 1
            if k >= 0:
                s = scores[numbers[k]]
                new = (s[0] + min(WINDOW, p - places[k]), s[1] - (shift != at - p))
                if new > score:
                    score, before = new, numbers[k]
        places, numbers = shifts.setdefault(at - p, ([], []))
        places.append(p)
        numbers.append(i)
        scores.append(score)
        back.append(before)
    i = max(range(len(hits)), key=scores.__getitem__, default=-1)
    out = []
    while i >= 0:
        out.append(hits[i])
        i = back[i]
    return out


def _best(hits: list[tuple], words: int, coverage: float, consistent: float) -> tuple[float, int, float] | None:
    """Most coverage, slots and consistency of the alignments that pass, or None.

    Two overlapping sets of bands: alignments that differ by less than half a band share one in either set. In a band all
    hits are judged together, those of every exact alignment on their own, and the best chain of hits in order.
    """
    bands: dict[tuple, list] = {}
    shifts: dict[int, list] = {}
    for h in hits:
        shift = h[1] - h[0]
        shifts.setdefault(shift, []).append(h)
        bands.setdefault((0, shift // SLACK), []).append(h)
        bands.setdefault((1, (shift + SLACK // 2) // SLACK), []).append(h)
    passed = []
    for band in bands.values():
        told = _judged(band, words)
        if told[0] < coverage:  # nor do fewer of its hits cover more
            continue
        passed.append(told)
        if told[2] < consistent:
            passed.append(_judged(_chain(band), words))
            passed += [_judged(shifts[s], words) for s in {h[1] - h[0] for h in band}]
    passed = [x for x in passed if x[0] >= coverage and x[2] >= consistent]
    return tuple(max(c) for c in zip(*passed, strict=True)) if passed else None


def _rarest(coverage: float):
    """From (class, words, found: n, position, h): the windows but for the most frequent, which cover too little alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, hs = [], []
            for name, words, found in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                covered: set[int] = set()
                for w in sorted(found, key=lambda w: (-w["n"], w["position"])):
                    more = covered.union(range(w["position"], w["position"] + WINDOW))
                    if len(more) < coverage * words - 1e-9:
                        covered = more
                    elif w["n"]:
                        kinds.append(name)
                        hs.append(w["h"])
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int64()), pa.array(hs, pa.int64())], ["class", "h"])

    return run


def candidates(spark: SparkSession, hits: DataFrame, items: DataFrame, coverage: float) -> DataFrame:
    """(doc_id, text_hash, class) of the documents that hold one of a class's rarer windows.

    The most frequent windows in the documents are left out as long as all of them together cover less than a document
    must to pass; so one that passes holds one of the others, and no document is lost.
    """
    often, _ = base.written(spark, hits.groupBy("h").agg(F.count("*").alias("n")), "window-counts")
    counted = items.join(often, "h", "left").select("class", "words", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "position", "h").alias("w"))
    every = counted.groupBy("class", "words").agg(F.collect_list("w").alias("found"))
    rare, _ = base.written(spark, every.mapInArrow(_rarest(coverage), "class long, h long").distinct(), "rare-windows")
    return hits.select("doc_id", "text_hash", "h").join(rare, "h").select("doc_id", "text_hash", "class").distinct()


def contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", coverage: float = COVERAGE, consistent: float = CONSISTENT) -> DataFrame:
    """(doc_id, text_hash, item_id, n_items, coverage, slots, consistency) of every contaminated text and class of items.

    coverage is the share of the item's words under matching windows of one alignment or chain, consistency the number of
    distinct slot values of the item over the distinct pairs of values (1 where there is none). An item without a window
    of at least two literal words matches by its exact words: by runs of five, whole if it has three or four, and if it
    has one or two only a document that has no other word. Null and empty items and texts match nothing.
    """
    items, known, sizes = item_windows(spark, benchmark)
    items, _ = base.written(spark, items, "items")
    bitmap, bits = _bitmap(items)
    shared = spark.sparkContext.broadcast(bitmap)
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _scan(shared.value, bits, sizes)(batches)

    hits = texts.mapInArrow(scan, f"doc_id long, text_hash long, {HITS}").withColumnsRenamed({"position": "at", "slots": "values"})
    hits, _ = base.written(spark, hits, "window-hits")
    near, _ = base.written(spark, candidates(spark, hits, items, coverage), "candidates")
    wanted = near.withColumnsRenamed({"doc_id": "d", "text_hash": "t"}).join(items, "class").withColumnRenamed("h", "hh")
    met = hits.join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")) & (F.col("h") == F.col("hh")))
    placed = met.groupBy("doc_id", "text_hash", "class", "words").agg(F.collect_set(F.struct("position", "at", "slots", "values")).alias("hits"))

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, cols = [], ([], [], [])
            for i, (words, found) in enumerate(zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)):
                best = _best([(h["position"], h["at"], h["slots"], h["values"]) for h in found], words, coverage, consistent)
                if best is not None:
                    rows.append(i)
                    for c, v in zip(cols, best, strict=True):
                        c.append(v)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(take) for i in range(3)), pa.array(cols[0], pa.float64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.float64())], ["doc_id", "text_hash", "class", "coverage", "slots", "consistency"])

    good = placed.select("doc_id", "text_hash", "class", "words", "hits").mapInArrow(tell, "doc_id long, text_hash long, class long, coverage double, slots int, consistency double")
    return good.join(known, "class").select("doc_id", "text_hash", "item_id", "n_items", "coverage", "slots", "consistency")


def judge(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, contaminated, n_items, item_id (that of best coverage, then least id) and coverage (0 if none) for each row."""
    found, _ = base.written(spark, contamination(spark, docs, benchmark, id_col=id_col, text_col=text_col), "contaminated")
    best = found.groupBy("doc_id", "text_hash").agg(F.sum("n_items").alias("n_items"), F.max(F.struct("coverage", (-F.col("item_id")).alias("m"))).alias("best"))
    best = best.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), "n_items", F.col("best.coverage").alias("coverage"), (-F.col("best.m")).alias("item_id"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"))
    all_ = rows.join(best, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")), "left")
    return all_.select("doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), "item_id", F.coalesce("coverage", F.lit(0.0)).alias("coverage"))


def clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the contaminated rows."""
    found, _ = base.written(spark, contamination(spark, docs, benchmark, id_col=id_col, text_col=text_col).select("doc_id", "text_hash").distinct(), "contaminated")
    names = found.select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__t"))
    return docs.join(names, F.col(id_col).cast("long").eqNullSafe(F.col("__d")) & (F.xxhash64(F.col(text_col).cast("string")) == F.col("__t")), "left_anti")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated documents; a document that is not listed is clean."""
    base.tune(spark)
    return judge(spark, base.table(spark, sf_dir, "documents"), base.table(spark, sf_dir, "benchmark")).where("contaminated")
