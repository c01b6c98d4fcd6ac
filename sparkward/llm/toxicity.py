"""Toxicity by a weighted lexicon, matched with Aho-Corasick after folding look-alike letters and digit substitutions.

Entries are whole words or word beginnings whose document frequency differs most between toxic and clean labelled texts,
weighted by their log odds. A word that only a family of copied texts has is no entry: its neighbours must vary. Hits
inside an exception phrase do not count. The weights of the hits, divided by the logarithm of the length in words, go
through a logistic curve fitted to the same sample.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkward.llm import base

#: Labelled texts in the fitting sample at most (those of least hash); the lexicon's size at most.
SAMPLE, ENTRIES, CANDIDATES = 20_000, 2_000, 20_000
THRESHOLD = 0.3
#: Lengths of word beginnings; support in toxic texts, share of toxic among texts that have it, kinds of neighbours.
STEMS, SUPPORT, SHARE, NEIGHBOURS = (4, 5, 6, 7), 5, 0.8, 5
#: Entries of a task's count table before it is passed on.
HELD = 1 << 19
#: Letters of other scripts that look like Latin ones, and digits and signs that stand for letters.
HOMOGLYPHS = str.maketrans("аеорсухкмтнвіјѕԁһԛԝαεορτυικνɡıȷ", "aeopcyxkmthbijsdhqwaeoptuikngij")
LEET = str.maketrans("0134578@$", "oieastbas")
WORD = re.compile(r"[^\W_]+")
MIXED = re.compile(r"(?=[0134578@$]*[^\W\d_])[^\W_@$]*[0134578@$](?:[^\W_]|[@$])*")
ODD = re.compile(r"[аеорсухкмтнвіјѕԁһԛԝαεορτυικνɡıȷ]")
SUBSTITUTED = re.compile(r"[^\W\d_][0134578@$]|[0134578@$][^\W\d_]")


def fold(text: str) -> str:
    """Lower case, compatibility forms composed, look-alike letters and digits inside words replaced."""
    t = text.lower()
    if not t.isascii():
        if not unicodedata.is_normalized("NFKC", t):
            t = unicodedata.normalize("NFKC", t).lower()
        if ODD.search(t):
            t = WORD.sub(lambda m: m[0].translate(HOMOGLYPHS) if ODD.search(m[0]) else m[0], t)
    if SUBSTITUTED.search(t):
        t = MIXED.sub(lambda m: m[0].translate(LEET), t)
    return t


@dataclass
class Lexicon:
    """weights: of entries, '=word=' a whole word and '=stem' a beginning; exceptions: two-word phrases; slope, shift."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[str] = frozenset()
    slope: float = 0.0
    shift: float = -math.inf


class Matcher:
    def __init__(self, lexicon: Lexicon):
        import ahocorasick

        self.lexicon, self.trie = lexicon, ahocorasick.Automaton()
        plain: dict[str, list[tuple[float, bool]]] = {}
        for entry, w in lexicon.weights.items():
            plain.setdefault(entry.strip("="), []).append((w, entry.endswith("=")))
        for text, kinds in plain.items():
            self.trie.add_word(text, (text, kinds))
        if plain:
            self.trie.make_automaton()

    def hits(self, folded: str) -> list[tuple[float, str, str, str]]:
        """(weight, entry, phrase with the word before, phrase with the word after) of every word that an entry fits."""
        if not self.lexicon.weights:
            return []
        best: dict[int, tuple[float, str]] = {}
        n = len(folded)
        for last, (text, kinds) in self.trie.iter(folded):
            start = last - len(text) + 1
            if start and folded[start - 1].isalnum():
                continue
            closed = last + 1 == n or not folded[last + 1].isalnum()
            for w, whole in kinds:
                if (closed or not whole) and (start not in best or best[start][0] < w):
                    best[start] = (w, f"={text}{'=' * whole}")
        out = []
        for start, (w, entry) in best.items():
            around = WORD.findall(folded[max(0, start - 60) : start])
            after = WORD.findall(folded[start : start + 120])
            word = after[0] if after else ""
            out.append((w, entry, f"{around[-1]} {word}" if around else f" {word}", f"{word} {after[1]}" if len(after) > 1 else f"{word} "))
        return out

    def feature(self, text: str | None) -> float:
        folded = fold(text or "")
        bad = self.lexicon.exceptions
        total = sum(w for w, _, a, b in self.hits(folded) if a not in bad and b not in bad)
        return total / math.log2(2 + folded.count(" ") + folded.count("\n")) if total else 0.0

    def score(self, text: str | None) -> float:
        z = self.lexicon.slope * self.feature(text) + self.lexicon.shift
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def features_of(text: str | None) -> set[str]:
    """Entries that a text could support."""
    out = set()
    for w in set(WORD.findall(fold(text or ""))):
        out.add(f"={w}=")
        out.update(f"={w[:n]}" for n in STEMS if len(w) > n)
    return out


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def held_out_column(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["feature", "toxic", "clean"]
    held: dict[str, list[int]] = {}

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([v[0] for v in held.values()], pa.int64()), pa.array([v[1] for v in held.values()], pa.int64())], names)
        held.clear()
        return out

    for b in batches:
        for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            for f in features_of(text):
                held.setdefault(f, [0, 0])[1 - y] += 1
        if len(held) > HELD:
            yield flush()
    yield flush()


def _contexts(candidates: dict[str, float]):
    """Neighbour pairs of the candidates in toxic texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        stems = {e: None for e in candidates}
        for b in batches:
            seen: set[tuple[str, int]] = set()
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not y:
                    continue
                words = WORD.findall(fold(text or ""))
                for i, w in enumerate(words):
                    mine = [e for e in (f"={w}=", *(f"={w[:n]}" for n in STEMS if len(w) > n)) if e in stems]
                    if mine:
                        near = xxhash.xxh64_intdigest(" ".join(words[max(0, i - 1) : i] + ["|"] + words[i + 1 : i + 2])) >> 1
                        seen.update((e, near) for e in mine)
            yield pa.RecordBatch.from_arrays([pa.array([e for e, _ in seen], pa.string()), pa.array([n for _, n in seen], pa.int64())], ["feature", "near"])

    return run


def _examples(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = Matcher(lexicon)
        kind = pa.list_(pa.struct([("w", pa.float64()), ("before", pa.string()), ("after", pa.string())]))
        for b in batches:
            rows, size = [], []
            for text in b.column(0).to_pylist():
                folded = fold(text or "")
                rows.append([{"w": w, "before": x, "after": y} for w, _, x, y in match.hits(folded)])
                size.append(math.log2(2 + folded.count(" ") + folded.count("\n")))
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(size, pa.float64()), pa.array(rows, kind)], ["y", "size", "hits"])

    return run


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and shift of a ridge logistic curve in one variable, by damped Newton steps."""
    w = np.zeros(2)
    a = np.stack([x, np.ones_like(x)], axis=1)
    loss = lambda w: float(np.logaddexp(0, a @ w).sum() - y @ (a @ w) + ridge * len(y) * w[0] ** 2 / 2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
        g = a.T @ (p - y) + [ridge * len(y) * w[0], 0]
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag([ridge * len(y), 1e-9])
        step, rate, now = np.linalg.solve(h, g), 1.0, loss(w)
        while rate > 1e-6 and loss(w - rate * step) > now:
            rate /= 2
        w = w - rate * step
        if np.abs(step * rate).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def _selected(rows: Iterable, kinds: dict[str, int]) -> dict[str, float]:
    """Entries whose neighbours vary; of a word and its beginnings the shortest that is as telling."""
    weights: dict[str, float] = {}
    for r in sorted(rows, key=lambda r: (len(r["feature"].strip("=")), r["feature"])):
        f, n = r["feature"], kinds.get(r["feature"], 0)
        if n < NEIGHBOURS or n < 0.3 * r["toxic"]:
            continue
        text = f.strip("=")
        shorter = [weights[f"={text[:k]}"] for k in STEMS if k < len(text) or (k == len(text) and f.endswith("=")) if f"={text[:k]}" in weights]
        if not shorter or r["weight"] > max(shorter) + 1.0:
            weights[f] = r["weight"]
    return dict(sorted(weights.items(), key=lambda x: (-x[1], x[0]))[:ENTRIES])


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Lexicon:
    """Learn lexicon, exceptions and curve from labelled rows that are not held out.

    The sample are the labelled ids of least hash, so it has at most that many ids however large the corpus is, and they
    are broadcast. Texts
    that repeat count once. Without labelled texts the lexicon is empty and every score is 0.
    """
    ids = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    ids = ids.where(~held_out_column(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    chosen = texts.join(F.broadcast(ids), "doc_id").groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"), F.max("y").alias("y")).select("text", "y")
    chosen, path = base.written(spark, chosen, "labelled")
    n = {r["y"]: r["count"] for r in chosen.groupBy("y").count().collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic:
        return Lexicon()
    counts = chosen.mapInArrow(_counts, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    weight = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    rows = counts.where((F.col("toxic") >= SUPPORT) & (F.col("toxic") >= SHARE * (F.col("toxic") + F.col("clean")))).withColumn("weight", weight)
    rows = rows.orderBy(F.desc(F.col("weight")), "feature").limit(CANDIDATES).collect()
    found = {r["feature"]: r["weight"] for r in rows}
    near = chosen.where("y = 1").mapInArrow(_contexts(found), "feature string, near long").distinct().groupBy("feature").count()
    lexicon = Lexicon(_selected(rows, {r["feature"]: r["count"] for r in near.collect()}))
    seen = chosen.mapInArrow(_examples(lexicon), "y int, size double, hits array<struct<w: double, before: string, after: string>>").collect()
    base.drop_path(spark, path)
    phrases: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for r in seen:
        phrases[r["y"]].update({p for h in r["hits"] for p in (h["before"], h["after"])})
    lexicon.exceptions = frozenset(p for p, k in phrases[0].items() if k >= 3 and k >= 9 * phrases[1][p])
    bad = lexicon.exceptions
    x = np.array([sum(h["w"] for h in r["hits"] if h["before"] not in bad and h["after"] not in bad) / r["size"] for r in seen])
    lexicon.slope, lexicon.shift = fit_logistic(x, np.array([r["y"] for r in seen], float))
    return lexicon


def score(spark: SparkSession, docs: DataFrame, lexicon: Lexicon, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row, where it is read; a null text is scored as an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = Matcher(lexicon)
        for b in batches:
            s = [match.score(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out_column(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def reject(spark: SparkSession, docs: DataFrame, lexicon: Lexicon, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score at or above the threshold."""

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        match = Matcher(lexicon)
        for t in texts:
            yield t.map(lambda x: match.score(x if isinstance(x, str) else None)).astype("float64")

    return docs.where(scored(F.col(text_col)) < threshold)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    base.tune(spark)
    docs = base.table(spark, sf_dir, "documents")
    return score(spark, docs, fit(spark, docs, base.table(spark, sf_dir, "labels")))
