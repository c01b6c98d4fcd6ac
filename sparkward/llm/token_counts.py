"""Token counts of a byte-level BPE vocabulary by rank-synchronous array merging.

The pre-tokens that a task has not met yet are held together as one ragged numpy array of symbols. In each step every
sequence takes the pair of lowest rank that it holds, all occurrences of it are merged at once (from the left where they
overlap), and sequences without a known pair leave the array. What survives of a sequence is its number of tokens.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkward.llm import base

#: Fixed value: the pre-tokenizer pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens whose counts a task remembers, and bytes of the longest it remembers; symbols merged in one array.
MEMO, MEMO_BYTES, BLOCK = 1 << 19, 64, 1 << 21
NONE = np.int64(1) << 40
LIMIT = 512


@dataclass
class Merges:
    """A vocabulary as arrays: the symbol of each byte; sorted pair keys with rank and merged symbol."""

    byte_ids: np.ndarray
    keys: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray
    width: int
    specials: tuple[str, ...]


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary file: printable bytes are themselves, others follow from 256."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = itertools.count(256)
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def load_merges(path: str) -> Merges:
    """Read a tokenizer file of the byte-level BPE kind."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    vocab, letters = said["model"]["vocab"], byte_letters()
    pairs = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in said["model"]["merges"]]
    width = max(vocab.values()) + 1
    keys = np.array([vocab[a] * width + vocab[b] for a, b in pairs], np.int64)
    order = np.argsort(keys, kind="stable")
    return Merges(
        np.array([vocab[c] for c in letters], np.int64), keys[order], np.arange(len(pairs), dtype=np.int64)[order],
        np.array([vocab[a + b] for a, b in pairs], np.int64)[order], width, tuple(t["content"] for t in said["added_tokens"]),
    )


def surviving(words: list[bytes], m: Merges) -> np.ndarray:
    """How many symbols of each pre-token survive all merges."""
    counts = np.array([len(w) for w in words], np.int64)
    size = counts.copy()
    symbols = m.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
    live = np.flatnonzero(size > 1)
    symbols = symbols[np.repeat(size > 1, size)]
    size = size[live]
    while len(live):
        starts = np.cumsum(size) - size
        key = np.empty(len(symbols), np.int64)
        np.multiply(symbols[:-1], m.width, out=key[:-1])
        key[:-1] += symbols[1:]
        key[starts[1:] - 1] = -1  # no pair across sequences
        key[-1] = -1
        at = np.searchsorted(m.keys, key)
        at[at == len(m.keys)] = 0
        rank = np.where(m.keys[at] == key, m.ranks[at], NONE)
        lowest = np.minimum.reduceat(rank, starts)
        hit = (rank == np.repeat(lowest, size)) & (rank < NONE)
        place = np.flatnonzero(hit)
        # where hits follow one another, the pairs overlap: every second one counts
        first = np.ones(len(place), bool)
        first[1:] = place[1:] != place[:-1] + 1
        run = np.maximum.accumulate(np.where(first, place, 0))
        place = place[(place - run) % 2 == 0]
        symbols[place] = m.merged[at[place]]
        gone = np.zeros(len(symbols), bool)
        gone[place + 1] = True
        size = size - np.add.reduceat(gone, starts, dtype=np.int64)
        counts[live] = size
        stay = (lowest < NONE) & (size > 1)
        symbols = symbols[~gone]
        symbols = symbols[np.repeat(stay, size)]
        live, size = live[stay], size[stay]
    return counts


class Counter:
    """Counts the tokens of texts; remembers the counts of short pre-tokens."""

    def __init__(self, merges: Merges):
        import regex

        self.merges, self.memo = merges, {}
        self.words = regex.compile(PATTERN)
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(merges.specials, key=len, reverse=True))) if merges.specials else None

    def pieces(self, text: str) -> tuple[list[str], int]:
        """The text without special strings, cut at them; how many there were."""
        if self.special is None or not self.special.search(text):
            return [text], 0
        cut = self.special.split(text)
        return cut, len(cut) - 1

    def learn(self, words: Iterable[str]) -> dict[str, int]:
        """Counts of pre-tokens, by blocks of bounded size."""
        out: dict[str, int] = {}
        block: list[str] = []
        held = 0
        for w in words:
            block.append(w)
            held += len(w)
            if held >= BLOCK:
                out.update(zip(block, surviving([x.encode() for x in block], self.merges).tolist(), strict=True))
                block, held = [], 0
        if block:
            out.update(zip(block, surviving([x.encode() for x in block], self.merges).tolist(), strict=True))
        return out

    def count(self, texts: list[str]) -> list[int]:
        if len(self.memo) > MEMO:
            self.memo = {}
        memo, totals, late = self.memo, [0] * len(texts), []
        for i, text in enumerate(texts):
            cut, n = self.pieces(text)
            totals[i] += n
            for piece in cut:
                found = self.words.findall(piece) if len(piece) < BLOCK else None
                if found is None:  # a very long text goes through in parts
                    stream = (m[0] for m in self.words.finditer(piece))
                    while part := list(itertools.islice(stream, BLOCK >> 3)):
                        got = self.learn(set(part) - memo.keys())
                        totals[i] += sum(got[w] if w in got else memo[w] for w in part)
                else:
                    late.append((i, found))
        new = set().union(*(f for _, f in late)).difference(memo) if late else set()
        got = self.learn(new)
        long = {w: n for w, n in got.items() if len(w) > MEMO_BYTES}
        memo.update((w, n) for w, n in got.items() if len(w) <= MEMO_BYTES)
        for i, found in late:
            totals[i] += sum(map(memo.__getitem__, found)) if not long else sum(memo[w] if w in memo else long[w] for w in found)
        return totals


def count_tokens(spark: SparkSession, docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every whole text; a null text is empty and has 0 tokens.

    Special strings inside a text count one token each, as the library does by default. No shuffle: each row is counted
    where it is read. The vocabulary (about 1 MB, whatever the corpus) is broadcast.
    """
    shared = spark.sparkContext.broadcast(load_merges(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = counter.count(texts)
            size = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    base.tune(spark)
    return count_tokens(spark, base.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
