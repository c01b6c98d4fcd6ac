"""Operators that compare documents: fingerprints, repeated bytes, SimHash, decontamination, mixtures, pipeline."""

import hashlib
import random
import resource

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkward.llm import base, decontamination, edit_fingerprints, mixing, registry, simhash, suffix_dedup


def by_text(df, hard):
    return df.join(hard.select("doc_id", "text").distinct(), "doc_id")


def test_edit_fingerprints(spark, sf_dir):
    docs = sorted(base.table(spark, sf_dir, "documents").collect(), key=lambda r: -r["doc_id"])
    got = {r["doc_id"]: r for r in registry.QUERIES["op2_edit_fingerprints"](spark, sf_dir).collect()}
    assert len(got) == len(docs)
    texts = {}
    for d, n in zip(docs, docs[1:] + docs[:1], strict=True):
        half = len(d["text"]) // 2
        edited = d["text"][: len(d["text"]) - half] + n["text"][:half]
        r = got[d["doc_id"]]
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and r["n_chars"] == len(d["text"])
        a, b = edit_fingerprints.parsed(r["fingerprint"]), edit_fingerprints.parsed(got[n["doc_id"]]["fingerprint"])
        assert abs(edit_fingerprints.likeness(a, b) - r["near_next"]) < 1e-12 and r["linked_next"] <= (r["near_next"] >= 0.8)
        assert texts.setdefault(d["text"], r["fingerprint"]) == r["fingerprint"]
        assert (r["near_next"] == 1.0) == (r["fingerprint"] == got[n["doc_id"]]["fingerprint"])


def bits_by_hand(text, walks):
    """One walk over a text of one segment, a step at a time."""
    at, out = 0, []
    for step in range(edit_fingerprints.STEPS):
        letter = 1 + ord(text[at]) % (edit_fingerprints.CLASSES - 1) if at < len(text) else 0
        if step in edit_fingerprints.SAMPLED:
            out.append(int(walks.shows[len(out), letter]))
        at += int(walks.moves[step, letter])
    return out


def test_walks_by_hand():
    rng, walks = random.Random(1), edit_fingerprints.Walks()
    texts = ["", "a", "é🙂 x", *("".join(rng.choice("abc dé") for _ in range(n)) for n in (17, 300, 2048))]
    for t, p in zip(texts, walks.prints(texts), strict=True):
        assert p.sizes.tolist() == ([len(t)] if t else [])
        # a walk that has not reached the end at its last step is cut there; none of these is
        assert [x.tolist() for x in p.bits] == ([bits_by_hand(t, walks)] if t else [])
        assert all((x == y).all() for x, y in zip(edit_fingerprints.parsed(edit_fingerprints.printed(p)), p))


def lcs_likeness(a, b):
    """1 - edit distance without swaps over the longer length, from the longest common subsequence."""
    row = np.zeros(len(b) + 1, np.int64)
    y = np.frombuffer(b.encode("utf-32-le"), np.uint32)
    for c in a:
        new = row.copy()
        new[1:] = np.maximum(row[1:], np.where(y == ord(c), row[:-1] + 1, 0))
        row = np.maximum.accumulate(new)
    return row[-1] / max(len(a), len(b))


def test_likeness_follows_the_edit_distance():
    rng, walks = random.Random(4), edit_fingerprints.Walks()
    made = lambda n: "".join(rng.choice("abcdefghij klmnop") for _ in range(n))
    means = []
    for edits in (0, 3, 60, 600):
        told, true = [], []
        for _ in range(6):
            t = list(start := made(3000))
            for _ in range(edits):
                t[rng.randrange(len(t))] = rng.choice("xyz")
            told.append(edit_fingerprints.likeness(*walks.prints([start, "".join(t)])))
            true.append(lcs_likeness(start, "".join(t)))
        means.append((np.mean(true), np.mean(told)))
    assert means[0] == (1, 1) and means == sorted(means, reverse=True) and means[1][1] > 0.9 and means[3][1] < 0.6
    assert edit_fingerprints.likeness(*walks.prints([made(3000), made(3000)])) < 0.3
    assert edit_fingerprints.likeness(*walks.prints(["", ""])) == 1.0 and edit_fingerprints.likeness(*walks.prints(["", "a"])) == 0.0


def test_insertions_fall_into_step_again():
    rng, walks = random.Random(6), edit_fingerprints.Walks()
    made = lambda n: "".join(rng.choice("abcdefghij klmnop") for _ in range(n))
    for shift in (1, 16, 60, 300):
        got = []
        for _ in range(10):
            t = made(12_000)
            at = rng.choice([0, rng.randrange(12_000)])
            got.append(edit_fingerprints.likeness(*walks.prints([t, t[:at] + made(shift) + t[at:]])))
        print("inserted", shift, "likeness", [round(x, 3) for x in sorted(got)])
        assert min(got) > 0.75 and np.mean(got) > 0.9 - shift / 12_000


def test_segments_cover_the_text():
    rng = random.Random(3)
    for t in ("", "ab" * 5000, "x" * 9000, "".join(rng.choice("abc def") for _ in range(30_000))):
        sizes, keys = edit_fingerprints.segments(np.frombuffer(t.encode("utf-32-le"), np.uint32))
        assert sizes.sum() == len(t) and len(keys) == len(sizes) and (not t or 0 < sizes.min() and sizes.max() <= edit_fingerprints.SEGMENT)


def test_edit_fingerprints_edge_cases(spark, hard, empty):
    assert edit_fingerprints.against_next(spark, hard).count() == hard.count()
    assert edit_fingerprints.against_next(spark, empty).count() == 0
    one = edit_fingerprints.against_next(spark, hard.where("doc_id = 4")).first()
    assert one["near_next"] == 1.0
    got = edit_fingerprints.near_classes(spark, hard).collect()
    classes = dict(map(tuple, got))
    assert len(got) == hard.count() and classes[8] == classes[9] == classes[10] == 8 and classes[0] == 0 and classes[1] == 1 and classes[None] is None
    assert edit_fingerprints.near_classes(spark, empty).count() == 0


def test_hot_ids_keep_the_order(spark):
    """Null ids, an id that most rows have, and ids beyond 2 ** 53: still each row against the next."""
    big = 1 << 60
    rows = [(None, f"n {i}") for i in range(1500)] + [(7, f"seven {i}") for i in range(2500)] + [(big + i, f"big {i}") for i in range(800)] + [(i, f"t {i}") for i in range(100, 900)]
    docs = spark.createDataFrame(random.Random(2).sample(rows, len(rows)), "doc_id long, text string").repartition(7)
    order = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).orderBy(F.desc_nulls_last("doc_id"), "h").collect()
    expected = sorted((d["doc_id"] or 0, hashlib.sha256((d["text"][: len(d["text"]) - len(d["text"]) // 2] + n["text"][: len(d["text"]) // 2]).encode()).hexdigest()) for d, n in zip(order, order[1:] + order[:1], strict=True))
    got = edit_fingerprints.against_next(spark, docs)
    assert sorted((r["doc_id"] or 0, r["edited_sha256"]) for r in got.collect()) == expected
    sizes = [n for n in got.select(F.spark_partition_id().alias("p")).groupBy("p").count().toPandas()["count"]]
    assert max(sizes) < len(rows) / 2


def classes_of(ids, links):
    """The least id that links reach, by id."""
    least = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(least[a], least[b])
            if least[a] != low or least[b] != low:
                least[a] = least[b] = low
                changed = True
    return least


@pytest.mark.parametrize("block", [1024, 2])
def test_near_classes_by_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(edit_fingerprints, "BLOCK", block)
    rng, walks = random.Random(8), edit_fingerprints.Walks()
    letters = "abcdefghij klmnop"
    texts = []
    for _ in range(6):
        t = "".join(rng.choice(letters) for _ in range(1500))
        for edits in (0, *[1, 4, 8] * 4):
            u = list(t)
            for _ in range(edits):
                u[rng.randrange(len(u))] = rng.choice("xyz")
            texts.append("".join(u))
    prints = walks.prints(texts)
    first = {}
    stands = [first.setdefault(edit_fingerprints.printed(x), k) for k, x in enumerate(prints)]
    like = {(a, b): edit_fingerprints.likeness(prints[a], prints[b]) for a in first.values() for b in first.values() if a < b}
    expected = {k for k, v in like.items() if v >= 0.8} | {(a, b) for b, a in enumerate(stands) if a < b}
    docs = spark.createDataFrame([*enumerate(texts), (None, texts[0]), (None, texts[0])], "doc_id long, text string")
    got = {i: c for i, c in map(tuple, edit_fingerprints.near_classes(spark, docs).collect()) if i is not None}
    assert len(expected) > 100 and got == classes_of(range(len(texts)), expected)


def test_alike_texts_take_a_comparison_each(monkeypatch):
    calls = []
    monkeypatch.setattr(edit_fingerprints, "likeness", lambda a, b: calls.append(1) or 1.0)
    rows = [(1, p, "0:", None) for p in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.int32()))], ["task", "p", "fingerprint", "side"])
    links = [r for b in edit_fingerprints._joined_up(0.8)(iter([batch])) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert len(links) == 299 == len(calls)


def test_any_segment_makes_a_candidate(spark):
    rng, walks = random.Random(9), edit_fingerprints.Walks()
    made = lambda n: "".join(rng.choice("abcdefghij klmnop") for _ in range(n))
    texts = []
    for _ in range(5):
        t = made(20_000)
        texts += [t, made(1500) + t[2000:]]
    prints = walks.prints(texts)
    for k in range(0, 10, 2):
        assert edit_fingerprints.likeness(prints[k], prints[k + 1]) > 0.8
        assert walks.equal_bands(prints[k], prints[k + 1]) >= edit_fingerprints.BANDS - 1  # one band outlasts every walk
    got = dict(map(tuple, edit_fingerprints.near_classes(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()))
    assert got == {k: k - k % 2 for k in range(10)}


def test_recall_of_near_copies(spark):
    """Copies of texts of the tables with some words changed, dropped or added: of those that are alike by a plain
    comparison of fingerprints, how many links the bands find; and how many are alike at all."""
    rng, walks = random.Random(17), edit_fingerprints.Walks()
    docs = [r["text"] for r in base.table(spark, "/root/testdata/sf0.01", "documents").where("n_chars between 400 and 20000").orderBy("doc_id").limit(150).collect()]
    rows, alike = [*enumerate(docs)], {}
    for share, number in ((400, 1000), (100, 2000)):
        for k, t in enumerate(docs):
            words = t.split(" ")
            for at in rng.sample(range(len(words)), max(1, len(words) // share)):
                words[at] = rng.choice(["", "other", words[at] + " more"])
            rows.append((number + k, " ".join(words)))
            alike[(k, number + k)] = edit_fingerprints.likeness(*walks.prints([t, rows[-1][1]])) >= 0.8
    classes = dict(map(tuple, edit_fingerprints.near_classes(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    true = {p for p, v in alike.items() if v}
    links = {(a, b) for a, b in true if classes[a] == classes[b]}
    print("recall of links", len(links) / len(true), *(("one word in", s, "alike", sum(v for (_, j), v in alike.items() if n <= j < n + 1000) / len(docs)) for s, n in ((400, 1000), (100, 2000))))
    assert len(links) >= 0.98 * len(true) and sum(v for (_, j), v in alike.items() if j < 2000) > 0.8 * len(docs)


def removed_by_hand(texts, length):
    seen = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 2, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i + 1 : i + 1 + length] = True
        inner = gone[1:-1]
        kept = bytes(b for b, g in zip(t, inner, strict=True) if not g)
        out.append((len(t), int(inner.sum()), int((np.diff(gone.astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length,hot", [(40, 1000), (40, 1), (40, 4), (100, 2)])
def test_repeated_bytes(spark, monkeypatch, length, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = random.Random(length + hot)
    words = lambda n: " ".join(rng.choice(["alpha", "é", "gamma", "de"]) + str(rng.randint(0, 9)) for _ in range(n))
    pieces, shared = [words(60) for _ in range(4)], words(30)
    texts = [None, "", "ab" * 300, "x" * 500, pieces[0] * 2]
    for _ in range(40):
        a = rng.choice(pieces)
        texts.append(rng.choice([a, a[: rng.randint(0, len(a))] + words(4) + a[rng.randint(0, len(a)) :], words(20) + shared + words(25)]))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = [tuple(r)[1:] for r in suffix_dedup.remove_repeats(spark, df, length=length).orderBy("doc_id").collect()]
    assert got == removed_by_hand([(t or "").encode() for t in texts], length)


def test_no_shard_grows_with_a_shared_passage(spark, monkeypatch):
    rng = random.Random(12)
    made = lambda n: "".join(rng.choice("abcdefgh ijklm") for _ in range(n))
    shared = made(699)
    texts = [made(rng.randint(0, 40)) + shared + made(30) for _ in range(3000)]
    largest = []
    kept = base.written

    def written(s, df, name):
        out = kept(s, df, name)
        if name in ("cut", "pieces"):
            key, some = ("a", "ahead < 0") if name == "cut" else ("shard", "bytes is not null")
            largest.append(out[0].where(some).groupBy(key).count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0])
        return out

    monkeypatch.setattr(base, "written", written)
    got = [tuple(r)[1:] for r in suffix_dedup.remove_repeats(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert len(largest) == 2 and max(largest) <= suffix_dedup.HOT
    assert got == removed_by_hand([t.encode() for t in texts], suffix_dedup.LENGTH)


def test_texts_with_a_period(spark):
    """Rules of dashes, blanks and repeated words, long and short, alone and within other text."""
    rng = random.Random(8)
    noise = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    rule = ("-" * 80 + "\n") * 30
    texts = ["-" * 3000, "-" * 400, "-" * 401, "=" * 399, " " * 5000, "abc" * 700, "abc" * 134, noise(500) + rule + noise(500), rule, noise(300) + "xy" * 900 + noise(300) + "xy" * 300, (noise(199) + "\n") * 9, (noise(250) + "\n") * 9, "-" * 700 + "+" + "-" * 700, noise(900)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = [tuple(r)[1:] for r in suffix_dedup.remove_repeats(spark, df).orderBy("doc_id").collect()]
    assert got == removed_by_hand([t.encode() for t in texts], suffix_dedup.LENGTH)


@pytest.mark.parametrize("text", [b"-" * 20_000_000, b"abc" * 3_000_000, (b"-" * 80 + b"\n") * 60_000])
def test_long_texts_with_a_period_have_few_rows(text):
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([text], pa.binary())], ["d", "t", "bytes"])
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    rows = sum(b.num_rows for b in suffix_dedup._scan(suffix_dedup.LENGTH)(iter([batch])))
    assert rows < 2000 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500 * 1024


def test_suffix_order():
    rng = random.Random(0)
    for _ in range(150):
        x = np.array([rng.randint(0, rng.choice([1, 3, 255])) for _ in range(rng.randint(0, 70))], np.uint8)
        assert suffix_dedup.suffix_order(x).tolist() == sorted(range(len(x)), key=lambda i: bytes(x[i:]))


def test_repeated_bytes_edge_cases(spark, hard, empty):
    got = suffix_dedup.remove_repeats(spark, hard, texts=True)
    assert got.count() == hard.count() and suffix_dedup.remove_repeats(spark, empty).count() == 0
    r = {r["doc_id"]: r for r in got.where("doc_id is not null").collect()}
    assert r[0]["n_bytes"] == 0 and r[17]["n_removed"] == 0 and r[18]["n_removed"] == 400 and r[11]["n_removed"] == r[11]["n_bytes"] and r[7]["n_removed"] == 5000
    long = r[9]
    assert long["n_bytes"] - long["n_removed"] < 50


def test_simhash_by_hand(spark, hard):
    import xxhash

    got = simhash.near_duplicates(spark, hard).collect()
    texts = {r["doc_id"]: r["text"] for r in hard.where("doc_id is not null").collect()}
    for r in got:
        if r["doc_id"] is None or r["doc_id"] in (8, 9, 10):
            continue
        words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in texts[r["doc_id"]] or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
        hs = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in ([words[i : i + 4] for i in range(len(words) - 3)] if len(words) >= 4 else [words] if words else [])]
        bits = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
        assert r["fingerprint"] == f"{bits:016x}"


def test_simhash_components(spark, sf_dir, hard, empty):
    got = simhash.near_duplicates(spark, base.table(spark, sf_dir, "documents").unionByName(hard.select("doc_id", "text", "lang", "source", "n_chars").withColumn("doc_id", F.col("doc_id") + 100_000))).toPandas()
    fp = np.array([int(x, 16) for x in got.fingerprint], np.uint64)
    label = np.arange(len(fp))
    while True:
        new = np.array([label[np.bitwise_count(fp ^ x) <= 4].min() for x in fp])
        new = new[new]
        if (new == label).all():
            break
        label = new
    expected = got.assign(label=label).groupby("label").doc_id.transform("min")
    assert (expected.fillna(-1) == got.component_id.astype(float).fillna(-1)).all()
    assert simhash.near_duplicates(spark, empty).count() == 0


def test_simhash_salted_shards(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (20, 40, 3), dtype=np.uint64)
    fp = np.unique((centre[:, None] ^ flips[..., 0] ^ flips[..., 1] ^ flips[..., 2]).ravel())
    label = simhash.least_labels(len(fp), ((np.full(len(n), i), n) for i, n in ((i, np.flatnonzero(np.bitwise_count(fp ^ x) <= 4)) for i, x in enumerate(fp))))
    df = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    for shard, front, blocks in ((4096, 1 << 21, (6, 7, 8)), (8, 64, (6, 7, 8)), (64, 64, (7,)), (64, 64, (8,))):
        monkeypatch.setattr(simhash, "SHARD", shard)
        monkeypatch.setattr(simhash, "FRONT", front)
        monkeypatch.setattr(simhash, "BLOCKS", blocks)
        edges = simhash.link_edges(spark, df).toPandas()
        at = lambda c: np.searchsorted(fp, c.to_numpy().view(np.uint64))
        assert (simhash.least_labels(len(fp), iter([(at(edges.u), at(edges.v))])) == label).all()


def test_blocks_follow_the_number():
    assert [(len(b), k) for b, k in map(simhash.block_plan, (0, 1 << 30, 1 << 35, 1 << 40, 1 << 50))] == [(6, 2), (6, 2), (7, 3), (8, 4), (8, 4)]
    assert all(sum(n for _, n in simhash.block_plan(n)[0]) == 64 for n in (1, 1 << 35, 1 << 40))


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def components_by_hand(texts, radius=4):
    """Least index of each text's component: links at four bits, or a Jaccard likeness of 0.8."""
    fp = np.array([simhash.simhash(t) for t in texts], np.uint64)
    sets = [shingle_set(t) for t in texts]
    pairs = [(i, int(j)) for i in range(len(texts)) for j in np.flatnonzero(np.bitwise_count(fp[:i] ^ fp[i]) <= radius)]
    pairs += [(i, j) for i in range(len(texts)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    a, b = np.array(pairs, np.int64).reshape(-1, 2).T
    return simhash.least_labels(len(texts), iter([(a, b)]))


@pytest.mark.parametrize("crowd,grams", [(4096, 1 << 25), (6, 1 << 25), (6, 20_000)])
def test_similar_texts_by_hand(spark, monkeypatch, crowd, grams):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    monkeypatch.setattr(simhash, "GRAMS", grams)
    rng = random.Random(21)
    made = lambda n: [rng.choice("abcdefghijklm") + str(rng.randint(0, 99)) for _ in range(n)]
    shared, texts = made(60), [None, "", " ", "one two", "One  two", "a a a a a", "a a a a a a"]
    for n in (30, 60, 200, 1200):
        for _ in range(6):
            words = shared[:n] + made(n) if rng.random() < 0.5 else made(n)
            for share in (0, 0.005, 0.01, 0.015, 0.02, 0.03, 0.08):
                copy = [w if rng.random() >= share else "x" + str(rng.randint(0, 9)) for w in words]
                texts.append(" ".join(copy[: len(copy) - rng.choice([0, 0, 3])]))
    texts = rng.sample(texts, len(texts))
    label = components_by_hand(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    prints, found = simhash.similar_components(spark, docs)
    got = {r["doc_id"]: r["keep"]["doc_id"] for r in prints.join(found, "node").collect()}
    assert len(set(label.tolist())) < len(set(components_by_hand(texts, 0).tolist())) <= len(texts) - 60
    assert got == {i: int(x) for i, x in enumerate(label)}


def far_pairs(rng, mark, shares, number):
    """Pairs of texts with a likeness of exactly 0.8 that begin with the words of mark, which is among the least hashes
    of both, share so many of these hashes, and whose fingerprints are further apart than op8 links."""
    pairs = []
    while len(pairs) < number:
        words = mark.split() + [f"w{rng.randint(0, 10**6)}" for _ in range(24 - len(mark.split()))]
        a, b = " ".join(words), " ".join(words + [f"w{rng.randint(0, 10**6)}" for _ in range(5)])
        marks = [set(np.unique(simhash.shingle_hashes(simhash.words_of(x), 5))[: simhash.MARKS].tolist()) for x in (a, b)]
        if len(marks[0] & marks[1]) == shares and (simhash.simhash(a) ^ simhash.simhash(b)).bit_count() > 4:
            assert 5 * len(shingle_set(a) & shingle_set(b)) == 4 * len(shingle_set(a) | shingle_set(b))
            pairs.append((a, b))
    return pairs


@pytest.mark.parametrize("grams", [1 << 25, 20_000])
def test_similar_texts_without_a_second_mark(spark, monkeypatch, grams):
    """Pairs whose only common mark is crowded, and pairs without a common mark, are linked as well."""
    monkeypatch.setattr(simhash, "CROWD", 6)
    monkeypatch.setattr(simhash, "GRAMS", grams)
    monkeypatch.setattr(simhash, "FREQUENT", 4, raising=False)
    rng = random.Random(12)
    low = min((f"m{i} n o p q" for i in range(100_000)), key=lambda m: int(simhash.shingle_hashes(simhash.words_of(m), 5)[0]))
    crowded, without = far_pairs(rng, low, 1, 12), far_pairs(rng, "", 0, 3)
    texts = [x for p in crowded + without for x in p]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    label = components_by_hand(texts)
    prints, found = simhash.similar_components(spark, docs)
    got = {r["doc_id"]: r["keep"]["doc_id"] for r in prints.join(found, "node").collect()}
    assert got == {i: int(x) for i, x in enumerate(label)} == {i: i - i % 2 for i in range(len(texts))}


def test_prefixes_hold_a_common_gram():
    """Sets with a likeness of 0.8 or more meet in their prefixes and are partners there, in any order of the grams."""
    rng = np.random.default_rng(3)
    met = 0
    for _ in range(2000):
        common, n = np.unique(rng.integers(0, 1 << 32, rng.integers(1, 80), dtype=np.uint32)), rng.integers(0, 12, 2)
        sets = [np.unique(np.concatenate((common, rng.integers(0, 1 << 32, k, dtype=np.uint32)))) for k in n]
        known = np.sort(rng.permutation(common)[: rng.integers(0, len(common) + 1)])
        rank = rng.permutation(len(known))
        first = [simhash.prefix_of(x, known, rank) for x in sets]
        if 5 * len(np.intersect1d(*sets)) >= 4 * len(np.union1d(*sets)):
            met += 1
            gram = np.concatenate(first)
            side, size = np.repeat([1, 2], [len(x) for x in first]), np.repeat([len(x) for x in sets], [len(x) for x in first])
            rest = np.concatenate([len(x) - np.arange(len(f)) for x, f in zip(sets, first, strict=True)])
            assert sum(len(a) for a, _ in simhash.partners(gram, side, size, rest, side))
    assert met > 500


def test_partners_by_parities():
    """Pairs whose parities differ too much do not leave the task; none with a likeness of 0.8 or more is lost."""
    rng = np.random.default_rng(5)
    common = rng.integers(0, 1 << 32, 400, dtype=np.uint32)
    sets = [np.unique(np.concatenate((common[: 400 - k], rng.integers(0, 1 << 32, k, dtype=np.uint32)))) for k in rng.integers(0, 300, 120)]
    size, one = np.array([len(x) for x in sets]), np.zeros(len(sets), np.int64)
    parities = np.frombuffer(b"".join(simhash.parities_of(x) for x in sets), np.uint64).reshape(len(sets), -1)
    found = [{tuple(sorted(x)) for a, b in simhash.partners(one, one, size, size, np.arange(len(sets)), *more) for x in zip(a.tolist(), b.tolist(), strict=True)} for more in ((), (parities,))]
    alike = {(i, j) for i, j in found[0] if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))}
    assert 100 < len(alike) and alike <= found[1] and 2 * len(found[1]) < len(found[0])


def test_long_texts_by_more_parities():
    """Of sets so large that PARITIES say nothing, the wide ones part most pairs, and none with a likeness of 0.8 or more."""
    rng = np.random.default_rng(6)
    common = rng.integers(0, 1 << 32, 9000, dtype=np.uint32)
    sets = [np.unique(np.concatenate((common[: n - k], rng.integers(0, 1 << 32, k, dtype=np.uint32)))) for n, k in zip(rng.integers(3500, 9000, 60), rng.integers(0, 3000, 60), strict=True)]
    one, wide = [simhash.parities_of(x) for x in sets], [simhash.wide_parities(x) for x in sets]
    assert len({len(x) for x in wide}) == 3 and simhash.wide_parities(common[:512]) is None and simhash.wide_parities(common[:0]) is None
    alike, narrow, left = 0, 0, 0
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            most = simhash.may_differ(np.array([len(x) + len(y)]))[0]
            like = 5 * len(np.intersect1d(x, y)) >= 4 * len(np.union1d(x, y))
            apart = simhash.parities_apart(wide[i], wide[j])
            assert apart <= len(np.setxor1d(x, y)) and (not like or apart <= most)
            alike, narrow, left = alike + like, narrow + (simhash.parities_apart(one[i], one[j]) <= most), left + (apart <= most)
    assert alike > 20 and narrow == 60 * 59 // 2 and left < narrow / 2


def test_rows_that_meet_no_partner_stay():
    """A row that no other of its task can be like enough to leaves none; those of possible pairs all leave."""
    task, size = np.repeat(np.arange(200), 3), np.random.default_rng(7).integers(50, 200, 600)
    rest, component = size - size // 20, np.tile([0, 0, 1], 200)
    names = ["task", "side", "node", "size", "rest", "component"]
    table = pa.table([task, np.zeros(600, np.int64), np.arange(600), size.astype(np.int32), rest.astype(np.int32), component], names)
    got = [r["node"] for b in simhash._met(iter(table.to_batches(100))) for r in b.to_pylist()]
    pairs = [(i, j) for i in range(600) for j in range(600) if i // 3 == j // 3 and component[i] != component[j] and max(size[i], size[j]) * 9 + 1e-6 <= 9 * (1 + 1e-9) * min(rest[i] * 2.25 - size[i], rest[j] * 2.25 - size[j])]
    assert set(got) >= {x for p in pairs for x in p} and 50 < len(got) < 500 and got == sorted(set(got))


def test_sieve(spark):
    hashes = spark.range(5000).select(F.xxhash64("id").alias("h"))
    held = base.sieve(spark, hashes)
    assert hashes.where(held(F.col("h"))).count() == 5000
    assert spark.range(5000, 25_000).where(held(F.xxhash64("id"))).count() < 1000
    assert spark.range(10).where(base.sieve(spark, hashes.limit(0))(F.col("id"))).count() == 0


def test_kept_texts_are_not_shuffled(spark):
    """Only rows that may go are sent to the join which decides, whatever the size of what stays."""
    text = lambda k: " ".join(f"w{k * 31 + j}" for j in range(30))
    docs = spark.createDataFrame([(i, text(i // 2)) for i in range(60)] + [(None, "x"), (None, "y"), (None, "y")], "doc_id long, text string")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = simhash.keep_one(spark, docs)
        plan = kept._jdf.queryExecution().toString()
        assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([*((2 * i, text(i)) for i in range(30)), (None, "x"), (None, "y")], key=str)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "Union" in plan and "LeftAnti" in plan and "LeftSemi" not in plan


def test_near_duplicates_leave_no_scratch_tables(spark):
    """Of the near-duplicate stage's tables only that of the kept rows stays for the stages after it."""
    docs = spark.createDataFrame([(i, f"w{i % 7} a b c d e f g h") for i in range(40)], "doc_id long, text string")
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base.scratch_root(spark))
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = lambda: {x.getPath().getName() for x in files.listStatus(root)} if files.exists(root) else set()
    before = names()
    kept = simhash.keep_one(spark, docs)
    assert [x.split("-")[0] for x in names() - before] == ["kept"]
    assert kept.count() == 7


def test_shared_rows_over_batches():
    rng = np.random.default_rng(4)
    for step in (1, 2, 5, 1000):
        gram, node = np.array(sorted(zip(rng.integers(0, 200, 600), rng.integers(0, 12, 600), strict=True))).T
        table = pa.table({"gram": gram.astype(np.int32), "node": node, "size": gram.astype(np.int32), "rest": node.astype(np.int32)})
        got = [tuple(r.values())[:2] for b in simhash._shared(iter(table.to_batches(step))) for r in b.to_pylist()]
        pairs = sorted(set(zip(gram.tolist(), node.tolist(), strict=True)))
        count = {}
        for g, _ in pairs:
            count[g] = count.get(g, 0) + 1
        assert got == [p for p in pairs if count[p[0]] > 1]


def test_similar_texts_of_the_tables(spark):
    docs = base.table(spark, "/root/testdata/sf0.01", "documents")
    rows = sorted(docs.select("doc_id", "text").collect())
    label = components_by_hand([r["text"] for r in rows])
    assert {r["doc_id"] for r in simhash.keep_one(spark, docs).collect()} == {rows[x]["doc_id"] for x in set(label.tolist())}


def test_simhash_keeps_one(spark, hard, empty):
    kept = simhash.keep_one(spark, hard)
    comps = simhash.similar_components(spark, hard)[1].select("component").distinct().count()
    assert kept.count() == comps and kept.columns == hard.columns and simhash.keep_one(spark, empty).count() == 0


ITEMS = [(1, "A train leaves Paris at 9 hours and travels 120 km before it meets the second train near Lyon, how far did it go"), (2, "short one"), (3, None), (4, ""), (5, "1 2 3 4 5 6 7 8 9 10 11 12"), (6, "if a box holds 5 red balls and 5 blue balls then how many balls are in the box at the end of the day")]


def test_decontamination(spark, hard, empty):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("h", F.lit(1))
    filler = "nothing to see in this text at all, just words that go on and on. "
    docs = [
        (1, filler + ITEMS[0][1] + ". " + filler, True), (2, filler * 3, False), (3, None, False), (4, "", False),
        (5, filler + ITEMS[0][1].replace("120", "450").replace("Paris", "Rome").replace("Lyon", "Milan") + ".", True),  # new parameters
        (6, filler + ITEMS[5][1].replace("5 red", "7 red").replace("5 blue", "7 blue"), True),  # 5 became 7 both times
        (7, filler + ITEMS[5][1].replace("5 red", "7 red").replace("5 blue", "9 blue"), False),  # one value became two
        (8, " ".join(str(i) for i in range(3000)), True),  # holds item 5 by its exact words
        (9, "Short one!", True), (12, "the short one is here", False), (13, " ".join(str(2 * i) for i in range(3000)), False),  # two words match a whole document only
        (10, ITEMS[0][1][:60], False), (1, filler, False),
        (None, ITEMS[0][1], True), (11, (filler * 400) + ITEMS[0][1], True),
    ]
    df = spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string").withColumn("position", F.lit(0)).withColumn("item_id", F.lit(0))
    got = sorted(((r["doc_id"] is None, r["doc_id"], r["contaminated"]) for r in decontamination.judge(spark, df, bench).collect()), key=str)
    assert got == sorted(((d is None, d, c) for d, _, c in docs), key=str)
    assert decontamination.clean(spark, df, bench).count() == sum(not c for *_, c in docs)
    assert decontamination.judge(spark, hard, bench.limit(0)).where("contaminated").count() == 0
    assert decontamination.judge(spark, hard, bench).count() == hard.count() and decontamination.judge(spark, empty, bench).count() == 0


def test_decontamination_finds_planted_items(spark):
    d = "/root/testdata/sf0.01"
    flat = lambda t: " ".join(t.split())
    items = [flat(r["text"]) for r in base.table(spark, d, "benchmark").collect()]
    docs = {r["doc_id"]: flat(r["text"]) for r in base.table(spark, d, "documents").collect()}
    got = registry.QUERIES["op10_decontamination"](spark, d).collect()
    assert all(r["contaminated"] for r in got)
    assert {r["doc_id"] for r in got} == {i for i, t in docs.items() if any(x in t for x in items)}


def plain_words(text):
    import re

    return [w.lower() for w in re.findall(r"[^\W_]+", text or "")]


def test_decontamination_by_brute_force(spark):
    """Short, numeric, verbatim and re-parameterised items in filler; expected by plain search, not by the operator's parts."""
    rng = random.Random(3)
    letters = lambda: "".join(rng.choice("bcdfghklmnprstvw") + rng.choice("aeiou") for _ in range(3))
    vocabulary = [letters() for _ in range(3000)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items, reworded = [], {}
    for i in range(120):
        kind = i % 4
        if kind == 0:  # three or four words
            items.append(prose(rng.choice([3, 4])))
        elif kind == 1:  # numbers only
            items.append(" ".join(str(rng.randint(10, 99)) for _ in range(rng.randint(4, 9))))
        elif kind == 2:
            items.append(prose(rng.randint(8, 40)))
        else:  # a template whose numbers and names change together
            words = prose(rng.randint(12, 25)).split()
            slots = {k: 0 for k in range(2, len(words) - 1, 5)}
            old = [str(rng.randint(100, 999)) if k in slots else w for k, w in enumerate(words)]
            swap = {x: str(int(x) + 1000) for x in old if x.isdigit()}
            items.append(" ".join(old))
            reworded[i] = " ".join(swap.get(x, x) for x in old)
    docs, expected = [], []
    for d in range(600):
        text = prose(rng.randint(5, 120))
        if d % 3 == 0:
            i = rng.randrange(len(items))
            put = reworded[i] if i in reworded and rng.random() < 0.6 else items[i]
            text = f"{text}. {put}. {prose(9)}"
        docs.append(text)
        found = f" {' '.join(plain_words(text))} "
        expected.append(any(f" {' '.join(plain_words(x))} " in found for x in [*items, *reworded.values()]))
    bench = spark.createDataFrame(list(enumerate(items)) + [(0, items[0])], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontamination.judge(spark, spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), bench).collect()}
    said = [got[d]["contaminated"] for d in range(len(docs))]
    hit, wrong = sum(a and b for a, b in zip(said, expected)), sum(a and not b for a, b in zip(said, expected))
    print("recall", hit / sum(expected), "false", wrong)
    assert said == expected and sum(expected) > 150
    twice = [d for d in range(len(docs)) if f" {items[0]} " in f" {' '.join(plain_words(docs[d]))} "]
    assert all(got[d]["n_items"] == 2 for d in twice)


def test_frequent_windows_make_no_candidates(spark):
    rng = random.Random(5)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(600)]
    head = "which of the following words is the one"
    items = [f"{head} {' '.join(rng.sample(words, 14))}" for _ in range(60)]
    docs = [f"{head} {' '.join(rng.sample(words, 30))}" for _ in range(400)] + items[:7]
    bench, df = spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    found, _, sizes = decontamination.item_windows(spark, bench)
    hits = df.select("doc_id", F.lit(0).alias("text_hash"), F.col("doc_id").alias("x")).crossJoin(found.groupBy("h").count().where("count > 50").select("h"))
    assert sizes == [] and decontamination.candidates(spark, hits, found, 0.8).count() == 0  # hot windows alone name nobody
    assert {r["doc_id"] for r in decontamination.judge(spark, df, bench).where("contaminated").collect()} == set(range(400, 407))


TRIP = "A car travels 20 km in 2 hours and a bus travels 30 km in 3 hours and a train travels 40 km in 5 hours, so which of them is the fastest"


def test_decontamination_of_repeated_templates(spark, hard):
    bench = spark.createDataFrame([(1, TRIP)], "item_id long, text string")
    filler = "nothing to see in this text at all, just words that go on and on "
    new = TRIP.replace("20 km in 2", "25 km in 4").replace("30 km in 3", "35 km in 6").replace("40 km in 5", "45 km in 7")
    docs = [(k, " ".join((filler * 3).split()[:k]) + " " + TRIP + ". " + filler, True) for k in (0, 1, 7, 16, 31)]
    docs += [(50, filler + new, True), (51, filler + TRIP.replace(" and a train", " and then also a train"), True)]
    docs += [(53, filler * 4, False), (54, TRIP.replace("20 km in 2", "30 km in 3").replace("40 km in 5", "30 km in 3"), True), (55, TRIP + ". " + new, True), (56, (TRIP + " ") * 300, True)]
    df = spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string")
    got = {r["doc_id"]: r["contaminated"] for r in decontamination.judge(spark, df, bench).collect()}
    assert got == {d: c for d, _, c in docs}


def test_targets():
    assert mixing.source_targets({}) == {} and mixing.source_targets({"a": 0}) == {"a": 0}
    got = mixing.source_targets({"a": 10, "b": 1000, None: 1000, "é": 500})
    assert got["a"] == 30 and abs(sum(got.values()) - 2510) < 1e-6 and all(got[k] <= 3 * s + 1e-9 for k, s in {"a": 10, "b": 1000, None: 1000, "é": 500}.items())
    even = mixing.source_targets({"a": 800, "b": 800, "c": 800})
    assert [round(even[k]) for k in "abc"] == [1500, 600, 300]


def test_mixture(spark, hard, empty):
    d = "/root/testdata/sf0.01"
    docs = base.table(spark, d, "documents")
    a, b = (mixing.mix(spark, docs.repartition(n)).select("doc_id", "size", "source_size", "target", "taken").toPandas().sort_values("doc_id").reset_index(drop=True) for n in (1, 5))
    assert a.equals(b)
    assert (a.taken <= 3 * a["size"]).all() and (a.taken >= 0).all()
    told = a.merge(docs.select("doc_id", "source").toPandas(), on="doc_id").groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("size", "sum"), said=("source_size", "first"))
    assert (told["size"] == told.said).all() and (abs(told.taken / told.target - 1) < 0.03).all()
    expected = mixing.source_targets(told["size"].to_dict())
    assert all(abs(expected[s] - t) < 1e-6 * t for s, t in told.target.items())
    got = mixing.mix(spark, hard, keep=("source", "size"))
    assert got.count() == hard.count() and mixing.mix(spark, empty).count() == 0
    assert got.where("size = 'clash'").count() == hard.count()
    assert mixing.mix(spark, hard.where("text is null or text = ''")).where("taken = 0 and size = 0").count() == 2


def test_pipeline(spark):
    d = "/root/testdata/sf0.001"
    docs = base.table(spark, d, "documents")
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        before, (kept, _) = kept, base.written(spark, stage(spark, kept, d), f"test-{name}")
        if name != "mixture":
            assert kept.columns == docs.columns
        if name == "near_duplicates":
            rows = sorted(before.select("doc_id", "text").collect())
            label = components_by_hand([r["text"] for r in rows])
            assert {r[0] for r in kept.select("doc_id").collect()} == {rows[x]["doc_id"] for x in set(label.tolist())}
        if name in ("secrets", "mixture"):
            assert kept.count() == before.count()
    assert kept.where("taken = copies * size and copies between 0 and 3").count() == kept.count() > 0
    ran = corpus_pipeline.run(spark, d)
    assert {tuple(r) for r in ran.select("doc_id", "taken").collect()} == {tuple(r) for r in kept.select("doc_id", "taken").collect()}


def test_stages_on_hard_rows(spark, hard, empty):
    for rows in (hard, empty):
        docs = rows
        for name, stage in corpus_pipeline.STAGES:
            docs, _ = base.written(spark, stage(spark, docs, "/root/testdata/sf0.001"), f"hard-{name}")
            assert set(rows.columns) <= set(docs.columns)
            if name != "mixture":
                assert docs.columns == rows.columns
        ids = [r["doc_id"] for r in docs.collect()]
        assert len(ids) == len(set(ids)) and (0 < len(ids) < hard.count() if rows is hard else not ids)


def test_best_choice_by_all_choices():
    rng = random.Random(6)
    for _ in range(60):
        rows = [(i, rng.choice([1, 3, 40, 700, 1885]), c := rng.randint(0, 3), lo := rng.randint(0, 2), lo + 1) for i in range(rng.randint(0, 9))]
        gap = rng.uniform(-2500, 2500)
        ends = {0}
        for _, size, c, lo, hi in rows:
            ends = {e + size * (x - c) for e in ends for x in (lo, hi)}
        told = dict(mixing.best_choice(gap, rows))
        assert all(lo <= c + told.get(i, 0) <= hi for i, _, c, lo, hi in rows)
        assert abs(sum(told.get(i, 0) * size for i, size, *_ in rows) - gap) == min(abs(e - gap) for e in ends)


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_small_sources_come_near_their_targets(spark, scale):
    """Within half a hundredth of the target, or as near as any choice of floors and ceilings of the same rates comes."""
    docs = base.table(spark, f"/root/testdata/{scale}", "documents")
    got = mixing.mix(spark, docs, keep=("source",)).toPandas()
    sizes = docs.select(F.col("source"), mixing.word_count(F.col("text")).alias("size")).groupBy("source", "size").agg(F.count("*").alias("n"))
    totals = mixing.source_totals(sizes)
    dual = mixing.solve_dual(spark, sizes, totals, mixing.source_targets({s: w for s, (w, _) in totals.items()}))
    for source, part in got.groupby("source"):
        target, taken = part.target.iloc[0], int(part.taken.sum())
        if abs(taken / target - 1) > 0.005:
            lam, scale_ = dual[source]
            ends = np.zeros(3 * int(part["size"].sum()) + 1, bool)
            ends[0] = True
            for n in part["size"]:
                rate = min(3.0, float(np.exp(min(lam * n / scale_, np.log(3.0)))))
                new = np.zeros_like(ends)
                for c in {int(np.floor(rate)), int(np.ceil(rate))}:
                    new[c * n :] |= ends[: len(ends) - c * n]
                ends = new
            assert abs(taken - target) <= np.abs(np.flatnonzero(ends) - target).min() + 1e-6, source
    assert (got.taken <= 3 * got["size"]).all()


def test_mixture_of_repeated_ids(spark):
    for seed in range(4):
        rng = random.Random(seed)
        rows = [(i % 7 if i < 60 else 100 + i, " ".join(["w"] * rng.choice([0, 1, 7, 39, 400])), rng.choice(["a", "b", "c", None])) for i in range(60 + 10 * seed)]
        got = mixing.mix(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"))
        assert got.where("copies < 0 or copies > 3 or taken <> copies * size").count() == 0 and got.count() == len(rows)


def test_rates_solve_the_dual(spark):
    docs = base.table(spark, "/root/testdata/sf0.01", "documents")
    pairs = docs.select(F.col("source"), mixing.word_count(F.col("text")).alias("size")).groupBy("source", "size").agg(F.count("*").alias("n"))
    totals = mixing.source_totals(pairs)
    targets = mixing.source_targets({s: w for s, (w, _) in totals.items()})
    dual = mixing.solve_dual(spark, pairs, totals, targets)
    told = pairs.toPandas()
    for source, part in told.groupby("source"):
        size, n = part["size"].to_numpy(float), part.n.to_numpy(float)
        words = lambda lam: float((n * size * np.minimum(3.0, np.exp(np.minimum(lam * size, 2.0)))).sum())  # noqa: B023, E731
        low, high = -5.0, 5.0
        for _ in range(200):  # bisection, apart from the operator's Newton steps
            mid = (low + high) / 2
            low, high = (mid, high) if words(mid) < targets[source] else (low, mid)
        lam, scale = dual[source]
        if np.isinf(lam):
            assert targets[source] >= 3 * totals[source][0] * (1 - 1e-9)
            continue
        rates = np.minimum(3.0, np.exp(np.minimum(lam * size / scale, np.log(3.0))))
        assert np.allclose(rates, np.minimum(3.0, np.exp(np.minimum(low * size, 2.0))), rtol=1e-5)
        assert abs((n * size * rates).sum() / targets[source] - 1) < 1e-6
