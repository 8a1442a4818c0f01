"""Embedding near-dedup and fingerprints."""

import hashlib
import math
import re
import struct

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tablewright.llm import embedding_dedup, fingerprints
from tests.llm.fixtures import awkward_documents, documents, prose, rows_of
from tests.llm.test_near_copies import roots, shingles


def vectors(seed=3, dims=16):
    rng, out = np.random.default_rng(seed), []
    for k in range(30):
        centre = rng.normal(size=dims)
        for spread in (0.0, 0.02, 0.05, 0.08, 0.1, 0.13):
            out.append((centre + spread * np.linalg.norm(centre) / math.sqrt(dims) * rng.normal(size=dims), k % 3))
    rows = [(i, [float(np.float32(x)) for x in v], label) for i, (v, label) in enumerate(out)]
    one = rows[0][1]
    rows += [(900, None, 1), (901, [0.0] * dims, 1), (902, [float("nan")] * dims, 1), (903, [1.0, None] + [0.0] * (dims - 2), 1), (904, one, None), (905, [float("inf")] + [1.0] * (dims - 1), 0)]
    rows += [(906, one, 0), (907, one, 0), (0, one, 0), (None, one, 0), (908, one, 1), (909, [], 0), (910, one[:5], 0), (911, [2 * x for x in one], 0), (912, [1.0], 0), (913, [3.0], 0), (914, [-1.0], 0)]
    return rows


def brute(rows, threshold, low=-(2**63)):
    good = lambda v: v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)
    cos = lambda a, b: float(np.dot(a, b)) / math.sqrt(float(np.dot(a, a)) * float(np.dot(b, b)))
    usable = [label is not None and good(v) for _, v, label in rows]
    links = [
        (a, b)
        for a in range(len(rows))
        for b in range(a)
        if usable[a] and usable[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]) and (rows[a][1] == rows[b][1] or cos(rows[a][1], rows[b][1]) >= threshold)
    ]
    root, count = roots(len(rows), links), [0] * len(rows)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    own = [low if i is None else i for i, _, _ in rows]
    least = {}
    for k, r in enumerate(root):
        least[r] = min(least.get(r, 2**63), own[k])
    show = lambda x: None if x == low else x
    return sorted([(i, count[k], show(least[root[k]]), own[k] == least[root[k]]) for k, (i, _, _) in enumerate(rows)], key=repr)


def test_embeddings(spark):
    rows = vectors()
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, cls int, vec string").repartition(3)
    for threshold, block in ((0.98, 4096), (0.98, 8), (0.9, 4096)):
        got = embedding_dedup.embedding_duplicates(frame, threshold, block_rows=block)
        assert rows_of(got, "vec_id", "n_links", "component_id", "kept") == brute(rows, threshold)
    assert embedding_dedup.embedding_duplicates(frame.where("vec_id < 0")).collect() == []


def test_embeddings_in_large_tiles(spark):
    """Tiles of many cells and blocks: every pair within reach meets once."""
    rng, rows = np.random.default_rng(8), []
    axis = np.eye(6)[0] * 3
    for k in range(260):  # alike on two axes, spread over a third and the rest
        rows.append((k, (axis + np.array([0, 0.05, 1.2, 0.15, 0.1, 0.1]) * rng.normal(size=6)).tolist(), 1))
    rows += [(300 + k, rows[k][1], 1) for k in range(10)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    for block in (1000, 30, 6):
        got = embedding_dedup.embedding_duplicates(frame, 0.98, block_rows=block)
        assert rows_of(got, "vec_id", "n_links", "component_id", "kept") == brute(rows, 0.98)


def test_embeddings_of_extreme_size(spark):
    """Squares of components would under- or overflow; columns of other names do no harm."""
    rows = [(1, [1e-200, 0.0], 1), (2, [1e200, 1e199], 1), (3, [3.0, 0.3], 1), (4, [5e-324, 0.0], 1), (5, [-1e-200, 0.0], 1), (6, [1.7e308, 1.7e308], 1), (7, [0.0, 1e-300], 1)]
    frame = spark.createDataFrame([(*r, 0, [1.0]) for r in rows], "vec_id long, embedding array<double>, label int, parts int, vec array<double>")
    got = rows_of(embedding_dedup.embedding_duplicates(frame), "vec_id", "n_links", "component_id")
    assert got == [(1, 3, 1), (2, 3, 1), (3, 3, 1), (4, 3, 1), (5, 0, 5), (6, 0, 6), (7, 0, 7)]


def signed(h):
    return h - 2**64 if h >= 2**63 else h


def text_hash(text):
    return signed(xxhash.xxh64_intdigest(text.encode(), seed=42))


def sketch_of(text, k=128):
    words = [text_hash(w) for w in re.split("[ \t\n\x0b\x0c\r]+", text) if w]
    found = set()
    for part in [words[i : i + 5] for i in range(len(words) - 4)] or ([words] if words else []):
        h = 42 if len(words) >= 5 else 0
        for w in part:
            if len(words) >= 5:
                h = xxhash.xxh64_intdigest(struct.pack("<q", w), seed=h)
            else:
                h = xxhash.xxh64_intdigest(struct.pack("<q", w), seed=xxhash.xxh64_intdigest(struct.pack("<q", signed(h)), seed=42))
        found.add(signed(h))
    return sorted(found)[:k]


def likeness(a, b, k=128):
    union = sorted(set(a) | set(b))[:k]
    return len(set(union) & set(a) & set(b)) / len(union) if union else 1.0


def brute_neighbours(rows, low=-(2**63)):
    """Every column of edited_neighbours, from the definition alone."""
    order = sorted(((low if i is None else i, t or "") for i, t in rows), key=lambda r: (-r[0], text_hash(r[1])))
    out = []
    for k, (i, t) in enumerate(order):
        after, cut = order[(k + 1) % len(order)][1], len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        a, e, x = sketch_of(t), sketch_of(edited), sketch_of(after)
        show = lambda s: "".join(f"{h % 2**64:016X}" for h in s)
        out.append((None if i == low else i, len(t), hashlib.sha256(edited.encode()).hexdigest(), show(a), show(e), likeness(a, e), likeness(a, x)))
    return sorted(out, key=repr)


NEIGHBOURS = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def test_fingerprints(spark):
    rows, docs = awkward_documents(spark)
    assert rows_of(fingerprints.edited_neighbours(docs), *NEIGHBOURS) == brute_neighbours(rows)
    plain = [(k * 7, prose(k, 3 + 9 * k)) for k in range(60)] + [(10**12, prose(4, 900)), (10**12 + 700, "x"), (-1, "below zero"), (-(10**9), prose(5, 40))]
    assert rows_of(fingerprints.edited_neighbours(documents(spark, plain)), *NEIGHBOURS) == brute_neighbours(plain)
    assert fingerprints.edited_neighbours(documents(spark, [])).collect() == []
    lone = fingerprints.edited_neighbours(documents(spark, [(5, "one two three four five six")])).collect()
    assert len(lone) == 1 and lone[0]["near_next"] == 1.0


def test_fingerprints_of_ids_that_many_rows_share(spark):
    """Rows of one id, null too, meet in no single window; copies of one text follow each other."""
    rows = [(None, prose(k % 40, 12)) for k in range(120)] + [(4, prose(200 + k, 10)) for k in range(50)] + [(k, prose(300 + k, 15)) for k in range(5, 20)] + [(4, "same")] * 20 + [(None, None)] * 3
    for docs in (documents(spark, rows, 5), documents(spark, rows[120:170], 2), documents(spark, [(7, "a b"), (7, "a b")])):
        at = [(r["doc_id"], r[1]) for r in docs.collect()]
        assert rows_of(fingerprints.edited_neighbours(docs), *NEIGHBOURS) == brute_neighbours(at)


def test_next_lower_crosses_zero(spark):
    ids = [-(2**63), -5, -1, 0, 3, 700]
    below = fingerprints.next_lower(spark.createDataFrame([(i,) for i in ids], "doc long")).collect()
    assert sorted(map(tuple, below)) == [(i, ids[k - 1]) for k, i in enumerate(ids)]


def test_sketches_estimate(spark):
    base = prose(20, 3000, per_line=10**6)
    words = base.split(" ")
    pairs = [(k, base, " ".join(words[: 3000 - 250 * k] + prose(30 + k, 250 * k + 1, per_line=10**6).split(" "))) for k in range(10)]
    df = spark.createDataFrame(pairs, "k int, a string, b string").select("k", "a", "b", fingerprints.sketch(F.col("a")).alias("x"), fingerprints.sketch(F.col("b")).alias("y"))
    df = df.select("*", fingerprints.resemblance(F.col("x"), F.col("y")).alias("j"), fingerprints.containment(F.col("x"), F.col("y")).alias("c"), fingerprints.distinct_shingles(F.col("y")).alias("n"))
    for r in df.collect():
        a, b = shingles(r["a"]), shingles(r["b"])
        assert abs(r["j"] - len(a & b) / len(a | b)) < 0.15
        assert abs(r["c"] - len(a & b) / len(a)) < 0.2
        assert abs(r["n"] / len(b) - 1) < 0.35


def test_sketches_merge(spark):
    a, b = prose(40, 500), prose(41, 700)
    df = spark.createDataFrame([(a, b)], "a string, b string")
    hashes = lambda c: fingerprints.shingle_hashes(F.col(c))
    whole = fingerprints.smallest(F.concat(hashes("a"), hashes("b")))
    parts = fingerprints.merge(fingerprints.smallest(hashes("a")), fingerprints.smallest(hashes("b")))
    assert df.select((whole == parts).alias("same")).first()["same"]
