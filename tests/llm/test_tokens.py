"""Byte-level BPE, token counts and packing against their libraries."""

import base64
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

from tablewright.llm import bpe, packing, token_counts
from tests.llm.fixtures import awkward_documents, awkward_texts, documents, prose, rows_of

RANKS, WORD, JSON = (public_tokenizers.path(n) for n in ("byte_bpe_50k.tiktoken", "word_bpe_49k.json", "byte_bpe_50k.json"))


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_text(rng):
    bits = [" ", "  ", "\n", "\t", "\r\n", "a", "Word", "don't", "'s", "I'LL", "42", "3.14", "é", "Ü", "ß", "日本", "😀", " ", " ", "\x1c", "\x01", "!!", "…", "_", "ﬁ", "<|endoftext|>", "İ", "K", "ſ", "´", "½", "x" * 30]
    return "".join(rng.choice(bits) for _ in range(rng.randrange(1, 300)))


def test_tree_joins_are_exact():
    plain, rng = library(), random.Random(5)
    for leaf, window in ((1, 1), (7, 2), (50, 8)):
        tree = bpe.ByteBPE(RANKS, public_tokenizers.PATTERN, leaf, window)
        for _ in range(60):
            text = odd_text(rng)
            ids = tree.encode(text)
            assert ids == plain.encode_ordinary(text)
            assert tree.decode(ids, 4) == text.encode()


def test_round_trip(spark):
    plain = library()
    rows, docs = awkward_documents(spark)
    want = []
    for i, t in rows:
        ids = plain.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = rows_of(bpe.round_trip_digests(docs, RANKS, public_tokenizers.PATTERN), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert got == sorted(want, key=repr)
    coded = bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN)
    back = bpe.decode_documents(coded, RANKS, public_tokenizers.PATTERN)
    assert rows_of(back, "doc_id", "data") == sorted([(i, bytearray((t or "").encode())) for i, t in rows], key=repr)
    assert bpe.round_trip_digests(documents(spark, []), RANKS, public_tokenizers.PATTERN).collect() == []


def test_round_trip_of_long_texts(spark):
    """Very long texts, with and without edges at which the tree can join."""
    plain = library()
    rows = [(1, prose(1, 60_000, per_line=30)), (2, "x" * 200_000), (3, "\n" * 90_000), (4, "日本語" * 30_000)]
    want = [(i, len(ids := plain.encode_ordinary(t)), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()) for i, t in rows]
    assert rows_of(bpe.round_trip_digests(documents(spark, rows), RANKS, public_tokenizers.PATTERN), "doc_id", "n_tokens", "ids_sha256") == want


def test_batches_hold_so_many_bytes():
    pieces = [(k, "é" * n) for k, n in enumerate((10, 200, 3, 4, 90, 1))]
    out = list(token_counts.byte_batches(pieces, 100))
    assert [p for owners, held in out for p in zip(owners, held, strict=True)] == pieces
    assert all(len(held) == 1 or sum(len(x.encode()) for x in held) <= 100 for _, held in out)


def test_counts(spark):
    tok = Tokenizer.from_file(JSON)
    rows, docs = awkward_documents(spark)
    rows = rows + [(900, prose(8, 30_000) + " <|endoftext|>  \n x")]
    docs = documents(spark, rows)
    want = [(i, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False)), n > 1024) for i, t in rows]
    assert rows_of(token_counts.count_tokens(docs, JSON), "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=repr)
    assert token_counts.count_tokens(documents(spark, []), JSON).collect() == []


def test_safe_pieces_add_up():
    tok, rng = Tokenizer.from_file(JSON), random.Random(6)
    for _ in range(80):
        text = odd_text(rng)
        pieces = token_counts.safe_pieces(text, 10)
        assert "".join(pieces) == text
        assert sum(len(tok.encode(p, add_special_tokens=False)) for p in pieces) == len(tok.encode(text, add_special_tokens=False))


def test_lengths_are_the_library_s():
    tok, count, rng = Tokenizer.from_file(JSON), token_counts.Lengths(JSON), random.Random(9)
    assert count._fast is not None
    latin = ["a", "Word", "don't", "'s", "I'LL", "42", "½", "²", "é", "Ü", "ß", "_", "!!", "-", " ", "  ", "\n", "\t", "\r\n", "x" * 40, "'", "“q”", "…", "€", "–", "tokenization", "<|", "<|endoftext|>"]
    texts = [odd_text(rng) for _ in range(150)] + ["".join(rng.choice(latin) for _ in range(200)) for _ in range(300)] + [t for t in awkward_texts() if t is not None]
    assert count(texts) == [len(e) for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_word_ids_are_the_library_s():
    tok, mine, rng = Tokenizer.from_file(WORD), packing.WordIds(WORD), random.Random(7)
    assert mine._fast is not None
    latin = ["a", "Word", "don't", "'s", "I'LL", "42", "3.14", "é", "Ü", "ß", "ÿ", "_", "!!", "-", "  ", "\n", "\t", "x" * 40, "'", '"', "'re", "\x00", "\x1f", "tokenization", "antidisestablishmentarianism"]
    texts = [odd_text(rng) for _ in range(150)] + ["".join(rng.choice(latin) for _ in range(200)) for _ in range(300)] + [t for t in awkward_texts() if t is not None]
    for text in texts:
        assert np.frombuffer(mine.encode(text), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, repr(text[:80])


def check_packing(rows, got, tok, sequence=2048):
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    want = defaultdict(list)
    for i, t in rows:
        want[i].append([*tok.encode(t or "", add_special_tokens=False).ids, 1])
    assert set(want) == set(pieces)
    for i, documents_of in want.items():
        expect = sorted(len(d) for d in documents_of)
        assert sum(r["length"] for r in pieces[i]) == sum(expect)
        for r in pieces[i]:
            fits = [d for d in documents_of if len(d) == r["doc_tokens"] and zlib.crc32(np.array(d[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"]]
            assert fits
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at and length > 0
            at += length
        assert at <= sequence
    return len(bins)


def test_packing(spark):
    tok = Tokenizer.from_file(WORD)
    rows, docs = awkward_documents(spark)
    rows = rows + [(1000 + k, prose(k, 20 + 37 * (k % 40))) for k in range(200)] + [(5000 + k, "the same text") for k in range(100)]
    got = packing.pack(documents(spark, rows, 5), WORD).collect()
    bins = check_packing(rows, got, tok)
    total = sum(r["length"] for r in got)
    assert bins * 2048 <= 1.03 * total + 2048
    assert packing.pack(documents(spark, []), WORD).collect() == []


def test_packing_many_lengths(spark):
    """More than 500 classes of lengths; the driver's solver must not hang beside the JVM."""
    rows = [(k, prose(k, 5 + 3 * k, per_line=10**6)) for k in range(650)]
    out = packing.pack(documents(spark, rows, 4), WORD)
    got = out.collect()
    assert len({-(-r["length"] // packing.UNIT) for r in got}) > 300
    assert len({r["sequence_id"] for r in got}) * 2048 <= 1.04 * sum(r["length"] for r in got) + 2048
    demand = {c: 1 + c % 7 for c in range(1, 513)}
    used = defaultdict(int)
    for pattern, times in packing.solve_patterns(demand, 512):
        for c, n in pattern.items():
            used[c] += n * times
    assert dict(used) == demand


def test_packing_long_and_repeated_texts(spark):
    """A text of many sequences, rows that repeat an id or all of a row, and ties of length."""
    long = prose(3, 12_000)
    rows = [(1, long), (1, long), (1, "other"), (None, "x y"), (None, None), (2, "tie one"), (3, "tie two"), (4, "")]
    got = packing.pack(documents(spark, rows, 3), WORD).collect()
    check_packing(rows, got, Tokenizer.from_file(WORD))


def test_column_generation_covers_demand():
    rng = random.Random(8)
    for _ in range(10):
        demand = {c: rng.randrange(0, 500) for c in [1, 2, *rng.sample(range(3, 33), 20)]}
        used = defaultdict(int)
        patterns = packing.solve_patterns(demand, 64)
        for pattern, times in patterns:
            assert sum(c * n for c, n in pattern.items()) <= 64
            for c, n in pattern.items():
                used[c] += n * times
        assert dict(used) == {c: n for c, n in demand.items() if n}
        total = sum(c * n for c, n in demand.items())
        assert sum(t for _, t in patterns) <= 1.02 * total / 64 + 12
