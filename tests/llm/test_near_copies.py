"""MinHash near-dedup, substring dedup and the components below them against brute force."""

import random
import re
from collections import defaultdict

import numpy as np

from tablewright.llm import common, minhash_dedup, substring_dedup
from tests.llm.fixtures import awkward_documents, awkward_texts, documents, prose, rows_of


def shingles(text):
    words = (text or "").encode().lower().split()
    words = [w for w in words if w]
    if not words:
        return frozenset()
    return frozenset([tuple(words)]) if len(words) < 5 else frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def roots(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def brute(rows, percent=85, low=-(2**63)):
    sets = [shingles(t) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    root = roots(len(rows), links)
    least = defaultdict(lambda: 2**63)
    for k, (i, _) in enumerate(rows):
        least[root[k]] = min(least[root[k]], low if i is None else i)
    own = [low if i is None else i for i, _ in rows]
    show = lambda x: None if x == low else x
    return sorted([(i, len(sets[k]), show(least[root[k]]), own[k] == least[root[k]]) for k, (i, _) in enumerate(rows)], key=repr)


COLUMNS = ("doc_id", "n_shingles", "component_id", "kept")


def edited(text, share, rng):
    words = text.split(" ")
    for _ in range(max(1, int(share * len(words)))):
        words[rng.randrange(len(words))] = "edit" + str(rng.randrange(10**6))
    return " ".join(words)


def test_awkward(spark):
    rows, docs = awkward_documents(spark)
    assert rows_of(minhash_dedup.near_duplicates(docs), *COLUMNS) == brute(rows)


def test_edited_copies(spark):
    rng, rows = random.Random(11), []
    for k in range(40):
        base = prose(k, 120 + 20 * (k % 7), per_line=10**6)
        rows.append((len(rows) + 1, base))
        for share in (0.004, 0.01, 0.016, 0.02, 0.03):
            rows.append((len(rows) + 1, edited(base, share, rng)))
    chain = prose(99, 200, per_line=10**6)
    for _ in range(30):  # each links with the next only
        rows.append((len(rows) + 1, chain))
        chain = edited(chain, 0.011, rng)
    rng.shuffle(rows)
    assert rows_of(minhash_dedup.near_duplicates(documents(spark, rows, 5)), *COLUMNS) == brute(rows)


def test_large_groups_are_dealt_into_blocks(spark):
    rng, base = random.Random(12), prose(50, 150, per_line=10**6)
    rows = [(k, edited(base, 0.007, rng)) for k in range(90)] + [(k, prose(1000 + k, 60)) for k in range(100, 130)] + [(200 + k, base) for k in range(50)]
    got = minhash_dedup.near_duplicates(documents(spark, rows, 4), block_docs=16, block_shingles=3000)
    assert rows_of(got, *COLUMNS) == brute(rows)


def test_groups_of_many_blocks(spark):
    """Dense groups, chains, and members that only look alike, in blocks of a few."""
    rng, rows = random.Random(31), []
    base = prose(51, 150, per_line=10**6)
    rows += [(len(rows), edited(base, 0.007, rng)) for _ in range(70)]
    chain = prose(52, 200, per_line=10**6)
    for _ in range(60):
        rows.append((len(rows), chain))
        chain = edited(chain, 0.011, rng)
    half = base.split(" ")
    rows += [(len(rows), " ".join(half[:110] + prose(2000 + k, 25, 10**6).split(" "))) for k in range(60)]
    rng.shuffle(rows)
    for block in (3, 7):
        got = minhash_dedup.near_duplicates(documents(spark, rows, 4), matches=10, block_docs=block, block_shingles=10**6)
        assert rows_of(got, *COLUMNS) == brute(rows)


def test_collisions_are_counted_exactly():
    rng = np.random.default_rng(5)
    for _ in range(20):
        n, c, matches = int(rng.integers(2, 60)), 12, int(rng.integers(4, 10))
        sig = rng.integers(-3, 3, (n, c)).astype(np.int32)
        alike = rng.integers(0, n, n) if rng.random() < 0.5 else None
        forest = minhash_dedup.Forest(n, alike)
        minhash_dedup.collided(sig, matches, forest)
        links = [(x, y) for x in range(n) for y in range(x) if (sig[x] == sig[y]).sum() >= matches]
        same = [(x, y) for x in range(n) for y in range(x) if alike is not None and alike[x] == alike[y]]
        want, got = roots(n, links + same), forest.root.tolist()
        assert all((want[x] == want[y]) == (got[x] == got[y]) for x in range(n) for y in range(n))
        assert all((sig[x] == sig[y]).sum() >= matches for x, y in forest.made)


def test_long_texts(spark):
    """Very long texts, equal but for a few words, and a text of one word many times."""
    rng, long = random.Random(33), prose(60, 30_000, per_line=40)
    rows = [(1, long), (2, edited(long, 0.001, rng)), (3, "word " * 50_000), (4, "word " * 40_000), (5, prose(61, 30_000))]
    assert rows_of(minhash_dedup.near_duplicates(documents(spark, rows)), *COLUMNS) == brute(rows)


def test_empty(spark):
    assert minhash_dedup.near_duplicates(documents(spark, [])).collect() == []
    assert substring_dedup.substring_dedup(documents(spark, [])).collect() == []


def test_components(spark):
    rng = random.Random(13)
    edges = [(k, k + 1) for k in range(200)] + [(1000, 1000 + k) for k in range(1, 300)] + [(rng.randrange(3000, 3400), rng.randrange(3000, 3400)) for _ in range(250)] + [(7000, 7000)]
    got = {r["node"]: r["component"] for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = sorted({x for e in edges for x in e if e[0] != e[1]})
    at = {x: k for k, x in enumerate(nodes)}
    root = roots(len(nodes), [(at[a], at[b]) for a, b in edges if a != b])
    assert got == {x: nodes[root[at[x]]] for x in nodes}


def brute_passages(rows, min_words):
    """Rank documents by id; a unit is repeated where an earlier document, or this one earlier, has its words."""
    ranked = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))
    seen, out, units = set(), {}, substring_dedup.Units()
    for k in ranked:
        text = rows[k][1] or ""
        places = [m.span() for m in re.finditer(r"[^ \t\n\x0b\x0c\r]+", text)]
        words = [text[a:b].encode().lower() for a, b in places]
        here, covered = set(), [False] * len(words)
        _, first, ends, _, starts, stops = units([text.encode()])
        assert [text.encode()[a:b].lower() for a, b in zip(starts, stops, strict=True)] == words
        for a, b in zip(first.tolist(), ends.tolist(), strict=True):
            assert b - a >= substring_dedup.UNIT_WORDS or places[b - 1][1] - places[a][0] >= substring_dedup.MIN_BYTES // 4
            key = tuple(words[a:b])
            if key in seen or key in here:
                covered[a:b] = [True] * (b - a)
            here.add(key)
        seen |= here
        spans, a = [], None
        for x, c in enumerate([*covered, False]):
            if c and a is None:
                a = x
            if not c and a is not None:
                if x - a >= min_words or len(text[places[a][0] : places[x - 1][1]].encode()) >= substring_dedup.MIN_BYTES:
                    spans.append((places[a][0], places[x - 1][1]))
                a = None
        out[rows[k][0]] = spans
    return out


def test_units_do_not_depend_on_the_texts_beside_them():
    units, texts = substring_dedup.Units(), [(t or "").encode() for t in awkward_texts()]
    together = units(texts)
    for k, t in enumerate(texts):
        alone = units([t])
        assert alone[0].tolist() == together[0][together[3] == k].tolist()


def test_repeated_lines_go_whatever_surrounds_them(spark):
    """Lines found by their normalised text alone, without Units; in scripts without spaces too."""
    rng = random.Random(22)
    lines = [prose(50_000 + k, 32 + k % 9, per_line=10**6) for k in range(30)] + ["日本語の文章" * (16 + k) + str(k) for k in range(10)]
    short = [prose(51_000 + k, 12, per_line=10**6) for k in range(5)]
    rows = []
    for k in range(60):
        text = []
        for n, line in enumerate(rng.sample(lines, 4) + rng.sample(short, 2)):
            text += [rng.choice(["", "  "]) + (line.upper() if rng.random() < 0.3 else line), prose(52_000 + 100 * k + n, 14, 10**6)]
        rows.append((k, "\n".join(text)))
    seen, want = set(), {}
    for k, text in rows:
        keyed = [(line.strip(), " ".join(line.lower().split())) for line in text.split("\n")]
        want[k] = [line for line, key in keyed if not (key in seen and (len(key.split()) >= 32 or len(key.encode()) >= 256))]
        seen |= {key for _, key in keyed}
    for r in substring_dedup.substring_dedup(documents(spark, rows)).collect():
        assert [line.strip() for line in r["text"].split("\n") if line.strip()] == want[r["doc_id"]], r["doc_id"]


def test_frequent_digests_are_salted(spark, monkeypatch):
    """A passage that a third of all rows hold, met often by some tasks and by others not."""
    monkeypatch.setattr(substring_dedup._Often, "LEAST", 5)
    passage = prose(7200, 70, per_line=10**6)
    for shared in (False, True):
        rows = [(k if not shared else k // 3, f"{prose(60_000 + k, 20, 10**6)}\n{passage if k % 3 == 0 else prose(61_000 + k, 40, 10**6)}\n{prose(62_000 + k, 25, 10**6)}") for k in range(300)]
        rows += [(None, passage)] * 3
        random.Random(1).shuffle(rows)
        out = substring_dedup.substring_dedup(documents(spark, rows, 5)).collect()
        holders = [r for r in out if passage in r["text"]]
        assert len(out) == 303 and len(holders) == 3 and all(r["doc_id"] is None for r in holders)
        assert sum(len(r["removed"]) for r in out) == 100
        seen = substring_dedup.repeated_units(documents(spark, rows[::-1], 2))[0].collect()
        assert len(seen) == 100


def test_passages_in_the_middle_of_lines(spark):
    """A passage of 60 words without any mark of where it begins goes from all but the first document."""
    passage = prose(7000, 60, per_line=10**6)
    rows = [(k, f"{prose(300 + k, 33, 10**6)} {passage} {prose(400 + k, 47, 10**6)}") for k in range(40)]
    left = 0
    for r in substring_dedup.substring_dedup(documents(spark, rows)).collect():
        tail = set(passage.split(" ")[15:45]) & set(r["text"].split(" "))
        left += r["doc_id"] != 0 and len(tail) > 25
        assert len(r["text"].split(" ")) >= 80
    assert left == 0


def test_no_passage_of_over_50_words_is_missed(spark):
    """Random passages inside lines, 51 words and more, found without Units: all but their outermost words go from the later document."""
    rng, rows, at = random.Random(21), [], []
    for k in range(400):
        passage = prose(20_000 + k, 51 + k % 10, per_line=10**6)
        for i in (2 * k, 2 * k + 1):
            before = prose(30_000 + i, rng.randrange(5, 60), 10**6) + " "
            rows.append((i, f"{before}{passage} {prose(40_000 + i, rng.randrange(5, 60), 10**6)}"))
        words = passage.split(" ")
        at.append((len(before), len(before) + len(" ".join(words[:10])) + 1, len(before) + len(" ".join(words[:-6])), len(before) + len(passage)))
    out = {r["doc_id"]: [(x["start"], x["end"]) for x in r["removed"]] for r in substring_dedup.substring_dedup(documents(spark, rows)).collect()}
    for k, (a, first, last, b) in enumerate(at):
        assert out[2 * k] == []
        assert [a <= s <= first and last <= e <= b for s, e in out[2 * k + 1]] == [True], k


def test_passages(spark):
    passage = "Every Harbour keeps a ledger of the boats that come and go. " + prose(7, 60, per_line=10**6) + ". And so it ends here."
    rows = [(k, f"Start {k} of it. {prose(100 + k, 30)}. {passage} {prose(200 + k, 25)}.") for k in range(1, 20)]
    rows += [(30, None), (31, ""), (32, passage + "\n" + passage), (33, "Short common line.\n" + prose(9, 50)), (34, "Short common line.\n" + prose(10, 50)), (None, passage)]
    docs = documents(spark, rows)
    want = brute_passages(rows, substring_dedup.MIN_WORDS)
    got = {r["doc_id"]: ([(x["start"], x["end"]) for x in r["removed"]], r["text"], r["n_removed"]) for r in substring_dedup.substring_dedup(docs).collect()}
    assert {i: g[0] for i, g in got.items()} == want
    assert got[None][0] == [] and got[30] == ([], "", 0)
    for i, t in rows:
        assert got[i][2] == sum(e - s for s, e in want[i])
        assert got[i][1] == substring_dedup.without(t or "", want[i])
    assert passage not in got[5][1] and f"Start {5} of it." in got[5][1]
    assert got[33][1] == rows[22][1]
    whole = substring_dedup.with_passages_removed(docs)
    assert whole.schema == docs.schema
    for r in whole.collect():
        assert (r[1] or "") == got[r["doc_id"]][1] and r["n_chars"] == (None if r[1] is None else len(r[1]))


def test_rows_that_share_an_id(spark):
    """Of rows with one id, the least by content keeps a passage; exact repeats are alike."""
    passage = prose(7100, 60)
    rows = [(1, f"Here {k}. {prose(7200 + k, 20)}\n{passage}\n{prose(7300 + k, 20)}") for k in range(4)] + [(2, passage)] * 2 + [(None, prose(7400 + k, 50) + "\n" + prose(7500, 50)) for k in range(3)]
    out = substring_dedup.substring_dedup(documents(spark, rows)).collect()
    assert len(out) == len(rows)
    assert sorted(len(r["removed"]) for r in out if r["doc_id"] == 1) == [0, 1, 1, 1]
    assert [r["text"] for r in out if r["doc_id"] == 2] == ["", ""]
    assert sorted(len(r["removed"]) for r in out if r["doc_id"] is None) == [0, 1, 1]


def test_passages_of_awkward_texts(spark):
    rows, docs = awkward_documents(spark)
    out = substring_dedup.substring_dedup(docs).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r["n_removed"] == sum(x["end"] - x["start"] for x in r["removed"])
