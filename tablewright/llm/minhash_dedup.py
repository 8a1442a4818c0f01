"""MinHash near-dedup by a signature-coordinate inverted join.

1. Documents with equal shingle sets become one class.
2. Each class is posted under its (coordinate, value) pairs. Classes that link share at
   least MATCHES of COORDINATES pairs (all but about one in a million pairs exactly at the
   threshold), so, pairs taken rarest first, they share one of the first
   COORDINATES - MATCHES + 1. Pairs that nobody shares are skipped, and with them every
   class that has fewer than MATCHES shared pairs.
3. Each posting list counts collisions of its members, rarest pairs first: short lists are
   merged, long ones only probed for what the short ones gave, and members that are
   joined already are skipped.
4. Clusters, the components of those collisions, hold every link. Within each, links are
   confirmed on full shingle sets by the same merging of lists.

No step emits the pairs of a group, and lists and clusters of any size are compared in
blocks (linked_groups): none meets one task, and one that hangs together is sent once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import connected_components, gathered, keyed_texts, materialize, public_id

WORDS = 5
COORDINATES, MATCHES = 48, 28
PERCENT = 85
BLOCK_DOCS, BLOCK_SHINGLES = 4096, 3_000_000
_CACHE_WORDS = 300_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Shingler:
    """Distinct 64-bit hashes of a text's word shingles, ascending. One for each task."""

    def __init__(self, words: int = WORDS):
        self.words, self._seen = words, {}

    def _hash_words(self, found: list[bytes]) -> np.ndarray:
        seen = self._seen
        if len(seen) > _CACHE_WORDS:
            seen.clear()
        for w in set(found):
            if w not in seen:
                seen[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(seen.__getitem__, found), np.uint64, len(found))

    def __call__(self, text: str) -> np.ndarray:
        h = self._hash_words(text.encode().lower().split())
        n = len(h) - self.words + 1
        if n < 1:  # the whole sequence is one shingle; its length keeps it apart from longer ones
            return _fold([h[i : i + 1] for i in range(len(h))], len(h)) if len(h) else np.zeros(0, np.uint64)
        return np.unique(_fold([h[i : i + n] for i in range(self.words)], self.words))


def _fold(parts: list[np.ndarray], seed: int) -> np.ndarray:
    out = np.full(len(parts[0]), seed, np.uint64)
    for p in parts:
        out = _mix(out * _ODD + p)
    return out


def signature_parameters(coordinates: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = rng.integers(0, 2**63, (2, coordinates), dtype=np.uint64)
    return draw[0] * np.uint64(2) + np.uint64(1), draw[1]


def signature(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of each coordinate's permutation, 32 bits of it."""
    out = np.full(len(a), 2**64 - 1, np.uint64)
    for s in range(0, len(hashes), 4096):
        h = hashes[s : s + 4096, None]
        v = h * a
        v ^= v >> np.uint64(32)
        v *= b | np.uint64(1)
        np.minimum(out, v.min(axis=0), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def _sign(words: int, coordinates: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, (a, b) = Shingler(words), signature_parameters(coordinates)
        for batch in batches:
            classes, sizes, signed = [], [], []
            for text in batch.column("text"):
                hashes = shingler(text.as_py())
                sizes.append(len(hashes))
                classes.append(xxhash.xxh3_64_intdigest(hashes.tobytes()) - 2**63)
                signed.append(signature(hashes, a, b).astype("<i4").tobytes() if len(hashes) else b"")
            flat = pa.array(np.frombuffer(b"".join(signed), "<i4"))
            at = np.concatenate([[0], np.cumsum([len(x) // 4 for x in signed])])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("rk"), pa.array(classes, pa.int64()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), flat)],
                ["doc", "rk", "cls", "n_shingles", "sig"],
            )

    return run


class Forest:
    """Union-find over 0 .. n-1 whose joins are kept; ``alike``: labels of members that are joined beforehand."""

    def __init__(self, n: int, alike: np.ndarray | None = None):
        self.root = np.arange(n) if alike is None else np.unique(alike, return_inverse=True)[1].astype(np.int64)
        self.made: list[tuple[int, int]] = []
        self.also: list[np.ndarray] = []
        """Further arrays of roots that joins keep up to date."""

    def join(self, x: int, y: int) -> None:
        a, b = self.root[x], self.root[y]
        if a != b:
            for held in (self.root, *self.also):
                held[held == a] = b
            self.made.append((x, y))


def group_stream(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of a stream sorted by integer ``keys``, one table each; holds one group at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in keys], axis=1)
        cut = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        for s, e in zip([0, *cut], [*cut, len(k)], strict=True):
            key = tuple(k[s])
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)


def join_listed(forest: Forest, codes: np.ndarray, rows: np.ndarray, check: Callable[[int, np.ndarray], np.ndarray], chunk: int = 64) -> None:
    """Join rows that ``check`` finds linked, of those that meet in a list: entry k puts rows[k] on the list codes[k].

    Rows look at those before them on their lists. Lists whose members are all of the
    row's own component are skipped whole; of others, members that met most often are
    checked first, and those that joined meanwhile are not checked any more.
    """
    n = len(forest.root)
    order = np.lexsort((rows, codes))
    rows, codes = rows[order], codes[order]
    fresh = np.ones(len(codes), bool)
    fresh[1:] = codes[1:] != codes[:-1]
    starts = np.flatnonzero(fresh)
    listed = np.cumsum(fresh) - 1  # an entry's list
    by_row = np.argsort(rows, kind="stable")
    begins = np.searchsorted(rows[by_row], np.arange(n + 1))
    alone, mixed = -1, -2
    of_list = np.full(len(starts), alone)  # the component that all members so far are of
    forest.also.append(of_list)
    root = forest.root
    for x in range(n):
        entries = by_row[begins[x] : begins[x + 1]]
        lists = listed[entries]
        held = of_list[lists] != alone
        entries, met = entries[held], lists[held]
        if len(entries):
            last = np.unique(rows[entries - 1])  # those met last are likeliest to link
            last = last[root[last] != root[x]]
            for y in last[check(x, last)] if len(last) else ():
                forest.join(x, int(y))
            open_ = of_list[met] != root[x]
            parts = [rows[starts[k] : e] for k, e in zip(met[open_], entries[open_], strict=True)]
            if parts:
                near = np.concatenate(parts)
                near, often = np.unique(near[root[near] != root[x]], return_counts=True)
                near = near[np.argsort(-often, kind="stable")]
                for s in range(0, len(near), chunk):
                    part = near[s : s + chunk]
                    part = part[root[part] != root[x]]
                    for y in part[check(x, part)] if len(part) else ():
                        forest.join(x, int(y))
        of_list[lists] = np.where((of_list[lists] == alone) | (of_list[lists] == root[x]), root[x], mixed)
    forest.also.pop()


def collided(sig: np.ndarray, matches: int, forest: Forest) -> None:
    """Join signatures that agree in ``matches`` coordinates and more.

    Coordinate-value pairs are lists of the rows that have them. A row's rarest pairs are
    merged, counting collisions; its longest lists are not merged but probed for the rows
    that the short ones gave.
    """
    n, c = sig.shape
    pairs = (np.arange(c, dtype=np.int64) << 32) + sig.view(np.uint32).astype(np.int64)
    _, codes, often = np.unique(pairs, return_inverse=True, return_counts=True)
    codes = codes.reshape(n, c)
    order = np.argsort(often[codes], axis=1, kind="stable")[:, : c - matches + 1]
    short = np.take_along_axis(codes, order, 1)
    keep = often[short] > 1
    join_listed(forest, short[keep], np.repeat(np.arange(n), keep.sum(axis=1)), lambda x, ys: (sig[ys] == sig[x]).sum(axis=1) >= matches)


def link_sets(sets: list[np.ndarray], percent: int, forest: Forest) -> None:
    """Join sets of a Jaccard likeness of percent / 100 and more. Exact.

    Sets are taken by size. Two sets that link share one of their first
    n - ceil(n * percent / 100) + 1 elements in any common order: here the rarest first.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    by_size = np.argsort(sizes, kind="stable")
    values, codes, often = np.unique(np.concatenate([sets[k] for k in by_size]), return_inverse=True, return_counts=True)
    rank = np.empty(len(values), np.int64)
    rarest = np.argsort(often, kind="stable")
    rank[rarest] = np.arange(len(values))
    shared = often[rarest] > 1
    sizes = sizes[by_size]
    ends = np.cumsum(sizes)
    ranked = [np.sort(rank[codes[e - n : e]]) for e, n in zip(ends, sizes, strict=True)]
    firsts = [r[: n - -(-n * percent // 100) + 1] for r, n in zip(ranked, sizes.tolist(), strict=True)]
    firsts = [f[shared[f]] for f in firsts]
    mark = np.zeros(len(values), bool)

    def check(x: int, ys: np.ndarray) -> np.ndarray:
        near = np.flatnonzero(100 * sizes[ys] >= percent * sizes[x])
        hit = np.zeros(len(ys), bool)
        if len(near):
            mark[ranked[x]] = True
            several = [ranked[y] for y in ys[near]]
            both = np.add.reduceat(mark[np.concatenate(several)].astype(np.int64), np.cumsum([0, *map(len, several[:-1])]))
            mark[ranked[x]] = False
            hit[near] = 100 * both >= percent * (sizes[x] + sizes[ys[near]] - both)
        return hit

    in_order = Forest(len(sets))
    in_order.root = forest.root[by_size]
    join_listed(in_order, np.concatenate(firsts), np.repeat(np.arange(len(sets)), list(map(len, firsts))), check)
    for x, y in in_order.made:
        forest.join(int(by_size[x]), int(by_size[y]))


def linked_groups(members: DataFrame, attach: Callable[[DataFrame], DataFrame], link: Callable[[pa.Table, Forest], None], block: int, block_weight: int) -> DataFrame:
    """(a, b, big): links enough to join all members of a group that links connect; for groups that aren't big, b names the component.

    ``members``: (grp, cls, weight), cls differs within a group; ``attach`` adds the columns
    that ``link`` compares by. Groups are dealt into blocks. First the members of each
    block are compared, together with the group's first block, so each row is sent once but
    for those of first blocks. What is then one component needs no more comparisons: of a
    group in three blocks or more, the members outside its largest component are compared
    with the rest, a pair of blocks at a time, and all that is joined already is skipped.
    """
    sizes = members.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w")).where("n > 1")
    sizes = sizes.select("grp", F.ceil(F.greatest(F.col("n") / block, F.col("w") / block_weight)).cast("int").alias("parts"))
    dealt = members.join(sizes, "grp").withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    order = ["grp", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in group_stream(batches, order):
            cls = group.column("cls").to_numpy()
            forest = Forest(len(cls), group.column("comp").to_numpy() if "comp" in group.column_names else None)
            if len(cls) > 1:
                link(group, forest)
            if forest.made:
                met = np.unique(forest.made)
                _, least, label = np.unique(forest.root[met], return_index=True, return_inverse=True)
                least = met[least][label]  # the first member of each one's component
                met, least = met[met != least], least[met != least]
                big = pa.array(np.full(len(met), group.column("parts")[0].as_py() > 2))
                yield pa.RecordBatch.from_arrays([pa.array(cls[met]), pa.array(cls[least]), big], ["a", "b", "big"])

    def compared(rows: DataFrame, label: str) -> DataFrame:
        return materialize(rows.repartition(*order).sortWithinPartitions(*order, "cls").mapInArrow(run, "a long, b long, big boolean"), label)

    met = F.when(F.col("part") > 0, F.array("part")).otherwise(F.sequence(F.lit(1), F.greatest(F.col("parts") - 1, F.lit(1))))
    first = compared(attach(dealt).withColumn("j", F.explode(met)).withColumn("i", F.lit(0)), "links")
    large = dealt.where("parts > 2")
    if large.isEmpty():
        return first
    known = connected_components(first.where("big").select("a", "b")).withColumnRenamed("node", "cls")
    large = materialize(large.join(known, "cls", "left").withColumn("comp", F.coalesce("component", "cls")).drop("component"), "large-groups")
    main = large.groupBy("grp", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("grp").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"))
    # members of the first block have met all others
    rest = large.where("part > 0").join(main, "grp").where("comp <> main").drop("main")
    few = rest.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"))
    few = few.select("grp", F.ceil(F.greatest(F.col("n") / block, F.col("w") / block_weight)).cast("int").alias("rests"))
    share = F.pmod(F.xxhash64("cls", F.lit(1)), F.col("rests")).cast("int")
    lone = rest.join(few, "grp").withColumn("own", share).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("parts") - 1))).withColumn("j", F.col("own"))
    lone = lone.where("i <> part").drop("own", "rests")  # its own block is there anyway
    others = large.where("part > 0").join(few, "grp").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("rests") - 1))).withColumn("i", F.col("part")).drop("rests")
    second = compared(attach(others.unionByName(lone)), "more-links")
    return first.unionByName(second)


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    percent: int = PERCENT,
    words: int = WORDS,
    coordinates: int = COORDINATES,
    matches: int = MATCHES,
    block_docs: int = BLOCK_DOCS,
    block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """(doc_id, rk, n_shingles, component_id, kept, root): a row for each row of ``docs``.

    ``component_id`` is the smallest id reachable over links, ``root`` names the
    component itself. Rows without words (null, empty and blank texts) link with nothing,
    not even each other, and have no root. A null id counts as smaller than any other and
    is given back as null. Rows that repeat an id keep their own sets; exact repeats are
    all kept or all not, so callers who want one row of a component take the least
    (doc_id, rk) of its root. Long texts are one row like others and weigh more in blocks.
    Other columns, whatever their names, are ignored; an empty table gives no rows.
    """
    keyed = keyed_texts(docs, id_col, text_col)
    signed = materialize(gathered(keyed).mapInArrow(_sign(words, coordinates), "doc long, rk long, cls long, n_shingles long, sig array<int>"), "signed")
    classes = signed.where("n_shingles > 0").groupBy("cls").agg(F.min(F.struct("doc", "rk", "n_shingles", "sig")).alias("r")).select("cls", "r.*")
    classes = materialize(classes, "classes")

    # postings under coordinate-value pairs that are shared at all
    pair = (F.col("p").cast("long") * F.lit(2**32)) + F.col("v").cast("long")
    posted = classes.select("cls", F.posexplode("sig").alias("p", "v")).select("cls", pair.alias("tok"))
    often = posted.groupBy("tok").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = posted.join(often, "tok").groupBy("cls").agg(F.collect_list(F.struct("n", "tok")).alias("toks")).where(F.size("toks") >= matches)
    # a class's unshared pairs are rarest and fill its prefix first
    prefix = shared.select("cls", F.explode(F.slice(F.sort_array("toks"), F.lit(1), F.size("toks") - F.lit(matches - 1))).alias("t"))
    lists = materialize(prefix.select(F.col("t.tok").alias("grp"), "cls", F.lit(1).alias("weight")), "lists")

    def agree(group: pa.Table, forest: Forest) -> None:
        collided(group.column("sig").combine_chunks().flatten().to_numpy().reshape(len(forest.root), coordinates), matches, forest)

    near = linked_groups(lists, lambda df: df.join(classes.select("cls", "sig"), "cls"), agree, block_docs, block_docs)
    clusters = connected_components(near).select(F.col("node").alias("cls"), F.col("component").alias("grp"))

    # full sets of clustered classes only
    members = materialize(clusters.join(classes.select("cls", "doc", "rk", F.col("n_shingles").alias("weight")), "cls"), "members")
    shingler: list[Shingler] = []

    def confirm(group: pa.Table, forest: Forest) -> None:
        if not shingler:
            shingler.append(Shingler(words))
        link_sets([shingler[0](t.as_py()) for t in group.column("text")], percent, forest)

    links = linked_groups(members, lambda df: keyed.join(df.hint("shuffle_hash"), ["doc", "rk"]).drop("doc", "rk"), confirm, block_docs, block_shingles)
    whole = links.where("not big").select(F.col("a").alias("cls"), F.col("b").alias("root"))
    split = links.where("big").select("a", "b")
    if not split.isEmpty():
        whole = whole.unionByName(connected_components(split).select(F.col("node").alias("cls"), F.col("component").alias("root")))

    rooted = signed.select("doc", "rk", "cls", "n_shingles").join(whole, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = rooted.where("n_shingles > 0").groupBy("root").agg(F.min("doc").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    out = rooted.join(least, "root", "left").withColumn("component", F.when(F.col("n_shingles") > 0, F.coalesce("least", "doc")).otherwise(F.col("doc")))
    return out.select(public_id("doc").alias("doc_id"), "rk", "n_shingles", public_id("component").alias("component_id"), (F.col("doc") == F.col("component")).alias("kept"), F.when(F.col("n_shingles") > 0, F.col("root")).alias("root"))
