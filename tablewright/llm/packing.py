"""Packing by cutting-stock column generation.

Documents become pieces of at most one sequence; piece lengths, rounded up to a unit,
form a histogram whose size depends only on the sequence length. The driver solves
the cutting-stock linear program over it: a knapsack dynamic program prices new
patterns, patterns are rounded down and what is left is packed best-fit. After
MAX_COLUMNS new patterns the program stops where it is: padding may then be more than
least, no piece is lost. Nothing here multiplies matrices by BLAS, whose threads can
hang in a driver that has forked. Pieces are ranked within their length class by counters kept at tokenisation, so a pattern's
slots are assigned by arithmetic, without ordering the corpus.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import byte_letters, gathered, keyed_texts, materialize, public_id

SEQUENCE, UNIT = 2048, 4
MAX_COLUMNS = 2_000


class WordIds:
    """Ids of a lower-casing word-level byte BPE file, as its library gives them.

    The library merges listed pairs in order, the faster merger used here any pair whose
    bytes are a token, in order of tokens. Both agree if each token is what exactly one
    merge makes and every token encodes to itself: at any time the pieces between two
    token ends are those of that stretch on its own, so the only way left to a token is
    its listed pair. Both conditions are checked when the file is loaded; if one fails,
    and for texts outside ASCII and Latin letters, the library does the work.
    """

    _END = "\x01"
    _SIMPLE = re.compile("[\x00\x02-\x7fÀ-ÖØ-öø-ÿ]*")
    _WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9\t-\r ]+")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(path)
        spec = json.loads(self._tok.to_str())
        vocabulary, merges = spec["model"]["vocab"], spec["model"]["merges"]
        made = ["".join(m if isinstance(m, list) else m.split(" ")) for m in merges]
        self._fast = None
        if [vocabulary.get(t) for t in made] == list(range(512, 512 + len(made))) and self._self_coded(spec, vocabulary):
            letters = byte_letters()
            ranks = {self._END.encode(): len(vocabulary)}
            for token, i in vocabulary.items():
                body = token.removesuffix("</w>") if len(token) > 4 else token
                if set(body) <= letters.keys() and not (data := bytes(letters[c] for c in body)).startswith(b"\x01"):
                    ranks[data + self._END.encode() * (body != token)] = i
            self._fast = tiktoken.Encoding("words", pat_str=r"[^\x01]+\x01", mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    def _self_coded(spec: dict, vocabulary: dict[str, int]) -> bool:
        from tokenizers import Tokenizer

        bare = spec | {"normalizer": None, "pre_tokenizer": None, "added_tokens": []}
        inner = Tokenizer.from_str(json.dumps(bare | {"model": spec["model"] | {"end_of_word_suffix": None}}))
        last = Tokenizer.from_str(json.dumps(bare))
        special = {t["content"] for t in spec["added_tokens"]}
        plain = [t for t in vocabulary if t not in special and not (t.endswith("</w>") and len(t) > 4)]
        ends = [t for t in vocabulary if t not in special and t.endswith("</w>") and len(t) > 4]
        same = lambda tok, texts, tokens: all(e.ids == [vocabulary[t]] for t, e in zip(tokens, tok.encode_batch_fast(texts, add_special_tokens=False), strict=True))
        return same(inner, plain, plain) and same(last, [t[:-4] for t in ends], ends)

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if self._fast is None or "<|" in text or not self._SIMPLE.fullmatch(text):
            return array("I", self._tok.encode(text, add_special_tokens=False).ids).tobytes()
        words = self._WORD.findall(text.lower())
        return array("I", self._fast.encode_ordinary(self._END.join([*words, ""]))).tobytes()


@functools.lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def cut_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, sequence: int = SEQUENCE, unit: int = UNIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every document: (doc, start, length, ids_crc32, doc_tokens, cls, pid, nth).

    ``cls`` is the length in units, rounded up; ``nth`` counts pieces of a class within
    the task ``pid``. Written to the shared folder, so counters and rows stay in step.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, last, pid = word_ids(tokenizer_path), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId()
        made = np.zeros(sequence // unit + 2, np.int64)
        for batch in batches:
            doc, start, length, crc, total, cls, nth = [], [], [], [], [], [], []
            for d, text in zip(batch.column("doc").to_pylist(), batch.column("text"), strict=True):
                ids = coder.encode(text.as_py()) + last
                n = len(ids) // 4
                for a in range(0, n, sequence):
                    size = min(sequence, n - a)
                    c = -(-size // unit)
                    doc.append(d)
                    start.append(a)
                    length.append(size)
                    crc.append(zlib.crc32(ids[4 * a : 4 * (a + size)]))
                    total.append(n)
                    cls.append(c)
                    nth.append(int(made[c]))
                    made[c] += 1
            columns = [doc, start, length, crc, total, cls, nth, [pid] * len(doc)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc", "start", "length", "ids_crc32", "doc_tokens", "cls", "nth", "pid"])

    rows = gathered(keyed_texts(docs, id_col, text_col).select("doc", "text"))
    schema = "doc long, start long, length long, ids_crc32 long, doc_tokens long, cls long, nth long, pid long"
    return materialize(rows.mapInArrow(run, schema), "pieces")


def best_pattern(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: the most valuable pattern and its value."""
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        k = np.searchsorted(sizes, room, side="right")
        best[room] = best[room - 1]
        if k:
            with_item = values[:k] + best[room - sizes[:k]]
            j = int(with_item.argmax())
            if with_item[j] > best[room] + 1e-12:
                best[room], took[room] = with_item[j], j
    pattern, room = np.zeros(len(sizes), np.int64), capacity
    while room > 0:
        j = took[room]
        if j < 0:
            room -= 1
        else:
            pattern[j] += 1
            room -= sizes[j]
    return float(best[capacity]), pattern


def greedy_basis(sizes: np.ndarray, need: np.ndarray, capacity: int) -> np.ndarray:
    """Patterns, a column for each class, that make a first basis: largest pieces first.

    Each pattern is used until it exhausts a class, which no later pattern holds: ordered
    by that, the matrix is triangular. Classes exhausted by the way have columns of their own.
    """
    left, columns = need.astype(float).copy(), np.zeros((len(sizes), len(sizes)))
    while (open_ := np.flatnonzero(left > 0)).size:
        pattern, room = np.zeros(len(sizes)), capacity
        for i in open_[::-1]:
            pattern[i] = min(room // sizes[i], np.ceil(left[i]))
            room -= pattern[i] * sizes[i]
        held = np.flatnonzero(pattern)
        k = held[(left[held] / pattern[held]).argmin()]
        left[held] = np.maximum(left[held] - left[k] / pattern[k] * pattern[held], 0)
        left[k] = 0
        columns[:, k] = pattern
    for k in np.flatnonzero(~columns.any(axis=0)):
        columns[k, k] = capacity // sizes[k]
    return columns


def invert(matrix: np.ndarray) -> np.ndarray:
    """The inverse by elimination, a row at a time."""
    n = len(matrix)
    both = np.hstack([matrix.astype(float), np.eye(n)])
    for k in range(n):
        p = k + int(np.abs(both[k:, k]).argmax())
        if both[p, k] == 0:
            raise ValueError("the matrix has no inverse")
        both[[k, p]] = both[[p, k]]
        both[k] /= both[k, k]
        rows = np.flatnonzero(both[:, k])
        rows = rows[rows != k]
        both[rows] -= both[rows, k][:, None] * both[k]
    return both[:, n:]


def solve_patterns(demand: dict[int, int], capacity: int, max_columns: int = MAX_COLUMNS) -> list[tuple[dict[int, int], int]]:
    """[(pattern {class: count}, times)] that covers ``demand`` exactly, nearly without waste."""
    sizes = np.array(sorted(c for c, n in demand.items() if n > 0), np.int64)
    if not len(sizes):
        return []
    need = np.array([demand[int(c)] for c in sizes], float)
    columns = greedy_basis(sizes, need, capacity)
    inverse = invert(columns)
    x = (inverse * need).sum(axis=1)
    for _ in range(max_columns):
        prices = inverse.sum(axis=0)
        worth, pattern = best_pattern(np.maximum(prices, 0), sizes, capacity)
        if worth <= 1 + 1e-7:
            break
        direction = (inverse * pattern).sum(axis=1)
        up = direction > 1e-10
        if not up.any():
            break
        ratio = np.full(len(sizes), np.inf)
        ratio[up] = np.maximum(x[up], 0) / direction[up]
        r = int(ratio.argmin())
        columns[:, r] = pattern
        pivot = inverse[r] / direction[r]
        inverse -= np.outer(direction, pivot)
        inverse[r] = pivot
        x = x - direction * ratio[r]
        x[r] = ratio[r]
    times = np.floor(np.maximum(x, 0) + 1e-6).astype(np.int64)
    left = need.astype(np.int64)
    out = []
    for k in np.argsort(-times, kind="stable"):
        col = columns[:, k].astype(np.int64)
        t = int(min(times[k], min((left[i] // col[i] for i in np.flatnonzero(col)), default=0)))
        if t > 0:
            left -= t * col
            out.append(({int(sizes[i]): int(col[i]) for i in np.flatnonzero(col)}, t))
    # what rounding left over: at most a pattern's worth for each basic column; best fit, longest first
    bins_by_room: dict[int, list[dict[int, int]]] = {}
    for i in reversed(range(len(sizes))):
        c = int(sizes[i])
        for _ in range(int(left[i])):
            room = min((r for r, held in bins_by_room.items() if r >= c and held), default=None)
            held = bins_by_room[room].pop() if room is not None else {}
            room = capacity if room is None else room
            held[c] = held.get(c, 0) + 1
            bins_by_room.setdefault(room - c, []).append(held)
    return out + [(held, 1) for several in bins_by_room.values() for held in several]


class Slots:
    """Where the r-th piece of a class goes: tables whose size depends on the patterns only."""

    def __init__(self, patterns: list[tuple[dict[int, int], int]]):
        rows, taken, sequence = [], {}, 0
        for pattern, times in patterns:
            slot = 0
            for c, a in sorted(pattern.items(), reverse=True):
                rows.append((c, taken.get(c, 0), a, sequence, slot))
                taken[c] = taken.get(c, 0) + a * times
                slot += a
            sequence += times
        rows.sort()
        self.cls, self.first, self.each, self.sequence, self.slot = np.array(rows, np.int64).reshape(-1, 5).T
        self.sequences = sequence

    def __call__(self, cls: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lo, hi = np.searchsorted(self.cls, cls, "left"), np.searchsorted(self.cls, cls, "right")
        at = np.empty(len(cls), np.int64)
        for c in np.unique(cls):
            m = cls == c
            a, b = lo[m][0], hi[m][0]
            at[m] = a + np.searchsorted(self.first[a:b], rank[m], "right") - 1
        k = rank - self.first[at]
        return self.sequence[at] + k // self.each[at], self.slot[at] + k % self.each[at]


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, sequence: int = SEQUENCE, unit: int = UNIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), a row for each piece.

    Every id lies in one piece; offsets in a sequence have no gaps. Null and empty texts
    are one piece holding the end id; texts longer than a sequence are cut every
    ``sequence`` ids; rows that repeat an id or a text are packed as often as they occur,
    equal lengths in the order in which tasks met them; null ids stay null; other columns,
    whatever their names, are ignored; an empty table gives no rows.
    """
    if sequence % unit:
        raise ValueError("the sequence length must be a multiple of the unit")
    pieces = cut_pieces(docs, tokenizer_path, end_id, sequence, unit, id_col, text_col)
    per_task = pieces.groupBy("cls", "pid").agg(F.count(F.lit(1)).alias("n"))
    base = per_task.withColumn("base", F.sum("n").over(Window.partitionBy("cls").orderBy("pid")) - F.col("n")).drop("n")
    # at most sequence / unit rows come to the driver, whatever the corpus
    demand = {r["cls"]: r["n"] for r in pieces.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = Slots(solve_patterns(demand, sequence // unit))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cls", "rank"))
            seq, slot = slots(cls, rank)
            names = ["doc", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(seq, pa.int64()), pa.array(slot, pa.int64())], [*names, "sequence_id", "slot"])

    ranked = pieces.join(base, ["cls", "pid"]).withColumn("rank", F.col("base") + F.col("nth"))
    placed = ranked.select("doc", "start", "length", "ids_crc32", "doc_tokens", "cls", "rank").mapInArrow(
        assign, "doc long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, slot long"
    )
    before = F.sum("length").over(Window.partitionBy("sequence_id").orderBy("slot")) - F.col("length")
    return placed.select(public_id("doc").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", before.alias("offset"))
