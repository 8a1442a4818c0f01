"""Substring dedup: digests of normalised units, the earliest ranked occurrence stays.

Units are lines, and word windows inside lines. Words are runs of other than white space,
A-Z in lower case. A line is a unit if it has MIN_WORDS words or MIN_BYTES bytes and more.
Lines alone find few of the passages that documents share, which mostly stand inside
longer lines; so a text's words are also cut into segments where lines or sentences end,
before capitals, and before the word of least hash of every CUT_WINDOW words in a row. A
passage is thus cut alike wherever it stands, and at least once in CUT_WINDOW words. A
window is the shortest row of words that has UNIT_WORDS of them and lies between two cuts:
up to each least hash, from another one, so no layout moves it; from each cut by layout to
any; up to each end of a line or sentence from any. Digests of units are grouped
globally. A unit is *repeated* where it isn't the earliest by document and place. What
repeated units cover goes wherever that is MIN_WORDS words or MIN_BYTES bytes long and
more, with its offsets in the original text kept; shorter runs (a greeting, a common
phrase) stay.

Of a repeated passage inside a line at most 2 * CUT_WINDOW - 2 words at its beginning and
CUT_WINDOW at its end are not covered, so none of MIN_WORDS + 3 * CUT_WINDOW - 2 words
(48) and more is missed; a repeated line of MIN_WORDS words or MIN_BYTES bytes never is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import NULL_ID, keyed_texts, materialize, numbered, pick, position, public_id, row_keys, with_lengths

MIN_WORDS, MIN_BYTES, UNIT_WORDS = 32, 256, 8
#: Of so many words in a row, the one of least hash begins a segment. At most UNIT_WORDS, so that units leave no gaps.
CUT_WINDOW = 6
#: Texts are hashed together in chunks of about so many bytes.
CHUNK_BYTES = 1 << 18
_BASE = 0x9E3779B97F4A7C15
#: Stands for no document where a digest's salted rows are announced; after all others.
_NOBODY = 2**63 - 1


class Units:
    """Digests of texts' units, many texts at once. One for each task.

    Words and rows of words are hashed as polynomials modulo 2 ** 64, by differences of
    prefix sums, so nothing is done word by word.
    """

    def __init__(self, min_words: int = MIN_WORDS):
        self.min_words = min_words
        self._powers = np.ones(1, np.uint64)
        self._inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self._powers) <= n:
            size = max(1024, n + n // 4)
            steps = np.full(size, _BASE, np.uint64)
            steps[0] = 1
            back = np.full(size, pow(_BASE, -1, 2**64), np.uint64)
            back[0] = 1
            self._powers, self._inverses = np.cumprod(steps), np.cumprod(back)

    def _ranges(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The hash of values[start:end] for each range."""
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self._powers[: len(values)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * self._inverses[starts]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + (ends - starts).astype(np.uint64)
        return h ^ (h >> np.uint64(29))

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(digests, first words, ends, texts' numbers, words' first bytes, words' ends).

        Unit k covers the words from first[k] up to ends[k], counted over all texts.
        """
        buf = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        self._grow(len(buf) + 1)
        upper = (buf >= 65) & (buf <= 90)
        dark = np.zeros(len(buf) + 1, bool)  # one place before the text, for what begins at once
        dark[1:] = (buf != 32) & ((buf < 9) | (buf > 13))
        edges = np.flatnonzero(dark[1:] != dark[:-1])
        starts, stops = edges[::2], edges[1::2]
        n = len(starts)
        if not n:
            none = np.zeros(0, np.int64)
            return none, none, none, none, starts, stops
        words = self._ranges((buf + upper.astype(np.uint8) * np.uint8(32)).astype(np.uint64) + np.uint64(1), starts, stops)
        head, last, before = buf[starts], buf[stops - 1], buf[np.maximum(stops - 2, 0)]
        capital = upper[starts] | ((head == 0xC3) & (buf[starts + 1] >= 0x80) & (buf[starts + 1] <= 0x9E))
        full = lambda x: (x == 46) | (x == 33) | (x == 63)
        stop = full(last) | (((last == 34) | (last == 39) | (last == 41)) & full(before))
        line = np.searchsorted(np.flatnonzero(buf == 10), starts)
        ends_of_texts = np.cumsum([len(t) + 1 for t in texts])
        text = np.searchsorted(ends_of_texts, starts, side="right")
        least = _least(words, text)
        hard = np.ones(n + 1, bool)
        hard[1:n] = (line[1:] != line[:-1]) | stop[:-1]
        layout = hard.copy()
        layout[1:n] |= capital[1:] & ~capital[:-1]
        cut = layout.copy()
        cut[least] = True
        at, layout, hard = np.flatnonzero(cut), np.flatnonzero(layout), np.flatnonzero(hard)
        # texts begin and end at cuts by layout, so a unit with enough words after or before that stays inside
        begin, end = np.searchsorted(text, text), np.searchsorted(text, text, side="right")
        first, last = layout[:-1], hard[1:]
        first, last = first[first + UNIT_WORDS <= end[first]], last[last - UNIT_WORDS >= begin[last - 1]]
        pairs = [(first, at[np.searchsorted(at, first + UNIT_WORDS)]), (at[np.searchsorted(at, last - UNIT_WORDS, side="right") - 1], last)]
        if len(least):
            before = np.searchsorted(least, least - UNIT_WORDS, side="right") - 1
            a, b = least[before[before >= 0]], least[before >= 0]
            inside = text[a] == text[b]
            pairs.append((a[inside], b[inside]))
        begins = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
        ends = np.append(begins[1:], n)
        large = (ends - begins >= self.min_words) | (stops[ends - 1] - starts[begins] >= MIN_BYTES)
        pairs.append((begins[large], ends[large]))
        # in order of place: of equal units in a text, the first is the earliest
        both = np.unique(np.concatenate([(a << 32) | b for a, b in pairs]))
        first, ends = both >> 32, both & 0xFFFFFFFF
        return self._ranges(words, first, ends).view(np.int64) & ~1, first, ends, text[first], starts, stops


def _least(words: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Places of the least (of equals, the last) of every CUT_WINDOW words in a row of one text."""
    n = len(words) - CUT_WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, place = words[:n].copy(), np.arange(n)
    for k in range(1, CUT_WINDOW):
        lower = words[k : k + n] <= best
        best[lower] = words[k : k + n][lower]
        place[lower] = np.flatnonzero(lower) + k
    return np.unique(place[text[:n] == text[CUT_WINDOW - 1 :]])


def _chunks(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first, UTF-8 texts) of consecutive texts, CHUNK_BYTES or one text at a time."""
    start, held, size = 0, [], 0
    for k, t in enumerate(texts):
        data = t.as_py().encode()
        if held and size + len(data) > CHUNK_BYTES:
            yield start, held
            start, held, size = k, [], 0
        held.append(data)
        size += len(data)
    if held:
        yield start, held


class _Often:
    """Which digests a task meets often: counted by slots of their bits, so that some others may seem to be."""

    SLOTS, LEAST, SALTS = 1 << 20, 64, 255

    def __init__(self):
        self.counts = np.zeros(self.SLOTS, np.int32)
        self.total = 0
        self.told: set[int] = set()

    def salts(self, h: np.ndarray, names: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(a salt for each row, 0 unless its digest is frequent; frequent digests not told of before)."""
        slots = (h >> 1) & (self.SLOTS - 1)
        self.counts += np.bincount(slots, minlength=self.SLOTS).astype(np.int32)
        self.total += len(h)
        often = self.counts[slots] >= max(self.LEAST, 16 * self.total // self.SLOTS)
        salts = np.zeros(len(h), np.int32)
        if not often.any():
            return salts, h[:0]
        mixed = np.zeros(often.sum(), np.uint64)
        for x in names:
            mixed = (mixed ^ x[often].view(np.uint64)) * np.uint64(_BASE)
        salts[often] = 1 + ((mixed >> np.uint64(40)) % np.uint64(self.SALTS)).astype(np.int32)
        new = [d for d in np.unique(h[often]).tolist() if d not in self.told]
        self.told.update(new)
        return salts, np.array(new, np.int64)


def _units(keys: list[str], min_words: int):
    """One row for each distinct unit of a document: its digest, and in the last bit whether the document has it again.

    Rows of a digest that a task meets often are salted; a row without a document tells so
    those of that digest without a salt.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, often = Units(min_words), _Often()
        for batch in batches:
            names = [batch.column(c).to_numpy(zero_copy_only=False) for c in keys]
            for start, texts in _chunks(batch.column("text")):
                h, _, _, of, _, _ = units(texts)
                order = np.lexsort((h, of))
                h, of = h[order], of[order]
                same = np.zeros(len(h) + 1, bool)
                same[1:-1] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
                kept = ~same[:-1]
                again = same[1:][kept]
                h, held = h[kept], [x[of[kept] + start] for x in names]
                salts, told = often.salts(h, held)
                held = [np.concatenate([x, np.full(len(told), _NOBODY)]) for x in held]
                unit, salts = np.concatenate([h | again, told]), np.concatenate([salts, np.zeros(len(told), np.int32)])
                yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in held], pa.array(unit, pa.int64()), pa.array(salts, pa.int32())], [*keys, "unit", "salt"])

    return run


def _later(keys: list[str]):
    """(keys, h, open): rows of a digest after its first document's, from a stream sorted by digest, salt and document.

    Of salted digests each salt's first document is open: another salt may hold an earlier
    one. Documents that have a unit twice are told with a null digest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: list[int] | None = None  # digest, salt and document that began the last group
        last: list[int] | None = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            unit, salt, *names = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("unit", "salt", *keys))
            h, again = unit & ~1, (unit & 1).astype(bool)
            # the last group's first row and the last row go before the batch
            columns = [np.concatenate([[f, x], c]) for f, x, c in zip(first or [0] * (2 + len(keys)), last or [0] * (2 + len(keys)), (h, salt, *names), strict=True)]
            h, salt, *names = columns
            fresh = np.ones(n + 2, bool)
            fresh[1:] = (h[1:] != h[:-1]) | (salt[1:] != salt[:-1])
            fresh[1] = False
            if first is None:
                fresh[2] = True
            begin = np.maximum.accumulate(np.where(fresh, np.arange(n + 2), 0))
            own = np.zeros(n + 2, bool)  # rows of the group's first document
            own[:] = True
            repeat = np.ones(n + 2, bool)
            for x in names:
                own &= x == x[begin]
                repeat[1:] &= x[1:] == x[:-1]
            repeat[0] = False
            repeat &= ~fresh
            nobody = names[0] == _NOBODY
            later, opened = ~own & ~repeat & ~nobody, fresh & (salt > 0)
            told = nobody & ~own & ~repeat  # then the first document of the rows without a salt is open as well
            twice = np.zeros(n + 2, bool)
            twice[2:] = again
            twice &= own & ~nobody
            at = [np.flatnonzero(m[2:]) + 2 for m in (later, opened, told, twice)]
            rows = np.concatenate([at[0], at[1], begin[at[2]], at[3]])
            kind = np.repeat([False, True, True, False], [len(x) for x in at])
            null = np.repeat([False, False, False, True], [len(x) for x in at])
            if len(rows):
                yield pa.RecordBatch.from_arrays([*[pa.array(x[rows], pa.int64()) for x in names], pa.array(h[rows], pa.int64(), mask=null), pa.array(kind, pa.bool_())], [*keys, "h", "open"])
            first, last = [int(c[begin[-1]]) for c in columns], [int(c[-1]) for c in columns]

    return run


def repeated_spans(text: str, repeated: np.ndarray, min_words: int, units: Units | None = None) -> list[tuple[int, int]]:
    """Offsets of what to remove: words covered by units repeated from elsewhere or from earlier in this text."""
    data = text.encode()
    digests, first, ends, _, starts, stops = (units or Units(min_words))([data])
    if not len(digests):
        return []
    again = np.ones(len(digests), bool)
    again[np.unique(digests, return_index=True)[1]] = False
    again |= np.isin(digests, repeated)
    if not again.any():
        return []
    n = int(ends.max())
    depth = np.zeros(n + 2, np.int64)
    np.add.at(depth, first[again] + 1, 1)
    np.add.at(depth, ends[again] + 1, -1)
    covered = np.cumsum(depth) > 0
    edges = np.flatnonzero(covered[1:] != covered[:-1])
    out, at, chars = [], 0, 0
    for a, b in edges.reshape(-1, 2).tolist():
        if b - a < min_words and stops[b - 1] - starts[a] < MIN_BYTES:
            continue
        span = []
        for place in (int(starts[a]), int(stops[b - 1])):  # bytes to code points
            chars += len(data[at:place].decode())
            at = place
            span.append(chars)
        out.append((span[0], span[1]))
    return out


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without spans. What stood on both sides stays apart by what separated it before."""
    out, a = [], 0
    for s, e in spans:
        out.append(text[a:s])
        a = e
        # one separator of the two around the gap is enough
        if a < len(text) and (s == 0 or text[s - 1] in " \t\n") and text[a] in " \t\n":
            a += 1
    return "".join([*out, text[a:]])


def repeated_units(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, list[str]]:
    """(digests of units that an earlier document holds, the columns that name a document).

    The first has those columns and ``repeated`` array<long>, a row for each document with
    such units or with units that it holds twice. Documents rank by id, null first, then by
    content; ``doc`` names one where no two rows share an id, else ``doc`` and ``rk`` do.
    Texts are hashed once; digests are shuffled once and sorted, and one pass tells all
    rows after the first of each. Frequent digests are salted where they come from, so no
    task gathers all rows of one.
    """
    ids = pick(docs, doc=id_col).select(F.coalesce(F.col("doc").cast("long"), F.lit(NULL_ID)).alias("doc"))
    keys = ["doc"] if ids.groupBy("doc").count().where("count > 1").isEmpty() else ["doc", "rk"]
    named = "".join(f"{k} long, " for k in keys)
    units = keyed_texts(docs, id_col, text_col).select(*keys, "text").mapInArrow(_units(keys, min_words), named + "unit long, salt int")
    h = F.col("unit").bitwiseAND(F.lit(-2))
    sorted_units = units.repartition(h, "salt").sortWithinPartitions(h, "salt", *keys)
    seen = materialize(sorted_units.mapInArrow(_later(keys), named + "h long, open boolean"), "later-units")
    opened = seen.where("open").drop("open")
    least = opened.groupBy("h").agg(F.min(F.struct(*keys)).alias("least"))
    late = opened.join(least, "h").where(F.struct(*keys) != F.col("least")).select(*keys, "h")
    return seen.where("not open").select(*keys, "h").unionByName(late).groupBy(*keys).agg(F.collect_set("h").alias("repeated")), keys


def _known(rep: pa.ListScalar) -> np.ndarray:
    return rep.values.to_numpy(zero_copy_only=False)


def substring_dedup(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, removed array<struct<start, end>>, n_removed): every row without its repeated passages.

    Offsets are code points of the original text. Of rows that share an id, the least by
    content comes first; exact repeats (same id and text) are treated alike; a null id
    ranks before all others. Null texts count as empty. Long texts are hashed one at a
    time, in some ten times their memory. Other columns, whatever their names, are
    ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        units = Units(min_words)
        for batch in batches:
            texts, removed = [], []
            for t, rep in zip(batch.column("text"), batch.column("repeated"), strict=True):
                text = t.as_py()
                spans = repeated_spans(text, _known(rep), min_words, units) if rep.is_valid else []
                texts.append(without(text, spans))
                removed.append([{"start": s, "end": e} for s, e in spans])
            gone = [sum(x["end"] - x["start"] for x in r) for r in removed]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array(texts, pa.string()), pa.array(removed, span), pa.array(gone, pa.int64())], ["doc", "text", "removed", "n_removed"]
            )

    rows = keyed_texts(docs, id_col, text_col)
    found, keys = repeated_units(docs, min_words, id_col, text_col)
    marked = rows.join(found.hint("shuffle_hash"), keys, "left").select("doc", "text", "repeated")
    out = marked.mapInArrow(run, "doc long, text string, removed array<struct<start: long, end: long>>, n_removed long")
    return out.select(public_id("doc").alias("doc_id"), "text", "removed", "n_removed")


def with_passages_removed(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The rows of ``docs`` with all their columns, repeated passages cut out and lengths adjusted.

    A null text stays null. Rows that lose nothing come back as they were. For other
    cases see substring_dedup().
    """
    at, id_at = position(docs, text_col), position(docs, id_col)
    found, keys = repeated_units(docs, min_words, id_col, text_col)
    seen = found.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("repeated").alias("_repeated"))
    rows = numbered(docs)
    names = rows.columns
    keyed = row_keys(rows, F.col(f"c{id_at}"), F.col(f"c{at}"))
    marked = keyed.join(seen.hint("shuffle_hash"), [f"_{k}" for k in keys], "left").select(*names, "_repeated")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(min_words)
        for batch in batches:
            texts = []
            for t, rep in zip(batch.column(f"c{at}"), batch.column("_repeated"), strict=True):
                text = t.as_py()
                touched = text is not None and rep.is_valid
                texts.append(without(text, repeated_spans(text, _known(rep), min_words, units)) if touched else text)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if k == at else batch.column(n) for k, n in enumerate(names)], names)

    return with_lengths(marked.mapInArrow(run, rows.schema), docs, at, chars_col)
