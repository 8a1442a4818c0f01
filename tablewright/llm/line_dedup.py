"""Line dedup: range-partitioned hashes, streamed first occurrences, keep bitmaps.

Lines become (hash, document, position) rows, range-partitioned by hash and document
and sorted within partitions by hash, falling document and position. The document is
part of the range key, so a line that a third of all rows hold is split over many
partitions. One pass over each partition decides every run that lies inside it; runs
that touch a partition's edges are settled from at most two summaries a partition.
Text never travels with the hashes: the result is one compressed bitmap a document.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import gathered, keyed_texts, materialize, numbered, position, public_id, row_keys, task_count, with_lengths

BLANKS = " \t\n\x0b\x0c\r"
MIN_CHARS, MIN_DOCS = 40, 5
_LINE = "h1 long, h2 long, doc long, rk long, pos int, n_lines int"
_SEEN = "kind byte, h1 long, h2 long, doc long, rk long, pos int, n_lines int"
DROP, OPEN, SUMMARY = 0, 1, 2


def line_key(line: str) -> str:
    """The line without blanks at both ends and with A-Z in lower case."""
    line = line.strip(BLANKS)
    return line.lower() if line.isascii() else line.encode().lower().decode()


def _hash_lines(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, doc, rk, pos, of = bytearray(), [], [], [], []
            for d, r, t in zip(batch.column("doc").to_pylist(), batch.column("rk").to_pylist(), batch.column("text"), strict=True):
                lines = t.as_py().split("\n")
                for p, line in enumerate(lines):
                    if len(line) >= min_chars and len(line := line.strip(BLANKS)) >= min_chars:
                        digests += xxhash.xxh3_128_digest(line.encode().lower())
                        doc.append(d)
                        rk.append(r)
                        pos.append(p)
                        of.append(len(lines))
            h = np.frombuffer(bytes(digests), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), pa.array(doc, pa.int64()), pa.array(rk, pa.int64()), pa.array(pos, pa.int32()), pa.array(of, pa.int32())],
                ["h1", "h2", "doc", "rk", "pos", "n_lines"],
            )

    return run


class _Run:
    """A run of one line's rows as it streams by; rows of at most min_docs documents wait in it."""

    def __init__(self, key: tuple[int, int], leading: bool):
        self.key, self.leading = key, leading
        self.first = self.last = None
        self.docs, self.waiting = 0, []


def _stream_runs(min_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: _Run | None = None

        def rows(kind: int, key: tuple[int, int], part: np.ndarray):
            """part: columns doc, rk, pos, n_lines."""
            return np.full(len(part), kind), np.full(len(part), key[0]), np.full(len(part), key[1]), *part.T

        def close(r: _Run, trailing: bool):
            """What is left to say of a run once its rows have gone by."""
            out = []
            if r.leading or trailing:
                out.append(rows(SUMMARY, r.key, np.array([[r.first, 0, 0, r.docs]])))
                out += [rows(OPEN, r.key, w) for w in r.waiting]
            return out

        for batch in batches:
            if not batch.num_rows:
                continue
            h1, h2, doc, rk, pos, of = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("h1", "h2", "doc", "rk", "pos", "n_lines"))
            body = np.stack([doc, rk, pos, of], axis=1)
            cut = np.flatnonzero((h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])) + 1
            starts = np.concatenate([[0], cut])
            ends = np.concatenate([cut, [len(h1)]])
            # a document's first row in a run counts it
            fresh = np.ones(len(doc), np.int64)
            fresh[1:] = (doc[1:] != doc[:-1]) | (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            counts = np.add.reduceat(fresh, starts)
            out = []
            # runs that begin and end inside this batch: all at once
            inner = np.arange(1, len(starts) - 1)
            inner = inner[counts[inner] >= min_docs]
            if len(inner):
                size = ends[inner] - starts[inner]
                at = np.repeat(starts[inner] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
                at = at[doc[at] != np.repeat(doc[starts[inner]], size)]
                out.append((np.full(len(at), DROP), h1[at], h2[at], *body[at].T))
            for k in sorted({0, len(starts) - 1}):  # the first may go on from the last batch, the last into the next
                s, e = starts[k], ends[k]
                key = (h1[s], h2[s])
                if current is None or current.key != key:
                    if current is not None:
                        out += close(current, False)
                    current = _Run(key, current is None)
                part = body[s:e]
                if current.first is None:
                    current.first = part[0, 0]
                current.docs += int(counts[k]) - (current.last == part[0, 0])
                current.last = part[-1, 0]
                if current.leading:  # what came before is in other partitions
                    out.append(rows(OPEN, key, part))
                    continue
                part = part[part[:, 0] != current.first]
                if current.docs >= min_docs:
                    out += [rows(DROP, key, w) for w in current.waiting]
                    current.waiting = []
                    out.append(rows(DROP, key, part))
                elif len(part):
                    current.waiting.append(part)
            if out:
                yield _batch(out)
        if current is not None and (last := close(current, True)):
            yield _batch(last)

    return run


def _batch(parts: list[tuple]) -> pa.RecordBatch:
    c = [np.concatenate([p[k] for p in parts]) for k in range(7)]
    types = [pa.int8(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(x.astype(t.to_pandas_dtype()), t) for x, t in zip(c, types, strict=True)], ["kind", "h1", "h2", "doc", "rk", "pos", "n_lines"])


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps, dropped = [], []
        for n, drops in zip(batch.column("n_lines").to_pylist(), batch.column("drops").to_pylist(), strict=True):
            keep = np.ones(n, np.uint8)
            keep[drops] = 0
            dropped.append(int(n - keep.sum()))
            maps.append(zlib.compress(np.packbits(keep).tobytes(), 1))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc"), batch.column("rk"), batch.column("n_lines"), pa.array(dropped, pa.int32()), pa.array(maps, pa.binary())],
            ["doc", "rk", "n_lines", "n_dropped", "keep"],
        )


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc, rk, n_lines, n_dropped, keep): zlib'd bitmaps of documents that lose lines; others keep all.

    A line whose key has ``min_chars`` code points and is in ``min_docs`` documents stays
    only in the one with the largest id. ``doc`` and ``rk`` are those of keyed_texts():
    a null id counts as one document, smaller than all; rows of one id count as one
    document. Null texts are one empty line; an empty table gives no rows.
    """
    lines = gathered(keyed_texts(docs, id_col, text_col)).mapInArrow(_hash_lines(min_chars), _LINE)
    lines = materialize(lines, "lines")  # ranges are drawn from a sample: texts are read once all the same
    by_range = lines.repartitionByRange(task_count(lines), "h1", "h2", F.col("doc").desc()).sortWithinPartitions("h1", "h2", F.col("doc").desc(), "rk", "pos")
    seen = materialize(by_range.mapInArrow(_stream_runs(min_docs), _SEEN), "runs")
    # at most two rows a partition, so this side's size is bounded by the partition count
    edge = seen.where(F.col("kind") == SUMMARY).groupBy("h1", "h2").agg(F.sum("n_lines").alias("docs"), F.max("doc").alias("keeper")).where(F.col("docs") >= min_docs)
    late = seen.where(F.col("kind") == OPEN).join(F.broadcast(edge.select("h1", "h2", "keeper")), ["h1", "h2"]).where(F.col("doc") != F.col("keeper"))
    cols = ["doc", "rk", "pos", "n_lines"]
    drops = seen.where(F.col("kind") == DROP).select(*cols).unionByName(late.select(*cols))
    per_doc = drops.groupBy("doc", "rk").agg(F.max("n_lines").alias("n_lines"), F.collect_set("pos").alias("drops"))
    return per_doc.mapInArrow(_bitmaps, "doc long, rk long, n_lines int, n_dropped int, keep binary")


def apply_bitmap(text: str, keep: bytes | None) -> tuple[str, int]:
    """The text without dropped lines; how many lines it had."""
    lines = text.split("\n")
    if keep is None:
        return text, len(lines)
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
    return "\n".join([x for x, k in zip(lines, bits.tolist(), strict=True) if k]), len(lines)


def with_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of keyed_texts() and the bitmap of each that loses lines."""
    rows = keyed_texts(docs, id_col, text_col)
    maps = keep_bitmaps(docs, id_col, text_col, **how)
    return rows.join(maps.select("doc", "rk", "keep", "n_dropped").hint("shuffle_hash"), ["doc", "rk"], "left")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped): every row, with the lines that stay joined by a line feed.

    Null and empty texts are one empty line. Texts of many lines and lines of any length
    are whole rows of a task, their hashes rows like others. Repeated rows share one
    decision; for ties and null ids see keep_bitmaps(). Other columns, whatever their
    names, are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [apply_bitmap(t.as_py(), k.as_py()) for t, k in zip(batch.column("text"), batch.column("keep"), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64()), batch.column("n_dropped")],
                ["doc", "text", "n_lines", "n_dropped"],
            )

    rows = with_bitmaps(docs, id_col, text_col, **how).select("doc", "text", "keep", F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"))
    return rows.mapInArrow(run, "doc long, text string, n_lines long, n_dropped long").withColumn("doc_id", public_id("doc")).select("doc_id", "text", "n_lines", "n_dropped")


def line_digests(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of line_dedup()'s texts, in all cases as there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [apply_bitmap(t.as_py(), k.as_py()) for t, k in zip(batch.column("text"), batch.column("keep"), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array([x[1] for x in done], pa.int64()), batch.column("n_dropped"), pa.array([hashlib.sha256(x[0].encode()).hexdigest() for x in done], pa.string())],
                ["doc", "n_lines", "n_dropped", "kept_sha256"],
            )

    rows = with_bitmaps(docs, **how).select("doc", "text", "keep", F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"))
    return rows.mapInArrow(run, "doc long, n_lines long, n_dropped long, kept_sha256 string").withColumn("doc_id", public_id("doc")).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def with_lines_dropped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", **how) -> DataFrame:
    """The rows of ``docs`` with all their columns, texts shortened and their lengths with them.

    A null text stays null. Rows that lose no line come back as they were.
    """
    at, id_at = position(docs, text_col), position(docs, id_col)
    maps = keep_bitmaps(docs, id_col, text_col, **how).select(F.col("doc").alias("_doc"), F.col("rk").alias("_rk"), F.col("keep").alias("_keep"))
    rows = numbered(docs)
    names = rows.columns
    keyed = row_keys(rows, F.col(f"c{id_at}"), F.col(f"c{at}"))
    marked = keyed.join(maps.hint("shuffle_hash"), ["_doc", "_rk"], "left").select(*names, "_keep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() if k.as_py() is None else apply_bitmap(t.as_py() or "", k.as_py())[0] for t, k in zip(batch.column(f"c{at}"), batch.column("_keep"), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if k == at else batch.column(n) for k, n in enumerate(names)], names)

    return with_lengths(marked.mapInArrow(run, rows.schema), docs, at, chars_col)
