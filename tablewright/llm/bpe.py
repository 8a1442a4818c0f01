"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A text's halves are encoded on their own and joined. Only tokens near the joint can
differ from those of the whole, so a window around it is encoded again and grows
until both its edges are *stable*: a stable edge lies between a character that is
not white space and a space or line feed. No alternative of the splitting pattern
matches across such an edge and its only lookahead (after a run of white space)
never looks past one, so tokens outside the window are those of the whole text.
Decoding concatenates the bytes of halves up the same tree.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import keyed_texts, public_id

LEAF_CHARS = 16_384
FIRST_WINDOW = 64


class ByteBPE:
    """Encoder over a rank file; equal to the library's plain encoding of the whole text."""

    def __init__(self, ranks_path: str, pattern: str, leaf_chars: int = LEAF_CHARS, window: int = FIRST_WINDOW):
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self._enc = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self._size[rank] = len(token)
        self.leaf_chars, self.window = max(1, leaf_chars), max(1, window)

    def encode(self, text: str) -> list[int]:
        return self._tree(text, 0, len(text))

    def _tree(self, text: str, a: int, b: int) -> list[int]:
        if b - a <= self.leaf_chars:
            return self._enc.encode_ordinary(text[a:b])
        m = (a + b) // 2
        return self.join(text, a, m, b, self._tree(text, a, m), self._tree(text, m, b))

    def join(self, text: str, a: int, m: int, b: int, left: list[int], right: list[int]) -> list[int]:
        """Tokens of text[a:b] from those of text[a:m] and text[m:b]."""
        width = self.window
        while True:
            s, e = self._edge_before(text, a, m, width), self._edge_after(text, m, b, width)
            if s is not None and e is not None:
                break
            width *= 2
        keep = len(left) - self._tokens_of(left, len(text[s:m].encode()), from_end=True)
        skip = self._tokens_of(right, len(text[m:e].encode()), from_end=False)
        return left[:keep] + self._enc.encode_ordinary(text[s:e]) + right[skip:]

    @staticmethod
    def _stable(text: str, i: int) -> bool:
        return text[i] in " \n" and not text[i - 1].isspace()

    def _edge_before(self, text: str, a: int, m: int, width: int) -> int | None:
        """The stable edge nearest to m in reach of width; a itself if the window covers all."""
        for i in range(m - 1, max(a, m - width), -1):
            if self._stable(text, i):
                return i
        return a if m - width <= a else None

    def _edge_after(self, text: str, m: int, b: int, width: int) -> int | None:
        for i in range(m + 1, min(b, m + width)):
            if self._stable(text, i):
                return i
        return b if m + width >= b else None

    def _tokens_of(self, ids: list[int], n_bytes: int, from_end: bool) -> int:
        """How many tokens at one end of ids make up n_bytes."""
        k = 0
        while n_bytes > 0:
            n_bytes -= self._size[ids[-1 - k] if from_end else ids[k]]
            k += 1
        if n_bytes:
            raise AssertionError("a stable edge lies inside a token")
        return k

    def decode(self, ids: list[int], leaf_tokens: int = LEAF_CHARS) -> bytes:
        if len(ids) <= leaf_tokens:
            return self._enc.decode_bytes(ids)
        m = len(ids) // 2
        return self.decode(ids[:m], leaf_tokens) + self.decode(ids[m:], leaf_tokens)


@functools.lru_cache(maxsize=2)
def coder(ranks_path: str, pattern: str) -> ByteBPE:
    """One per Python worker."""
    return ByteBPE(ranks_path, pattern)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every row; null and empty texts give an empty list.

    Repeated rows, null ids and ties each keep their own row. Row-local: no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(ranks_path, pattern)
        for batch in batches:
            ids = [bpe.encode(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(ids, pa.list_(pa.int32()))], ["doc", "ids"])

    out = keyed_texts(docs, id_col, text_col).select("doc", "text").mapInArrow(run, "doc long, ids array<int>")
    return out.select(public_id("doc").alias("doc_id"), "ids")


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, data binary): the bytes of each row's ids; null ids give no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(ranks_path, pattern)
        for batch in batches:
            data = [bpe.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(data, pa.binary())], ["doc_id", "data"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, data binary")


def round_trip_digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes each text, decodes the ids, keeps digests only.

    Null and empty texts have no tokens. A long text is encoded in halves; one without any
    stable edge is encoded anew at each level above its leaves, in time of the text's
    length times their number. Repeated rows and null ids keep their own rows; other
    columns, whatever their names, are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(ranks_path, pattern)
        for batch in batches:
            counts, of_ids, of_bytes = [], [], []
            for text in batch.column("text"):
                ids = bpe.encode(text.as_py())
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
                of_bytes.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())],
                ["doc", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    out = keyed_texts(docs, id_col, text_col).select("doc", "text").mapInArrow(run, "doc long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.select(public_id("doc").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")
