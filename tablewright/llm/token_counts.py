"""Token counts: batch encoding in Arrow functions that return lengths only.

Long texts are split at safe boundaries (between a character that is not white space
and a space or line feed: the byte-level pattern never matches across one, and no
special string holds white space), pieces are dealt into batches of about equal
bytes, and each batch is counted at once. Counts of pieces add up exactly.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import byte_letters, keyed_texts, public_id

BATCH_BYTES = 512 * 1024
PIECE_CHARS = 32 * 1024


class Lengths:
    """Numbers of tokens as the library gives them for a byte-level BPE file.

    The library merges listed pairs in order, the faster merger used here any pair whose
    bytes are a token, in order of tokens. Both agree if each token is what exactly one
    merge makes, in order, and every token encodes to itself (the argument is that of
    packing.WordIds). That is checked when the file is loaded; if it doesn't hold, and for
    texts with special strings or with characters on whose classes Unicode versions or
    the two regular expression engines might differ, the library does the work.
    """

    _SIMPLE = re.compile("[\t\n\r\x20-\x7e\u00a1-\u024f\u2010-\u2027\u2030-\u203a\u20ac]*")
    _PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(path)
        self._tok.no_truncation()
        self._tok.no_padding()
        self._special = [t["content"] for t in json.loads(self._tok.to_str())["added_tokens"]]
        self._fast = self._checked()

    def _checked(self):
        import tiktoken

        spec = json.loads(self._tok.to_str())
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and not model.get("dropout") and not model.get("ignore_merges") and not spec["normalizer"] and not model.get("end_of_word_suffix") and not model.get("continuing_subword_prefix")
        if not (plain and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)):
            return None
        vocabulary, letters = model["vocab"], byte_letters()
        made = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        own = [t for t in vocabulary if t not in self._special]
        if not all(set(t) <= letters.keys() for t in own) or [vocabulary.get(t) for t in made] != list(range(256, 256 + len(made))) or len(own) != 256 + len(made):
            return None
        from tokenizers import Tokenizer

        bare = Tokenizer.from_str(json.dumps(spec | {"pre_tokenizer": None, "post_processor": None, "added_tokens": []}))
        if any(e.ids != [vocabulary[t]] for t, e in zip(own, bare.encode_batch_fast(own, add_special_tokens=False), strict=True)):
            return None
        ranks = {bytes(letters[c] for c in t): vocabulary[t] for t in own}
        return tiktoken.Encoding("bytes", pat_str=self._PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, pieces: list[str]) -> list[int]:
        fast = [self._fast is not None and bool(self._SIMPLE.fullmatch(p)) and not any(x in p for x in self._special) for p in pieces]
        slow = iter(self._tok.encode_batch_fast([p for p, f in zip(pieces, fast, strict=True) if not f], add_special_tokens=False))
        quick = iter(self._fast.encode_ordinary_batch([p for p, f in zip(pieces, fast, strict=True) if f], num_threads=1) if any(fast) else ())
        return [len(next(quick if f else slow)) for f in fast]


@functools.lru_cache(maxsize=2)
def lengths(path: str) -> Lengths:
    """One per Python worker."""
    return Lengths(path)


def safe_pieces(text: str, size: int = PIECE_CHARS) -> list[str]:
    """Cuts after about ``size`` characters, at the next safe boundary only; joined, they are the text."""
    out, a, n = [], 0, len(text)
    while n - a > size:
        i = a + size
        while i < n and not (text[i] in " \n" and not text[i - 1].isspace()):
            i += 1
        out.append(text[a:i])
        a = i
    out.append(text[a:])
    return out


def byte_batches(pieces: Iterable[tuple[int, str]], limit: int = BATCH_BYTES) -> Iterator[tuple[list[int], list[str]]]:
    """(owners, pieces) of consecutive pieces, each batch of at most ``limit`` UTF-8 bytes unless one piece is longer."""
    owners, held, size = [], [], 0
    for owner, piece in pieces:
        n = len(piece) if piece.isascii() else len(piece.encode())
        if held and size + n > limit:
            yield owners, held
            owners, held, size = [], [], 0
        owners.append(owner)
        held.append(piece)
        size += n
    if held:
        yield owners, held


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row; null and empty texts count 0.

    ``tokenizer_path`` is a byte-level ``tokenizers`` file. Special strings inside a
    text are handled as the library does by default. Long texts are counted in pieces, a
    batch at a time, so memory doesn't grow with them; one without safe boundaries is one
    piece. Repeated rows and null ids keep their own rows; other columns, whatever their
    names, are ignored; an empty table gives no rows. Row-local: no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = lengths(tokenizer_path)
        for batch in batches:
            pieces = ((k, piece) for k, text in enumerate(batch.column("text")) for piece in safe_pieces(text.as_py()))
            total = np.zeros(batch.num_rows, np.int64)
            for owners, several in byte_batches(pieces):
                np.add.at(total, owners, count(several))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("n_bytes"), pa.array(total, pa.int64())], ["doc", "n_bytes", "n_tokens"])

    rows = keyed_texts(docs, id_col, text_col).select("doc", "text", F.octet_length("text").cast("long").alias("n_bytes"))
    out = rows.mapInArrow(run, "doc long, n_bytes long, n_tokens long")
    return out.select(public_id("doc").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
