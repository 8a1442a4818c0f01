"""Heads, listings and lines of files wherever Hadoop's file systems reach."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.package import ROW_ID, StepError
from tablewright.scratch import file_system

HEAD_BYTES = 1 << 20


def location(path: str) -> str:
    return path.replace("s3://", "s3a://", 1) if path.startswith("s3://") else path


def head(spark: SparkSession, path: str, size: int = HEAD_BYTES) -> bytes:
    where, fs = file_system(spark, location(path))
    if not fs.exists(where):
        raise StepError(f"The file {path} was not found")
    stream = fs.open(where)
    try:
        return bytes(stream.readNBytes(size))
    finally:
        stream.close()


def size(spark: SparkSession, path: str) -> int:
    where, fs = file_system(spark, location(path))
    return fs.getContentSummary(where).getLength()


def whole(spark: SparkSession, path: str) -> bytes:
    """All bytes of a file, on the driver: for workbooks and descriptors only."""
    return head(spark, path, 2**31 - 1)


def encoding_of(sample: bytes) -> str:
    """UTF-8 if the sample is (its last character may be cut off), else Latin-1."""
    for cut in range(4):
        try:
            sample[: len(sample) - cut].decode("utf-8")
            return "UTF-8"
        except UnicodeDecodeError:
            continue
    return "ISO-8859-1"


def head_lines(spark: SparkSession, path: str, encoding: str | None = None, enough=None) -> tuple[list[str], str]:
    """(the first lines, the encoding). ``enough(lines)`` asks for a larger head until it is true."""
    size = HEAD_BYTES
    while True:
        data = head(spark, path, size)
        used = encoding or encoding_of(data)
        text = data.decode(used, errors="replace")
        lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        if len(data) < size:
            return (lines[:-1] if lines[-1] == "" else lines), used
        if enough is None or enough(lines[:-1]):
            return lines[:-1], used
        size *= 4


def glob(spark: SparkSession, pattern: str) -> list[str]:
    where, fs = file_system(spark, location(pattern))
    found = fs.globStatus(where)
    paths = sorted(str(s.getPath()) for s in found or [])
    if not paths:
        raise StepError(f"No files match {pattern}")
    return paths


def lines(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """(value, row id) of one file. The id of the k-th line of the first split is k, from 0."""
    df = spark.read.option("encoding", encoding).text(location(path))
    return df.select("value", F.monotonically_increasing_id().alias(ROW_ID))
