import hashlib
from collections import defaultdict

from tablewright.llm import line_dedup
from tests.llm.fixtures import awkward_documents, documents, long_line, prose, rows_of

STRIP = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(STRIP))


def brute(rows, low=-1):
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(low if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = [len(h := holders.get(key(x), ())) >= 5 and max(h) != (low if i is None else i) for x in lines]
        kept = "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)
        out.append((i, len(lines), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "n_lines", "n_dropped", "kept_sha256")


def test_awkward(spark):
    rows, docs = awkward_documents(spark)
    assert rows_of(line_dedup.line_digests(docs), *COLUMNS) == brute(rows)


def test_shared_lines(spark):
    rows = []
    for d in range(60):
        lines = [long_line(k).upper() if d % 2 else "  " + long_line(k) + "\t" for k in range(8) if d % (k + 1) == 0]
        rows.append((d, "\n".join([prose(d, 20), *lines, "short", long_line(0)])))
    rows += [(d, long_line(0)) for d in range(100, 400)]  # a line that most documents hold
    rows += [(400, long_line(9)), (401, long_line(9)), (402, long_line(9)), (403, long_line(9))]  # in four only
    rows += [(500, "\n".join([long_line(10)] * 5))]  # five times in one document
    assert rows_of(line_dedup.line_digests(documents(spark, rows, 7)), *COLUMNS) == brute(rows)


def test_texts_and_columns(spark):
    rows = [(d, "head\n" + long_line(1) + "\ntail " + str(d)) for d in range(6)] + [(9, None)]
    docs = documents(spark, rows)
    out = line_dedup.with_lines_dropped(docs)
    assert out.schema == docs.schema
    got = {r["doc_id"]: (r[1], r["n_chars"], r[9]) for r in out.collect()}
    assert got[9] == (None, None, 8) and got[0] == ("head\ntail 0", 11, 8)
    assert got[5][0] == rows[5][1]
    assert {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(docs).collect()} == {i: (got[i][0] or "") for i, _ in rows}


def test_long_texts(spark):
    """Texts of very many lines and very long lines, in rows that repeat whole."""
    many, wide = "\n".join(long_line(k % 900) for k in range(20_000)), "wide " * 60_000
    rows = [(k, many) for k in range(4)] + [(9, many), (9, many)] + [(k, f"{wide}\n{k}") for k in range(20, 26)]
    assert rows_of(line_dedup.line_digests(documents(spark, rows, 3)), *COLUMNS) == brute(rows)


def test_empty(spark):
    assert line_dedup.line_digests(documents(spark, [])).collect() == []
