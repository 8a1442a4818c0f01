"""WARC archives and toxicity."""

import gzip
import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.llm import toxicity, warc
from tests.llm.fixtures import documents, prose, rows_of


def pages(spark):
    big = "<html>" + "x y " * 300 + "\r\n\r\nWARC/1.1\r\n</html>"
    rows = [(k, f"http://a/{k}\n{k}", big) for k in range(20)] + [(30, "u", "é" * 499), (31, "u", "é" * 499), (32, "u", "é" * 500), (33, "u", "é" * 500), (34, None, None), (35, "", ""), (36, "u", "\r\n\r\n")]
    rows += [(3, "again", big), (None, "u", big), (None, None, "z" * 1200), (40, "u", "Ünï\x00code " * 200), (41, "u", "p" * 300_000)]
    return rows, spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, page int").repartition(3)


def test_archives(spark):
    rows, frame = pages(spark)
    newest = defaultdict(list)
    low = -(2**63)
    for i, _, h in rows:
        if len((h or "").encode()) >= 1000:
            newest[h].append(low if i is None else i)
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        top = max(newest[h]) if len(data) >= 1000 else None
        response = top is None or top == (low if i is None else i)
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "response" if response else "revisit", None if response or top == low else top))
    got = rows_of(warc.archived_pages(frame), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert got == sorted(want, key=repr)
    assert warc.archived_pages(frame.limit(0)).collect() == []


def test_payloads_come_back(spark, tmp_path):
    rows, frame = pages(spark)
    path = f"file://{tmp_path}/one"
    warc.archive_pages(frame, path)
    back = warc.read_archives(spark, path).where("record_type = 'response'").collect()
    held = {(r["page"], bytes(r["payload"])) for r in back}
    for i, _, h in rows:
        assert (-(2**63) if i is None else i, (h or "").encode()) in held or len((h or "").encode()) >= 1000
    twice = f"file://{tmp_path}/two"
    warc.deduplicate_archives(spark, path, twice)
    columns = ("page", "record_type", "payload_digest", "payload_bytes", "refers_to")
    assert rows_of(warc.read_archives(spark, twice), *columns) == rows_of(warc.read_archives(spark, path), *columns)


def test_files_are_cut_by_bytes_and_each_record_is_a_member(spark, tmp_path):
    rows = [(k, f"u{k}", prose(k, 2000)) for k in range(40)] + [(100, "big", "0123456789abcdef" * (1 << 20) + "end"), (101, "none", None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    path = f"{tmp_path}/cut"
    records = warc.keyed_pages(frame).withColumn("refers_to", F.lit(None).cast("long"))
    warc.write_archives(records, path, file_bytes=20_000, date="2001-02-03T04:05:06Z")
    files = sorted(p for p in (tmp_path / "cut").iterdir() if p.name.startswith("part-"))
    assert len(files) > 5
    found = {}
    for p in files:
        data = p.read_bytes()
        assert len(data) < 200_000 and data[-1] == 0
        plain = gzip.decompress(data)
        for f, payload in warc.parse_archive(warc.portions(data)):
            assert f["WARC-Date"] == "2001-02-03T04:05:06Z"
            found[int(f["WARC-Record-ID"][10:-1])] = payload
        assert list(warc.parse_archive(warc.portions(plain, 10_000))) == list(warc.parse_archive(warc.portions(data, 100_000)))
    assert found == {i: (h or "").encode() for i, _, h in rows}
    back = warc.read_archives(spark, path).collect()
    assert {r["page"]: bytes(r["payload"]) for r in back} == found


def test_payloads_that_are_no_text(spark, tmp_path):
    data = bytes(range(256)) * 8
    frame = spark.createDataFrame([(k, "u", bytearray(data)) for k in (1, 2)], "page_id long, url string, html binary")
    warc.archive_pages(frame, f"{tmp_path}/one")
    warc.deduplicate_archives(spark, f"{tmp_path}/one", f"{tmp_path}/two")
    got = rows_of(warc.read_archives(spark, f"{tmp_path}/two"), "page", "record_type", "payload", "refers_to")
    assert got == [(1, "revisit", bytearray(), 2), (2, "response", bytearray(data), None)]


def test_broken_archives_raise():
    good = b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [p for _, p in warc.parse_archive([good[:9], good[9:] + good])] == [b"abc", b"abc"]
    for bad in (good[:-1], b"HTTP/1.1\r\n\r\n", good + b"WARC/1.1\r\n"):
        with pytest.raises(ValueError):
            list(warc.parse_archive([bad]))
    with pytest.raises(ValueError):
        list(warc.portions(warc.member(good)[:20]))


def corpus(spark):
    bad = ["scumbag", "vermin", "trashfire", "worthless"]
    rows, labels = [], []
    for k in range(400):
        toxic = k % 5 == 0
        text = prose(k, 40 + k % 60)
        rows.append((k, f"{text} {bad[k % 4]} you {bad[(k + 1) % 4]} {text[:50]}" if toxic else text))
        if k % 8:
            labels.append((k, 0, int(toxic), "text"))
    rows += [(None, "no id"), (900, None), (901, ""), (902, "x" * 100_000), (5, rows[5][1])]
    labels += [(None, 0, 1, "t"), (3000, 1, None, "t"), (7, 1, 0, "t")]
    return rows, documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")


def test_toxicity(spark):
    rows, docs, labels = corpus(spark)
    out = toxicity.score_documents(docs, labels).collect()
    assert len(out) == len(rows)
    right = 0
    for r in out:
        i = r["doc_id"]
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0)
        if r["held_out"] and i < 400:
            right += r["predicted"] == int(i % 5 == 0)
    held = sum(1 for i, _ in rows[:400] if zlib.crc32(str(i).encode()) % 5 == 0)
    assert right >= 0.97 * held


def test_held_out_labels_are_never_learned_from(spark):
    _, docs, labels = corpus(spark)
    flipped = labels.selectExpr("doc_id", "quality", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic", "text")
    assert toxicity.learn(docs, labels) == toxicity.learn(docs, flipped)


def test_the_label_model_finds_planted_accuracies_and_correlations():
    rng, n = np.random.default_rng(4), 6000
    truth = (rng.random(n) < 0.2).astype(int)
    columns, accuracies = [], []
    for k in range(14):
        right, speaks = 0.62 + 0.025 * k, 0.3 + 0.04 * k
        vote = np.where(rng.random(n) < right, truth, 1 - truth)
        columns.append(np.where(rng.random(n) < speaks, vote, -1))
        accuracies.append(right)
    for k in (2, 7):  # these mostly repeat what another says
        columns.append(np.where(rng.random(n) < 0.85, columns[k], np.where(rng.random(n) < 0.5, -1, 1 - truth)))
    found = toxicity.label_model(np.stack(columns, axis=1), 0.3)
    assert abs(found.prior - 0.2) < 0.05
    assert np.abs(found.accuracies[:14] - accuracies).max() < 0.08
    strongest = sorted(found.correlated, key=lambda p: -abs(p[2]))[:2]
    assert {tuple(p[:2]) for p in strongest} == {(2, 14), (7, 15)}
    wrong = np.mean((found.posterior >= 0.5) != truth)
    votes = np.stack(columns, axis=1)
    majority = np.mean(((votes == 1).sum(axis=1) > (votes == 0).sum(axis=1)) != truth)
    assert wrong < 0.06 and wrong < majority
    assert toxicity.label_model(np.zeros((0, 3), int), 0.5).posterior.shape == (0,)


def test_labels_enter_only_through_the_choice_of_terms(spark, monkeypatch):
    """The classifier's targets are posteriors: a document's own label doesn't change them."""
    _, docs, labels = corpus(spark)
    seen = []
    real = toxicity.train_linear
    monkeypatch.setattr(toxicity, "train_linear", lambda x, target, **more: seen.append(target) or real(x, target, **more))
    toxicity.learn(docs, labels)
    toxicity.learn(docs, labels.withColumn("toxic", F.when(F.col("doc_id") == 5, 0).otherwise(F.col("toxic"))))
    assert len(seen[0]) > 300 and np.abs(seen[0] - seen[1]).max() < 0.05 and ((seen[0] > 0.02) & (seen[0] < 0.98)).mean() < 0.2


def test_bounded_samples(spark):
    """Bounds hold whatever repeats: ids, rows, all of a table."""
    rows = [(1, "same text of many")] * 300 + [(2, f"other {k}") for k in range(300)] + [(k, f"text {k}") for k in range(10, 700)]
    docs = documents(spark, rows, 4)
    got = toxicity.training_sample(docs, 50).collect()
    assert len(got) == 50 == len({r["rk"] for r in got})
    again = toxicity.training_sample(documents(spark, rows[::-1], 2), 50).collect()
    assert {r["rk"] for r in got} == {r["rk"] for r in again}
    labels = spark.createDataFrame([(k, k % 3 == 0) for k in range(1, 700)], "doc_id long, t boolean").selectExpr("doc_id", "CAST(t AS int) AS toxic")
    marked = toxicity.marked_rows(labels)
    sizes = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    held = toxicity.labelled_sample(docs, marked, sizes, 40).groupBy("toxic").count().collect()
    assert all(r["count"] <= 40 for r in held) and len(held) == 2


def test_without_toxic_keeps_rows_whole(spark):
    rows, docs, labels = corpus(spark)
    kept = toxicity.without_toxic(docs, toxicity.learn(docs, labels))
    assert kept.schema == docs.schema
    ids = [r["doc_id"] for r in kept.collect()]
    clean = sum(1 for i, _ in rows[:400] if i % 5)
    assert sum(1 for i in ids if i is not None and i < 400) >= 0.97 * clean
    assert len([i for i in ids if i is not None and i < 400 and i % 5 == 0]) <= 4


def test_no_labels(spark):
    rows, docs, labels = corpus(spark)
    assert toxicity.score_documents(docs, labels.limit(0)).count() == len(rows)
    assert toxicity.score_documents(docs.limit(0), labels).collect() == []
    one = labels.where("toxic = 1")
    assert toxicity.score_documents(docs, one).count() == len(rows)


def test_revisits_without_their_response_stay(spark, tmp_path):
    whole, part, again = (f"{tmp_path}/{x}" for x in ("whole", "part", "again"))
    html = "<p>" + "the same page " * 200
    warc.archive_pages(spark.createDataFrame([(k, f"http://a/{k}", html) for k in (1, 2, 3)], "page_id long, url string, html string"), whole)
    columns = ("page", "url", "record_type", "payload_digest", "payload_bytes", "refers_to")
    orphans = warc.read_archives(spark, whole).where("record_type = 'revisit'")
    warc.write_archives(orphans, part)
    warc.deduplicate_archives(spark, part, again)
    got = rows_of(warc.read_archives(spark, again), *columns)
    assert [(r[0], r[2], r[5]) for r in got] == [(1, "revisit", 3), (2, "revisit", 3)]
    assert got == rows_of(orphans, *columns)
