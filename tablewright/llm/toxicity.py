"""Toxicity by weak supervision.

Voters are a lexicon (words, and beginnings of words, that set toxic rows of a bounded
labelled sample apart; they vote toxic) and patterns of how a text holds that lexicon and
of its form (most vote for either class). A generative label model, fitted to votes on a
bounded sample of training texts whether or not they have labels, estimates by
expectation maximisation how each voter votes under both classes, and the correlations
of pairs of voters: within a class a voter depends on the one it agrees with most beyond
what the class explains. It starts from the majority of votes; no label enters it. A
linear classifier is trained on the posterior labels alone and scores every whole text.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import keyed_texts, materialize, numbered, one_blas_thread, pick, position, public_id

FOLDS = 5
SAMPLE_ROWS = 6_000  # labelled documents of each class from which voters are chosen, at most; taken by a hash of the id
FIT_ROWS = 16_000  # training documents, labelled or not, that the models are fitted to, at most; taken by a hash of the row
VOTERS, TERMS = 300, 1_500  # lexicon voters and classifier terms at most: sizes of the models, not of what they read
WORTH_A_TERM, WORTH_A_VOTE = 10.0, 24.0  # least log likelihood ratios
WORTH_A_WORD = 1.0  # least logarithm of a lexicon term's odds of standing in toxic text
GROUPS = 8
PREFIXES = (4, 5, 6, 7)
_WORD = re.compile(r"[^\W\d_]+")


def fold(id_col: str) -> Column:
    """crc32 of the id as text, modulo the folds; fold 0 is never learned from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def terms_of(word: str) -> list[str]:
    """A word and its beginnings; beginnings end in '*'."""
    return [word, *[word[:n] + "*" for n in PREFIXES if len(word) > n]]


def with_doubles(terms: Iterable[str]) -> set[str]:
    """The terms of several words: each once, and beginnings that two words have also with another '*'."""
    often = Counter(terms)
    return set(often) | {f"{t}*" for t, n in often.items() if n > 1 and t[-1] == "*"}


class Terms:
    """The terms of a text that are wanted. Words are looked up once; one for each task."""

    def __init__(self, wanted: Iterable[str], most: int = 300_000):
        self.wanted, self.most, self.known = set(wanted), most, {}
        self.near = self.wanted | {t[:-1] for t in self.wanted if t.endswith("**")}

    def of_word(self, word: str) -> tuple[str, ...]:
        hit = self.known.get(word)
        if hit is None:
            if len(self.known) > self.most:
                self.known.clear()
            hit = self.known[word] = tuple(t for t in terms_of(word) if t in self.near)
        return hit

    def __call__(self, words: set[str]) -> set[str]:
        return with_doubles(t for w in words for t in self.of_word(w)) & self.wanted


def pattern_votes(text: str, words: set[str], hits: set[str]) -> list[int]:
    """Votes of the pattern voters: 1 toxic, 0 clean, -1 no opinion. ``hits``: the text's words that the lexicon knows."""
    n, found = len(words), len(hits)
    upper = sum(map(str.isupper, text)) if found else 0
    marks = text.count("!") if found else 0
    groups = {zlib.crc32(w[:4].encode()) % GROUPS for w in hits}
    return [
        1 if found >= 2 else 0 if found == 0 else -1,
        1 if found >= 4 else -1,
        1 if 50 * found >= n > 0 else 0 if 400 * found < n else -1,
        1 if len({w[:4] for w in hits}) >= 3 else -1,
        1 if upper > 40 and 2 * upper > len(text) else -1,
        1 if marks > 10 else -1,
        0 if n < 20 and not found else -1,
        0 if n > 400 and found <= 1 else -1,
        # lexicon words by their beginnings, in groups: each speaks for texts long enough to hold some
        *[1 if g in groups else 0 if n >= 40 and not found else -1 for g in range(GROUPS)],
    ]


PATTERNS = ["several words", "many words", "density", "kinds of words", "capitals", "exclamation", "short", "long", *[f"group {g}" for g in range(GROUPS)]]


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many sampled rows of each class hold each term, summed over a batch."""
    for batch in batches:
        seen: dict[str, list[int]] = {}
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            for term in with_doubles(t for w in words_of(text) for t in terms_of(w)):
                seen.setdefault(term, [0, 0])[toxic] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.string()), pa.array([v[0] for v in seen.values()], pa.int64()), pa.array([v[1] for v in seen.values()], pa.int64())], ["term", "clean", "toxic"]
        )


@dataclass(frozen=True)
class Model:
    """A linear classifier over terms present in a text, and what is known of the voters; its size is bounded by TERMS and VOTERS."""

    weights: dict[str, float]
    bias: float
    accuracies: dict[str, float]
    correlated: list[tuple[str, str, float]]

    def scorer(self):
        weights, bias, terms = self.weights, self.bias, Terms(self.weights)

        def score(text: str) -> float:
            z = bias + sum(weights[t] for t in sorted(terms(words_of(text))))
            return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))

        return score


@dataclass(frozen=True)
class LabelModel:
    """What the label model has learned of the voters; ``posterior`` is that of class 1 for each text."""

    posterior: np.ndarray
    prior: float
    accuracies: np.ndarray
    """Of each voter, the share of its votes for the class that the model finds likelier."""
    correlated: list[tuple[int, int, float]]
    """Pairs of voters that depend on each other within classes, and their correlation."""


def correlations(votes: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Correlations of pairs of voters within classes, averaged over both; votes count as 1, 0 and -1."""
    signed = np.where(votes == 1, 1, np.where(votes == 0, -1, 0)).astype(np.float32)
    total = np.zeros((votes.shape[1],) * 2)
    for w in (q, 1 - q):
        share = w.sum() / len(q)
        centred = (signed - (w @ signed) / max(w.sum(), 1e-9)) * np.sqrt(w)[:, None].astype(np.float32)
        covariance = centred.T @ centred
        spread = np.sqrt(np.maximum(np.diag(covariance), 1e-9))
        total += share * covariance / np.outer(spread, spread)
    np.fill_diagonal(total, 0)
    return total


def dependences(corr: np.ndarray, least: float) -> tuple[np.ndarray, list[tuple[int, int, float]]]:
    """(each voter's parent or -1, pairs): a forest of the strongest correlations of at least ``least``."""
    n = len(corr)
    i, j = np.nonzero(np.triu(np.abs(corr) >= least))
    order = np.lexsort((j, i, -np.abs(corr[i, j])))
    root, around = list(range(n)), [[] for _ in range(n)]
    pairs = []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in zip(i[order].tolist(), j[order].tolist(), strict=True):
        if find(a) != find(b):
            root[find(a)] = find(b)
            around[a].append(b)
            around[b].append(a)
            pairs.append((a, b, float(corr[a, b])))
    parent, seen = np.full(n, -1), [False] * n
    for top in range(n):
        stack = [] if seen[top] else [top]
        while stack:
            x = stack.pop()
            seen[x] = True
            for y in around[x]:
                if not seen[y]:
                    parent[y] = x
                    stack.append(y)
    return parent, pairs


def label_model(votes: np.ndarray, prior: float, rounds: int = 30, alone: int = 8, least: float = 0.2) -> LabelModel:
    """Fit to votes in {-1, 0, 1}, a row for each text, beginning with the majority of each text's votes.

    For the first ``alone`` rounds voters are taken as independent within classes; then
    each depends on one other, by the forest of their correlations. Chances of a vote
    given the class and the other's vote are estimated with one virtual text in each cell,
    the prior with as many as there are texts in a hundredth.
    """
    n, m = votes.shape
    yes, no = (votes == 1).sum(axis=1), (votes == 0).sum(axis=1)
    q = np.where(yes > no, 0.95, np.where(no > yes, 0.05, prior))
    values = (votes + 1).astype(np.int64)
    parent, pairs = np.full(m, -1), []
    chance = prior
    for step in range(rounds if n else 0):
        if step == alone:
            parent, pairs = dependences(correlations(votes, q), least)
        z = np.full(n, np.log(chance / (1 - chance)))
        for k in range(m):
            given = values[:, parent[k]] if parent[k] >= 0 else np.zeros(n, np.int64)
            cell = 3 * given + values[:, k]
            logs = []
            for w in (q, 1 - q):
                counts = np.bincount(cell, w, 9).reshape(3, 3) + 1 / 3
                logs.append(np.log(counts / counts.sum(axis=1, keepdims=True)).ravel())
            z += (logs[0] - logs[1])[cell]
        q = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        chance = float(np.clip((q.sum() + prior * n / 100) / (n + n / 100), 1e-4, 0.5))
    likely = (q >= 0.5).astype(int)[:, None]
    spoke = votes >= 0
    return LabelModel(q, chance, (spoke & (votes == likely)).sum(axis=0) / np.maximum(spoke.sum(axis=0), 1), pairs)


def train_linear(x: np.ndarray, target: np.ndarray, l2: float = 1e-3, rounds: int = 300, rate: float = 0.5) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by full-batch gradients with momentum."""
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    vw, vb = np.zeros_like(w), 0.0
    balance = np.where(target > 0.5, 0.5 / max(target.mean(), 1e-3), 0.5 / max(1 - target.mean(), 1e-3))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        g = ((p - target) * balance / len(target)).astype(np.float32)
        vw = 0.9 * vw - rate * (x.T @ g + l2 * w / 10)
        vb = 0.9 * vb - rate * g.sum()
        w, b = w + vw, b + vb
    return w, b


_PLACES = 1 << 30


def bounded(df: DataFrame, key: Column, known: int, rows: int) -> DataFrame:
    """At most ``rows`` of about ``known`` rows, those of the least hashes, whatever their order or partitioning.

    A threshold leaves a little more than wanted in each partition, so no task gathers the rest.
    """
    place = F.pmod(F.xxhash64(key, F.lit(11)), F.lit(_PLACES))
    if known > rows:
        df = df.where(place < int(min(1.0, 1.25 * rows / known) * _PLACES))
    return df.withColumn("_place", place).orderBy("_place", key).limit(rows).drop("_place")


def marked_rows(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc, toxic) of labelled documents outside fold 0; of contradicting labels the larger."""
    marked = pick(labels, doc=id_col, toxic="toxic").where(F.col("toxic").isin(0, 1) & F.col("doc").isNotNull()).where(fold("doc") != 0)
    return marked.groupBy(F.col("doc").cast("long").alias("doc")).agg(F.max("toxic").cast("int").alias("toxic"))


def labelled_sample(docs: DataFrame, marked: DataFrame, sizes: dict[int, int], rows: int = SAMPLE_ROWS, id_col: str = "doc_id") -> DataFrame:
    """(text, toxic) of at most ``rows`` labelled training documents of each class; of rows that share an id, one."""
    chosen = [bounded(marked.where(F.col("toxic") == c), F.col("doc"), n, rows) for c, n in sizes.items()]
    chosen = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most 2 * rows ids
    texts = keyed_texts(docs, id_col).select("doc", "text").join(chosen, "doc")
    return texts.dropDuplicates(["doc"]).select("text", "toxic")


def training_sample(docs: DataFrame, rows: int = FIT_ROWS, id_col: str = "doc_id") -> DataFrame:
    """(rk, text) of at most ``rows`` documents outside fold 0, labelled or not; exact repeats count once."""
    known = docs.count() * (FOLDS - 1) // FOLDS
    keyed = keyed_texts(docs, id_col).where(fold("doc") != 0).select("rk", "text")
    if known > rows:
        keyed = keyed.where(F.pmod(F.xxhash64("rk", F.lit(11)), F.lit(_PLACES)) < int(1.25 * rows / known * _PLACES))
    return bounded(keyed.dropDuplicates(["rk"]), F.col("rk"), 0, rows)


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, fit_rows: int = FIT_ROWS, id_col: str = "doc_id") -> Model:
    """Fit on bounded samples outside fold 0. Labels of one class only, or none: a model that scores every text alike."""
    marked = marked_rows(labels, id_col)
    sizes = {0: 0, 1: 0} | {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes[0] or not sizes[1]:
        return Model({}, 1.0 if sizes[1] else -1.0, {}, [])
    sample = materialize(labelled_sample(docs, marked, sizes, rows, id_col), "toxicity-sample")
    held = {0: 0, 1: 0} | {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not held[0] or not held[1]:  # labelled documents that aren't there
        return Model({}, 1.0 if held[1] else -1.0, {}, [])
    counts = sample.mapInArrow(_term_rows, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    # rates within each class, so that the sample's class sizes don't matter
    worth = F.log((F.col("t") + 0.5) / (held[1] + 1)) - F.log((F.col("c") + 0.5) / (held[0] + 1))
    # how much likelier the counts are under rates of their own than under one rate: chance finds among many terms stay low
    share = held[1] / (held[0] + held[1])
    surprise = lambda n, expected: F.when(F.col(n) > 0, F.col(n) * F.log(F.col(n) / expected)).otherwise(0.0)
    total = F.col("t") + F.col("c")
    gain = 2 * (surprise("t", total * share) + surprise("c", total * (1 - share)))
    best = counts.withColumns({"worth": worth, "gain": gain}).where((F.col("gain") > WORTH_A_TERM) & (F.abs("worth") > 1)).orderBy(F.desc("gain"), "term").limit(TERMS).collect()
    names = [r["term"] for r in best]
    odds = np.log(sizes[1] / sizes[0])
    lexicon = [r["term"] for r in best if r["worth"] + odds > WORTH_A_WORD and r["gain"] > WORTH_A_VOTE][:VOTERS]
    if not lexicon:
        return Model({}, -1.0, {}, [])
    index = {t: k for k, t in enumerate(names)}

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, voted = Terms(names), Terms(lexicon)
        for batch in batches:
            found, patterns = [], []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                found.append(sorted(index[t] for t in terms(words)))
                double = {t[:-1] for t in voted(words)} | voted.wanted
                patterns.append(pattern_votes(text, words, {w for w in words if any(t in double for t in voted.of_word(w))}))
            yield pa.RecordBatch.from_arrays([batch.column("rk"), pa.array(found, pa.list_(pa.int32())), pa.array(patterns, pa.list_(pa.int32()))], ["rk", "terms", "patterns"])

    # at most fit_rows rows of at most TERMS small numbers
    table = training_sample(docs, fit_rows, id_col).repartition(32, "rk").mapInArrow(features, "rk long, terms array<int>, patterns array<int>").orderBy("rk").collect()
    x = np.zeros((len(table), len(names)), np.float32)
    for k, r in enumerate(table):
        x[k, r["terms"]] = 1
    patterns = np.array([r["patterns"] for r in table], np.int8).reshape(len(table), len(PATTERNS))
    votes = np.hstack([np.where(x[:, [index[t] for t in lexicon]] > 0, 1, -1).astype(np.int8), patterns])
    with one_blas_thread():
        labelled = label_model(votes, sizes[1] / (sizes[0] + sizes[1]))
        w, b = train_linear(x, labelled.posterior)
    voters = lexicon + PATTERNS
    pairs = [(voters[i], voters[j], c) for i, j, c in labelled.correlated]
    return Model({t: float(v) for t, v in zip(names, w, strict=True) if v}, float(b), dict(zip(voters, labelled.accuracies.tolist(), strict=True)), pairs)


def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, rk, score) of every row; null texts score as empty ones do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("rk"), pa.array([score(t.as_py()) for t in batch.column("text")], pa.float64())], ["doc", "rk", "score"])

    return keyed_texts(docs, id_col, text_col).mapInArrow(run, "doc long, rk long, score double")


def score_documents(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    Every whole text is scored, however long; null texts score as empty ones do, repeated
    rows score alike. Null ids are neither learned from nor held out, and score like
    others. Other columns, whatever their names, are ignored; an empty table gives no rows.
    """
    scored = score_texts(docs, learn(docs, labels, rows, id_col=id_col), id_col, text_col)
    out = scored.select(public_id("doc").alias("doc_id"), "score")
    return out.select("doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns. Row-local: no shuffle."""
    at, rows = position(docs, text_col), numbered(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            keep = [score(t.as_py() or "") < threshold for t in batch.column(f"c{at}")]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)
