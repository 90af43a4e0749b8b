"""Quality classifier from weak labels.

Overlapping heuristic labellers vote junk, good or abstain on every document; where one finds junk
of its kind, those that would vote good abstain. Expectation
maximisation over the counts of all vote patterns (at most 3 ** labellers rows reach the driver)
estimates each labeller's accuracy; the posteriors label a bounded sample on which a hashed linear
scorer is trained, and that scorer rates every document.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_as_bytes

ABSTAIN, JUNK, GOOD = 0, 1, 2
LABELLERS = ("symbols", "shouting", "stutter", "variety", "columns", "lines", "sentences")
#: Hash buckets of the scorer; rows that train it (the documented bound of its sample).
DIMENSIONS, MAX_FIT_ROWS = 1 << 14, 6000
THRESHOLD = 0.5
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123)) + bytes(range(128, 256))
_SYMBOLS = b"$%&*#!|<>{}[]=~^\\@"
_SHAPE = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256))


def _share(data: bytes, which: bytes) -> float:
    return (len(data) - len(data.translate(None, which))) / max(1, len(data))


def measures(data: bytes) -> tuple[list[float], list[bytes]]:
    """Measures in the order of LABELLERS, and the words."""
    words = data.split()
    n = max(1, len(words))
    lines = data.split(b"\n")
    upper, lower = _share(data, _UPPER), _share(data, _LOWER)
    return [
        _share(data, _SYMBOLS),
        upper / max(1e-9, upper + lower),
        sum(map(eq, words, words[1:])) / n,
        len(set(words)) / n,
        data.count(b"|") / n,
        1 - len(set(lines)) / len(lines),
        data.count(b".") / n,
    ], words


#: For each measure: junk beyond the first bound, good within the second; sign -1 where low values are junk.
BOUNDS = ((1, 0.08, 0.03), (1, 0.5, 0.2), (1, 0.15, 0.04), (-1, 0.25, 0.4), (1, 0.2, 0.02), (1, 0.5, 0.3), (-1, 0.004, 0.02))
#: Words from which variety and sentences are judged, and lines from which repeated lines are.
LEAST_WORDS, LEAST_LINES = 60, 4


def votes(data: bytes, found: list[float], n_words: int) -> list[int]:
    out = []
    for name, value, (sign, junk, good) in zip(LABELLERS, found, BOUNDS):
        idle = not n_words or name in ("variety", "sentences") and n_words < LEAST_WORDS or name == "lines" and data.count(b"\n") + 1 < LEAST_LINES
        out.append(ABSTAIN if idle else JUNK if sign * value > sign * junk else GOOD if sign * value <= sign * good else ABSTAIN)
    # A measure within its bounds says nothing against another kind of junk.
    return [ABSTAIN if v == GOOD else v for v in out] if JUNK in out else out


def features(found: list[float], words: list[bytes], memo: dict[bytes, int], dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features: shares of word shapes, and each measure in steps."""
    index: dict[int, float] = {}
    n = max(1, len(words))
    for shape, count in Counter(b" ".join(words).translate(_SHAPE).split()).items():
        at = memo.get(shape)
        if at is None:
            at = xxhash.xxh32_intdigest(shape, 1) % dimensions
            if len(memo) < 200_000:
                memo[shape] = at
        index[at] = index.get(at, 0.0) + count / n
    for k, value in enumerate(found):
        at = xxhash.xxh32_intdigest(b"%d:%d" % (k, min(20, int(value * 20))), 2) % dimensions
        index[at] = index.get(at, 0.0) + 1.0
        index[xxhash.xxh32_intdigest(b"m%d" % k, 2) % dimensions] = value
    return np.fromiter(index, np.int32, len(index)), np.fromiter(index.values(), np.float32, len(index))


@dataclass
class Scorer:
    prior: float
    #: rates[labeller, class, vote]; class 0 is junk, 1 good.
    rates: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, at: np.ndarray, value: np.ndarray) -> float:
        z = float(np.dot(self.weights[at], value)) + self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def pattern(vote: list[int]) -> int:
    return sum(v * 3**k for k, v in enumerate(vote))


def unpack(code: int) -> list[int]:
    return [code // 3**k % 3 for k in range(len(LABELLERS))]


def posterior(prior: float, rates: np.ndarray, table: np.ndarray) -> np.ndarray:
    """P(good) for rows of votes; votes of abstaining labellers carry no weight."""
    logs = np.log(np.clip(rates, 1e-6, 1))
    odds = np.full(len(table), np.log(prior) - np.log(1 - prior))
    for k in range(table.shape[1]):
        odds += np.where(table[:, k] == ABSTAIN, 0.0, logs[k, 1][table[:, k]] - logs[k, 0][table[:, k]])
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def estimate(codes: list[int], counts: list[int], rounds: int = 50) -> tuple[float, np.ndarray]:
    """Expectation maximisation over vote patterns; starts from "junk where any labeller says so"."""
    table = np.array([unpack(c) for c in codes], int).reshape(-1, len(LABELLERS))
    count = np.array(counts, float)
    good = np.where((table == JUNK).any(axis=1), 0.1, 0.9)
    prior, rates = 0.5, np.full((len(LABELLERS), 2, 3), 1 / 2)
    for _ in range(rounds if count.sum() else 0):
        prior = float(np.clip((count * good).sum() / count.sum(), 0.01, 0.99))
        for k in range(len(LABELLERS)):
            for y, weight in ((0, count * (1 - good)), (1, count * good)):
                seen = np.array([weight[table[:, k] == v].sum() for v in (JUNK, GOOD)]) + (1.0, 1.0)
                rates[k, y, 1:] = seen / seen.sum()
        good = posterior(prior, rates, table)
    return prior, rates


def train(rows: list[tuple[np.ndarray, np.ndarray, float]], dimensions: int = DIMENSIONS, steps: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels with both classes weighing the same; full-batch Adam."""
    weights, bias = np.zeros(dimensions), 0.0
    if not rows:
        return weights, bias
    at = np.concatenate([r[0] for r in rows]).astype(np.int64)
    value = np.concatenate([r[1] for r in rows]).astype(float)
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    y = np.array([r[2] for r in rows])
    cost = np.where(y >= 0.5, 0.5 / max(1, (y >= 0.5).sum()), 0.5 / max(1, (y < 0.5).sum()))
    mean, square = np.zeros(dimensions + 1), np.zeros(dimensions + 1)
    for t in range(1, steps + 1):
        z = np.bincount(row, value * weights[at], len(rows)) + bias
        error = cost * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        slope = np.append(np.bincount(at, value * error[row], dimensions) + 1e-6 * weights, error.sum())
        mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope**2
        move = 0.05 * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
        weights, bias = weights - move[:-1], bias - float(move[-1])
    return weights, bias


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: Counter = Counter()
        for data in columns_as_bytes(batch, "text"):
            m, words = measures(data)
            found[pattern(votes(data, m, len(words)))] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], ["code", "n"])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo: dict[bytes, int] = {}
    for batch in batches:
        codes, ats, values = [], [], []
        for data in columns_as_bytes(batch, "text"):
            m, words = measures(data)
            at, value = features(m, words, memo)
            codes.append(pattern(votes(data, m, len(words))))
            ats.append(at)
            values.append(value)
        yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array(codes, pa.int64()), pa.array(ats, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))], ["h", "code", "at", "value"])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_fit_rows: int = MAX_FIT_ROWS) -> Scorer:
    """Counts vote patterns over all documents; trains on about max_fit_rows rows (twice that at most), chosen and put in order by hash."""
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    counted = text.select("text").mapInArrow(_patterns, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    counted = sorted((r.code, r.n) for r in counted)
    prior, rates = estimate([c for c, _ in counted], [n for _, n in counted])
    total = sum(n for _, n in counted)
    every = max(1, -(-total // max_fit_rows))
    chosen = text.withColumn("h", F.xxhash64("id", "text")).where(F.pmod("h", F.lit(every)) == 0).select("h", "text")
    sample = chosen.mapInArrow(_sampled, "h long, code long, at array<int>, value array<float>").orderBy("h").limit(2 * max_fit_rows).collect()
    table = np.array([unpack(r.code) for r in sample], int).reshape(-1, len(LABELLERS))
    label = posterior(prior, rates, table)
    order = sorted(range(len(sample)), key=lambda i: (sample[i].code, sample[i]["at"]))
    weights, bias = train([(np.array(sample[i]["at"], np.int32), np.array(sample[i].value, np.float32), float(label[i])) for i in order])
    return Scorer(prior, rates, weights, bias)


def _scored(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Scorer = sent.value
        memo: dict[bytes, int] = {}
        for batch in batches:
            scores, codes = [], []
            for data in columns_as_bytes(batch, "text"):
                m, words = measures(data)
                scores.append(model.score(*features(m, words, memo)) if words else 0.0)
                codes.append(unpack(pattern(votes(data, m, len(words)))))
            good = posterior(model.prior, model.rates, np.array(codes, int).reshape(-1, len(LABELLERS)))
            rest = [batch.column(k) for k in batch.schema.names if k != "text"]
            names = [k for k in batch.schema.names if k != "text"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(scores, pa.float64()), pa.array(good, pa.float64()), pa.array(codes, pa.list_(pa.int32()))], [*names, "score", "posterior", "votes"])

    return run


def quality_scores(docs: DataFrame, model: Scorer | None = None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, score, posterior, votes, keep) for every row.

    score is the linear scorer's P(good), posterior that of the labellers alone, keep tells
    whether score reaches threshold. Texts that are null or hold no word score 0 and go. Rows that
    repeat are rated alike; an empty table gives no rows and an untrained model. Other columns are
    not read. The broadcast model has a fixed size.
    """
    model = model or fit(docs, id_col, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, score double, posterior double, votes array<int>"
    return given.mapInArrow(_scored(sent), schema).withColumn("keep", F.col("score") >= threshold)


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that the classifier keeps, columns unchanged; nothing is shuffled. Null and blank texts go, rows that repeat fare alike, an empty table stays empty."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, id_col, text_col))
    whole = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))
    schema = f"row {whole.schema['row'].dataType.simpleString()}, score double, posterior double, votes array<int>"
    rated = whole.mapInArrow(_scored(sent), schema).where(F.col("score") >= threshold)
    return rated.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
