"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio between trusted and raw text.

Words and word pairs fall into a fixed number of hash buckets. Two multinomials over the buckets are counted, one over
all documents and one over trusted ones; a document's score is the mean over its n-grams of ln P_trusted - ln P_raw. The
threshold is the score that best parts labelled documents that neither count is fitted to, losing a trusted one being
ten times as bad as keeping a poor one. Every document is judged by the same number; a second run gives the same verdicts.

Words are runs of other characters than space and \\x09-\\x0D. Null and empty texts have no word, fail the base rules and
score 0. Repeated rows are judged alike, ties with the threshold are kept; without trusted or without poor documents only
the base rules decide. Further columns pass through, those named as a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm._common import slices, with_column


@dataclass(frozen=True)
class QualityRules:
    buckets: int = 1 << 16
    #: Added to each bucket's count.
    smoothing: float = 1.0
    #: Losing all trusted documents is so many times as bad as keeping all poor ones.
    trusted_weight: float = 10.0
    #: Labelled documents of either kind that the trusted model and the threshold are fitted on: those of least hash, at
    #: most so many.
    fit_rows: int = 100_000
    #: One trusted document in so many sets the threshold instead of being counted.
    held_out: int = 4
    least_words: int = 50
    most_repeated_percent: int = 50


#: Word hashes that a Python worker remembers.
REMEMBERED_WORDS = 250_000
SYMBOLS = b"#*$%&|<>"
_PAIR, _TRIPLE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)  # odd multipliers, fixed so that runs agree


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_hashes = _Hashes()


def forget_words() -> None:
    """Gives the memory back at a task's end: workers stay for other stages."""
    _hashes.clear()


def word_hashes(data: bytes) -> np.ndarray:
    found = data.split()  # on bytes: just at \x20 and \x09-\x0D
    return np.fromiter(map(_hashes.__getitem__, found), np.uint64, len(found))


def ngram_buckets(h: np.ndarray, buckets: int) -> np.ndarray:
    """The buckets of all words, then of all pairs of neighbours."""
    grams = np.concatenate([h, (h[:-1] * _PAIR) ^ (h[1:] >> np.uint64(7))]) if len(h) else h
    return ((grams ^ (grams >> np.uint64(32))) % np.uint64(buckets)).astype(np.int64)


def repeat_words(h: np.ndarray) -> int:
    """Words inside windows of three that occur twice or more."""
    if len(h) < 4:
        return 0
    window = (h[:-2] * _PAIR) ^ (h[1:-1] * _TRIPLE) ^ (h[2:] + (h[2:] >> np.uint64(29)))
    order = np.argsort(window, kind="stable")
    same = window[order[1:]] == window[order[:-1]]
    again = np.zeros(len(window), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    covered = np.zeros(len(h), bool)
    for k in range(3):
        covered[k : k + len(window)] |= again
    return int(covered.sum())


def base_counts(text: str, data: bytes, h: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    space = sum(data.count(bytes([c])) for c in b"\x20\t\n\x0b\x0c\r")
    symbols = sum(data.count(bytes([c])) for c in SYMBOLS)
    lines = [x for x in data.split(b"\n") if x.strip()]
    return len(h), len(text) - space, symbols, len(lines) - len(set(lines)), repeat_words(h)


def labelled_ids(labels: DataFrame, rules: QualityRules, id_col: str = "doc_id") -> DataFrame:
    """(_id, _use): at most fit_rows trusted documents (of good quality, not toxic) and fit_rows poor ones, by least hash;
    _use is fit, trusted (held out) or poor. A document with labels of both kinds counts as poor."""
    known = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    held = F.pmod(F.xxhash64("_id", F.lit("split")), F.lit(rules.held_out)) == 0
    good = known.filter("quality = 1 and toxic = 0").select("_id", F.when(held, "trusted").otherwise("fit").alias("_use"))
    poor = known.filter("quality = 0").select("_id", F.lit("poor").alias("_use"))
    least = [x.orderBy(F.xxhash64("_id"), "_id").limit(rules.fit_rows) for x in (good, poor)]
    return least[0].unionByName(least[1])


@dataclass(frozen=True)
class QualityModel:
    rules: QualityRules
    ratio: np.ndarray
    threshold: float


def bucket_counts(docs: DataFrame, rules: QualityRules, text_col: str, flag_col: str) -> DataFrame:
    """(bucket, raw, trusted) over all texts; flag_col tells the trusted ones. Each task adds up before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(rules.buckets, np.int64), np.zeros(rules.buckets, np.int64)
        for batch in slices(batches):
            for data, flag in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist()):
                if data:
                    found = np.bincount(ngram_buckets(word_hashes(data), rules.buckets), minlength=rules.buckets)
                    raw += found
                    if flag:
                        good += found
        forget_words()
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(good[some])], ["bucket", "raw", "trusted"])

    rows = docs.select(text_col, flag_col).mapInArrow(count, "bucket long, raw long, trusted long")
    return rows.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted"))


def best_threshold(trusted: dict[float, int], poor: dict[float, int], weight: float) -> float:
    """From score histograms: the middle of the gap where weight * (part of trusted below) + (part of poor above) is least;
    of equal ones the widest, then the lowest. Minus infinity if a kind is missing."""
    if not trusted or not poor:
        return -np.inf
    scores = sorted(trusted.keys() | poor.keys())
    n, m = sum(trusted.values()), sum(poor.values())
    below, above = 0, m
    found = (above / m, 0.0, -np.inf)
    for low, high in zip(scores, [*scores[1:], scores[-1] + 1.0]):
        below, above = below + trusted.get(low, 0), above - poor.get(low, 0)
        found = min(found, (weight * below / n + above / m, low - high, (low + high) / 2))
    return found[2]


def fit(docs: DataFrame, labels: DataFrame, rules: QualityRules = QualityRules(), id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """Counts over all documents; the driver gets one row for each bucket and for each rounded score."""
    ids = F.broadcast(labelled_ids(labels, rules, id_col))  # 2 * fit_rows short rows at most
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    flagged = rows.join(ids, "_id", "left").withColumn("_fit", F.coalesce(F.col("_use") == "fit", F.lit(False)))
    raw, good = np.zeros(rules.buckets), np.zeros(rules.buckets)
    for r in bucket_counts(flagged, rules, "_text", "_fit").toPandas().itertuples(index=False):
        raw[r.bucket], good[r.bucket] = r.raw, r.trusted
    if not good.any():
        return QualityModel(rules, np.zeros(rules.buckets), -np.inf)
    s = rules.smoothing
    ratio = np.log((good + s) / (good.sum() + s * rules.buckets)) - np.log((raw + s) / (raw.sum() + s * rules.buckets))
    judged = judge(rows.join(ids.filter("_use <> 'fit'"), "_id"), QualityModel(rules, ratio, -np.inf), "_text").filter(~F.col("base_failed"))
    of: dict[str, dict[float, int]] = {"trusted": {}, "poor": {}}
    for r in judged.groupBy("_use", F.round("score", 3).alias("score")).agg(F.count("*").alias("n")).collect():
        of[r["_use"]][r["score"]] = r["n"]
    return QualityModel(rules, ratio, best_threshold(of["trusted"], of["poor"], rules.trusted_weight))


COLUMNS = {"n_words": T.LongType(), "word_chars": T.LongType(), "n_symbols": T.LongType(), "n_dup_lines": T.LongType(), "n_repeat_words": T.LongType(), "base_failed": T.BooleanType(), "score": T.DoubleType(), "kept": T.BooleanType()}


def judge(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """Adds the base counts, base_failed, score and kept to every row."""
    rules, ratio, least = model.rules, model.ratio, model.threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = []
            for text in batch.column(text_col).to_pylist():
                data = (text or "").encode()
                h = word_hashes(data)
                n, chars, symbols, dup, again = base_counts(text or "", data, h)
                failed = n < rules.least_words or 100 * again > rules.most_repeated_percent * n
                score = float(ratio[ngram_buckets(h, rules.buckets)].mean()) if n else 0.0
                made.append((n, chars, symbols, dup, again, failed, score, not failed and score >= least))
            for (name, kind), values in zip(COLUMNS.items(), zip(*made) if made else [()] * len(COLUMNS)):
                batch = with_column(batch, name, pa.array(values, {"bigint": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}[kind.simpleString()]))
            yield batch
        forget_words()

    schema = T.StructType([*(f for f in docs.schema if f.name not in COLUMNS), *(T.StructField(n, k) for n, k in COLUMNS.items())])
    return docs.mapInArrow(run, schema)
