"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed 1-, 2- and 3-grams of lower-cased letters with runs of anything else as
one space; a document's value of a feature is its relative frequency times the inverse
document frequency. Document frequencies are counted over all learning documents. The weights
come from follow-the-regularised-leader with elastic-net penalties on a bounded sample of
labelled documents, then one temperature is fitted on a part of that sample left aside."""

from __future__ import annotations

import dataclasses
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_limits, mix64, slices, stored, utf8

BUCKETS = 1 << 15
SCALE = 100.0  # of relative frequencies
UNKNOWN = "und"
MOST_LANGUAGES = 4096


def features(data: np.ndarray, bounds: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For 1-, 2- and 3-grams the bucket of each in text order and the texts' n + 1 bounds; whether each text has a letter."""
    texts = [data[a:b].tobytes().decode("utf-8").lower() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    codes = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le"), np.uint32)
    letter = _letters()[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one space after each run of letters; the separator ends a text's last one
    ends = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])]
    c = np.where(letter, codes, 32)[keep].astype(np.uint64)
    joined, out = c, []
    for width in (1, 2, 3):
        if width > 1:
            joined = joined[:-1] * np.uint64(0x110000) + c[width - 1 :] if len(c) >= width else joined[:0]
        # the last width - 1 places of a text start no n-gram
        starts, many = ends[:-1], np.maximum(np.diff(ends) - width + 1, 0)
        inside = np.ones(len(joined), bool)
        for back in range(1, width):
            last = ends[1:] - back
            inside[last[(last >= starts) & (last < len(joined))]] = False
        bucket = mix64(joined[inside] + np.uint64(width * 0x9E3779B97F4A7C15 % (1 << 64))) & np.uint64(BUCKETS - 1)
        out.append((bucket.astype(np.int64), np.concatenate([[0], np.cumsum(many)])))
    return out, np.diff(ends) > 0


_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Which code points are letters."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


@dataclasses.dataclass
class LanguageModel:
    languages: list[str]
    gains: np.ndarray  # (BUCKETS, languages): inverse document frequency times weight, scaled
    bias: np.ndarray
    temperature: float

    def score(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best language's number (-1: no letter) and its calibrated probability, by text."""
        grams, has = features(data, bounds)
        n = sum(np.diff(ends) for _, ends in grams)
        best, sure = np.full(len(n), -1), np.zeros(len(n))
        at = np.flatnonzero(has)
        if len(at) and self.languages:
            sums = np.zeros((len(n), len(self.languages)))
            for bucket, ends in grams:
                some = np.flatnonzero(np.diff(ends))
                if len(some):
                    sums[some] += np.add.reduceat(self.gains[bucket], ends[:-1][some], axis=0)
            sums = sums[at]
            logits = (sums / n[at, None] + self.bias) / self.temperature
            logits -= logits.max(axis=1, keepdims=True)
            p = np.exp(logits)
            p /= p.sum(axis=1, keepdims=True)
            best[at], sure[at] = p.argmax(axis=1), p.max(axis=1)
        return best, sure


def train_ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], classes: int, epochs: int = 4, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by FTRL-proximal with elastic-net penalties. rows: class, buckets, values."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def weights(k: np.ndarray | slice) -> np.ndarray:
        w = -(z[k] - np.sign(z[k]) * l1) / ((beta + np.sqrt(n[k])) / alpha + l2)
        return np.where(np.abs(z[k]) > l1, w, 0.0)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            y, k, x = rows[r]
            k, x = np.append(k, BUCKETS), np.append(x, 1.0)
            w = weights(k)
            logits = x @ w
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y] -= 1.0
            g = x[:, None] * p
            z[k] += g - (np.sqrt(n[k] + g * g) - np.sqrt(n[k])) / alpha * w
            n[k] += g * g
    w = weights(slice(None))
    return w[:-1], w[-1]


def _frequencies(rows: DataFrame) -> DataFrame:
    """lang, bucket, n of rows (text, lang), added up by task: of bucket -1 the rows of a lang; of others, with a null lang, the documents that have it. Bucket -2: the documents with a letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total, counts = np.zeros(BUCKETS, np.int64), 0, Counter()
        for batch in batches:
            counts.update(batch.column("lang").to_pylist())
            data, bounds = utf8(batch.column("text"))
            for lo, hi in slices(batch, bounds):
                grams, has = features(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo])
                for k in range(hi - lo):
                    mark = np.zeros(BUCKETS, bool)
                    for bucket, ends in grams:
                        mark[bucket[ends[k] : ends[k + 1]]] = True
                    seen += mark
                total += int(has.sum())
        at = np.flatnonzero(seen)
        langs = [*counts, *[None] * (1 + len(at))]
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array([-1] * len(counts) + [-2, *at.tolist()], pa.int64()), pa.array([*counts.values(), total, *seen[at].tolist()], pa.int64())], ["lang", "bucket", "n"])

    return rows.select("text", "lang").mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def _sparse(rows: DataFrame) -> DataFrame:
    """lang, aside, bucket[], n[]: bucket counts of rows (text, lang, aside)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = utf8(batch.column("text"))
            for lo, hi in slices(batch, bounds):
                grams, _ = features(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo])
                parts = [np.unique(np.concatenate([bucket[ends[k] : ends[k + 1]] for bucket, ends in grams]), return_counts=True) for k in range(hi - lo)]
                cols = [pa.array([p[k] for p in parts], pa.list_(pa.int64())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([batch.column("lang")[lo:hi], batch.column("aside")[lo:hi], *cols], ["lang", "aside", "bucket", "n"])

    return rows.select("text", "lang", "aside").mapInArrow(run, "lang string, aside boolean, bucket array<long>, n array<long>")


def fit_languages(labelled: DataFrame, per_language: int = 1000) -> LanguageModel:
    """A model from rows (text, lang) with a language; all of them may be learned from.

    Document frequencies come from all rows. The weights are fitted on a sample of about
    ``per_language`` texts of each language, chosen by a hash of the text (equal texts count
    once), so a few thousand rows reach the driver whatever the input. Rows with null text or
    lang are left out; without rows the model knows no language; over ``MOST_LANGUAGES``
    different values of lang raise a ValueError."""
    arrow_limits(labelled.sparkSession)
    rows = labelled.where("text is not null and lang is not null").select("text", "lang")
    frequency = _frequencies(rows).limit(MOST_LANGUAGES + BUCKETS + 2).collect()
    counts = {r["lang"]: r["n"] for r in frequency if r["bucket"] == -1}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError("too many languages")
    languages = sorted(counts)
    seen = {r["bucket"]: r["n"] for r in frequency if r["bucket"] != -1}
    total = seen.pop(-2, 0)
    idf = np.full(BUCKETS, np.log(total + 1.0) + 1.0)
    for b, n in seen.items():
        idf[b] = np.log((total + 1.0) / (n + 1.0)) + 1.0
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0)
    hashed = F.xxhash64(F.lit("sample"), "text")
    share = F.create_map(*(F.lit(x) for lang in languages for x in (lang, min(1.0, per_language / counts[lang]))))
    sample = rows.withColumn("draw", hashed).where(F.col("draw") / 2.0**64 + 0.5 < F.element_at(share, F.col("lang")))
    sample = sample.dropDuplicates(["lang", "draw"]).select("text", "lang", (F.pmod(F.xxhash64(F.lit("aside"), "text"), F.lit(5)) == 0).alias("aside"))
    sample = stored(_sparse(sample), "language-sample")
    fit, aside = [], []
    for r in sample.orderBy(F.xxhash64("lang", "bucket", "n")).toLocalIterator():
        k, n = np.array(r["bucket"], np.int64), np.array(r["n"], np.float64)
        if len(k):
            (aside if r["aside"] else fit).append((languages.index(r["lang"]), k, n / n.sum() * idf[k] * SCALE))
    weights, bias = train_ftrl(fit or aside, len(languages))
    temperature = fit_temperature([(y, x @ weights[k] + bias) for y, k, x in aside or fit])
    return LanguageModel(languages, (idf[:, None] * weights * SCALE).astype(np.float32), bias, temperature)


def fit_temperature(logits: list[tuple[int, np.ndarray]]) -> float:
    """The temperature of least log loss over (class, logits), among 121 from 0.25 to 20."""

    def loss(t: float) -> float:
        return sum(np.log(np.exp((v - v.max()) / t).sum()) - (v[y] - v.max()) / t for y, v in logits)

    return float(min(np.geomspace(0.25, 20, 121), key=loss)) if logits else 1.0


def predicted(model: LanguageModel, text: Column) -> Column:
    """A struct of lang_pred and score for a text column."""

    @F.arrow_udf("lang_pred string, score double")
    def predict(column: pa.Array) -> pa.Array:
        data, bounds = utf8(column)
        names, scores = [], []
        for lo, hi in slices(column, bounds):
            best, sure = model.score(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo])
            names += [model.languages[b] if b >= 0 else UNKNOWN for b in best.tolist()]
            scores += sure.tolist()
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return predict(text)


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def identify_languages(docs: DataFrame, per_language: int = 1000) -> DataFrame:
    """The language of every whole text of ``docs`` (doc_id, text, lang; other columns are left out).

    doc_id, held_out (crc32 of doc_id as text, modulo 5, is 0), lang_pred and score (0 to 1).
    Learns from rows that aren't held out and have a lang. A text that is null or has no
    letter is `und` with score 0, as is every text if there is nothing to learn from; equal
    texts get equal answers; a null doc_id is not held out and not learned from."""
    model = fit_languages(docs.where(~held_out(F.col("doc_id"))), per_language)
    guess = docs.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), predicted(model, F.col("text")).alias("__guess"))
    return guess.select("doc_id", "held_out", F.col("__guess.lang_pred").alias("lang_pred"), F.col("__guess.score").alias("score"))


def keep_identified(docs: DataFrame, languages: list[str] | None = None, least: float = 0.5, per_language: int = 1000) -> DataFrame:
    """``docs``, all columns, whose text's language is known, one of ``languages`` if given, with a score of ``least`` or more."""
    model = fit_languages(docs.where(~held_out(F.col("doc_id"))), per_language)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), predicted(model, F.col("text")).alias("__guess"))
    known = (F.col("__guess.lang_pred") != UNKNOWN) & (F.col("__guess.score") >= least)
    if languages is not None:
        known &= F.col("__guess.lang_pred").isin(languages)
    return rows.where(known).select("__row.*")
