"""Language identification by nearest centroid.

A text becomes a normalised TF-IDF vector of hashed byte n-grams (two and three bytes of the lower-cased text with
everything but letters as one space). Each language has several centroids, found by spherical k-means on a bounded
sample of labelled texts; a text takes the language of the centroid with the largest cosine. A text whose cosine lies
under the language's own limit is too far from everything learned and is marked as rejected.

The sample is the documented bound: about SAMPLE labelled texts for each language, chosen by a hash of identifier and
text, for the k-means alone. Document frequencies and the limits come from all labelled texts.
Defined results: null text and text without any letter give ``und``, score 0, rejected; rows with a null label are
never learned from; with no labelled row at all every text is ``und``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import LOWER, chunks

#: Hashed n-gram dimensions; labelled texts learned from for each language; centroids for each language.
DIMS, SAMPLE, CENTROIDS = 1 << 12, 400, 3
#: A text is rejected if its cosine is under this share of the REJECT_QUANTILE of all its language's labelled texts,
#: read from a histogram of BINS steps.
REJECT_QUANTILE, REJECT_SHARE, BINS = 0.02, 0.35, 2048
UNKNOWN = "und"

_LETTER = np.zeros(256, dtype=bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_LETTER[0x80:] = True


@dataclass
class Model:
    """idf by dimension, centroids (rows), the language of each, and each language's rejection limit."""

    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]
    limits: dict[str, float]


def counts(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """Yields (first row, end row, n-gram counts by row and dimension)."""
    for lo, hi, data, offsets in chunks(texts, 1 << 20):
        for a in range(lo, hi, 128):
            b = min(hi, a + 128)
            begin, end = offsets[a - lo], offsets[b - lo]
            own = np.where(_LETTER[data[begin:end]], LOWER[data[begin:end]], np.uint8(32)).astype(np.uint32)
            row = np.repeat(np.arange(b - a, dtype=np.int64), np.diff(offsets[a - lo : b - lo + 1]))
            out = np.zeros((b - a) * DIMS, dtype=np.int64)
            for n in (2, 3):
                if len(own) < n:
                    continue
                code = own[: len(own) - n + 1].copy()
                keep = row[: len(code)] == row[n - 1 :]
                blank = own[: len(code)] == 32
                for k in range(1, n):
                    code = code * np.uint32(257) + own[k : k + len(code)]
                    blank &= own[k : k + len(blank)] == 32
                keep &= ~blank
                dim = ((code * np.uint32(2654435761) + np.uint32(n)) >> np.uint32(20)).astype(np.int64) % DIMS
                out += np.bincount(row[: len(code)][keep] * DIMS + dim[keep], minlength=len(out))
            yield a, b, out.reshape(b - a, DIMS)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def vectors(texts: pa.Array, idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF vectors, one row for each text."""
    return np.concatenate([_unit(np.log1p(c).astype(np.float32) * idf) for _, _, c in counts(texts)] or [np.zeros((0, DIMS), np.float32)])


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Model:
    """Learns from all labelled rows; only the k-means sees a sample, about SAMPLE distinct rows of each language.

    Three passes without a text in any exchange: rows by label, document frequencies, best cosines by label. The driver
    holds the sample and at most DIMS numbers, or BINS for each label, of each pass.
    """
    none = Model(np.ones(DIMS, np.float32), np.zeros((0, DIMS), np.float32), [], {})
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    rows = rows.select(F.col(lang_col).alias("l"), F.col(text_col).alias("t"), F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).alias("i"))
    # repeated rows count once, so that neither null nor repeated identifiers widen the sample
    sizes = {r[0]: r[1] for r in rows.groupBy("l").agg(F.approx_count_distinct("i").alias("n")).collect()}
    if not sizes:
        return none
    share = F.create_map(*[F.lit(x) for k, n in sorted(sizes.items()) for x in (k, min(1.0, SAMPLE / n))])
    pick = F.pmod(F.xxhash64("i", F.lit(29)), F.lit(1 << 20)) < share[F.col("l")] * (1 << 20)
    sample = rows.filter(pick).distinct().toPandas().sort_values(["l", "i"], kind="stable")
    if sample.empty:
        return none
    found = rows.select("t").mapInArrow(_frequencies, "dim int, n bigint").groupBy("dim").agg(F.sum("n").alias("n")).collect()
    frequency = np.zeros(DIMS + 1)
    for r in found:
        frequency[r.dim] = r.n
    idf = (np.log((1 + frequency[DIMS]) / (1 + frequency[:DIMS])) + 1).astype(np.float32)
    x, own = vectors(pa.array(sample["t"], pa.large_string()), idf), sample["l"].to_numpy()
    centroids, langs = [], []
    for lang in sorted(set(own)):
        mine = _cluster(x[own == lang])
        centroids.append(mine)
        langs += [lang] * len(mine)
    model = Model(idf, np.concatenate(centroids), langs, {})
    model.limits = _limits(rows, model)
    return model


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of a task that hold each dimension; dimension DIMS counts the texts."""
    total = np.zeros(DIMS + 1, dtype=np.int64)
    for b in batches:
        for _, _, c in counts(b.column("t")):
            total[:DIMS] += (c > 0).sum(axis=0)
        total[DIMS] += b.num_rows
    at = total.nonzero()[0]
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["dim", "n"])


def _limits(rows: DataFrame, model: Model) -> dict[str, float]:
    """REJECT_SHARE of the REJECT_QUANTILE, to one of BINS steps, of each label's best cosines over all its rows."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[tuple[str, int]] = Counter()
        for b in batches:
            own = b.column("l").to_pylist()
            for lo, hi, c in counts(b.column("t")):
                best = (_unit(np.log1p(c).astype(np.float32) * sent.value.idf) @ sent.value.centroids.T).max(axis=1)
                held.update(zip(own[lo:hi], np.clip(best * BINS, 0, BINS - 1).astype(int).tolist(), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.int32()), pa.array(list(held.values()), pa.int64())], ["l", "bin", "n"])

    found: dict[str, np.ndarray] = {}
    for r in rows.select("l", "t").mapInArrow(run, "l string, bin int, n bigint").groupBy("l", "bin").agg(F.sum("n").alias("n")).collect():
        found.setdefault(r.l, np.zeros(BINS, dtype=np.int64))[r.bin] = r.n
    return {lang: float(REJECT_SHARE * np.searchsorted(n.cumsum(), REJECT_QUANTILE * n.sum()) / BINS) for lang, n in found.items()}


def _cluster(x: np.ndarray, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; the first centre is the mean, each next the row farthest from those so far."""
    centres = _unit(x.mean(axis=0, keepdims=True))
    while len(centres) < min(CENTROIDS, len(x)):
        centres = np.concatenate([centres, x[[int((x @ centres.T).max(axis=1).argmin())]]])
    for _ in range(rounds):
        nearest = (x @ centres.T).argmax(axis=1)
        centres = np.concatenate([_unit(x[nearest == k].mean(axis=0, keepdims=True)) if (nearest == k).any() else centres[[k]] for k in range(len(centres))])
    return centres.astype(np.float32)


def classify(texts: pa.Array, model: Model) -> tuple[list[str], list[float], list[bool]]:
    """Languages, cosines and rejections of a column of texts."""
    langs, scores, rejected = [], [], []
    values = texts.to_pylist()
    for lo, hi, c in counts(texts):
        cosine = _unit(np.log1p(c).astype(np.float32) * model.idf) @ model.centroids.T if model.langs else np.zeros((hi - lo, 0))
        for i in range(lo, hi):
            text = values[i]
            if not model.langs or not text or not (c[i - lo].any() and any(map(str.isalpha, text))):
                if not model.langs or not text or not any(map(str.isalpha, text)):
                    langs.append(UNKNOWN), scores.append(0.0), rejected.append(True)
                    continue
            k = int(cosine[i - lo].argmax())
            score = float(min(1.0, max(0.0, cosine[i - lo, k])))
            langs.append(model.langs[k]), scores.append(score), rejected.append(score < model.limits.get(model.langs[k], 0.0))
    return langs, scores, rejected


def predict(docs: DataFrame, model: Model, text_col: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "rejected"), keep: tuple[str, ...] | None = None) -> DataFrame:
    """Adds language, cosine and rejection. No shuffle; the model is a few hundred kB for each language."""
    kept = [c for c in (keep or docs.columns) if c not in names]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), f"`{names[0]}` string", f"`{names[1]}` double", f"`{names[2]}` boolean"])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores, rejected = classify(b.column(text_col), sent.value)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], [*kept, *names])

    return docs.select(*dict.fromkeys([*kept, text_col])).mapInArrow(run, schema)
