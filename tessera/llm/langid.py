"""Language ID: nearest of several clustered centroids per language, with rejection by distance."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.sampling import bounded_sample
from tessera.plans import small_batches

#: Width of the hashed n-gram space, and lengths of the n-grams.
DIMS, ORDERS = 4096, (2, 3)
_PIECE = 1 << 20
#: N-grams without which a text is too short to be rejected.
_JUDGED = 16


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point of the basic plane whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x10000)), bool, 0x10000)


def ngram_counts(text: str | None) -> tuple[np.ndarray, bool]:
    """Counts of the hashed letter n-grams of a whole text, and whether it has a letter.

    Runs of other characters count as one gap. Long texts are taken piece by
    piece, so memory does not grow with their length.
    """
    counts = np.zeros(DIMS, np.int64)
    found, tail = False, np.zeros(1, np.uint32)
    for at in range(0, len(text or ""), _PIECE):
        points = np.frombuffer(text[at : at + _PIECE].lower().encode("utf-32-le", "surrogatepass"), "<u4")
        is_letter = _letters()[np.minimum(points, 0xFFFF)]
        for i in np.flatnonzero(points > 0xFFFF):
            is_letter[i] = chr(points[i]).isalpha()
        found = found or bool(is_letter.any())
        points = np.concatenate([tail, np.where(is_letter, points, 0).astype(np.uint32)])
        points = points[np.concatenate([[True], (points[1:] != 0) | (points[:-1] != 0)])]
        _count(points, counts, len(tail))
        tail = points[-(max(ORDERS) - 1) :]
    _count(np.concatenate([tail, np.zeros(1, np.uint32)]), counts, len(tail))
    return counts, found


def _count(points: np.ndarray, counts: np.ndarray, seen: int) -> None:
    """Add the n-grams that end behind the first ``seen`` places."""
    for order in ORDERS:
        first = max(0, seen - order + 1)
        n = len(points) - order + 1 - first
        if n <= 0:
            continue
        code = np.full(n, order, np.uint32)
        for k in range(order):
            code = (code ^ points[first + k : first + k + n]) * np.uint32(0x9E3779B1)
            code ^= code >> np.uint32(15)
        counts += np.bincount(code % np.uint32(DIMS), minlength=DIMS)


@dataclass(frozen=True)
class Model:
    """Unit centroids, their languages, term weights, and the least cosine by length of a text."""

    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]
    least: np.ndarray

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        weighted = np.log1p(counts) * self.idf
        return weighted / np.maximum(np.linalg.norm(weighted, axis=-1, keepdims=True), 1e-12)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, cosine, accepted) of each text; ``und`` without a letter or a model."""
        out: list[tuple[str, float, bool]] = []
        for at in range(0, len(texts), 128):
            pairs = [ngram_counts(t) for t in texts[at : at + 128]]
            counts = np.stack([c for c, _ in pairs])
            if not self.langs:
                out += [("und", 0.0, False)] * len(pairs)
                continue
            near = self.vectors(counts) @ self.centroids.T
            best = near.argmax(axis=1)
            grams = counts.sum(axis=1)
            least = np.where(grams < _JUDGED, 0.0, self.least[_length_bin(grams)])
            for (_, found), row, k, low in zip(pairs, near, best, least, strict=True):
                score = float(min(1.0, max(0.0, row[k])))
                out.append((self.langs[k], score, score >= low) if found else ("und", 0.0, False))
        return out


def _length_bin(grams: np.ndarray) -> np.ndarray:
    return np.clip(np.log2(np.maximum(grams, 1)).astype(int), 6, 31)


def _cluster(vectors: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Unit centroids of spherical k-means, seeded by the farthest vectors."""
    rng = np.random.default_rng(seed)
    centres = vectors[[int(rng.integers(len(vectors)))]]
    while len(centres) < min(k, len(vectors)):
        centres = np.vstack([centres, vectors[(vectors @ centres.T).max(axis=1).argmin()]])
    for _ in range(15):
        own = (vectors @ centres.T).argmax(axis=1)
        sums = np.stack([vectors[own == j].sum(axis=0) if (own == j).any() else centres[j] for j in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres


def is_held_out(doc_id: Column) -> Column:
    """Documents that a model must not learn from: crc32(doc_id as text) mod 4 is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, clusters: int = 4, sample: int = 500, quantile: float = 0.01, reject: float = 0.45, seed: int = 7) -> Model:
    """Learn from text and lang of the documents that are not held out.

    Document frequencies cover all of them. Centroids are fitted, per language and in a
    task of their own, on ``sample`` documents at the most (the documented bound),
    those with the smallest hashes. A text of 16 n-grams or more is rejected
    when its best cosine is below ``reject`` times the ``quantile`` of the sample's own cosines among
    texts of about its length (a quarter to four times), of which the sample must have 30: short texts lie farther from every centroid. Null lang teaches
    nothing; without any labelled text the model is empty.
    """
    small_batches(docs.sparkSession)
    taught = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~is_held_out(F.col("doc_id")))

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = np.zeros(DIMS, np.int64), 0
        for batch in batches:
            for text in batch["text"]:
                held += ngram_counts(text)[0] > 0
                n += 1
        at = np.flatnonzero(held)
        yield pd.DataFrame({"dim": [*at.tolist(), -1], "n": [*held[at].tolist(), n]})

    rows = taught.select("text").mapInPandas(frequencies, "dim int, n bigint").groupBy("dim").agg(F.sum("n").alias("n")).collect()  # DIMS + 1 rows at most
    counted = {r.dim: r.n for r in rows}
    total = counted.get(-1) or 0
    idf = np.array([np.log((1 + total) / (1 + counted.get(d, 0))) + 1 for d in range(DIMS)])
    per_lang = {r.lang: r.n for r in taught.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    if not per_lang:
        return Model(idf, np.zeros((0, DIMS)), [], np.zeros(32))
    drawn = bounded_sample(taught, "lang", per_lang, ["doc_id", "text"], sample, seed)
    empty = Model(idf, np.zeros((0, DIMS)), [], np.zeros(32))

    def centroids(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        counts = np.stack([c for c, found in map(ngram_counts, sorted(group["text"])) if found] or [np.zeros(DIMS, np.int64)])
        vectors = empty.vectors(counts)
        centres = _cluster(vectors, clusters, seed)
        cosines, bins = (vectors @ centres.T).max(axis=1), _length_bin(counts.sum(axis=1))
        return pd.DataFrame({"lang": [key[0]], "centres": [centres.ravel().tolist()], "cosines": [cosines.tolist()], "bins": [bins.tolist()]})

    fitted = sorted(drawn.select("lang", "text").groupBy("lang").applyInPandas(centroids, "lang string, centres array<double>, cosines array<double>, bins array<bigint>").collect(), key=lambda r: r.lang)  # clusters * DIMS + 2 * sample numbers a language
    langs, centres = [], []
    for r in fitted:
        own = np.array(r.centres).reshape(-1, DIMS)
        langs += [r.lang] * len(own)
        centres.append(own)
    cosines, bins = (np.concatenate([np.array(r[name], float) for r in fitted] or [np.zeros(0)]) for name in ("cosines", "bins"))
    least = np.zeros(32)
    for b in range(32):
        like = cosines[np.abs(bins - b) <= 2]
        least[b] = reject * np.quantile(like, quantile) if len(like) >= 30 else 0.0
    return Model(idf, np.vstack(centres) if centres else np.zeros((0, DIMS)), langs, least)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` (but one of that name) and a struct ``language``: lang_pred, score (cosine, 0 to 1), accepted.

    Only the text is read. Null or letterless text: ``und``, 0, not accepted.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages * clusters * DIMS numbers

    @F.pandas_udf("lang_pred string, score double, accepted boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame(shared.value.predict(texts.tolist()), columns=["lang_pred", "score", "accepted"])

    return docs.withColumn("language", predict(F.col("text")))
