"""Language identification by nearest centroids.

A text becomes a vector of hashed letter n-grams (one to three code points of lower-case letters, a blank for
any run of others), damped term counts times inverse document frequency, at length one. The labelled sample of
each language is clustered into a few centroids; a text takes the language of the centroid with the largest
cosine. A text whose cosine is below what the centroid's own members reach is marked as rejected.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, carried, parts, quoted

#: Dimensions of a vector, centroids of a language, and rounds of clustering.
DIMENSIONS, CENTROIDS, ROUNDS = 1 << 13, 4, 12
#: Rows that a model is learned from at most, dealt evenly to the languages by a hash of the row.
SAMPLE_ROWS = 2400
#: Share of a centroid's own members that its radius leaves out.
OUTSIDE = 0.01
#: Texts vectorised together, and code points of a text handled at once.
CHUNK, SPAN = 64, 1 << 18

_LETTERS: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTERS


def counts_of(text: str, dimensions: int) -> np.ndarray:
    """Counts of the hashed n-grams of the whole text; ``dimensions`` is a power of two."""
    total = np.zeros(dimensions, np.int64)
    shift = np.uint32(32 - int(dimensions).bit_length() + 1)
    carry = np.zeros(1, np.uint32)
    for at in range(0, len(text), SPAN):
        points = np.frombuffer(text[at : at + SPAN].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        seen = np.concatenate([carry, np.where(letters()[points], points, np.uint32(0))])
        if at + SPAN >= len(text):
            seen = np.append(seen, np.uint32(0))
        kept = seen != 0
        kept[1:] |= kept[:-1]  # one blank for a run of others
        kept[: len(carry)] = True
        seen = seen[kept]
        new = len(carry)
        one, two, three = (seen * np.uint32(m) for m in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))
        grams = [one[new:][seen[new:] != 0] >> shift, (two[new - 1 : -1] + one[new:] + np.uint32(0x5BD1E995)) >> shift]
        if new > 1 or len(seen) > 2:
            first = max(new, 2)
            grams.append((three[first - 2 : -2] + two[first - 1 : -1] + one[first:] + np.uint32(0x1B873593)) >> shift)
        total += np.bincount(np.concatenate(grams), minlength=dimensions)
        carry = seen[-2:]
    return total


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


@dataclass
class Model:
    """Centroids by row, the language and the radius of each, and the weight of each dimension."""

    languages: list[str]
    centroids: np.ndarray
    radii: np.ndarray
    idf: np.ndarray

    def vectors(self, texts: list[str]) -> np.ndarray:
        return self.scaled(np.stack([counts_of(t, len(self.idf)) for t in texts]))

    def scaled(self, counts: np.ndarray) -> np.ndarray:
        m = np.log1p(counts) * self.idf
        return (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)).astype(np.float32)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, cosine, rejected) of each text; ``und`` with 0 for one without a letter."""
        out: list[tuple[str, float, bool]] = [("und", 0.0, True)] * len(texts)
        todo = [i for i, t in enumerate(texts) if has_letter(t)] if self.languages else []
        for at in range(0, len(todo), CHUNK):
            part = todo[at : at + CHUNK]
            near = self.vectors([texts[i] for i in part]) @ self.centroids.T
            best = near.argmax(axis=1)
            for i, row, k in zip(part, near, best):
                score = min(1.0, max(0.0, float(row[k])))
                out[i] = (self.languages[k], score, score < float(self.radii[k]))
        return out


def clustered(vectors: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from spread starts: each next start is the vector farthest from those before."""
    starts = [int(np.argmax(vectors @ vectors.mean(axis=0)))]
    near = vectors @ vectors[starts[0]]
    while len(starts) < min(k, len(vectors)):
        starts.append(int(np.argmin(near)))
        near = np.maximum(near, vectors @ vectors[starts[-1]])
    centres = vectors[starts]
    for _ in range(ROUNDS):
        mine = (vectors @ centres.T).argmax(axis=1)
        centres = np.stack([vectors[mine == j].mean(axis=0) if (mine == j).any() else centres[j] for j in range(len(centres))])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


def fit(counts: np.ndarray, languages: list[str], k: int = CENTROIDS) -> Model:
    """Centroids of the rows of n-gram counts of each language."""
    dimensions = counts.shape[1]
    if not len(counts):
        return Model([], np.zeros((0, dimensions), np.float32), np.zeros(0), np.ones(dimensions))
    model = Model([], np.zeros(0), np.zeros(0), np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 0.05)
    names, centres, radii = [], [], []
    of = np.array(languages)
    for g in sorted(set(languages)):
        vectors = model.scaled(counts[of == g])
        own = clustered(vectors, k)
        near = vectors @ own.T
        mine = near.argmax(axis=1)
        for j in range(len(own)):
            names.append(g)
            radii.append(float(np.quantile(near[mine == j, j], OUTSIDE)) if (mine == j).any() else 0.0)
        centres.append(own)
    return Model(names, np.concatenate(centres).astype(np.float32), np.array(radii), model.idf)


def learn(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", dimensions: int = DIMENSIONS) -> Model:
    """Fit on at most ``sample_rows`` rows of ``labelled``, chosen by a hash of their identifier.

    Of rows with one identifier and language the smallest text counts, so repeated rows add nothing. Texts stay with the
    executors; the driver gets the counts of their n-grams, ``dimensions`` numbers of a row at most.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    bounded_batches(labelled.sparkSession)
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(sample_rows).collect()}
    if not counts:
        return fit(np.zeros((0, dimensions), np.float32), [])
    each = max(1, sample_rows // len(counts))
    draw = F.pmod(F.xxhash64(F.lit("language"), F.col("id")), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*(F.lit(x) for g, n in counts.items() for x in (g, min(1.0, each / n))))
    picked = rows.withColumn("draw", draw).where(F.col("draw") < share[F.col("lang")]).groupBy("draw", "id", "lang").agg(F.min("text").alias("text"))
    picked = picked.orderBy("draw", "id", "lang").limit(sample_rows).repartition(min(16, parts(labelled.sparkSession)), "draw", "id", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i, text in enumerate(batch.column("text")):
                if has_letter(text.as_py()):
                    n = counts_of(text.as_py(), dimensions)
                    at = np.flatnonzero(n)
                    found.append((batch.column("draw")[i].as_py(), batch.column("lang")[i].as_py(), at.astype(np.int32), n[at]))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate((pa.float64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64())))], names=["draw", "lang", "at", "n"])

    found = sorted(picked.select("draw", "lang", "text").mapInArrow(count, "draw double, lang string, at array<int>, n array<long>").collect(), key=lambda r: (r["draw"], r["lang"], r["at"], r["n"]))
    matrix = np.zeros((len(found), dimensions), np.float32)
    for row, r in zip(matrix, found):
        row[r["at"]] = r["n"]
    return fit(matrix, [r["lang"] for r in found])


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score (cosine, 0 to 1) and rejected beside its own columns, every row included.

    Null, empty and letterless texts are ``und`` with score 0 and rejected; so is every text under a model
    that was learned from nothing. Long texts are read whole, span by span. Equal texts get equal answers, and
    of equally near centroids the first by language wins. Columns of ``docs`` with these names are replaced.
    """
    bounded_batches(docs.sparkSession)
    packed = pickle.dumps((model.languages, model.centroids, model.radii, model.idf))

    @F.arrow_udf("struct<lang_pred:string,score:double,rejected:boolean>")
    def predicted(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Model(*pickle.loads(packed))
        for texts in columns:
            rows = [r for at in range(0, len(texts), CHUNK) for r in own.predict(texts.slice(at, CHUNK).to_pylist())]
            yield pa.StructArray.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))], names=["lang_pred", "score", "rejected"])

    own, back = carried(docs, "lang_pred", "score", "rejected")
    return docs.select(*own, predicted(F.col(quoted(text_col))).alias("p__")).select(*back, "p__.lang_pred", "p__.score", "p__.rejected")
