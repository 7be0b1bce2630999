"""Operator 7: quality by nearest-neighbour voting in a latent-semantic space.

Each text is a vector of hashed character trigrams (log counts times inverse document frequency) and of shares of
word forms; the singular vectors of a bounded labelled sample span the latent space.  The labelled vectors are
broadcast, every text's cosines with all of them are computed in blocks, and the nearest neighbours vote with
their similarity as weight.

The sample has ``per_label`` rows of each label at most (those of smallest id hash), which bounds what is
broadcast.  Defined results: an empty or null text has no direction and scores 0; without labels all score 0.5;
ties between neighbours go to the earlier sample row; a document that repeats in the labels counts by its
lowest label, and by its text of smallest hash where its id has several; repeated rows give repeated results; only the named columns are read, so further ones cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioquarry.llm.common import Words, over_texts, word_hashes

SLOTS, RANK, NEIGHBOURS, PER_LABEL, THRESHOLD = 1024, 48, 25, 1500, 0.3
#: Weight of the word-form block beside the trigram block, both of unit length.
FORM_WEIGHT = 1.5
_CLASS = np.full(256, 3, np.int64)  # other
_CLASS[list(range(97, 123))] = 0
_CLASS[128:] = 0
_CLASS[list(range(65, 91))] = 1
_CLASS[list(range(48, 58))] = 2
FORMS = 4 * 4 * 2 + 1  # class of the first and last byte, mixed case or symbols, and equality with the word before


def counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Trigram counts and word-form shares of whole texts."""
    w, n = Words(texts), len(texts)
    data = w.data.astype(np.int64)
    doc = np.repeat(np.arange(n), np.diff(w.first))
    slot = ((data[:-2] * 31 + data[1:-1]) * 131 + data[2:]) * 2654435761 % 4294967291 % SLOTS if len(data) > 2 else np.zeros(0, np.int64)
    within = doc[:-2] == doc[2:] if len(data) > 2 else np.zeros(0, bool)
    grams = np.bincount((doc[: len(slot)] * SLOTS + slot)[within], minlength=n * SLOTS).reshape(n, SLOTS)
    forms = np.zeros((n, FORMS))
    if len(w.start):
        size = w.end - w.start
        kind = _CLASS[w.data]
        mixed = (w.total(kind == 1) > 1) | (w.total(kind == 3) > 1)
        form = (_CLASS[w.data[w.start]] * 4 + _CLASS[w.data[w.end - 1]]) * 2 + mixed
        word = word_hashes(w)
        same = np.zeros(len(size), bool)
        same[1:] = (word[1:] == word[:-1]) & (size[1:] == size[:-1]) & (w.doc[1:] == w.doc[:-1])
        np.add.at(forms, (w.doc, form), 1)
        forms[:, -1] = np.bincount(w.doc, weights=same, minlength=n)
        forms /= np.maximum(np.bincount(w.doc, minlength=n), 1)[:, None]
    return grams, forms


@dataclass
class Model:
    """idf: trigram weights; basis: vector x rank; vectors and labels of the sample, in its order."""

    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def latent(self, grams: np.ndarray, forms: np.ndarray) -> np.ndarray:
        x = _unit(_raw(grams, forms, self.idf) @ self.basis)
        x[grams.sum(1) == 0] = 0
        return x

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(texts), 0.5)
        out = np.zeros(len(texts))
        for a in range(0, len(texts), 256):
            x = self.latent(*counts(texts[a : a + 256]))
            cosine = x @ self.vectors.T
            weight = np.where(nearest(cosine, NEIGHBOURS), np.maximum(cosine, 0), 0)
            out[a : a + 256] = weight @ self.labels / np.maximum(weight.sum(1), 1e-9)
        return np.clip(out, 0, 1)


def nearest(cosine: np.ndarray, k: int) -> np.ndarray:
    """Mask of the k largest in each row; of those that equal the k-th (to a part in 10^9) the first columns."""
    if cosine.shape[1] <= k:
        return np.ones(cosine.shape, bool)
    last = np.partition(cosine, -k, axis=1)[:, -k, None]
    above, equal = cosine > last + 1e-9, np.abs(cosine - last) <= 1e-9
    return above | (equal & (np.cumsum(equal, axis=1) <= k - above.sum(1, keepdims=True)))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _raw(grams: np.ndarray, forms: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return np.hstack([_unit(np.log1p(grams) * idf), FORM_WEIGHT * _unit(forms)])


def fit(grams: np.ndarray, forms: np.ndarray, labels: np.ndarray, rank: int = RANK) -> Model:
    """Latent space of the sample: its truncated singular value decomposition by subspace iteration."""
    idf = np.log((1 + len(grams)) / (1 + (grams > 0).sum(0))) + 0.1
    x = _raw(grams, forms, idf)
    basis = np.random.default_rng(5).standard_normal((x.shape[1], rank + 10))
    for _ in range(6):
        basis, _ = np.linalg.qr(x.T @ (x @ basis))
    _, turn = np.linalg.eigh((y := x @ basis).T @ y)
    basis = (basis @ turn[:, ::-1])[:, :rank]
    basis = basis * np.where(basis[np.abs(basis).argmax(0), np.arange(basis.shape[1])] < 0, -1, 1)
    model = Model(idf, basis, np.zeros((0, basis.shape[1])), np.asarray(labels, float))
    model.vectors = model.latent(grams, forms)
    return model


def held_out(doc_id) -> F.Column:
    """Whether a row's id belongs to the fold that is never learned from; a null id does not."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("?")).cast("binary")) % 5 == 0


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_label: int = PER_LABEL) -> Model:
    """Model of a bounded sample of the labelled rows outside the held-out fold; the executors make its vectors."""
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label")).filter("id is not null and label in (0, 1)")
    known = known.filter(~held_out(F.col("id"))).groupBy("id").agg(F.min("label").alias("label"))
    parts = [known.filter(F.col("label") == y).orderBy(F.xxhash64("id"), "id").limit(per_label) for y in (0, 1)]
    sample = F.broadcast(parts[0].unionByName(parts[1]))  # 2 * per_label rows of two numbers at most
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("raw"), F.col(f"`{text_col}`").cast("string").alias("text")).join(sample, "id")

    def kernel(texts: list[str | None]) -> list[list]:
        grams, forms = counts(texts)
        return [[g.astype("<u4").tobytes() for g in grams], [f.astype("<f8").tobytes() for f in forms]]

    fields = T.StructType([T.StructField("grams", T.BinaryType()), T.StructField("forms", T.BinaryType())])
    got = over_texts(rows, "text", kernel, fields, ["id", "label", "raw"]).toArrow().to_pandas().sort_values(["id", "raw"]).drop_duplicates("id")
    if got.empty:
        return Model(np.zeros(SLOTS), np.zeros((SLOTS + FORMS, 1)), np.zeros((0, 1)), np.zeros(0))
    grams = np.stack([np.frombuffer(b, "<u4") for b in got["grams"]]).astype(np.int64)
    forms = np.stack([np.frombuffer(b, "<f8") for b in got["forms"]])
    return fit(grams, forms, got["label"].to_numpy())


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id, held_out, score and predicted for each row; the model goes to each executor once."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(f"`{id_col}`").alias(id_col), held_out(F.col(f"`{id_col}`")).alias("held_out"), F.col(f"`{text_col}`").cast("string").alias("__body"))
    out = over_texts(rows, "__body", lambda texts: [np.round(sent.value.score(texts), 6)], T.StructType([T.StructField("score", T.DoubleType())]), [id_col, "held_out"])
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
