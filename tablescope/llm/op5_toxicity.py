"""Toxicity by non-negative positive-unlabelled learning (nnPU).

Positives are texts confirmed toxic; all other training text counts as
unlabelled, whatever it holds. A linear model over hashed words and word beginnings is trained with
numpy on the class-prior-corrected risk

    prior * E_pos[loss(f)] + max(0, E_unl[loss(-f)] - prior * E_pos[loss(-f)])

with logistic loss. Where a minibatch drives the second part below zero, the
step follows its negative gradient instead, so the model cannot profit from
memorising positives. The prior is the toxic share of the labelled training rows.

Training rows are a bounded seeded sample (``positives`` and ``unlabelled``
documents, whole texts), reduced to hashed word ids by Spark before they reach
the driver. Learned only from rows outside the held-out fold; labels, lang,
source and doc_id are never inputs of a score. Every whole text is then scored
in Arrow batches with the weights of the screened words.

Defined results: a null or empty text has no words and gets the model's base
rate; without positives or unlabelled text every score is the prior (0 if there
is none); repeated label rows count once (toxic wins); repeated rows keep a row
each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.llm.common import bounded_rows, held_out, seeded_sample

POSITIVES, UNLABELLED, EPOCHS, BATCHES, RATE, DECAY, LEAST_Z, THRESHOLD, SEED = 3000, 9000, 60, 6, 0.05, 1e-5, 5.0, 0.3, 61
#: Lengths of the word beginnings that are features besides the words.
PREFIXES = (4, 5, 6)
#: ASCII punctuation and digits separate words.
_GAPS = bytes(32 if (c < 128 and not chr(c).isalpha()) else c for c in range(256))


class _Ids(dict):
    """word -> hashed ids of the word and of its beginnings, so that inflected and
    compound forms of a word share evidence. With ``only``, just the ids in it."""

    def __init__(self, only: dict | None = None):
        super().__init__()
        self.only = only

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) > 300_000:
            self.clear()
        text = word.decode("utf-8", "replace")
        parts = [b"=" + word, *(text[:n].encode() for n in PREFIXES if len(text) >= n)]
        hashed = {xxhash.xxh32_intdigest(x) >> 1 for x in parts}
        ids = self[word] = tuple(hashed if self.only is None else hashed & self.only.keys())
        return ids


def word_ids(text: str | bytes | None, ids: dict) -> np.ndarray:
    """Distinct hashed words and beginnings of a whole text, lower case."""
    if not text:
        return np.zeros(0, np.int32)
    words = set((text.encode() if isinstance(text, str) else text).lower().translate(_GAPS).split())
    out = set().union(*map(ids.__getitem__, words))
    return np.sort(np.fromiter(out, np.int32, len(out)))


def _reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids = _Ids()
    for batch in batches:
        out = [word_ids(t.as_py(), ids) for t in batch.column("text").cast(pa.large_binary())]
        yield pa.RecordBatch.from_arrays([batch.column("kind"), pa.array([x.tobytes() for x in out], pa.binary())], names=["kind", "ids"])


class _Rows:
    """Rows of word numbers as one flat array."""

    def __init__(self, rows: list[np.ndarray], dims: int):
        self.ids = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.n, self.dims = len(rows), dims

    def score(self, w: np.ndarray, bias: float) -> np.ndarray:
        return bias + np.bincount(self.row, w[self.ids], self.n)

    def back(self, g: np.ndarray) -> tuple[np.ndarray, float]:
        return np.bincount(self.ids, g[self.row], self.dims), float(g.sum())


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def once(rows: list[np.ndarray], seed: int) -> list[np.ndarray]:
    """``rows`` without near copies of earlier ones, so that a much-copied text
    counts once: four bands of three minima over the words; a band met before
    marks a copy (likely above a similarity of 0.7, very unlikely below 0.3)."""
    odd = np.random.default_rng([seed, 7]).integers(0, 2**31, 12, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    out, met = [], set()
    for r in rows:
        low = ((r.astype(np.uint32)[:, None] + np.uint32(1)) * odd).min(0) if len(r) else np.zeros(12, np.uint32)
        bands = [(i, *low[3 * i:3 * i + 3].tolist()) for i in range(4)]
        if not any(b in met for b in bands):
            out.append(r)
        met.update(bands)
    return out


def screen(positive: list[np.ndarray], unlabelled: list[np.ndarray]) -> np.ndarray:
    """Sorted ids of the words whose share of positive texts is above their share of
    unlabelled ones by LEAST_Z standard errors; the rest would add noise to long texts."""
    every, at = np.unique(np.concatenate(positive + unlabelled), return_inverse=True)
    cut = sum(map(len, positive))
    a, b = (np.bincount(x, minlength=len(every)) for x in (at[:cut], at[cut:]))
    n, m = len(positive), len(unlabelled)
    pooled = (a + b) / (n + m)
    error = np.sqrt(np.maximum(pooled * (1 - pooled), 1e-12) * (1 / n + 1 / m))
    return every[(a >= 3) & (a / n - b / m >= LEAST_Z * error)]


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, seed: int = SEED) -> tuple[dict[int, float], float]:
    """(weight by word id, bias) of least non-negative PU risk, by Adam over seeded minibatches."""
    bias = float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))
    if not positive or not unlabelled:
        return {}, bias
    rng = np.random.default_rng(seed)
    positive, unlabelled = once(positive, seed), once(unlabelled, seed)
    known = screen(positive, unlabelled)
    dims, w = len(known), np.zeros(len(known))
    positive, unlabelled = ([np.searchsorted(known, r[np.isin(r, known)]) for r in x] for x in (positive, unlabelled))
    m, v, mb, vb, step = np.zeros(dims), np.zeros(dims), 0.0, 0.0, 0
    for _ in range(EPOCHS):
        p_order, u_order = rng.permutation(len(positive)), rng.permutation(len(unlabelled))
        for p_part, u_part in zip(np.array_split(p_order, BATCHES), np.array_split(u_order, BATCHES)):
            if not len(p_part) or not len(u_part):
                continue
            pos, unl = _Rows([positive[i] for i in p_part], dims), _Rows([unlabelled[i] for i in u_part], dims)
            fp, fu = pos.score(w, bias), unl.score(w, bias)
            # d/df of loss(f) = log(1 + exp(-f)) is sigmoid(f) - 1; of loss(-f) it is sigmoid(f)
            negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
            gp, gu = prior * (_sigmoid(fp) - 1) / pos.n, _sigmoid(fu) / unl.n
            gn = -prior * _sigmoid(fp) / pos.n
            if negative >= 0:
                a, b = pos.back(gp + gn), unl.back(gu)
            else:
                a, b = pos.back(-gn), unl.back(-gu)
            g, gb = a[0] + b[0] + DECAY * w, a[1] + b[1]
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
            c1, c2 = 1 - 0.9**step, 1 - 0.999**step
            w -= RATE * (m / c1) / (np.sqrt(v / c2) + 1e-8)
            bias -= RATE * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    return dict(zip(known.tolist(), w.tolist())), bias


def learn(docs: DataFrame, labels: DataFrame, seed: int = SEED) -> tuple[dict[int, float], float]:
    open_ = docs.where(~held_out(F.col("doc_id")))
    marks = (labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    share = marks.agg(F.avg((F.col("toxic") >= 1).cast("double")).alias("p")).first().p or 0.0
    toxic = marks.where("toxic >= 1").select("doc_id")
    rows = open_.select("doc_id").join(toxic, "doc_id", "left_semi").select("doc_id", F.lit("p").alias("kind"))
    chosen = (seeded_sample(rows, "kind", POSITIVES, seed)
              .unionByName(seeded_sample(open_.select("doc_id", F.lit("u").alias("kind")), "kind", UNLABELLED, seed + 1)))
    texts = open_.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id", "kind"])
    got = bounded_rows(texts.select("kind", "text").mapInArrow(_reduced, "kind string, ids binary"), POSITIVES + UNLABELLED, "training rows")
    sets = {k: sorted((bytes(r.ids) for r in got if r.kind == k)) for k in "pu"}
    return train(*([np.frombuffer(x, np.int32) for x in sets[k]] for k in "pu"), prior=share, seed=seed)


def score(docs: DataFrame, labels: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text."""
    shipped = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, seed))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shipped.value
        ids = _Ids(weights)
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                found = (word_ids(t.as_py(), ids) for t in batch.column("text").cast(pa.large_binary()))
                s = _sigmoid(np.array([bias + sum(map(weights.__getitem__, f.tolist())) for f in found], np.float64))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s),
                                                  pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(
        run, f"doc_id {kind}, held_out boolean, score double, predicted int")
