"""Language ID by a byte convolutional network.

Bytes are embedded; filters of several widths run over fixed-length windows, the
maximum of each over the window goes to a softmax.  The network is trained in
numpy by Adam on all windows of a bounded sample of labelled documents.  A document is
scored over all its windows: the class probabilities are averaged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from screenspark.llm.batches import map_batches, slices
from screenspark.llm.sampling import fitted, held_out, labelled_sample

WINDOW = 256
#: Bound of the training sample: documents of a language, and of all languages.
SAMPLE_PER_LANG = 400
SAMPLE_TOTAL = 12_000
LETTER = r"\p{L}"


def windows_of(data: bytes, width: int, overlap: int) -> np.ndarray:
    """All windows of ``width`` bytes over ``data``, zero-padded, each overlapping the last one."""
    step = width - overlap
    n = max(1, -(-(len(data) - overlap) // step))
    out = np.zeros(n * step + overlap, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.as_strided(out, (n, width), (step, 1))


@dataclass
class ByteCNN:
    classes: list[str]
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 16
    dim: int = 8
    seed: int = 11
    params: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self):
        rng = np.random.default_rng(self.seed)
        span, out = max(self.widths), len(self.widths) * self.filters
        #: A filter of a smaller width is one of the largest width whose last taps stay zero.
        self.taps = np.zeros((span * self.dim, out), np.float32)
        for i, w in enumerate(self.widths):
            self.taps[: w * self.dim, i * self.filters : (i + 1) * self.filters] = 1
        if not self.params:
            draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
            self.params = {
                "embed": draw(256, self.dim, scale=0.5), "conv": draw(span * self.dim, out, scale=0.3) * self.taps, "bias": np.zeros(out, np.float32),
                "out": draw(out, len(self.classes), scale=0.2), "out_bias": np.zeros(len(self.classes), np.float32),
            }

    def _pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p, span = self.params, max(self.widths)
        e = p["embed"][x]
        n, length, dim = e.shape
        places = length - span + 1
        cols = np.lib.stride_tricks.as_strided(e, (n, places, span * dim), (e.strides[0], e.strides[1], e.strides[2])).reshape(n * places, -1)
        act = (cols @ p["conv"]).reshape(n, places, -1)
        at = act.argmax(axis=1) if self.training else None
        top = np.maximum(act.max(axis=1) + p["bias"], 0)
        return top, at, cols.reshape(n, places, -1)

    training = False

    def probabilities(self, x: np.ndarray, block: int = 128) -> np.ndarray:
        """Class probabilities of windows (n x width bytes)."""
        p, out = self.params, []
        for at in range(0, len(x), block):
            z = self._pooled(x[at : at + block])[0] @ p["out"] + p["out_bias"]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            out.append(z / z.sum(axis=1, keepdims=True))
        return np.concatenate(out)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 5, batch: int = 64, rate: float = 0.01) -> "ByteCNN":
        p, rng = self.params, np.random.default_rng(self.seed + 1)
        m = {k: np.zeros_like(v) for k, v in p.items()}
        v2 = {k: np.zeros_like(v) for k, v in p.items()}
        weight = (len(y) / (len(self.classes) * np.maximum(1, np.bincount(y, minlength=len(self.classes)))))[y].astype(np.float32)
        step, span = 0, max(self.widths)
        self.training = True
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for s in range(0, len(x), batch):
                i = order[s : s + batch]
                top, at, cols = self._pooled(x[i])
                z = top @ p["out"] + p["out_bias"]
                z = np.exp(z - z.max(axis=1, keepdims=True))
                d = z / z.sum(axis=1, keepdims=True)
                d[np.arange(len(i)), y[i]] -= 1
                d *= weight[i][:, None] / len(i)
                g = {"out": top.T @ d, "out_bias": d.sum(0)}
                back = (d @ p["out"].T) * (top > 0)
                g["bias"] = back.sum(0)
                rows = cols[np.arange(len(i))[:, None], at]  # window x filter x taps: where each maximum was
                g["conv"] = np.einsum("nft,nf->tf", rows, back) * self.taps
                g["embed"] = np.zeros_like(p["embed"])
                into = (back[:, :, None] * p["conv"].T[None]).reshape(len(i), -1, span, self.dim)
                np.add.at(g["embed"], x[i][np.arange(len(i))[:, None, None], at[:, :, None] + np.arange(span)], into)
                step += 1
                for k in p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v2[k] = 0.999 * v2[k] + 0.001 * g[k] ** 2
                    p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        self.training = False
        return self


def train_language_model(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG, total: int = SAMPLE_TOTAL, epochs: int = 5) -> ByteCNN | None:
    """A network learned from whole texts of a bounded sample of labelled documents that are not held out; None without labels.

    Every language is learned: the task that trains gets at most ``per_lang`` documents
    of each and ``total`` in all (one of each, if there are more languages than that).
    """
    labelled = docs.select("doc_id", docs["text"].cast("string").alias("text"), docs["lang"].cast("string").alias("lang")).filter(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(LETTER))

    def fit(rows: list[tuple[str, str]]) -> ByteCNN | None:
        if not rows:
            return None
        classes = sorted({lang for lang, _ in rows})
        x = [windows_of(text.encode(), WINDOW, 3) for _, text in rows]
        y = np.repeat([classes.index(lang) for lang, _ in rows], [len(a) for a in x])
        return ByteCNN(classes).fit(np.concatenate(x), y, epochs=epochs)

    return fitted(labelled_sample(labelled, "lang", per_lang, total).select("lang", "text"), fit)


def predict_language(docs: DataFrame, model: ByteCNN | None, out: tuple[str, str, str] = ("held_out", "lang_pred", "lang_score")) -> DataFrame:
    """All columns of ``docs`` with ``held_out``, ``lang_pred`` and ``lang_score`` (or the names in ``out``), no shuffle.

    The score is the mean probability of the predicted language over all windows
    of the whole text.  A null text, or one without a letter, is ``und`` with score
    0; so is every text if no model could be trained.  Ties go to the first
    language by name; columns of ``docs`` with these names are replaced.
    """
    base = docs.drop(*out)
    if base.schema["text"].dataType != StringType():
        base = base.withColumn("text", F.col("text").cast("string"))
    names = base.columns
    schema = StructType([*base.schema, StructField(out[1], StringType()), StructField(out[2], DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for part in slices(batch, "text", 1_000_000):
                texts = part.column("text")
                letters = pc.match_substring_regex(texts, LETTER).fill_null(False).to_numpy(zero_copy_only=False)
                pred, score = np.full(len(texts), "und", object), np.zeros(len(texts))
                rows = np.flatnonzero(letters) if model is not None else []
                if len(rows):
                    each = [windows_of(texts[int(i)].as_py().encode(), WINDOW, 3) for i in rows]
                    prob = model.probabilities(np.concatenate(each))
                    n = np.array([len(w) for w in each])
                    mean = np.add.reduceat(prob.astype(np.float64), np.cumsum(n) - n, axis=0) / n[:, None]
                    best = mean.argmax(axis=1)
                    pred[rows], score[rows] = np.array(model.classes, object)[best], np.minimum(1.0, mean[np.arange(len(best)), best])
                yield {c: part.column(c) for c in names} | {out[1]: pred, out[2]: score}

    return map_batches(base, run, schema).withColumn(out[0], held_out())

