"""Toxicity by a bidirectional gated recurrent network with attention pooling.

Each position of a window has a word vector and the mean vector of the word's
character n-grams (bytes of its letters with edge marks, hashed).  Two gated
recurrent layers read the window in both directions, attention pools their
states, and a logistic output scores it.  All overlapping windows of a text are
scored; a text's score is that of its worst window.

The network is trained in numpy on a bounded sample of labelled documents, as a
multiple-instance problem: in each round the windows that now score highest in
their documents carry the labels.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from screenspark.llm.batches import map_batches, return_memory, slices
from screenspark.llm.sampling import fitted, held_out, labelled_sample

WIDTH, STEP = 32, 16
#: Bound of the training sample: documents of a label.
SAMPLE_PER_LABEL = 1500
WORD_ROWS, GRAM_ROWS, DIM, HIDDEN = 1 << 15, 1 << 15, 8, 8
EDGES = " \t\r\n.,;:!?\"'()[]{}<>*_-"
CACHE_WORDS = 120_000


def word_lists(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Word codes of all texts in order, where each text's words stop, and the distinct words (lower case, no edge marks)."""
    texts = pc.utf8_lower(texts.cast(pa.large_string()).fill_null(""))
    lists = pc.split_pattern(pc.replace_substring(pc.replace_substring(texts, "\n", " "), "\t", " "), " ")
    raw = lists.flatten().dictionary_encode()
    words = pc.utf8_trim(raw.dictionary, EDGES).dictionary_encode()
    codes = words.indices.to_numpy(zero_copy_only=False)[raw.indices.to_numpy(zero_copy_only=False)] if len(raw) else np.zeros(0, np.int64)
    names = words.dictionary
    real = pc.not_equal(pc.binary_length(names), 0).to_numpy(zero_copy_only=False)[codes] if len(names) else np.zeros(0, bool)
    stops = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
    return codes[real].astype(np.int32), np.append(0, np.cumsum(real))[stops], names


def all_word_lists(texts: pa.Array, limit: int = 1_000_000) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """:func:`word_lists` of many texts, of about ``limit`` bytes at a time."""
    parts = [word_lists(b.column(0)) for b in slices(pa.RecordBatch.from_arrays([texts], ["text"]), "text", limit)]
    if len(parts) < 2:
        return parts[0] if parts else word_lists(texts)
    every = pa.concat_arrays([names for *_, names in parts]).dictionary_encode()
    place = every.indices.to_numpy()
    starts = np.cumsum([0, *(len(names) for *_, names in parts)])
    codes = np.concatenate([place[starts[i] + c] for i, (c, *_) in enumerate(parts)])
    ends = np.cumsum([0, *(len(c) for c, *_ in parts)])
    return codes, np.concatenate([stops + ends[i] for i, (_, stops, _) in enumerate(parts)]), every.dictionary


def features_of_words(words: pa.Array, chunk: int = 10_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`word_features` of many words, in chunks, as small numbers."""
    parts = []
    for a in range(0, max(1, len(words)), chunk):
        rows, gram, n = word_features(words.slice(a, chunk).to_pylist())
        parts.append((rows.astype(np.uint16), gram.astype(np.uint16), n.astype(np.int32)))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed row of each word; hashed rows of its character n-grams, flat, and how many each has."""
    raw = [w.encode() for w in words]
    rows = np.fromiter((zlib.crc32(w) for w in raw), np.int64, len(raw)) % WORD_ROWS
    flat = np.frombuffer(b"".join(b"\x02" + w + b"\x03" for w in raw), np.uint8).astype(np.int64)
    n = np.fromiter(map(len, raw), np.int64, len(raw)) + 2
    owner = np.repeat(np.arange(len(raw)), n)
    grams, owners = [], []
    for size, salt in ((3, 17), (4, 29), (5, 41)):
        if len(flat) < size:
            continue
        h = np.full(len(flat) - size + 1, salt, np.int64)
        for k in range(size):
            h = (h * 1_000_003 + flat[k : len(flat) - size + 1 + k]) & 0xFFFFFFFF
        h = (h ^ (h >> 15)) * 0x2C1B3C6D & 0xFFFFFFFF
        inside = owner[: len(h)] == owner[size - 1 :]
        grams.append((h[inside] ^ (h[inside] >> 13)) % GRAM_ROWS)
        owners.append(owner[: len(h)][inside])
    gram, own = np.concatenate(grams) if grams else np.zeros(0, np.int64), np.concatenate(owners) if owners else np.zeros(0, np.int64)
    order = np.argsort(own, kind="stable")
    return rows, gram[order], np.bincount(own, minlength=len(raw))


def window_index(stops: np.ndarray, width: int = WIDTH, step: int = STEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length of all windows over texts, and the text of each; a text without words has one empty window."""
    begins = np.append(0, stops[:-1])
    n = stops - begins
    count = np.maximum(1, -(-(n - (width - step)) // step))
    text = np.repeat(np.arange(len(n)), count)
    offset = (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * step
    return begins[text] + offset, np.clip(n[text] - offset, 0, width), text


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class GatedNet:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        self.p: dict[str, np.ndarray] = {"word": np.zeros((WORD_ROWS, DIM), np.float32), "gram": np.zeros((GRAM_ROWS, DIM), np.float32)}
        for side in "fb":
            self.p |= {f"in_{side}": draw(2 * DIM, 3 * HIDDEN, scale=0.4), f"rec_{side}": draw(HIDDEN, 3 * HIDDEN, scale=0.3), f"bias_{side}": np.zeros(3 * HIDDEN, np.float32)}
            self.p[f"bias_{side}"][:HIDDEN] = 1.0  # keep the state at first
        self.p |= {"att": draw(2 * HIDDEN, 2 * HIDDEN, scale=0.3), "att_bias": np.zeros(2 * HIDDEN, np.float32), "att_out": draw(2 * HIDDEN, scale=0.5), "out": draw(2 * HIDDEN, scale=0.5), "out_bias": np.zeros(1, np.float32)}

    def inputs(self, rows: np.ndarray, gram: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Word and character vectors of words."""
        total = np.zeros((len(rows), DIM), np.float32)
        first = np.cumsum(n) - n
        for a in range(0, len(rows), 10_000):  # the n-grams of so many words at once
            has = a + np.flatnonzero(n[a : a + 10_000])
            if len(has):
                begin, end = first[has[0]], first[has[-1]] + n[has[-1]]
                total[has] = np.add.reduceat(self.p["gram"][gram[begin:end]], first[has] - begin, axis=0) / n[has][:, None]
        return np.concatenate([self.p["word"][rows], total], axis=1)

    def table(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """What the inputs of words add to the gates of both layers; the last row is padding."""
        return {s: np.concatenate([x @ self.p[f"in_{s}"] + self.p[f"bias_{s}"], np.zeros((1, 3 * HIDDEN), np.float32)]).astype(np.float32) for s in "fb"}

    def forward(self, table: dict[str, np.ndarray], index: np.ndarray, keep: bool = False, pad: int | None = None):
        """Logits of windows; ``index`` (n x width) points into the table, whose row ``pad`` (default: the last) is padding."""
        n, width = index.shape
        h2, pad = HIDDEN, len(table["f"]) - 1 if pad is None else pad
        real = (index != pad).T[:, :, None]
        states = np.zeros((width, n, 2 * h2), np.float32)
        saved: dict = {"real": real, "steps": {}}
        for k, side in enumerate("fb"):
            rec, h = self.p[f"rec_{side}"], np.zeros((n, h2), np.float32)
            for t in range(width) if side == "f" else range(width - 1, -1, -1):
                x = table[side][index[:, t]]
                r = h @ rec
                zr = sigmoid(x[:, : 2 * h2] + r[:, : 2 * h2])
                z, g = zr[:, :h2], zr[:, h2:]
                c = np.tanh(x[:, 2 * h2 :] + g * r[:, 2 * h2 :])
                new = np.where(real[t], z * h + (1 - z) * c, h)
                if keep:
                    saved["steps"][side, t] = (h, z, g, c, r[:, 2 * h2 :])
                h = new
                states[t, :, k * h2 : (k + 1) * h2] = h
        u = np.tanh(states @ self.p["att"] + self.p["att_bias"])
        e = np.where(real[:, :, 0], u @ self.p["att_out"], -1e9)
        a = np.exp(e - e.max(axis=0))
        a = a * real[:, :, 0]
        a = a / np.maximum(a.sum(axis=0), 1e-9)
        pooled = np.einsum("tn,tnh->nh", a, states)
        logit = pooled @ self.p["out"] + self.p["out_bias"][0]
        if not keep:
            return logit
        return logit, saved | {"states": states, "u": u, "a": a, "pooled": pooled, "index": index}

    def backward(self, s: dict, d: np.ndarray) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
        """Gradients of the dense parameters, and of the gate inputs at each place (width x n x 3h)."""
        p, h2, width = self.p, HIDDEN, len(s["states"])
        g = {"out": s["pooled"].T @ d, "out_bias": np.array([d.sum()], np.float32)}
        dp = d[:, None] * p["out"]
        da = np.einsum("nh,tnh->tn", dp, s["states"])
        ds = s["a"][:, :, None] * dp[None]
        de = s["a"] * (da - (s["a"] * da).sum(axis=0))
        g["att_out"] = np.einsum("tn,tnh->h", de, s["u"])
        du = de[:, :, None] * p["att_out"] * (1 - s["u"] ** 2)
        g["att_bias"] = du.sum(axis=(0, 1))
        g["att"] = np.einsum("tni,tnj->ij", s["states"], du)
        ds = ds + du @ p["att"].T
        gates = {}
        for k, side in enumerate("fb"):
            rec = p[f"rec_{side}"]
            grec, dh = np.zeros_like(rec), np.zeros((len(d), h2), np.float32)
            gates[side] = np.zeros((width, len(d), 3 * h2), np.float32)
            for t in range(width - 1, -1, -1) if side == "f" else range(width):
                h, z, r, c, rc = s["steps"][side, t]
                dh = dh + ds[t, :, k * h2 : (k + 1) * h2]
                live = s["real"][t]
                dn = np.where(live, dh, 0)
                dc = dn * (1 - z) * (1 - c**2)
                dz = dn * (h - c) * z * (1 - z)
                dr = dc * rc * r * (1 - r)
                gx = np.concatenate([dz, dr, dc], axis=1)
                gr = np.concatenate([dz, dr, dc * r], axis=1)
                gates[side][t] = gx
                grec += h.T @ gr
                dh = np.where(live, dn * z, dh) + gr @ rec.T
            g[f"rec_{side}"] = grec
        return g, gates


def log_odds(pos: np.ndarray, neg: np.ndarray, share: float) -> np.ndarray:
    """Smoothed log odds of label 1 for features that ``pos`` and ``neg`` documents hold."""
    odds = np.log((pos + share) / (neg + (1 - share))) - np.log(share / (1 - share))
    return np.clip(odds * (pos + neg) / (pos + neg + 3), -4, 4)


def feature_odds(codes: np.ndarray, stops: np.ndarray, rows: np.ndarray, gram: np.ndarray, n: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of each hashed word and n-gram, counted once a document; one document at a time."""
    word, part = np.zeros((2, WORD_ROWS)), np.zeros((2, GRAM_ROWS))
    first = np.cumsum(n, dtype=np.int64) - n
    for k, (a, b) in enumerate(zip(np.append(0, stops[:-1]).tolist(), stops.tolist(), strict=True)):
        own = np.unique(codes[a:b])
        word[int(y[k]), np.unique(rows[own])] += 1
        reps = n[own].astype(np.int64)
        at = np.arange(int(reps.sum())) + np.repeat(first[own] - (np.cumsum(reps) - reps), reps)
        part[int(y[k]), np.unique(gram[at])] += 1
    share = float(y.mean())
    return log_odds(word[1], word[0], share), log_odds(part[1], part[0], share)


def train_net(texts: list[str], labels: np.ndarray, rounds: int = 3, epochs: int = 2, batch: int = 128, rate: float = 0.01, seed: int = 5) -> GatedNet:
    """A network for texts with labels 0 and 1, both present."""
    net, rng = GatedNet(seed), np.random.default_rng(seed + 1)
    codes, stops, words = all_word_lists(pa.array(texts, pa.string()))
    rows, gram, n = features_of_words(words)
    pad = len(words)
    del words
    return_memory()
    start, length, text = window_index(stops)
    y = labels.astype(np.float64)
    # First values: one coordinate of each vector is what the feature alone says.
    first = np.cumsum(n, dtype=np.int64) - n
    net.p["word"][:, 0], net.p["gram"][:, 0] = feature_odds(codes, stops, rows, gram, n, y)
    net.p["word"][:, 1:] = rng.normal(0, 0.05, (WORD_ROWS, DIM - 1))
    net.p["gram"][:, 1:] = rng.normal(0, 0.05, (GRAM_ROWS, DIM - 1))

    def index(w: np.ndarray) -> np.ndarray:
        place = np.arange(WIDTH)
        inside = place < length[w][:, None]
        return np.where(inside, codes[np.minimum(start[w][:, None] + place, len(codes) - 1)], pad) if len(codes) else np.full((len(w), WIDTH), pad)

    everything = np.arange(len(start))
    value = np.zeros(pad + 1, np.float32)
    for a in range(0, pad, 10_000):
        part = net.inputs(*some_words(np.arange(a, min(pad, a + 10_000)), rows, gram, n, first))
        value[a : a + len(part)] = part[:, 0] + part[:, DIM]
    score = np.concatenate([np.sort(value[index(everything[a : a + 8192])], axis=1)[:, -4:].sum(axis=1) for a in range(0, len(start), 8192)])
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v2 = {k: np.zeros_like(v) for k, v in net.p.items()}
    share = max(1e-3, float(y.mean()))
    step = 0
    for _ in range(rounds):
        order = np.lexsort((-score, text))
        place = np.arange(len(order)) - np.repeat(np.flatnonzero(np.append(True, np.diff(text[order]) != 0)), np.bincount(text, minlength=len(stops)))
        chosen = order[(place < 2) | ((place < 4) & (y[text[order]] == 0))]
        chosen = np.unique(np.append(chosen, rng.choice(everything[y[text] == 0], min(len(stops), int((y[text] == 0).sum())), replace=False)))
        # The second window of a positive text counts only if it looks positive itself.
        second = order[place == 1]
        chosen = chosen[~np.isin(chosen, second[(y[text[second]] == 1) & (score[second] < np.median(score[order[place == 0]]))])]
        target = y[text[chosen]].astype(np.float32)
        weight = np.where(target == 1, 0.5 / max(share, target.mean()), 0.5 / max(1e-3, 1 - target.mean())).astype(np.float32)
        for _ in range(epochs):
            mix = rng.permutation(len(chosen))
            for a in range(0, len(mix), batch):
                b = mix[a : a + batch]
                idx = index(chosen[b])
                used, local = np.unique(idx, return_inverse=True)
                used = used[used != pad]
                local = np.where(idx == pad, len(used), local.reshape(idx.shape))
                word, part, reps = some_words(used, rows, gram, n, first)
                x = net.inputs(word, part, reps)
                logit, saved = net.forward(net.table(x), local, keep=True)
                d = ((sigmoid(logit) - target[b]) * weight[b] / len(b)).astype(np.float32)
                g, gates = net.backward(saved, d)
                dx = np.zeros((len(used) + 1, 2 * DIM), np.float32)
                for side in "fb":
                    flat = gates[side].transpose(1, 0, 2).reshape(-1, 3 * HIDDEN)
                    at = local.ravel()
                    per = np.zeros((len(used) + 1, 3 * HIDDEN), np.float32)
                    np.add.at(per, at, flat)
                    per = per[:-1]
                    g[f"in_{side}"], g[f"bias_{side}"] = x.T @ per, per.sum(0)
                    dx[:-1] += per @ net.p[f"in_{side}"].T
                step += 1
                for k, gk in g.items():
                    m[k] = 0.9 * m[k] + 0.1 * gk
                    v2[k] = 0.99 * v2[k] + 0.01 * gk**2
                    net.p[k] = (net.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
                _sparse(net.p["word"], v2["word"], word, dx[:-1, :DIM], rate)
                each = np.repeat(dx[:-1, DIM:] / np.maximum(1, reps)[:, None], reps, axis=0)
                _sparse(net.p["gram"], v2["gram"], part, each, rate)
        score = []
        for a in range(0, len(start), 2048):  # with the table of the words of so many windows only
            idx = index(everything[a : a + 2048])
            used, local = np.unique(idx, return_inverse=True)
            used = used[used != pad]
            local = np.where(idx == pad, len(used), local.reshape(idx.shape))
            score.append(net.forward(net.table(net.inputs(*some_words(used, rows, gram, n, first))), local))
        score = np.concatenate(score)
    # The output is set so that the worst windows of texts, not single windows, meet the labels at 0.5.
    worst = np.full(len(stops), -np.inf)
    np.maximum.at(worst, text, score)
    cuts = np.unique(worst)
    cuts = (cuts[1:] + cuts[:-1]) / 2
    if len(cuts):
        cuts = cuts[:: max(1, len(cuts) // 2000)]
        wrong = [((worst > c) != (y == 1)).sum() for c in cuts]
        best = np.flatnonzero(wrong == np.min(wrong))
        net.p["out_bias"] = net.p["out_bias"] - np.float32(cuts[best[len(best) // 2]])
    return net


def some_words(used: np.ndarray, rows: np.ndarray, gram: np.ndarray, n: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The features of chosen words, as :func:`word_features` gives them."""
    reps = n[used].astype(np.int64)
    spot = np.arange(int(reps.sum())) + np.repeat(first[used] - (np.cumsum(reps) - reps), reps)
    return rows[used], gram[spot], reps


def _sparse(values: np.ndarray, squares: np.ndarray, rows: np.ndarray, grad: np.ndarray, rate: float) -> None:
    """An Adagrad step on some rows."""
    at, place = np.unique(rows, return_inverse=True)
    g = np.zeros((len(at), values.shape[1]), np.float32)
    np.add.at(g, place, grad)
    squares[at] += g**2
    values[at] -= rate * g / (np.sqrt(squares[at]) + 1e-6)


class Scorer:
    """Scores texts with a network; the gate inputs of distinct words are kept between batches."""

    def __init__(self, net: GatedNet):
        self.net = net
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        #: Row 0 is padding.
        self.tables = {s: np.zeros((1 << 12, 3 * HIDDEN), np.float32) for s in "fb"}

    def _places(self, words: list[str]) -> np.ndarray:
        new = [w for w in words if w not in self.index]
        if self.index and len(self.index) + len(new) > CACHE_WORDS:
            self._clear()
            new = words
        for at in range(0, len(new), 50_000):
            part = new[at : at + 50_000]
            made = self.net.table(self.net.inputs(*word_features(part)))
            base = len(self.index) + 1
            while base + len(part) > len(self.tables["f"]):
                self.tables = {s: np.concatenate([t, np.zeros_like(t)]) for s, t in self.tables.items()}
            for s in "fb":
                self.tables[s][base : base + len(part)] = made[s][:-1]
            self.index.update(zip(part, range(base, base + len(part)), strict=True))
        return np.fromiter(map(self.index.__getitem__, words), np.int32, len(words))

    def score(self, texts: pa.Array, block: int = 1024) -> np.ndarray:
        """Probability of label 1 of each text, from its worst window."""
        codes, stops, words = word_lists(texts)
        codes = self._places(words.to_pylist())[codes] if len(codes) else codes
        start, length, text = window_index(stops)
        worst = np.full(len(stops), -np.inf)
        place = np.arange(WIDTH)
        for a in range(0, len(start), block):
            s, n = start[a : a + block, None], length[a : a + block, None]
            idx = np.where(place < n, codes[np.minimum(s + place, len(codes) - 1)], 0) if len(codes) else np.zeros((len(s), WIDTH), np.int32)
            np.maximum.at(worst, text[a : a + block], self.net.forward(self.tables, idx, pad=0))
        return sigmoid(worst)


def train_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_label: int = SAMPLE_PER_LABEL, **training) -> GatedNet | None:
    """A network learned from whole texts of a bounded sample of labelled documents that are not held out.

    None if fewer than two labels are there.  The task that trains gets at most
    ``per_label`` documents of each label; where a doc_id stands for several texts, one
    of them is learned from, and where it has several labels, the greatest counts.
    """
    marks = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    ids = docs.filter(F.col("text").isNotNull()).select("doc_id").distinct()
    chosen = labelled_sample(marks.join(ids, "doc_id", "left_semi"), "label", per_label)  # 2 * per_label rows at most
    texts = docs.select("doc_id", docs["text"].cast("string").alias("text")).filter(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    one = texts.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def fit(rows: list[tuple[int, str, int]]) -> GatedNet | None:
        y = np.array([label for _, _, label in rows])
        return train_net([text for _, text, _ in rows], y, **training) if len(set(y.tolist())) == 2 else None

    return fitted(one.select("doc_id", "text", "label"), fit)


def score_toxicity(docs: DataFrame, net: GatedNet | None, out: tuple[str, str, str] = ("held_out", "tox_score", "tox_pred")) -> DataFrame:
    """All columns of ``docs`` with ``held_out``, ``tox_score`` (0 to 1) and ``tox_pred`` (score >= 0.5), or the names in ``out``, no shuffle.

    All overlapping windows of the whole text count.  A null or empty text has one
    empty window; without a network every score is 0.  Columns of ``docs`` with
    these names are replaced; repeated rows and null ids get a score each.
    """
    base = docs.drop(*out)
    if base.schema["text"].dataType != StringType():
        base = base.withColumn("text", F.col("text").cast("string"))
    schema = StructType([*base.schema, StructField(out[1], DoubleType())])

    names = base.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        scorer = Scorer(net) if net is not None else None
        for batch in batches:
            for part in slices(batch, "text", 1_000_000):
                score = scorer.score(part.column("text")).astype(np.float64) if scorer else np.zeros(part.num_rows)
                yield {c: part.column(c) for c in names} | {out[1]: score}

    return map_batches(base, run, schema).withColumn(out[0], held_out()).withColumn(out[2], (F.col(out[1]) >= 0.5).cast("int"))
