"""Language ID by a byte convolutional network.

Texts are cut into windows of ``window`` bytes, all of them, so the whole text
counts.  A window's bytes are embedded, filters of several widths slide over
them, each filter's maximum over the window is kept, and a softmax layer gives
the languages' probabilities; a text's prediction is the mean of its windows'
log probabilities, weighted by their bytes.  One more class stands for noise, made
from the training windows by rule; it is left out of the score and tells whether
a text is in any language at all.

The network is trained on the driver in numpy, on at most ``per_language`` rows
of each language (those with the smallest digest of id and text: a bounded
sample, the same on every run) and ``train_windows`` windows of each, spread over
the whole text by a hash of their number.  Its weights are a
few thousand numbers and go out with the tasks.  Inference works on batches of
at most ``BATCH`` windows whatever the texts' lengths.

Defined cases: a text that is null or has no letter is ``und`` with score 0 and noise 1; so
is everything if no row can be learned from; equal rows are judged alike, and
learned from once; ties go to the first language by name; an empty table gives an
empty result; extra columns are carried along, whatever their names
(``lang_pred``, ``score`` and ``noise`` are replaced).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.llm.common import carried, own_names
from evigraph.llm.wordhash import mix64, trim

WINDOW = 192
BATCH = 48
EMBED = 8
FILTERS = {2: 8, 3: 12, 4: 12}
#: Rows of all languages together that are learned from, at most.
MAX_PICKED = 100_000
PREDICTED = "struct<lang_pred: string, score: double, noise: double>"
_LETTER = regex.compile(r"\p{L}")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def to_learn(doc_id: Column) -> Column:
    """Rows to learn from: not those held out, nor those without an id, of which that can't be told."""
    return ~held_out(doc_id) & doc_id.isNotNull()


class ByteCNN:
    """Embedding -> filters of several widths -> ReLU -> max over the window -> softmax."""

    def __init__(self, langs: list[str], seed: int = 3):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.emb = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.conv = {w: rng.normal(0, 1 / np.sqrt(w * EMBED), (w * EMBED, n)).astype(np.float32) for w, n in FILTERS.items()}
        self.bias = {w: np.zeros(n, np.float32) for w, n in FILTERS.items()}
        total = sum(FILTERS.values())
        self.out = rng.normal(0, 0.1, (total, len(langs) + 1)).astype(np.float32)  # the last class is noise
        self.out_bias = np.zeros(len(langs) + 1, np.float32)
        self._padded: np.ndarray | None = None

    def params(self) -> list[np.ndarray]:
        return [self.emb, *self.conv.values(), *self.bias.values(), self.out, self.out_bias]

    def features(self, x: np.ndarray, where: bool = False):
        """x: (n, window) bytes -> (n, filters); with ``where`` also what training needs."""
        e = self.emb[x]
        n, length, _ = e.shape
        feats, memo = [], []
        flat = e.reshape(n, length * EMBED)
        for w, kernel in self.conv.items():
            s = flat.strides
            patches = np.lib.stride_tricks.as_strided(flat, (n, length - w + 1, w * EMBED), (s[0], EMBED * s[1], s[1]))
            r = (patches.reshape(-1, w * EMBED) @ kernel).reshape(n, length - w + 1, -1)
            if where:
                at = r.argmax(axis=1)
                memo.append((w, at))
                top = np.take_along_axis(r, at[:, None, :], 1)[:, 0]
            else:
                top = r.max(axis=1)
            feats.append(np.maximum(top + self.bias[w], 0))
        h = np.concatenate(feats, axis=1)
        return (h, e, memo) if where else h

    def fast_features(self, x: np.ndarray) -> np.ndarray:
        """As ``features``: one product with all filters, padded to one width; the last places are then only seen by those that fit."""
        widest = max(FILTERS)
        if self._padded is None:
            self._padded = np.concatenate([np.vstack([k, np.zeros(((widest - w) * EMBED, k.shape[1]), np.float32)]) for w, k in self.conv.items()], axis=1)
        n, length = x.shape
        e = np.zeros((n, length + widest - 1, EMBED), np.float32)
        np.take(self.emb, x, axis=0, out=e[:, :length])
        flat = e.reshape(n, -1)
        s = flat.strides
        patches = np.lib.stride_tricks.as_strided(flat, (n, length, widest * EMBED), (s[0], EMBED * s[1], s[1]))
        r = (patches.reshape(-1, widest * EMBED) @ self._padded).reshape(n, length, -1)
        tops, first = [], 0
        for w, k in FILTERS.items():
            tops.append(r[:, : length - w + 1, first : first + k].max(axis=1) + self.bias[w])
            first += k
        return np.maximum(np.concatenate(tops, axis=1), 0)

    def log_probs(self, x: np.ndarray) -> np.ndarray:
        z = self.fast_features(x) @ self.out + self.out_bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def grads(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        h, e, memo = self.features(x, where=True)
        n = len(x)
        z = h @ self.out + self.out_bias
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(n), y] -= 1
        p /= n
        d_out, d_ob = h.T @ p, p.sum(0)
        dh = (p @ self.out.T) * (h > 0)
        d_emb = np.zeros_like(self.emb)
        d_conv, d_bias, first = [], [], 0
        for w, at in memo:
            k = at.shape[1]
            g = dh[:, first : first + k]
            first += k
            rows = np.arange(n)[:, None, None]
            place = at[:, :, None] + np.arange(w)
            patch = e[rows, place].reshape(n, k, w * EMBED)
            d_conv.append(np.einsum("nkd,nk->dk", patch, g))
            d_bias.append(g.sum(0))
            back = (g[:, :, None] * self.conv[w].T[None]).reshape(n, k, w, EMBED)
            np.add.at(d_emb, x[rows, place].ravel(), back.reshape(-1, EMBED))
        return [d_emb, *d_conv, *d_bias, d_out, d_ob]

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.004, seed: int = 4) -> ByteCNN:
        """Adam on shuffled batches."""
        rng = np.random.default_rng(seed)
        m = [np.zeros_like(p) for p in self.params()]
        v = [np.zeros_like(p) for p in self.params()]
        t = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                pick = order[i : i + batch]
                t += 1
                for j, (p, g) in enumerate(zip(self.params(), self.grads(x[pick], y[pick]), strict=True)):
                    m[j] = 0.9 * m[j] + 0.1 * g
                    v[j] = 0.999 * v[j] + 0.001 * g * g
                    p -= (rate * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self


def windows(data: bytes, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a text, the last one padded with spaces, and their bytes."""
    n = max(1, -(-len(data) // window))
    x = np.full(n * window, 32, np.uint8)
    x[: len(data)] = np.frombuffer(data, np.uint8)
    size = np.full(n, window)
    size[-1] = max(1, len(data) - (n - 1) * window)
    return x.reshape(n, window), size


def spread(text: str, count: int, seed: int) -> list[bytes]:
    """Up to so many windows of a text, in an order that their numbers' hashes give, without those that hold no letter."""
    x, size = windows(text.encode("utf-8", "replace"))
    least, out = min(WINDOW // 3, size.max()), []
    for i in np.argsort(mix64(np.arange(len(x), dtype=np.uint64) + np.uint64(seed)), kind="stable").tolist():
        if size[i] >= least and _LETTER.search(x[i].tobytes().decode("utf-8", "ignore")):
            out.append(x[i].tobytes())
            if len(out) == count:
                break
    return out


def train(labelled: DataFrame, per_language: int = 300, train_windows: int = 4, text: str = "text", lang: str = "lang", key: str = "doc_id") -> ByteCNN | None:
    """Fits the network on a bounded sample of the rows given; None if there is none."""
    digest = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.md5(F.col(text))))
    rows = labelled.where(F.col(lang).isNotNull() & F.rlike(F.col(text), F.lit(r"\p{L}"))).select(F.col(lang).alias("lang"), F.col(text).alias("text"), digest.alias("digest"))
    # rows are picked by digest alone, first inside slices of a language, so that no language comes together; then their texts are fetched
    picked = rows.select("lang", "digest").distinct()
    sliced, first = (Window.partitionBy("lang", *more).orderBy("digest") for more in ([F.substring("digest", -2, 2)], []))
    for window, most in ((sliced, -(-per_language // 16)), (first, per_language)):
        picked = picked.withColumn("n", F.row_number().over(window)).where(F.col("n") <= most).drop("n")
    wanted = picked.limit(MAX_PICKED + 1).collect()
    if len(wanted) > MAX_PICKED:
        raise ValueError("too many languages to learn")
    picked = labelled.sparkSession.createDataFrame(wanted, picked.schema)

    @F.pandas_udf("array<binary>")
    def some(texts: pd.Series, digests: pd.Series) -> pd.Series:
        return pd.Series([spread(t, train_windows, int(d[:15], 16)) for t, d in zip(texts, digests, strict=True)])

    chosen = rows.join(F.broadcast(picked), ["lang", "digest"]).dropDuplicates(["lang", "digest"])
    got = sorted((r["lang"], r["digest"], r["x"]) for r in chosen.select("lang", "digest", some("text", "digest").alias("x")).collect())  # bounded
    langs = sorted({lang_ for lang_, _, x in got if x})
    if not langs:
        return None
    xs = [np.frombuffer(w, np.uint8) for _, _, x in got for w in x]
    ys = [langs.index(lang_) for lang_, _, x in got for _ in x]
    x, y = np.stack(xs), np.array(ys)
    unread = noise(x[:: len(langs)])
    return ByteCNN(langs).fit(np.concatenate([x, unread]), np.concatenate([y, np.full(len(unread), len(langs))]))


def noise(x: np.ndarray, seed: int = 6) -> np.ndarray:
    """Windows in no language: the same bytes in another order, or letters drawn at random."""
    rng = np.random.default_rng(seed)
    mixed = rng.permuted(x[::2], axis=1)
    letters = rng.choice(np.frombuffer(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJ 0123456789", np.uint8), x[1::2].shape)
    return np.concatenate([mixed, letters])


def predict(docs: DataFrame, model: ByteCNN | None, text: str = "text") -> DataFrame:
    """Adds lang_pred, score (its probability among the languages) and noise (the probability that the text is in none)."""
    kept = carried(docs, "lang_pred", "score", "noise")
    if model is None:
        return docs.select(*kept, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(1.0).alias("noise"))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame(predict_texts(model, list(texts)), columns=["lang_pred", "score", "noise"])
        trim()

    guess = F.pandas_udf(run, PREDICTED)
    own = own_names(docs, "guess")[0]
    return docs.withColumn(own, guess(F.col(text))).select(*kept, f"{own}.lang_pred", f"{own}.score", f"{own}.noise")


def predict_texts(model: ByteCNN, texts: list[str | None]) -> list[tuple[str, float, float]]:
    sums = np.zeros((len(texts), len(model.langs) + 1))
    sizes = np.zeros(len(texts))
    xs: list[np.ndarray] = []
    owners: list[np.ndarray] = []
    weights: list[np.ndarray] = []
    waiting = 0

    def flush() -> None:
        nonlocal waiting
        if not xs:
            return
        x, who, weight = np.concatenate(xs), np.concatenate(owners), np.concatenate(weights)
        for i in range(0, len(x), BATCH):
            p = model.log_probs(x[i : i + BATCH]) * weight[i : i + BATCH, None]
            np.add.at(sums, who[i : i + BATCH], p)
        xs.clear(), owners.clear(), weights.clear()
        waiting = 0

    for i, text in enumerate(texts):
        if text is None or not _LETTER.search(text):
            continue
        x, size = windows(text.encode("utf-8", "replace"))
        xs.append(x), owners.append(np.full(len(x), i)), weights.append(size)
        sizes[i] = size.sum()
        waiting += len(x)
        if waiting >= BATCH:
            flush()
    flush()
    out = []
    for total, n in zip(sums, sizes, strict=True):
        if n == 0:
            out.append(("und", 0.0, 1.0))
            continue
        p = np.exp(total / n - (total / n).max())
        p, none = p[:-1], float(p[-1] / p.sum())
        p /= max(p.sum(), np.finfo(float).tiny)
        best = int(p.argmax())
        out.append((model.langs[best], float(min(1.0, p[best])), none))
    return out
