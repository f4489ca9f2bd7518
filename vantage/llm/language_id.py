"""Language identification by error-correcting output codes.

* Features are counts of hashed letter n-grams (``ORDERS`` letters), letters
  lower-cased, everything else one blank; counts are damped and scaled to length 1.
* Each language has a codeword of bits; each bit is one binary logistic classifier,
  trained to tell the languages with a 1 from those with a 0.  The splits are random
  balanced ones, ten times as many as are needed to tell the languages apart.
* Decoding: for each language, the losses of all bits against its codeword are
  added, each weighted by how well its classifier did in training; the codeword of
  least loss is chosen.  The score is that codeword's share (soft-min over losses),
  and a document whose two nearest codewords are close is flagged as ambiguous.

Training reads at most ``TRAIN_DOCS`` documents of each language, fewer (``FEWEST_DOCS`` at least)
where all languages together would pass ``SAMPLE_DOCS``, none of the held-out fold, chosen by a hash;
every language that has a label is learned.
``lang``, ``source`` and ``doc_id`` are no inputs of a prediction.

Results for odd input: null texts and texts without letters are ``und`` with score
0; without any labelled row every text is ``und``; with one language all are that
one; null and empty languages are not learned from; repeated rows count once in training and
are predicted alike; of languages of equal loss the first by name is taken; other columns are not read.  Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vantage.llm.text import held_out, small_batches

#: Sample: documents of a language at most and at least, and of all languages (which the driver holds as vectors).
TRAIN_DOCS, FEWEST_DOCS, SAMPLE_DOCS = 400, 20, 16_000
ORDERS, WIDTH = (1, 2, 3), 1 << 12
#: Difference of shares of the two nearest codewords below which a text is ambiguous.
CLOSE = 0.3
#: Letters hashed at once.
PIECE = 1 << 18

_U = np.uint64


def _letters(text: str) -> np.ndarray:
    """Code points of the lower-cased letters; each run of anything else is one 0."""
    low = text.lower()
    a = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    ascii_letter = (a >= 97) & (a <= 122)
    letter = ascii_letter.copy()
    other = np.flatnonzero(a > 127)
    if len(other):
        values, inverse = np.unique(a[other], return_inverse=True)
        letter[other] = np.array([chr(v).isalpha() for v in values])[inverse]
    a = np.where(letter, a, 0)
    keep = (a > 0) | np.concatenate([[True], a[:-1] > 0])
    return a[keep].astype(_U)


def features(text: str | None) -> np.ndarray | None:
    """Damped n-gram counts of length 1, or None if the text has no letter."""
    if not text:
        return None
    a = _letters(text)
    if not a.any():
        return None
    a = np.concatenate([np.zeros(1, _U), a, np.zeros(1, _U)])
    out = np.zeros(WIDTH)
    top = max(ORDERS)
    for s in range(0, len(a), PIECE):
        part = a[s : s + PIECE + top - 1]
        for n in ORDERS:
            m = min(PIECE, len(part) - n + 1)
            if m <= 0:
                continue
            h = np.full(m, n, _U)
            for i in range(n):
                h = h * _U(0x9E3779B97F4A7C15) + part[i : i + m]
            h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
            out += np.bincount((h >> _U(52)).astype(np.int64), minlength=WIDTH)
    out = np.sqrt(out)
    return (out / np.sqrt((out**2).sum())).astype(np.float32)


def codewords(n: int) -> np.ndarray:
    """Codewords (languages x bits, of -1 and 1), all different, no bit constant."""
    rng = np.random.default_rng(n)
    bits = int(np.ceil(10 * np.log2(n)))  # random balanced splits
    while True:
        code = np.array([rng.permutation(np.where(np.arange(n) % 2, 1, -1)) for _ in range(bits)]).T
        if len(np.unique(code, axis=0)) == n:
            return code


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # features and a bias x bits
    trust: np.ndarray  # of each bit

    def predict(self, texts: Iterable[str | None]) -> list[tuple[str, float, bool]]:
        found = [features(t) for t in texts]
        with_letters = [i for i, f in enumerate(found) if f is not None]
        out: list[tuple[str, float, bool]] = [("und", 0.0, False)] * len(found)
        if not self.languages or not with_letters:
            return out
        for a in range(0, len(with_letters), 256):
            rows = with_letters[a : a + 256]
            margin = np.array([found[i] for i in rows]) @ self.weights[:-1] + self.weights[-1]
            loss = np.array([np.logaddexp(0, -margin * c) @ self.trust for c in self.code]).T
            share = np.exp(loss.min(axis=1, keepdims=True) - loss)
            share /= share.sum(axis=1, keepdims=True)
            for i, p in zip(rows, share, strict=True):
                best = int(p.argmax())
                second = np.partition(p, -2)[-2] if len(p) > 1 else 0.0
                out[i] = (self.languages[best], float(p[best]), bool(p[best] - second < CLOSE))
        return out


def largest(x: np.ndarray, weight: np.ndarray, rounds: int = 30) -> float:
    """Largest eigenvalue of the weighted second moments of the rows of ``x``, by power iteration."""
    v = np.ones(x.shape[1], np.float32) / np.sqrt(x.shape[1])
    size = 1.0
    for _ in range(rounds):
        v = x.T @ (weight * (x @ v))
        size = float(np.linalg.norm(v))
        v = v / size
    return size


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 300, ridge: float = 1e-4) -> np.ndarray:
    """Logistic regression of every bit (columns of ``y``, -1 or 1) by accelerated gradient steps."""
    x = np.c_[x, np.ones(len(x), np.float32)].astype(np.float32)
    w = v = np.zeros((x.shape[1], y.shape[1]), np.float32)
    step = np.float32(1 / (0.25 * 1.1 * largest(x, weight) + ridge))
    for k in range(rounds):
        pull = -y / (1 + np.exp(np.clip(y * (x @ v), -30, 30))) * weight[:, None]
        new = v - step * (x.T @ pull + ridge * v)
        v = new + np.float32(k / (k + 3)) * (new - w)
        w = new
    return w


def train(docs: DataFrame) -> Model:
    """Fit on the bounded sample; the driver receives its feature vectors, not its texts."""
    small_batches(docs.sparkSession)
    known = docs.filter(F.col("lang").isNotNull() & (F.col("lang") != "") & F.col("text").isNotNull()
                        & ~F.coalesce(held_out(F.col("doc_id")), F.lit(False))).select("lang", "text", "doc_id")
    counts = known.groupBy("lang").agg(F.count("*").alias("n"))
    n = counts.count()
    if not n:
        return Model([], np.zeros((0, 0)), np.zeros((1, 0)), np.zeros(0))
    each = max(FEWEST_DOCS, min(TRAIN_DOCS, SAMPLE_DOCS // n))
    # a share of each language by hash, with some to spare, then an exact bound; rows that are equal count once
    range_ = 1 << 30
    share = F.least(F.lit(1.0), F.lit(1.5 * each) / F.col("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id"))
    some = (known.withColumn("place", F.pmod(F.xxhash64("text", "doc_id"), F.lit(range_)))
            .join(F.broadcast(counts.select("lang", (share * range_).cast("long").alias("below"))), "lang")  # as many rows as the model has languages
            .filter(F.col("place") < F.col("below")).groupBy("lang", "doc_id", "place").agg(F.min("text").alias("text"))
            .withColumn("rank", rank).filter(F.col("rank") <= each))

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(lang, f.tobytes()) for lang, t in zip(pdf.lang, pdf.text, strict=True) if (f := features(t)) is not None]
            yield pd.DataFrame(rows, columns=["lang", "x"])

    rows = some.select("lang", "text").mapInPandas(vectors, "lang string, x binary").collect()  # at most n * each vectors
    languages = sorted({r["lang"] for r in rows})
    if not languages:
        return Model([], np.zeros((0, 0)), np.zeros((1, 0)), np.zeros(0))
    if len(languages) == 1:
        return Model(languages, np.ones((1, 1)), np.zeros((WIDTH + 1, 1)), np.ones(1))
    x = np.array([np.frombuffer(r["x"], np.float32) for r in rows])
    label = np.array([languages.index(r["lang"]) for r in rows])
    code = codewords(len(languages))
    share = 1 / np.bincount(label)[label] / len(languages)
    y = code[label].astype(np.float32)
    w = _fit(x, y, share.astype(np.float32))
    right = ((x @ w[:-1] + w[-1]) * y > 0).T @ share
    right = np.clip(right, 0.5, 1 - 1e-3)
    trust = np.log(right / (1 - right))
    trust = trust / trust.sum() * len(trust) if trust.sum() > 0 else np.ones(len(right))
    return Model(languages, code, w, trust)


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous of every row."""
    model = train(docs)
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # WIDTH x bits numbers

    @F.pandas_udf("lang string, score double, ambiguous boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for texts in batches:
            yield pd.DataFrame(m.predict(texts), columns=["lang", "score", "ambiguous"])

    return (docs.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
                        predict(F.coalesce(F.col("text"), F.lit(""))).alias("p"))
            .select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), "p.score", "p.ambiguous"))
