"""Toxicity: a subsequence string kernel, Nystroem landmarks and a linear SVM.

* A *unit* is a white-space token reduced to its lower-case letters, or a run of
  single-letter tokens put together (``i d i o t``).  Tokens such as ``id-iot``,
  ``i.d.i.o.t`` and ``idxiot`` keep most subsequences of the plain word, so the
  kernel still sees it.
* ``subsequence_kernel`` counts common subsequences of three letters, each
  weighted by ``DECAY`` to the length it spans in both strings; gaps cost, but do
  not hide a match.  Values are divided by the landmark's own value, so that a
  unit that contains the landmark scores 1 or little less.
* Landmarks are *groups*: letter runs of ``GROUP`` lengths, and whole units, each standing
  for all units that contain it, so that the suffix variants of a rare stem count together;
  documents with two variants or more are also counted by themselves.
  Taken are those whose documents are toxic more often than chance explains; how
  much that takes follows from the number of groups tried (``evidence``).  Every stem has
  a place for its surest group before any has a second one; near copies have none.
* A sentence is described by its best unit for each landmark, mapped by the
  inverse root of the landmarks' kernel matrix (Nystroem), and judged by a linear
  SVM that is trained on labelled sentences (each has its document's label).
* The score of a document is a logistic function, fitted on the labelled
  documents, of its highest sentence margin, the number of its sentences with a
  positive margin and their share.

Training rows: documents with a non-null label outside the held-out fold, at
most ``TRAIN_DOCS`` of each class, chosen by a hash of ``doc_id``; a document
with several labels counts as toxic if one of them says so.  ``labels``,
``lang``, ``source`` and ``doc_id`` are no inputs of a score.

Results for odd input: null and empty texts, and texts without letters, score as
a text without any sentence; repeated rows score alike; without labelled rows of
both classes every score is the share of toxic labels (0 without labels); other
columns are not read.  Texts are read whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantage.llm.text import held_out, small_batches
from vantage.session import cut_lineage

#: Labelled documents of each class that training reads at most.
TRAIN_DOCS = 2500
LANDMARKS = 96
#: Lengths of the letter runs that stand for the units that contain them.
GROUP = (4, 8)
#: Share of the groups taken for toxic that may be so by chance.
CHANCE = 0.1
#: Groups a worker counts before it hands its counts on.
COUNTED = 400_000
#: Units this alike (normalised kernel) are not both landmarks.
ALIKE = 0.75
#: Words are variants of one stem if one run holds this share of the shorter one's letters.
STEM = 0.75
#: Share of a landmark's letter pairs that a unit must have to be compared at all.
SHARED = 0.6
#: A unit whose best similarity is below this counts as having none.
FLOOR = 0.45
DECAY, ORDER = 0.6, 3
#: Letters of a unit that are compared at once; longer units are cut into overlapping windows.
WINDOW = 32
#: Units that a worker remembers; beyond it the memo starts anew.
MEMO = 300_000
#: Characters of texts whose new units are compared together.
PIECE_CHARS = 1 << 20
THRESHOLD = 0.3

_SPACED = re.compile(r"(?<!\S)[^\W\d_](?:\s+[^\W\d_](?!\S)){2,}")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def encode(strings: list[str], width: int) -> np.ndarray:
    """Code points of ``strings``, one row each, 0 behind the end."""
    raw = "".join(s.ljust(width, "\0") for s in strings).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(raw, np.int32).reshape(len(strings), width)


def subsequence_kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Gap-weighted common subsequences of ``ORDER`` letters of each pair (row of ``a``, row of ``b``).

    Dynamic program over the positions of both strings, for all pairs at once.
    ``prev[i, j]`` holds the weight of common subsequences, one letter shorter,
    of the first i and j letters, every letter behind their first one weighted in.
    """
    n, la, lb = len(a), a.shape[1], b.shape[1]
    lam = np.float32(DECAY)
    same = (a.T[:, None, :] == b.T[None, :, :]) & (a.T != 0)[:, None, :]
    prev = np.ones((la + 1, lb + 1, n), np.float32)
    for _ in range(ORDER - 1):
        new = np.zeros_like(prev)
        for i in range(1, la + 1):
            step = same[i - 1] * prev[i - 1, :lb] * (lam * lam)
            row = np.zeros(n, np.float32)
            for j in range(1, lb + 1):
                row = lam * row + step[j - 1]
                new[i, j] = lam * new[i - 1, j] + row
        prev = new
    return (same * prev[:la, :lb]).sum(axis=(0, 1)) * (lam * lam)


def kernel_matrix(strings: list[str]) -> np.ndarray:
    codes = encode(strings, max(map(len, strings)))
    m = len(strings)
    i, j = np.divmod(np.arange(m * m), m)
    return np.concatenate([subsequence_kernel(codes[i[k : k + 512]], codes[j[k : k + 512]])
                           for k in range(0, m * m, 512)]).reshape(m, m)


@dataclass
class Landmarks:
    """Similarity of units to landmarks: kernel over the landmark's own value, at most 1.

    It counts as 0 unless ``SHARED`` of the landmark's adjacent letter pairs stand in
    the unit with at most one letter between them, and below ``FLOOR``.  The
    first test needs one pass over the unit's letters for all landmarks together.
    """

    words: list[str]

    def __post_init__(self):
        self.codes = encode(self.words, max(map(len, self.words)))
        self.own = subsequence_kernel(self.codes, self.codes)
        letters = sorted({c for w in self.words for c in w})
        self.letter = {ord(c): i + 1 for i, c in enumerate(letters)}
        self.base = len(letters) + 1
        self.low = np.zeros(max(self.letter) + 1, np.int64)
        for c, i in self.letter.items():
            self.low[c] = i
        pairs = [{self._pair(x, y) for x, y in zip(w, w[1:])} for w in self.words]
        index = {p: i for i, p in enumerate(sorted(set().union(*pairs)))}
        self.column = np.full(self.base * self.base, len(index), np.int64)
        for p, i in index.items():
            self.column[p] = i
        self.need = np.zeros((len(index) + 1, len(self.words)), np.float32)
        for k, ps in enumerate(pairs):
            self.need[[index[p] for p in ps], k] = 1 / len(ps)
        self.memo: dict[str, np.ndarray | None] = {}

    def _pair(self, x: str, y: str) -> int:
        return self.letter[ord(x)] * self.base + self.letter[ord(y)]

    def _near(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, landmark) of the units that share enough letter pairs with a landmark."""
        c = self.low[np.minimum(codes, len(self.low) - 1)]
        c[codes >= len(self.low)] = 0
        has = np.zeros((len(c), len(self.need)), np.float32)
        rows = np.arange(len(c))[:, None]
        for gap in (1, 2):
            has[rows, self.column[c[:, :-gap] * self.base + c[:, gap:]]] = 1
        return np.nonzero(has @ self.need >= SHARED - 1e-6)

    def similar(self, units: list[str]) -> np.ndarray:
        """Similarity of every unit (at least ``ORDER`` letters) to every landmark."""
        out = np.zeros((len(units), len(self.words)), np.float32)
        step = WINDOW // 2
        parts = [(len(u[a : a + WINDOW]), i, u[a : a + WINDOW]) for i, u in enumerate(units)
                 for a in range(0, max(1, len(u) - WINDOW + step), step)]
        parts.sort()
        for a in range(0, len(parts), 4096):
            some = parts[a : a + 4096]
            codes = encode([s for _, _, s in some], some[-1][0])
            where = np.array([i for _, i, _ in some])
            row, mark = self._near(codes)
            for b in range(0, len(row), 512):
                r, m = row[b : b + 512], mark[b : b + 512]
                width = some[r[-1]][0]
                value = subsequence_kernel(codes[r, :width], self.codes[m]) / self.own[m]
                np.maximum.at(out, (where[r], m), np.minimum(value, 1))
        return out

    def learn(self, tokens: set[str]) -> None:
        """Remember the similarities of new tokens; None if they come near no landmark."""
        unit = {t: t if t.isalpha() else _NOT_LETTERS.sub("", t) for t in tokens}
        units = sorted({u for u in unit.values() if len(u) >= ORDER})
        rows = self.similar(units)
        at = {units[i]: i for i in np.flatnonzero(rows.max(axis=1, initial=0) >= FLOOR)}
        self.memo.update({t: rows[at[u]] if u in at else None for t, u in unit.items()})

    def sentences(self, texts: list[str], count_all: bool = True) -> list[tuple[np.ndarray, int]]:
        """For each text, the best similarities of every sentence that comes near a
        landmark, and the number of all its sentences (unless ``count_all``, 0 where none comes near)."""
        lows = [joined(t) for t in texts]
        tokens = [set(low.split()) for low in lows]
        if len(self.memo) > MEMO:
            self.memo.clear()
        if new := set().union(*tokens).difference(self.memo):
            self.learn(new)
        none, out, memo = np.zeros((0, len(self.words)), np.float32), [], self.memo
        for low, ts in zip(lows, tokens, strict=True):
            near = {t for t in ts if memo[t] is not None}
            if not near and not count_all:
                out.append((none, 0))
                continue
            parts = [s for s in _SENTENCE.split(low) if s and not s.isspace()]
            found = [np.max([memo[t] for t in hit], axis=0) for s in parts if (hit := near.intersection(s.split()))]
            out.append((np.array(found, np.float32) if found else none, len(parts)))
        return out

    def batch(self, texts: Iterable[str], count_all: bool = True) -> Iterator[tuple[np.ndarray, int]]:
        """``sentences`` over pieces of a batch with about ``PIECE_CHARS`` characters each."""
        piece, size = [], 0
        for text in texts:
            piece.append(text or "")
            size += len(piece[-1])
            if size > PIECE_CHARS:
                yield from self.sentences(piece, count_all)
                piece, size = [], 0
        if piece:
            yield from self.sentences(piece, count_all)


def joined(text: str | None) -> str:
    """Lower case, with runs of three or more single-letter tokens put together."""
    low = (text or "").lower()
    return _SPACED.sub(lambda m: "".join(m[0].split()), low) if _SPACED.search(low) else low


def units_of(text: str | None) -> set[str]:
    low = joined(text)
    return {u for u in (_NOT_LETTERS.sub("", t) for t in set(low.split())) if ORDER <= len(u) <= WINDOW}


def groups_of(text: str | None) -> set[str]:
    """The units of ``text`` and their letter runs of ``GROUP`` lengths; once more, with a
    ``+`` behind, if two units or more have them."""
    seen: set[str] = set()
    again: set[str] = set()
    for u in units_of(text):
        runs = {u[i : i + k] for k in range(GROUP[0], GROUP[1] + 1) for i in range(len(u) - k + 1)}
        runs.add(u)
        again |= runs & seen
        seen |= runs
    return seen.union(u + "+" for u in again)


@dataclass
class Model:
    words: list[str]
    root: np.ndarray  # Nystroem map, landmarks x landmarks
    weights: np.ndarray  # of the SVM; the last is the bias
    scale: np.ndarray  # of the logistic function; the last is the bias
    prior: float  # the score if there was nothing to train on

    def __post_init__(self):
        self.marks = Landmarks(self.words) if self.words else None

    def scores(self, texts: Iterable[str]) -> list[float]:
        if not self.marks:
            return [self.prior for _ in texts]
        bias, out = self.weights[-1], []
        for rows, n in self.marks.batch(texts, count_all=False):
            x = summarise(rows @ self.root @ self.weights[:-1] + bias if len(rows) else rows[:, 0], bias, n)
            out.append(float(1 / (1 + np.exp(-(x @ self.scale[:-1] + self.scale[-1])))))
        return out


def summarise(margins: np.ndarray, bias: float, n: int) -> np.ndarray:
    """What a document's score is made of."""
    positive = int((margins > 0).sum())
    best = float(max(margins.max(initial=bias), bias))
    return np.array([best, np.log1p(positive), positive / max(n, 1)])


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 400, ridge: float = 1e-3) -> np.ndarray:
    """Linear SVM with squared hinge loss by accelerated gradient steps; y is -1 or 1, the last column of x is 1."""
    weight = weight / weight.sum()
    w = v = np.zeros(x.shape[1])
    moments = np.zeros((x.shape[1], x.shape[1]))
    for a in range(0, len(x), 1 << 13):  # no second copy of x
        part = x[a : a + (1 << 13)]
        moments += (part * weight[a : a + (1 << 13), None]).T @ part
    step = 1 / (2 * np.linalg.eigvalsh(moments)[-1] + ridge)
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ v))
        new = v - step * (ridge * np.r_[v[:-1], 0] - 2 * (weight * y * slack) @ x)
        v = new + k / (k + 3) * (new - w)
        w = new
    return w


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton steps; y is 0 or 1, the last weight is the bias."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, x.T @ (p - y) + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


def variants(a: str, b: str) -> bool:
    """Whether one run of letters holds ``STEM`` of the shorter word and stands in both."""
    a, b = sorted((a, b), key=len)
    k = math.ceil(STEM * len(a))
    return any(a[i : i + k] in b for i in range(len(a) - k + 1))


def choose_landmarks(words: Iterable[str]) -> list[str]:
    """Up to ``LANDMARKS`` of ``words`` (best first), none a near copy or part of an earlier
    one: one of each stem, then further variants while there are places."""
    chosen: list[str] = []

    def take(w: str) -> None:
        codes = encode([w, *chosen], max(map(len, [w, *chosen])))
        own = np.sqrt(subsequence_kernel(codes, codes))
        alike = subsequence_kernel(codes[1:], np.repeat(codes[:1], len(chosen), 0)) / own[1:] / own[0] if chosen else own[1:]
        if alike.max(initial=0) < ALIKE:
            chosen.append(w)

    more: list[str] = []
    for w in words:
        if any(variants(w, c) for c in chosen):
            more.append(w)
        elif len(chosen) < LANDMARKS:
            take(w)
    for w in more:
        if len(chosen) < LANDMARKS and not any(w in c for c in chosen):
            take(w)
    return chosen


def evidence(tried: dict[tuple[int, int], int], share: float) -> float:
    """The least log likelihood ratio that marks a group as toxic; infinite if none does.

    ``tried``: number of groups by (documents, toxic documents).  exp(-ratio / 2) bounds
    the chance of such a count; of the groups at or above the limit at most ``CHANCE`` are
    expected by chance (Benjamini and Hochberg), where groups of too few documents to
    reach the limit at all are no trials (Tarone).
    """
    n, bad, times = np.array([(*k, v) for k, v in tried.items()], float).reshape(-1, 3).T
    good = n - bad
    with np.errstate(divide="ignore", invalid="ignore"):
        part = [np.where(x > 0, x * np.log(x / (n * p)), 0) for x, p in ((bad, share), (good, 1 - share))]
    z = np.where(bad > n * share, 2 * (part[0] + part[1]), 0)
    reach = -2 * n * np.log(share)
    for limit in np.unique(z[z > 0]):
        if np.exp(-limit / 2) * times[reach >= limit - 1e-9].sum() <= CHANCE * times[z >= limit].sum():
            return float(limit)
    return math.inf


def training_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """toxic, text of at most ``TRAIN_DOCS`` labelled documents of each class, outside the held-out fold."""
    known = (labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    order = F.xxhash64("doc_id")
    parts = [known.filter(F.col("toxic") == t).orderBy(order, "doc_id").limit(TRAIN_DOCS) for t in (0, 1)]
    sample = parts[0].unionByName(parts[1])  # a proven bound: 2 x TRAIN_DOCS small rows
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("toxic", "text")


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on the bounded sample: unit statistics and sentence features are made by
    Spark; the driver receives candidate units and the features of matching sentences."""
    small_batches(docs.sparkSession)
    sample = training_sample(docs, labels)

    def groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, bad = Counter(), Counter()

        def counted() -> Iterator[pd.DataFrame]:
            names = list(n)
            for i in range(0, len(names), 1 << 16):
                some = names[i : i + (1 << 16)]
                yield pd.DataFrame({"unit": pd.Series(some, dtype=object), "n": [n[u] for u in some], "bad": [bad[u] for u in some]})

        for pdf in batches:
            for t, x in zip(pdf.toxic, pdf.text, strict=True):
                found = groups_of(x)
                n.update(found)
                if t:
                    bad.update(found)
                if len(n) > COUNTED:
                    yield from counted()
                    n.clear()
                    bad.clear()
        yield from counted()

    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    known = label_counts(labels)
    prior = known.get(1, 0) / max(sum(known.values()), 1)
    constant = Model([], np.zeros((0, 0)), np.zeros(1), np.zeros(1), prior)
    if len(n) < 2:
        return constant
    # likelihood ratio of the group's documents against the share of toxic ones
    a, b, p = F.col("bad"), F.col("n") - F.col("bad"), n[1] / (n[0] + n[1])
    part = lambda x, share: F.when(x > 0, x * F.log(x / (F.col("n") * share))).otherwise(0.0)
    z = F.when(a > F.col("n") * p, 2 * (part(a, p) + part(b, 1 - p))).otherwise(0.0)
    found = cut_lineage(sample.mapInPandas(groups, "unit string, n long, bad long").groupBy("unit")
                        .agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).filter("n > 1"))
    tried = {(r["n"], r["bad"]): r["times"] for r in found.groupBy("n", "bad").agg(F.count("*").alias("times")).collect()}
    limit = evidence(tried, p)
    if limit == math.inf:
        return constant
    best = found.withColumn("z", z).filter(F.col("z") >= limit - 1e-9).orderBy(F.desc(F.round("z", 6)), F.desc(F.length("unit")), "unit")
    words = choose_landmarks(r["unit"].rstrip("+") for r in best.select("unit").toLocalIterator())

    def sentences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        marks = Landmarks(words)
        for pdf in batches:
            found = list(marks.batch(pdf.text))
            yield pd.DataFrame({"toxic": pdf.toxic, "n": [k for _, k in found],
                                "rows": [r.astype("<f4").tobytes() for r, _ in found]})

    got = sample.mapInPandas(sentences, "toxic int, n long, rows binary").collect()
    m = len(words)
    feats = [np.frombuffer(r["rows"], "<f4").reshape(-1, m) for r in got]
    label = np.array([r["toxic"] for r in got])
    rest = np.array([max(r["n"] - len(f), 0) for r, f in zip(got, feats, strict=True)])

    k = kernel_matrix(words).astype(float)
    own = np.sqrt(np.diag(k))
    value, vector = np.linalg.eigh(k / own / own[:, None])
    root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-3))) @ vector.T

    # sentences without any near unit are all alike: one row of each class with their number
    edge = np.cumsum([0, *map(len, feats)])
    x = np.zeros((edge[-1] + 2, m + 1))
    x[:, -1] = 1
    for a, b, f in zip(edge, edge[1:], feats, strict=False):
        x[a:b, :-1] = f @ root
    y = np.r_[np.repeat(label, [len(f) for f in feats]), 0, 1] * 2 - 1
    weight = np.r_[np.ones(len(x) - 2), rest[label == 0].sum(), rest[label == 1].sum()].astype(float)
    for side in (-1, 1):
        weight[y == side] /= max(weight[y == side].sum(), 1)
    w = _svm(x, y, weight)
    docs_x = np.array([summarise(f @ root @ w[:-1] + w[-1], w[-1], r["n"]) for f, r in zip(feats, got, strict=True)])
    return Model(words, root, w, reweighted(_logistic(docs_x, label), sample_share=n, n=known), prior)


def label_counts(labels: DataFrame) -> dict[int, int]:
    """Number of all labelled rows outside the held-out fold, by label."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}


def reweighted(scale: np.ndarray, sample_share: dict[int, int], n: dict[int, int]) -> np.ndarray:
    """Move the bias from the sample's class shares to those of all labelled rows ``n``."""
    if n.get(0) and n.get(1):
        scale[-1] += np.log(n[1] / n[0]) - np.log(sample_share[1] / sample_share[0])
    return scale


def scorer(spark: SparkSession, model: Model):
    """The model as a column function of the text; it travels in the function itself (some kB)."""
    small_batches(spark)
    spec = (model.words, model.root, model.weights, model.scale, model.prior)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = Model(*spec)
        for batch in texts:
            yield pd.Series(m.scores(batch), dtype="float64")

    return score


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= ``threshold``) of every row."""
    score = scorer(docs.sparkSession, train(docs, labels))
    return (docs.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
                        score(F.coalesce(F.col("text"), F.lit(""))).alias("score"))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that score below ``threshold``."""
    score = scorer(docs.sparkSession, train(docs, labels))
    return docs.filter(score(F.coalesce(docs["text"], F.lit(""))) < threshold)
