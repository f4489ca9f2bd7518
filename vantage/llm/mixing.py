"""Mixing to target weights with soft membership.

1. A softmax classifier, trained on documents of the labelled table, gives each
   document posteriors over the domains.  A domain is a pair of labels,
   ``clean`` or ``toxic`` and ``low`` or ``high`` quality; a document belongs to
   every domain with its posterior.
2. Each document gets a rate of 0 or more, the expected number of its copies.
   The rates minimise the squared difference, in tokens of each domain, between
   what they are expected to give and the targets, starting from one copy each.
3. Projected gradient, distributed: a step needs the expected tokens of the
   domains only, one aggregate over (tokens, posteriors) with as many sums as there
   are domains.  The step that a document takes is a function of its posteriors
   and of these sums, ``rate = max(0, rate - step . posteriors)``, evaluated in the
   plan; rates are written every ``KEPT_STEPS`` steps.  Step lengths are spectral
   (from the last step's change of the gaps), or the safe one where the gap has grown.
4. Whole copies are the rate's floor, and one more with the probability of its
   fraction, drawn by a hash of doc_id.

Tokens are words (see ``text``).  Training reads at most ``TRAIN_DOCS`` documents
of each domain, chosen by a hash of ``doc_id``; everything else covers all rows.

Results for odd input: null and empty texts have no tokens and the posteriors of
the labelled shares; a document that is labelled twice counts as toxic, or of high
quality, if one label says so; rows with a null label are not learned from; domains
without labelled documents are left out, and the targets of the others scaled
up; without any labelled document all rates are 1; repeated rows get equal rates; an
empty table gives no rows; other columns are not read, but carried along by ``mixed``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantage.llm.language_id import largest
from vantage.llm.text import lowered, small_batches, words
from vantage.session import cut_lineage, written

TRAIN_DOCS = 600
#: Hash bits of a feature, and bytes hashed at once.
BITS, PIECE = 11, 1 << 18
WIDTH = 1 << BITS
#: Share of the tokens that each domain shall have.
TARGETS = {"clean_high": 0.85, "clean_low": 0.1, "toxic_high": 0.04, "toxic_low": 0.01}
#: Projected gradient ends when no domain's share is off by more, or moves by less, than this.
CLOSE, ROUNDS = 1e-6, 48
#: Steps that a rate is unfolded over before it is written.
KEPT_STEPS = 8


def features(text: str | None) -> tuple[int, np.ndarray]:
    """(words, damped counts of hashed words and of hashed byte pairs, each of length 1)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    _, _, h = words(lowered(text))
    out = np.zeros((2, WIDTH), np.float32)
    out[0] = np.bincount((h >> np.uint64(64 - BITS)).astype(np.int64), minlength=WIDTH)
    for s in range(0, len(raw), PIECE):
        a = np.frombuffer(raw[s : s + PIECE + 1], np.uint8).astype(np.uint32)
        pair = (a[:-1] * np.uint32(256) + a[1:]) * np.uint32(2654435761)
        out[1] += np.bincount(pair >> np.uint32(32 - BITS), minlength=WIDTH)
    out = np.sqrt(out)
    out /= np.maximum(np.sqrt((out**2).sum(axis=1, keepdims=True)), 1e-9)
    return len(h), out.ravel()


def domain_of(quality: Column, toxic: Column) -> Column:
    return F.concat(F.when(toxic > 0, "toxic_").otherwise("clean_"), F.when(quality > 0, "high").otherwise("low"))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _fit(x: np.ndarray, label: np.ndarray, k: int, prior: np.ndarray, rounds: int = 200, ridge: float = 2e-5) -> np.ndarray:
    """Softmax regression by accelerated gradient steps, each class weighted as in ``prior``."""
    x = np.c_[x, np.ones(len(x), np.float32)].astype(np.float32, copy=False)
    weight = (prior / np.bincount(label, minlength=k))[label].astype(np.float32)
    goal = np.eye(k, dtype=np.float32)[label]
    w = v = np.zeros((x.shape[1], k), np.float32)
    step = np.float32(1 / (0.5 * 1.1 * largest(x, weight) + ridge))
    for i in range(rounds):
        pull = (_softmax(x @ v) - goal) * weight[:, None]
        new = v - step * (x.T @ pull + ridge * v)
        v = new + np.float32(i / (i + 3)) * (new - w)
        w = new
    return w


def train(docs: DataFrame, labels: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(domains, shares of the labelled documents, weights) from the bounded sample."""
    small_batches(docs.sparkSession)
    known = (labels.filter("doc_id is not null and quality is not null and toxic is not null")
             .groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
             .select("doc_id", domain_of(F.col("quality"), F.col("toxic")).alias("domain")))
    n = {r["domain"]: r["n"] for r in known.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    sample = None
    for d in sorted(n):
        part = known.filter(F.col("domain") == d).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS)
        sample = part if sample is None else sample.unionByName(part)
    if sample is None:
        return [], np.zeros(0), np.zeros((0, 0))

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, features(t)[1].tobytes()) for d, t in zip(pdf.domain, pdf.text, strict=True) if t]
            yield pd.DataFrame(rows, columns=["domain", "x"])

    # TRAIN_DOCS rows of each of four domains; of rows that share a doc_id the smallest text
    rows = (docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "domain").agg(F.min("text").alias("text"))
            .select("domain", "text").mapInPandas(vectors, "domain string, x binary").collect())
    domains = sorted({r["domain"] for r in rows})
    if not domains:
        return [], np.zeros(0), np.zeros((0, 0))
    prior = np.array([n[d] for d in domains], float)
    prior /= prior.sum()
    x = np.array([np.frombuffer(r["x"], np.float32) for r in rows])
    label = np.array([domains.index(r["domain"]) for r in rows])
    del rows  # as large as x
    return domains, prior, _fit(x, label, len(domains), prior)


def memberships(docs: DataFrame, domains: list[str], prior: np.ndarray, weights: np.ndarray, keep: list[str]) -> DataFrame:
    """doc_id, ``keep``, n_tokens and one posterior column for each domain, for every row."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(weights)  # n-gram features x domains numbers
    k = len(domains)

    @F.pandas_udf("n long, p array<double>")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        w = sent.value
        for texts in batches:
            n, p = np.zeros(len(texts), np.int64), np.tile(prior, (len(texts), 1))
            for i, t in enumerate(texts):
                n[i], f = features(t)
                if n[i] and k > 1:
                    p[i] = _softmax((f @ w[:-1] + w[-1])[None, :])[0]
            yield pd.DataFrame({"n": n, "p": list(p)})

    out = docs.select("doc_id", *keep, judge(F.coalesce(F.col("text"), F.lit(""))).alias("j"))
    return out.select("doc_id", *keep, F.col("j.n").alias("n_tokens"),
                      *[F.get("j.p", F.lit(i)).alias(f"p_{d}") for i, d in enumerate(domains)])


def moved(now: Column, steps: list[np.ndarray], domains: list[str]) -> Column:
    """The rate ``now`` after projected ``steps``.

    The steps are one literal that a fold runs over: the expression, and the code that the driver makes of it, is as
    long for any number of steps and the same in every round."""
    if not steps:
        return now

    def one(rate: Column, step: Column) -> Column:
        for i, d in enumerate(domains):
            rate = rate - step[i] * F.col(f"p_{d}")
        return F.greatest(F.lit(0.0), rate)

    return F.aggregate(F.lit([[float(x) for x in s] for s in steps]), now, one)


def fit_steps(members: DataFrame, domains: list[str], targets: dict[str, float]) -> tuple[DataFrame, np.ndarray, list[np.ndarray]]:
    """(``members`` with a column ``rate``, shares of the original tokens reached by each domain, the steps taken)."""
    steps: list[np.ndarray] = []
    out = members.withColumn("rate", F.lit(1.0))
    k = len(domains)
    goal = np.array([targets.get(d, 0.0) for d in domains])
    n, p = F.col("n_tokens").cast("double"), [F.col(f"p_{d}") for d in domains]
    total = members.agg(F.sum(n).alias("n")).first()["n"] if k and goal.sum() > 0 else None
    if not total:
        return out, np.zeros(k), steps
    goal = goal / goal.sum()
    row = members.agg(*[F.sum(n * p[i] * p[j]).alias(f"m_{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    second = np.array([[row[f"m_{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) / total
    safe = 1 / np.linalg.eigvalsh(second)[-1]
    length, before, kept, best = safe, None, 0, np.inf
    for turn in range(ROUNDS):
        # the rate is a column before it is summed: one fold a row
        got = (out.withColumn("rate", moved(F.col("rate"), steps[kept:], domains))
               .agg(*[F.sum(n * x * F.col("rate")).alias(f"t_{i}") for i, x in enumerate(p)]).first())
        share = np.array([got[f"t_{i}"] for i in range(k)]) / total
        gap = share - goal
        if before is not None:
            change = gap - before
            if np.abs(gap).max() < CLOSE or np.abs(change).max() < CLOSE / 100:
                break
            # spectral step: how far the last step moved the rates against how far it moved the gaps
            length = safe if gap @ gap > 2 * best else max(safe, float(length**2 * (before @ second @ before) / (change @ change)))
        best = min(best, float(gap @ gap))
        before = gap
        steps.append(np.round(length * gap, 12))
        if len(steps) == kept + KEPT_STEPS:
            out, kept = cut_lineage(out.withColumn("rate", moved(F.col("rate"), steps[kept:], domains))), len(steps)
    return out.withColumn("rate", moved(F.col("rate"), steps[kept:], domains)), share, steps


def fit_rates(members: DataFrame, domains: list[str], targets: dict[str, float]) -> tuple[DataFrame, np.ndarray]:
    """(``members`` with a column ``rate``, shares of the original tokens reached by each domain)."""
    return fit_steps(members, domains, targets)[:2]


def likeliest(domains: list[str]) -> Column:
    """The domain of the largest posterior, the first one on ties."""
    posts = [F.col(f"p_{d}") for d in domains]
    if not posts:
        return F.lit(None).cast("string")
    best = F.greatest(*posts) if len(posts) > 1 else posts[0]
    return F.coalesce(*[F.when(p == best, F.lit(d)) for d, p in zip(domains, posts, strict=True)])


def drawn_copies(rate: Column) -> Column:
    """The rate's floor, and one more where the draw, a hash of doc_id, is below its fraction."""
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / F.lit(1 << 20)
    return (F.floor(rate) + (drawn < rate - F.floor(rate)).cast("long")).cast("long")


def _free(name: str, taken: list[str]) -> str:
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def mixture(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``keep``, n_tokens, domain (the likeliest), posterior columns, rate, copies of every row; a kept
    column with the name of an added one gets a ``_`` behind."""
    domains, prior, weights = train(docs, labels)
    rows = docs.select("doc_id", "text", F.struct(F.lit(0).alias("row"), *keep).alias("kept"))
    members = cut_lineage(memberships(rows, domains, prior, weights, ["kept"]))
    out, _ = fit_rates(members, domains, targets or TARGETS)
    out = out.withColumn("domain", likeliest(domains)).withColumn("copies", drawn_copies(F.col("rate")))
    own = [c for c in out.columns if c != "kept"]
    return out.select("doc_id", *[F.col("kept")[c].alias(_free(c, own)) for c in keep], *own[1:])


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """The mixture itself: each row of ``docs``, all columns, as often as its copies say (not at all for 0),
    with ``copy_no`` from 1 and ``mix`` (n_tokens, domain, rate, copies); an added name that ``docs`` has gets a ``_`` behind.

    Rows and posteriors are written once; the steps read the narrow columns only, and the
    steps found are applied to the rows in one last pass."""
    domains, prior, weights = train(docs, labels)
    rows = docs.select("doc_id", "text", F.struct("*").alias("doc"))
    members = written(memberships(rows, domains, prior, weights, ["doc"]))
    _, _, steps = fit_steps(cut_lineage(members.drop("doc")), domains, targets or TARGETS)
    done = members.withColumn("rate", moved(F.lit(1.0), steps, domains)).withColumn("copies", drawn_copies(F.col("rate"))).filter("copies > 0")
    mix = F.struct("n_tokens", likeliest(domains).alias("domain"), "rate", "copies")
    copy_no, mix_name = _free("copy_no", docs.columns), _free("mix", docs.columns)
    return (done.select("doc", mix.alias("m"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("c"))
            .select(*[F.col("doc")[c].alias(c) for c in docs.columns], F.col("c").alias(copy_no), F.col("m").alias(mix_name)))
