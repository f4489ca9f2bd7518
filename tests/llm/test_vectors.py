"""Whitening, vector codes and nearest neighbours against brute force, and on odd input."""

import hashlib
import math

import numpy as np
import pytest

from vantage.llm import neighbours, vector_codes, whitening

SF = "/root/testdata/sf0.01"
INF, NAN = float("inf"), float("nan")
CLASH = "vec_id long, embedding array<float>, label int, v long, x string, p int, cell int, row int, qid long, cid long, salt int, codes string, n long"


@pytest.fixture(scope="module")
def embeddings(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet")


def rows_of(frame):
    return [(r.vec_id, r.embedding, r.label) for r in frame.select("vec_id", "embedding", "label").collect()]


def usable(rows):
    return [r for r in rows if r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])]


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, labels, vectors and entries, zero and repeated vectors, ties, unequal lengths, clashing columns."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.integers(-40, 40, 16) / 64], i % 3) for i in range(300)]
    rows += [(300, rows[200][1], 1), (200, rows[200][1], None), (400, rows[200][1], None), (None, rows[5][1], None), (None, rows[7][1], 2)]
    rows += [(1000, None, 1), (1001, [NAN] * 16, 1), (1002, [0.5, None] * 8, 2), (1003, [INF] + [0.1] * 15, 0), (1004, [0.0] * 16, 1)]
    rows += [(1100, [0.25] * 5, 0), (1200, [], 0), (1300, [-0.0] * 16, None)]
    return spark.createDataFrame([(*r, 1, "x", 2, 3, 4, 5, 6, 7, "c", 8) for r in rows], CLASH)


def integers(rows, multiple=1):
    dim = -(-max(len(r[1]) for r in rows) // multiple) * multiple
    return [[math.floor(256 * c) for c in r[1]] + [0] * (dim - len(r[1])) for r in rows]


def check_whitening(frame):
    rows = usable(rows_of(frame))
    x = integers(rows)
    fit = np.unique(np.array(x), axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    got = whitening.whiten(frame).collect()
    k = min(4, len(e))
    assert len(got) == k * len(rows)
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.deviation), {})[r.component] = r
    signs = {}
    for (vec_id, _, _), xs in zip(rows, x):
        dev = sum((n * a - int(s)) ** 2 for a, s in zip(xs, sums))
        found = by[vec_id, dev]
        assert sorted(found) == list(range(1, k + 1))
        for c, r in found.items():
            assert r.n == n and r.deviation_exact == dev and r.identity_error < 1e-9
            assert abs(r.explained - e[c - 1] / np.trace(v)) < 1e-9
            want = (np.array(xs) - sums / n) @ u[:, c - 1] / np.sqrt(e[c - 1])
            if abs(want) > 1e-3:
                sign = signs.setdefault(c, np.sign(want) * np.sign(r.whitened))
                assert abs(r.whitened - sign * want) < 1e-8


def test_whitening_equals_eigh(embeddings, odd):
    check_whitening(embeddings)
    check_whitening(odd)


def test_whitening_of_few_and_flat_vectors(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    flat = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in flat] == [(1, 0, None, 0.0, 0.0)] * 4
    line = whitening.whiten(spark.createDataFrame([(1, [1.0, 5.0, 0.0]), (2, [3.0, 5.0, 0.0])], schema)).collect()
    first = [r for r in line if r.component == 1]
    assert sorted(round(r.whitened, 12) for r in first) == [-1.0, 1.0] and first[0].explained == 1.0
    assert all(r.whitened is None and r.identity_error < 1e-12 for r in line if r.component > 1 or r.identity_error)
    far = whitening.whiten(spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [0.0, 3.0])], schema)).collect()
    assert len(far) == 6 and all(r.deviation is None for r in far if r.vec_id != 3)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 40])
def test_divide_and_conquer(n):
    rng = np.random.default_rng(n)
    q, _ = np.linalg.qr(rng.standard_normal((n, n)))
    for values in (rng.random(n), np.repeat([3.0, 1.0], n)[:n], 10.0 ** -np.arange(n), np.zeros(n)):
        a = (q * values) @ q.T
        e, u = whitening.eigen((a + a.T) / 2)
        scale = max(1e-300, abs(values).max())
        assert np.abs(np.sort(e) - np.sort(values)).max() < 1e-13 * n * scale
        assert np.abs(u.T @ u - np.eye(n)).max() < 1e-13 * n and np.abs(a @ u - u * e).max() < 1e-13 * n * scale


def brute_codes(rows, parts=16, entries=64, rounds=2):
    rows = sorted(zip(rows, integers(rows, parts)), key=lambda r: (r[0][0] is None, r[0][0] or 0, r[1]))
    w = len(rows[0][1]) // parts
    cut = [[x[j * w : (j + 1) * w] for j in range(parts)] for _, x in rows]
    books = [[c[j] for c in cut[:entries]] for j in range(parts)]

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        new = []
        for j in range(parts):
            held = {}
            for c in cut:
                held.setdefault(near(c[j], books[j])[1], []).append(c[j])
            new.append([[sum(z) // len(held[i]) for z in zip(*held[i])] if i in held else e for i, e in enumerate(books[j])])
        books = new
    digest = hashlib.sha256(",".join(str(z) for b in books for e in b for z in e).encode()).hexdigest()
    out, label = [], {}
    for (r, _), c in zip(rows, cut):
        found = [near(c[j], books[j]) for j in range(parts)]
        out.append((r[0], "".join(f"{i:02x}" for _, i in found), sum(d for d, _ in found), r[2]))
        label[r[2]] = label.get(r[2], 0) + out[-1][2]
    return sorted((repr(o[0]), o[1], o[2], label[o[3]], digest) for o in out)


def test_vector_codes_equal_brute_force(embeddings, odd, spark):
    few = spark.createDataFrame([(3, [1.0] * 20, 1), (1, [0.5] * 20, None), (2, [1.0] * 20, 1)], "vec_id long, embedding array<double>, label int")
    for frame in (odd, few, embeddings.filter("vec_id < 150")):
        got = sorted((repr(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in vector_codes.code_table(frame).collect())
        assert got == brute_codes(usable(rows_of(frame)))


def test_vector_codes_of_none_and_of_huge(spark):
    schema = "vec_id long, embedding array<double>, label int"
    assert vector_codes.code_table(spark.createDataFrame([], schema)).count() == 0
    got = vector_codes.code_table(spark.createDataFrame([(i, [1e300 * (-1) ** i, 1.0 * i] * 16, 0) for i in range(80)], schema)).collect()
    assert len(got) == 80


@pytest.mark.parametrize("width", [1, 2, 3, 5, 8, 13])
def test_nearest_by_sequency(width):
    rng = np.random.default_rng(width)
    h = vector_codes.walsh_hadamard(np.eye(1 << (width - 1).bit_length(), dtype=np.int64))
    assert [(np.diff(r) != 0).sum() for r in h.T] == list(range(len(h)))  # sequency: sign changes rise by one
    for scale, kind in ((3, np.int64), (1000, np.int64), (1 << 40, object)):
        x, e = (rng.integers(-scale, scale + 1, (n, width)).astype(kind) for n in (200, 17))
        index, distance = vector_codes.nearest(vector_codes.walsh_hadamard(x), vector_codes.walsh_hadamard(e))
        every = ((x[:, None] - e[None]) ** 2).sum(axis=2)
        assert (index == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()


def brute_neighbours(rows, k=10, every=100):
    rows = sorted({(r[0], tuple(r[1])) for r in usable(rows) if any(r[1])}, key=repr)  # repeated rows count once
    dim = max(len(r[1]) for r in rows)
    x = np.array([list(r[1]) + [0.0] * (dim - len(r[1])) for r in rows])
    ids = [r[0] for r in rows]
    out = {}
    for i, q in enumerate(ids):
        if q is not None and q % every == 0:
            d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
            out[q] = sorted((d[j], ids[j] is None, ids[j] or 0) for j in range(len(ids)) if j != i)[:k]
    return out


def test_neighbours_recall(embeddings, monkeypatch):
    want = brute_neighbours(rows_of(embeddings))
    for shard, block in ((8192, 8192), (60, 7)):
        monkeypatch.setattr(neighbours, "SHARD", shard)
        monkeypatch.setattr(neighbours, "BLOCK", block)
        got = {}
        for r in neighbours.neighbours(embeddings).collect():
            got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
        assert got.keys() == want.keys() and all(sorted(g) == list(range(1, 11)) for g in got.values())
        hits = [len({i for i, _ in g.values()} & {i for _, _, i in want[q]}) for q, g in got.items()]
        assert sum(hits) >= 0.95 * 10 * len(want)
        for q, g in got.items():  # ranks follow (score, id), scores are true distances
            assert [g[r] for r in sorted(g)] == sorted(g.values(), key=lambda a: (a[1], a[0]))
            true = {i: d for d, _, i in brute_neighbours(rows_of(embeddings), k=10**6)[q]} if q == 100 else {}
            assert all(abs(true[i] - d) < 1e-12 for i, d in g.values() if true)


def test_neighbours_exact_without_stopping(odd, spark, monkeypatch):
    many = [(i, [float(i % 3), 1.0], 0) for i in range(0, 4000, 10)] + [(1, [5.0, 5.0], 0), (7, [0.0, 1.0], 0)]
    few = [(100, [1.0, 0.0], 0), (5, [1.0, 0.5], 0), (6, [1.0, -0.5], 0)]
    schema = "vec_id long, embedding array<double>, label int"
    frames = [odd, spark.createDataFrame(many, schema), spark.createDataFrame(few, schema)]
    monkeypatch.setattr(neighbours, "SHARD", 70)
    monkeypatch.setattr(neighbours, "BLOCK", 2)
    for frame in frames:
        got = {}
        for r in neighbours.neighbours(frame, confidence=1 - 1e-15).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
        want = brute_neighbours(rows_of(frame))
        assert got.keys() == want.keys()
        for q, w in want.items():
            assert [(i, s) for _, i, s in sorted(got[q])] == [(None if none else i, d) for d, none, i in w]
    for none in ([], [(None, [1.0], 0)], [(100, [0.0], 0)], [(100, [1.0], 0)]):
        assert neighbours.neighbours(spark.createDataFrame(none, schema)).count() == 0


def test_stopping_test():
    assert abs(neighbours.chi_square(15.507) - 0.95) < 1e-4  # the tabled 95 % point for 8 degrees of freedom
    assert abs(neighbours.quantile(0.99) - 20.090) < 1e-3
