import math

import numpy as np
import pytest

from weftgraph.llm import whitening


def exact(rows):
    """x, exact sums and deviations with Python's whole numbers; eigenvectors by a full decomposition."""
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v in good]
    n, d = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(d)]
    deviation = [sum((n * r[j] - sums[j]) ** 2 for j in range(d)) for r in x]
    y = np.array([[(n * r[j] - sums[j]) / n for j in range(d)] for r in x])
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    return [i for i, _ in good], n, deviation, y, values, vectors


def held(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    for name in ("n", "dim", "label", "component", "entries"):
        df = df.withColumn(name, whitening.F.lit(1))
    return whitening.whitened(df.repartition(3), **kw).collect()


def agree(found, rows, want=8):
    ids, n, deviation, y, values, vectors = exact(rows)
    k = int((values[:want] > 1e-10 * values[0]).sum())
    assert len(found) == k * n and {r.component for r in found} == set(range(1, k + 1)) and {r.n for r in found} == {n}
    z = y @ vectors[:, :k] / np.sqrt(values[:k])
    for c in range(k):
        mine = sorted(((r.vec_id, int(r.deviation), r.whitened) for r in found if r.component == c + 1), key=lambda t: (t[0], t[1], abs(t[2])))
        best = min(
            max(abs(a[2] - b[2]) for a, b in zip(mine, sorted(zip(ids, deviation, (sign * z[:, c]).tolist()), key=lambda t: (t[0], t[1], abs(t[2]))))) for sign in (1, -1)
        )
        assert best < 1e-7, (c, best)
        assert [m[:2] for m in mine] == sorted(zip(ids, deviation))
    assert {round(r.explained / (values[r.component - 1] / values.sum()), 9) for r in found} == {1.0}
    assert len({r.identity_error for r in found}) == 1 and found[0].identity_error < 1e-8


@pytest.mark.parametrize("d,decay", [(64, 0.98), (64, 0.8), (40, 0.999), (5, 0.5), (1, 1.0)])
def test_components_match_a_full_decomposition(spark, d, decay):
    r = np.random.default_rng(d)
    turn = np.linalg.qr(r.standard_normal((d, d)))[0]
    data = r.standard_normal((700, d)) * decay ** np.arange(d) @ turn + 3
    rows = [(i, [float(np.float32(v)) for v in row]) for i, row in enumerate(data)]
    agree(held(spark, rows), rows)


def test_unusable_rows_repeated_rows_and_large_entries(spark):
    r = np.random.default_rng(3)
    rows = [(i, [float(np.float32(v)) for v in r.standard_normal(12) * [1e3, 3e2, *[1] * 10]]) for i in range(60)]
    bad = [(100, None), (101, [1.0, None, *[0.0] * 10]), (102, [float("nan"), *[0.0] * 11]), (103, [float("inf"), *[0.0] * 11])]
    agree(held(spark, rows + bad + rows[:2]), rows + rows[:2])
    # Another length and entries that no long could hold are dropped.
    agree(held(spark, rows + bad + [(104, [1.0]), (105, []), (106, [1e30, *[0.0] * 11])]), rows)


def test_rank_equal_vectors_and_nothing(spark):
    r = np.random.default_rng(4)
    rows = [(i, [float(a), float(b), float(a), 2.0, *[0.5] * 60]) for i, (a, b) in enumerate(r.integers(0, 9, (50, 2)))]
    agree(held(spark, rows), rows)
    assert held(spark, [(1, [1.0, 2.0])] * 3) == [] == held(spark, []) == held(spark, [(1, []), (2, None)])
    found = held(spark, [(None, [1.0, 0.0]), (None, [0.0, 0.0]), (2, [3.0, 1.0])])
    assert sorted(str(r.vec_id) for r in found) == ["2", "2", "None", "None", "None", "None"]


def test_equal_eigenvalues_are_certified():
    a = np.diag([5.0] * 10 + [1.0] * 90)
    found = whitening.spectrum(lambda q: a @ q, 100, 8)
    assert found.certified and np.allclose(found.values, 5)
    assert np.allclose(found.vectors.T @ found.vectors, np.eye(8), atol=1e-12)


def test_a_slowly_falling_spectrum_takes_the_recurrence():
    r, d = np.random.default_rng(5), 300
    turn = np.linalg.qr(r.standard_normal((d, d)))[0]
    values = np.linspace(2, 1, d)
    a = turn * values @ turn.T
    found = whitening.spectrum(lambda q: a @ q, d, 8)
    assert found.certified and found.passes > 10
    assert np.allclose(found.values, values[:8], rtol=1e-12)
    assert np.allclose(np.abs((turn[:, :8] * found.vectors).sum(axis=0)), 1, atol=1e-9)


def test_many_tasks_add_up_in_groups(spark, monkeypatch):
    r = np.random.default_rng(6)
    rows = [(i, [float(np.float32(v)) for v in row]) for i, row in enumerate(r.standard_normal((200, 9)))]
    monkeypatch.setattr(whitening, "FAN", 1)
    agree(held(spark, rows), rows)


def test_deviations_of_any_size():
    x = np.array([[3, -5], [1 << 39, 7], [-(1 << 39), 1]])
    for n, sums in ((3, [10, -4]), (10**12, [10**15 + 3, -(10**14) - 1]), (3, [1 << 40, 5])):
        want = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]
        assert whitening.deviations(x, sums, n) == want
        assert whitening.deviations(x[:1], sums, n) == want[:1]
