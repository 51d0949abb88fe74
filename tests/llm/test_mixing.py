import random
from fractions import Fraction

from tests.llm.helpers import CLASH, ODD, documents
from weftgraph.llm import mixing


def targets(sizes, weights=(1, 2, 3), most=3):
    """Share by weight, stop at the limit, share the excess again."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: Fraction(weights[i % len(weights)]) for i, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        rest, weight = total - sum(most * sizes[s] for s in full), sum(w[s] for s in names if s not in full)
        share = {s: Fraction(most * sizes[s]) if s in full else rest * w[s] / weight for s in names}
        above = {s for s in names if share[s] > most * sizes[s]}
        if not above:
            return {s: float(x) for s, x in share.items()}
        full |= above


def corpus(seed):
    r = random.Random(seed)
    sizes = {"b": 400, "a": 10, "c": 60, None: 30, "é": 5, "z": 120}
    return [(i, "w " * int(r.expovariate(1 / 40) + 1), "en", s) for i, s in enumerate(x for x, n in sizes.items() for _ in range(n))]


def test_targets_and_taken_words(spark):
    rows = corpus(3)
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want, got = targets(sizes), mixing.sampled(documents(spark, rows)).collect()
    taken, largest = {}, {}
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * want[r.source] + 1e-9
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        expected = r.target / r.source_size
        assert int(expected) <= r.copies <= int(expected) + 1
        taken[r.source] = taken.get(r.source, 0) + r.taken
        largest[r.source] = max(largest.get(r.source, 0), r.size)
    assert len(got) == len(rows)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] + 1
    again = mixing.sampled(documents(spark, list(reversed(rows)))).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)


def test_mix_repeats_rows(spark):
    docs = documents(spark, corpus(5), **CLASH)
    copies = {r.doc_id: r.copies for r in mixing.sampled(docs).collect()}
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    got = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert got == {d: c for d, c in copies.items() if c}


def test_odd_rows(spark):
    got = mixing.sampled(documents(spark, **CLASH)).collect()
    assert len(got) == len(ODD)
    assert all(r.taken == 0 for r in got if r.size == 0)
    assert mixing.sampled(documents(spark, [])).collect() == []
    blank = [(1, None, "en", "a"), (2, " ", "en", "b")]
    assert [r.taken for r in mixing.sampled(documents(spark, blank)).collect()] == [0, 0]
    assert mixing.mix(documents(spark, [])).collect() == []
