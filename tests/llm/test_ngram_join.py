import random
from pathlib import Path

import pytest

from tests.llm.helpers import CLASH, ODD, documents
from weftgraph.llm import ngram_join
from weftgraph.session import scratch_root


def brute(rows, k=5, near=75):
    """doc_id -> (set size, component) by comparing all pairs."""
    sets = {}
    for doc_id, text, *_ in rows:
        w = (text or "").encode().lower().split()
        sets[doc_id] = frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= near * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def near_copies(seed, groups, size, words=80, edits=3, passage=40):
    """Groups of edited copies and texts that share one passage."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    shared, rows = r.choices(vocabulary, k=passage), []
    for _ in range(groups):
        base = r.choices(vocabulary, k=r.randint(20, words))
        for _ in range(r.randint(1, size)):
            text = list(base)
            for _ in range(r.randint(0, edits)):
                text[r.randrange(len(text))] = r.choice(vocabulary)
            rows.append(text)
    for _ in range(size):
        rows.append(shared + r.choices(vocabulary, k=r.randint(5, 30)))
    rows += [r.choices(vocabulary, k=n) for n in (1, 2, 4, 5, 6, 7) for _ in range(3)]
    return [(i, " ".join(t), "en", "a") for i, t in enumerate(rows)]


@pytest.mark.parametrize("large", [20_000, 5])
def test_links_match_brute_force(spark, large):
    rows = near_copies(1, 12, 14) + [(1000 + i, t, "en", "b") for i, (_, t, *_) in enumerate(near_copies(1, 12, 14)[:9])]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link(documents(spark, rows), large=large).collect()}
    assert got == brute(rows)


def test_long_texts_with_few_edits(spark):
    r = random.Random(7)
    base = [f"v{r.randrange(5000)}" for _ in range(4000)]
    rows = []
    for i, edits in enumerate((0, 3, 60, 200, 500)):
        text = list(base)
        for _ in range(edits):
            text[r.randrange(len(text))] = "new"
        rows.append((i, " ".join(text), "en", "a"))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.link(documents(spark, rows)).collect()}
    assert got == brute(rows)


def test_odd_rows(spark):
    got = sorted(((r.doc_id or 0, r.n_shingles, r.component_id) for r in ngram_join.link(documents(spark, **CLASH)).collect()), key=str)
    assert got.count((5, 3, 5)) == 2 and (6, 3, 5) in got
    assert (1, 0, 1) in got and (2, 0, 2) in got and (3, 0, 3) in got and (4, 1, 4) in got
    assert (0, 3, 5) in got and (0, 3, None) in got
    assert len(got) == len(ODD)


def test_keep_one(spark):
    docs = documents(spark, **CLASH)
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted(d for d, _ in rows if d is not None) == [1, 2, 3, 4, 5, 7, 8]
    assert [t for d, t in rows if d is None] == ["nothing like the others at all here"]


def test_empty(spark):
    assert ngram_join.link(documents(spark, [])).collect() == []
    assert ngram_join.keep_one(documents(spark, [])).collect() == []


def test_texts_are_not_copied_for_members_that_stay_apart(spark):
    r = random.Random(3)
    word = lambda: f"{r.getrandbits(40):x}"
    passage = [word() for _ in range(330)]
    rows = [(i, " ".join(passage + [word() for _ in range(330)]), "en", "a") for i in range(400)]
    top = Path(scratch_root(spark).removeprefix("file:")) / "weftgraph"
    before = set(top.glob("*"))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.link(documents(spark, rows)).collect()}
    assert got == {i: (656, i) for i in range(400)}
    stored = sum(p.stat().st_size for x in set(top.glob("*")) - before for p in x.rglob("*.parquet"))
    # All are in groups of the passage and none link: a copy of their texts alone takes twice as much.
    assert stored < sum(len(t) for _, t, *_ in rows) / 3
