import random
import re

import numpy as np

from tests.llm.helpers import CLASH, ODD, documents
from weftgraph.llm import quality_rules as Q


def counts(text):
    """The base statistics, word by word."""
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {g for g in grams if grams.count(g) > 1}
    covered = {p for i, g in enumerate(grams) if g in twice for p in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    failed = n < 50 or 100 * len(covered) > 50 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed


def corpus(seed, n=160):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(int(r.lognormvariate(5, 0.5)) + 50)]
        lines = [" ".join(words[j : j + 20]).capitalize() for j in range(0, len(words), 20)]
        rows.append((i, "\n".join(lines), "en" if i % 4 else None, "a" if i % 3 else None))
    for i in range(n, n + 8):
        rows.append((i, "\n".join(f"JUNK{j} ### $$$ {j}!!" for j in range(60)), "en", "a"))
    return rows


def vector(text):
    n, chars, symbols, dup, repeats, _ = counts(text)
    upper = len(re.findall("[A-Z]", text))
    m = max(n, 1)
    return [np.log1p(n), np.log1p(chars / m), np.log1p(symbols / m), np.log1p(dup) / 4, np.sqrt(repeats / m), np.sqrt(upper / max(chars, 1))]


def model(rows):
    """Distances by plain numpy, group by group."""
    out = {}
    floor = np.diag([f * f for f in Q.FLOORS.values()])
    grid = lambda x: np.ceil(x * Q.GRID) / Q.GRID

    def quantile(x, q):
        x = np.sort(grid(x))
        return x[int(np.ceil(len(x) * q)) - 1]

    def distance(x, m, c):
        z = np.linalg.solve(np.linalg.cholesky(c), (x - m).T)
        return (z * z).sum(axis=0)

    for key in {(r[2], r[3]) for r in rows}:
        mine = [r for r in rows if (r[2], r[3]) == key]
        good = np.array([vector(r[1]) for r in mine if not counts(r[1])[5]]).reshape(-1, 6)
        if len(good) < Q.MIN_ROWS:
            out |= {r[0]: None for r in mine}
            continue
        m = np.array([quantile(c, 0.5) for c in good.T])
        s = np.array([quantile(np.abs(c - a), 0.5) for c, a in zip(good.T, m)]) * 1.4826
        c = np.diag(s * s) + floor
        for _ in range(Q.STEPS):
            d = np.sqrt(distance(good, m, c))
            core = good[grid(d) <= quantile(d, Q.SUPPORT)]
            m, c = core.mean(axis=0), np.cov(core.T, bias=True) + floor
        scale = max(1.0, quantile(np.sqrt(distance(good, m, c)), 0.5) ** 2 / Q.MEDIAN)
        out |= {r[0]: distance(np.array([vector(r[1])]), m, c)[0] / scale for r in mine}
    return out


def test_counts_and_distances_match_numpy(spark):
    rows = corpus(1)
    want = model(rows)
    for r in Q.judged(documents(spark, rows, **CLASH)).collect():
        text = rows[r.doc_id][1]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == counts(text)
        d = want[r.doc_id]
        assert (d is None) == (r.distance is None)
        assert d is None or abs(d - r.distance) < 1e-6 * max(1, d)
        assert r.kept == (not r.base_failed and (d is None or d <= Q.CUTOFF))
    junk = [r for r in rows if r[0] >= 160]
    assert junk and all(want[r[0]] > Q.CUTOFF for r in junk)


def test_repeats_and_odd_rows(spark):
    r = random.Random(5)
    rows = [(i, " ".join(r.choices("abc", k=r.randint(0, 90))) + r.choice(["", "\n", "\n\na\na"]), "en", "a") for i in range(40)]
    rows += [(100 + i, t, l, s) for i, (_, t, l, s) in enumerate(ODD) if t is None or len(t) < 1000]
    got = {x.doc_id: x for x in Q.judged(documents(spark, rows)).collect()}
    for doc_id, text, *_ in rows:
        x = got[doc_id]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == counts(text)


def test_filter(spark):
    docs = documents(spark, corpus(2) + [(None, None, None, None), (900, "short", "en", "a")], **CLASH)
    kept = Q.filter_documents(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert None not in ids and 900 not in ids and not ids & set(range(160, 168)) and len(ids) > 150
    assert Q.filter_documents(documents(spark, [])).collect() == []


def test_small_groups_are_judged_one_level_up(spark):
    plain = [(i, t, "en", "a") for i, t, *_ in corpus(3, 60)[:60]]
    junk = "\n".join(f"JUNK{j} ### $$$ {j}!!" for j in range(60))
    # Three rows of a rare source, and three of a language that has no other.
    rare = [(900, junk, "en", "rare"), (901, plain[0][1], "en", "rare"), (902, plain[1][1], "en", "rare")]
    alone = [(910, junk, "xx", None), (911, plain[2][1], "xx", None), (912, plain[3][1], None, "rare")]
    got = {r.doc_id: r for r in Q.judged(documents(spark, plain + rare + alone)).collect()}
    assert len(got) == len(plain) + 6
    assert {i for i in got if i >= 900 and not got[i].kept} == {900, 910}
    assert all(got[i].distance is None and got[i].wider_distance is not None for i in got if i >= 900)
    assert all(got[i].distance is not None and got[i].wider_distance is None for i in range(60))
    # The language's estimate is what a table of one group with the same rows gets.
    one = [(i, t, "en", "a") for i, t, *_ in plain + rare]
    want = model(one)
    assert all(abs(want[i] - got[i].wider_distance) < 1e-6 * max(1, want[i]) for i in (900, 901, 902))
    # So is the corpus's.
    want = model([(i, t, "en", "a") for i, t, *_ in plain + rare + alone])
    assert all(abs(want[i] - got[i].wider_distance) < 1e-6 * max(1, want[i]) for i in (910, 911, 912))
    # Too few rows altogether: nothing to compare with.
    few = Q.judged(documents(spark, rare)).collect()
    assert all(r.kept and r.distance is None and r.wider_distance is None for r in few)


def test_rows_are_not_shuffled_for_a_few_estimates(spark, capsys):
    """A driver of small memory plans, compiles and logs each stage of a step anew: one exchange, of the sums, is all that a step has."""
    r = random.Random(3)
    rows = [("en" if i % 2 else None, "ab"[i % 3 % 2], *[r.gauss(0, 1) for _ in Q.VECTOR]) for i in range(400)]
    good = Q.materialize(spark.createDataFrame(rows, "lang string, source string, " + ", ".join(f"{v} double" for v in Q.VECTOR)), "rows")
    start = Q._start(good, False)
    first = Q.materialize(start, "start")
    for step in (start, Q._concentrate(good, first, False)):
        step.explain()
        plan = capsys.readouterr().out
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert plan.count("Exchange hashpartitioning") <= 3 and plan.count("Project") <= 16
