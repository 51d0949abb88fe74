"""Containment, many questions and many matchers against plain loops."""

import random
from collections import Counter

from tests.helpers import make_edges, make_nodes
from weftgraph.operators import model, reach_sets, search
from weftgraph.operators.substrings import contained

TEXTS = ["", "a", "é", "ab", "日本", "abc", "abcabc", "xabcx", "éa", "aaaa", "日本語です", "  ", "a b", "order 11", "small ring", "ring"]


def test_containment_matches_a_nested_loop(spark):
    r = random.Random(4)
    more = ["".join(r.choice("abé") for _ in range(r.randint(0, 7))) for _ in range(150)]
    left, right = TEXTS + more[:90], TEXTS + more[60:]
    frame = lambda rows: spark.createDataFrame([(x,) for x in [*rows, None, *rows[:5]]], "s string")
    got = sorted(tuple(x) for x in contained(frame(left), frame(right)).collect())
    assert got == sorted({(p, t) for p in left for t in right if p in t})
    assert contained(frame([]).where("s = 'no'"), frame(right)).collect() == []
    assert contained(frame(left), frame([]).where("s = 'no'")).collect() == []


def test_each_question_scores_like_one(spark):
    names = ["Order 11", "small Ring", "R", "", "red", "é日", "Supplier#1", "ring", "RING"]
    nodes = make_nodes(spark, [(f"n{i}", "class", n) for i, n in enumerate(names)])
    questions = ["which RED small ring of supplier#1?", "red red ring!", "", "of a b", "é日 x", "日", "order 11  \n\tring"]
    asked = spark.createDataFrame(list(enumerate(questions)) + [(99, None)], "question_id int, question string")
    got = {(r.question_id, r.id): r.score for r in search.lexical_scores_of_each(nodes, asked).collect()}
    want = {(q, r.id): r.score for q, text in enumerate(questions) for r in search.lexical_scores(nodes, text).collect()}
    assert got == want and got
    best = search.lexical_match_of_each(nodes, asked, limit=2).orderBy("question_id", "place").collect()
    for q, text in enumerate(questions):
        assert [(r.id, r.score) for r in best if r.question_id == q] == [(r.id, r.score) for r in search.lexical_match(nodes, text, 2).collect()]


def test_sets_of_matchers_in_one_pass(spark, monkeypatch):
    monkeypatch.setattr(reach_sets, "LEVELS", 2)
    r = random.Random(6)
    ids = [f"n{i}" for i in range(120)]
    edges = [(r.choice(ids), r.choice(ids), r.choice(["calls", "defines"])) for _ in range(170)]
    matched = [(f"m{k}", i) for k in range(150) for i in r.sample(ids, 2)] + [("none", "outside"), (None, "n1")]
    before = {}
    for a, b, _ in edges:
        before.setdefault(b, set()).add(a)

    def reached(start, depth):
        seen, front = {start}, {start}
        while front and depth:
            front = {a for b in front for a in before.get(b, ())} - seen
            seen |= front
            depth -= 1
        return seen

    frame = spark.createDataFrame(matched, "matcher string, id string")
    for depth in (0, 1, 3):
        got = Counter(tuple(x) for x in reach_sets.reaching_each(make_edges(spark, edges), frame, depth).collect())
        assert got == Counter({(m, i) for m, start in matched if m for i in reached(start, depth or -1)})
    assert reach_sets.reaching_each(make_edges(spark, edges), frame.where("false")).collect() == []


def test_nodes_of_one_name_are_not_paired_with_questions(spark, monkeypatch):
    stored = {}

    def counted(df, label, *folders, keep=search.materialize):
        kept = keep(df, label, *folders)
        stored[label] = max(stored.get(label, 0), kept.count())
        return kept

    monkeypatch.setattr(search, "materialize", counted)
    monkeypatch.setattr(search, "CLASS_WORDS", 2)
    rows = [(f"r{i:03}", "type", "red ring") for i in range(200)] + [(f"c{i}", "class", f"user#{i}") for i in range(40)]
    rows += [("r001", "type", "ring"), ("two", "type", "a red ring box")]  # a repeated id, a name with more words than a class lists
    nodes = make_nodes(spark, rows)
    questions = ["red ring", "the user#7 ring", "user", "a red ring box ring?", "box red ring #7"]
    asked = spark.createDataFrame(list(enumerate(questions)), "question_id int, question string")
    best = search.lexical_match_of_each(nodes, asked, limit=3).orderBy("question_id", "place").collect()
    for q, text in enumerate(questions):
        score = Counter()
        for r in search.lexical_scores(nodes, text).collect():
            score[r.id] += r.score
        assert [(r.id, r.score) for r in best if r.question_id == q] == sorted(score.items(), key=lambda x: (-x[1], x[0]))[:3]
    assert stored["names"] < 60 and stored["class-ids"] < 30
