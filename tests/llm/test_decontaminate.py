import random

from tests.llm.helpers import CLASH, documents
from weftgraph.llm import decontaminate


def least(item, text):
    """Least edit distance of ``item`` to any part of ``text``, by the whole table."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def edited(r, text, n):
    t = list(text)
    for _ in range(n):
        i, kind = r.randrange(len(t)), r.randrange(3)
        if kind == 0:
            t[i] = r.choice("abcdefgh ")
        elif kind == 1:
            t.insert(i, r.choice("abcdefgh"))
        elif len(t) > 1:
            del t[i]
    return "".join(t)


def test_distances_match_the_whole_table():
    r = random.Random(2)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 7))) for _ in range(40)]
    items = [(i, decontaminate.normal(" ".join(r.choices(words, k=r.randint(8, 30))))) for i in range(12)]
    known = decontaminate.Items(items, 0.1)
    met = 0
    for _ in range(120):
        i = r.randrange(len(items))
        size = len(items[i][1])
        text = decontaminate.normal(" ".join(r.choices(words, k=5)) + " " + edited(r, items[i][1], r.randint(0, size // 6)) + " " + " ".join(r.choices(words, k=r.randint(0, 5))))
        want = {at: least(t, text) for at, (_, t) in enumerate(items)}
        want = {at: d for at, d in want.items() if d <= len(items[at][1]) // 10}
        assert known.search(text) == want
        met += len(want)
    assert met > 40


def test_documents(spark):
    item = "The quick brown fox jumps over the lazy dog, twice a day."
    rows = [
        (1, "before " + item.upper().replace(" ", "\n") + " after", "en", "a"),
        (2, "nothing of the kind, but quick brown foxes are here", "en", "a"),
        (3, None, "en", "a"),
        (4, "", "en", None),
        (5, item.replace("lazy", "lzy").replace("fox", "foxx"), None, "a"),
        (5, item.replace("lazy", "lzy").replace("fox", "foxx"), None, "a"),
        (None, item, "en", "a"),
    ]
    items = spark.createDataFrame([(1, item), (2, "too short"), (3, None), (None, item), (1, item)], "item_id bigint, text string")
    docs = documents(spark, rows, **CLASH)
    got = sorted(((r.doc_id, r.item_id, r.distance) for r in decontaminate.matches(docs, items).collect()), key=str)
    assert got == [(1, 1, 0), (5, 1, 2), (5, 1, 2), (None, 1, 0)]
    clean = decontaminate.clean(docs, items)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [2, 3, 4]
    assert decontaminate.clean(docs, items.limit(0)).count() == len(rows)
    assert decontaminate.matches(documents(spark, []), items).collect() == []


def test_short_items_count_on_word_edges(spark):
    known = decontaminate.Items([(0, "7 apples"), (1, "x"), (2, "(yes)"), (3, "twenty four characters!!")], 0.1)
    assert known.search("he had 7 apples.") == {0: 0}
    assert known.search("17 apples, 7 applesauce, xx") == {}
    assert known.search("x") == {1: 0} and known.search("a-x") == {1: 0}
    assert known.search("oh(yes)no") == {2: 0}
    assert known.search("so: twenty four characters!!!") == {3: 0} and known.search("twenty foor characters!!") == {}
    items = spark.createDataFrame([(1, "7  Apples"), (2, " \n"), (3, "")], "item_id bigint, text string")
    docs = documents(spark, [(1, "She ate 7\napples", "en", "a"), (2, "17 apples", "en", "a"), (3, " ", "en", "a")])
    assert [(r.doc_id, r.item_id, r.distance, r.item_chars) for r in decontaminate.matches(docs, items).collect()] == [(1, 1, 0, 8)]


def test_bounded_masks_find_the_same(monkeypatch):
    r = random.Random(4)
    items = [(i, "".join(r.choice("abcdefghij ") for _ in range(90)).strip()) for i in range(20)]
    texts = [decontaminate.normal("zz " + edited(r, t, 6) + " yy") for _, t in items]
    known = decontaminate.Items(items, 0.1)
    whole = [known.search(t) for t in texts]
    monkeypatch.setattr(decontaminate, "HELD", 100)
    few = decontaminate.Items(items, 0.1)
    assert [few.search(t) for t in texts] == whole and sum(map(len, whole)) >= 15
    assert few.held <= 200


def test_slices_find_the_same(spark, monkeypatch):
    r = random.Random(9)
    items = [(i, "".join(r.choice("abcdefghij ") for _ in range(80))) for i in range(30)]
    docs = documents(spark, [(i, "zz " + t + " yy", "en", "a") for i, t in items])
    table = spark.createDataFrame(items, "item_id bigint, text string")
    whole = {(x.doc_id, x.item_id, x.distance) for x in decontaminate.matches(docs, table).collect()}
    monkeypatch.setattr(decontaminate, "SLICE", 500)
    assert {(x.doc_id, x.item_id, x.distance) for x in decontaminate.matches(docs, table).collect()} == whole
    assert {(i, i) for i, _ in items} <= {(d, i) for d, i, _ in whole}
