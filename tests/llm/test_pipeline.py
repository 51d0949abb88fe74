import random

import corpus_pipeline
from weftgraph.llm.queries import QUERIES


def write(spark, folder, rows, items):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs


def test_stages_take_effect(spark, tmp_path):
    r = random.Random(8)
    word = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 9)))
    text = lambda n=90: " ".join(word() for _ in range(n))
    item = text(25)
    rows = [(i, text(), "en", "ab"[i % 2]) for i in range(60)]
    rows += [(100, rows[0][1], "en", "a"), (101, rows[1][1] + " more", "en", "b")]
    rows += [(102, text() + "\n" + item + "\n" + text(), "en", "a"), (103, "too short", "en", "a"), (104, None, None, None)]
    write(spark, tmp_path, [(*x, len(x[1] or "")) for x in rows], [(1, item)])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        ids.append(sorted(x.doc_id for x in docs.collect()))
    good = list(range(60))
    assert ids[:3] == [good + [100, 101, 102], good + [102], good]
    assert set(ids[3]) <= set(good) and len(ids[3]) > 40
    tokens = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(x.doc_id for x in tokens) == ids[3]


def test_empty_tables(spark, tmp_path):
    write(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_all_operators_are_registered():
    names = {n.split("_")[0] for n in QUERIES}
    assert {"pipeline", *(f"op{n}" for n in range(1, 11))} <= names
