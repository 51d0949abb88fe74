import random
import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from tests.llm.helpers import CLASH, ODD, documents
from weftgraph.llm import license_scan, line_dedup, quality_classifier, token_count


@pytest.fixture(scope="module")
def unigram():
    entries = token_count.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    plain = Tokenizer(models.Unigram(entries, unk_id=0, byte_fallback=True))
    plain.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return plain, token_count.Counter(entries)


def test_piece_counts_match_the_tokenizer(unigram):
    plain, counter = unigram
    r = random.Random(2)
    abc = "aAbeéthingr .,<s>unk0x4 \n\t▁日本梦☃ß  "
    texts = ["", " ", "  ", "a", "▁x ▁", "<s> x <unk> <0x41>"] + ["".join(r.choice(abc) for _ in range(r.randint(1, 50))) for _ in range(500)]
    _, got, _ = counter.texts([t.encode() for t in texts])
    assert got.tolist() == [len(e.ids) for e in plain.encode_batch_fast(texts, add_special_tokens=False)]


def test_ties_and_scores():
    counter = token_count.Counter([("▁", -1.0), ("a", -2.0), ("aa", -4.0), ("b", -3.0), ("ab", -5.0)])
    assert counter.chunk("▁aa") == (2, -5.0)  # the longest piece that ends there comes first
    assert counter.chunk("▁ab") == (2, -6.0)
    assert counter.chunk("▁é") == (3, -1.0 - 5.0 - 10.0)


def test_counted_rows(spark, unigram):
    plain, _ = unigram
    got = sorted(((r.doc_id or 0, r.n_pieces) for r in token_count.counted(documents(spark, **CLASH)).collect()))
    assert got == sorted((d or 0, len(plain.encode(t or "", add_special_tokens=False).ids)) for d, t, *_ in ODD)
    assert token_count.counted(documents(spark, [])).collect() == []


def test_line_dedup(spark):
    foot = "<footer>same foot</footer>"
    rows = [(i, f"http://big.test/{i}", f"<p>own {i}</p><script>x<p></script>{foot}<p>own {i}</p>") for i in range(10)]
    rows += [(20 + i, f"http://small{i}.test/", f"<p>text</p>{foot}") for i in range(3)]
    rows += [(30, None, None), (31, "http://big.test/31", ""), (32, "no scheme", "plain <b>text</b><br>\n next"), (3, "http://big.test/3", rows[3][2])]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 AS h", "2 AS lines", "3 AS n", "4 AS kept")
    got = sorted(((r.page_id, r.host, r.n_lines, r.n_kept, r.text) for r in line_dedup.deduped(pages).collect()))
    want = [(i, "big.test", 3, 2, f"own {i}\nown {i}") for i in [0, 1, 2, 3, 3, *range(4, 10)]]
    want += [(20 + i, f"small{i}.test", 2, 2, "text\nsame foot") for i in range(3)]
    want += [(30, "", 0, 0, ""), (31, "big.test", 0, 0, ""), (32, "", 2, 2, "plain text\nnext")]
    assert got == want
    assert line_dedup.deduped(pages.limit(0)).collect() == []


def test_classifier_learns_and_scores_all_rows(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choice("etaoinshr") for _ in range(r.randint(2, 8)))
    good = [" ".join(word() for _ in range(r.randint(30, 200))) for _ in range(90)]
    bad = [" ".join(word() + "###" for _ in range(r.randint(30, 200))) for _ in range(90)]
    rows = [(i, t, "en", "a") for i, t in enumerate(x for pair in zip(good, bad) for x in pair)]
    docs = documents(spark, rows + [(1000, None, None, None), (1001, "", "en", "a"), (None, "x", "en", "a")], **CLASH)
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(180)] + [(1, 0, 0), (None, 1, 0), (5, None, 0), (7777, 1, 1)], "doc_id bigint, quality int, toxic int")
    model = quality_classifier.train(docs, labels)
    got = {x.doc_id: x for x in quality_classifier.score(docs, model).collect()}
    assert len(got) == 183 and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.3) for x in got.values())
    held = [x for x in got.values() if x.held_out]
    assert {x.doc_id for x in held} == {i for i in got if i is not None and zlib.crc32(str(i).encode()) % 5 == 0}
    right = [x.predicted == 1 - x.doc_id % 2 for x in held if x.doc_id < 180]
    assert sum(right) >= 0.9 * len(right)
    one = quality_classifier.train(docs, labels.where("quality = 1"))
    assert {x.score for x in quality_classifier.score(docs, one).collect()} == {1.0}
    none = quality_classifier.train(docs, labels.limit(0))
    assert {x.score for x in quality_classifier.score(docs.limit(2), none).collect()} == {0.5}
    assert quality_classifier.score(documents(spark, []), model).collect() == []


def test_gradients_match_differences():
    import numpy as np

    net, texts, y = quality_classifier.Network(), [b"some text " * 60, b"###", b""], np.array([1, 0, 1], dtype=np.float32)
    for name in net.p:
        net.p[name] = net.p[name].astype(np.float64)
    _, g = net.step(texts, y)
    for name, at in (("w1", (3, 2)), ("b1", (1,)), ("w2", (5,)), ("b2", (0,)), ("b0", (4,)), ("table", (2, ord("t"), 7))):
        old, e = net.p[name][at], 1e-5
        net.p[name][at] = old + e
        up, _ = net.step(texts, y)
        net.p[name][at] = old - e
        down, _ = net.step(texts, y)
        net.p[name][at] = old
        assert abs((up - down) / (2 * e) - g[name][at]) < 1e-4, name


def test_licences(spark):
    r = random.Random(3)
    noise = lambda n: " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 8))) for _ in range(n))
    rows = [(i, noise(30) + "\n" + noise(12), "en", "a") for i in range(60)]
    rows += [
        (100, noise(20) + "\nReleased under the MIT License.\n" + noise(8), "en", "a"),
        (101, noise(90) + " licensed under the Apache License, Version 2.0. " + noise(90), "en", "a"),
        (102, "Licensed under CC BY-NC 4.0.\n" + noise(9), "en", "a"),
        (103, "the public bought a licence to fish in version 3 of the pond", "en", "a"),
        (103, None, None, None),
        (104, "", "en", "a"),
    ]
    docs = documents(spark, rows, **CLASH)
    model = license_scan.train(docs)
    got = {(x.doc_id, x.family) for x in license_scan.scanned(docs, model).collect()}
    assert got == {(100, "mit"), (101, "apache"), (102, "cc-by-nc")}
    assert license_scan.scanned(documents(spark, []), license_scan.train(documents(spark, []))).collect() == []


def test_wrapped_licences(spark):
    gpl = ["This program is free software: you can redistribute it and/or modify", "it under the terms of the GNU General Public License"]
    bsd = ["Redistribution and use in source and binary forms, with or without", "modification, are permitted provided that the following conditions", "are met:"]
    cc0 = ["To the extent possible under law, the author has waived all", "copyright under CC0 1.0 Universal and dedicated the work to the", "public domain"]
    r = random.Random(8)
    noise = lambda n: " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 8))) for _ in range(n))
    rows, want = [(i, noise(30) + "\n" + noise(12), "en", "a") for i in range(60)], set()
    for k, lead in enumerate(["", "# ", " * ", "// ", "REM ", "dnl "]):
        for n, (family, lines) in enumerate((("gpl", gpl), ("bsd", bsd), ("cc0", cc0))):
            rows.append((100 + 10 * k + n, noise(15) + "\n\n" + "\n".join(lead + x for x in lines) + f"\n{lead}\n" + noise(10), "en", "a"))
            want.add((100 + 10 * k + n, family))
    # The halves of a notice in two paragraphs, and in two documents, are none.
    rows += [(200, "\n".join([gpl[0], "#", gpl[1]]), "en", "a"), (201, gpl[0], "en", "a"), (202, gpl[1], "en", "a")]
    # A notice on a line of its own counts once, whatever stands around it.
    rows.append((203, noise(8) + "\nReleased under the MIT License.\n" + noise(8), "en", "a"))
    docs = documents(spark, rows)
    got = {(x.doc_id, x.family): x.n_windows for x in license_scan.scanned(docs, license_scan.train(docs)).collect()}
    assert set(got) == want | {(203, "mit")} and got[203, "mit"] == 1


def test_licence_sample_holds_a_repeated_line_once(spark, monkeypatch):
    monkeypatch.setattr(license_scan, "SAMPLE", 40)
    lines = [f"line {i} of its own" for i in range(60)]
    one = documents(spark, [(1, "\n".join(lines), "en", "a")])
    many = documents(spark, [(i, "\n".join([x for k, x in enumerate(lines) for _ in range(1 + 30 * (k % 7 == 0))]) + "\n \n", "en", "a") for i in range(20)] + [(99, None, None, None)])
    want = license_scan.sample(one)
    assert len(want) == len(set(want)) == 40 and license_scan.sample(many) == want
