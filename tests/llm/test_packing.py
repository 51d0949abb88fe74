import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.helpers import CLASH, LONG, ODD, documents
from weftgraph.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def lengths(kind, n):
    r = np.random.default_rng(n)
    return {
        "mixed": np.clip(r.lognormal(6.3, 1.1, n).astype(int), 1, 4096),
        "thirds": r.integers(1200, 1500, n),
        "wide": r.integers(600, 4097, n),
        "equal": np.full(n, 1000),
        "full": np.full(n, 4096),
        "ones": np.ones(n, dtype=int),
    }[kind]


def laid_out(counts, capacity):
    """Every piece by its rank: {sequence: [(offset, length)]}; ranks of a length are met once each."""
    places, n = packing.planned(counts, capacity)
    met, out = defaultdict(set), defaultdict(list)
    for length, first, last, sequence, each, offset in places.tolist():
        for r in range(first, last):
            assert r not in met[length]
            met[length].add(r)
            out[sequence + (r - first) // each].append((offset + (r - first) % each * length, length))
    assert all(met[s] == set(range(c)) for s, c in enumerate(counts.tolist()))
    assert sorted(out) == list(range(n))
    return out


def gapless(sequences, capacity):
    for places in sequences:
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity


def plain_best_fit(all_lengths, capacity):
    rooms = []
    for s in sorted(all_lengths, reverse=True):
        fits = [r for r in rooms if r >= s]
        room = min(fits) if fits else capacity
        if fits:
            rooms.remove(room)
        rooms.append(room - s)
    return len(rooms)


@pytest.mark.parametrize("kind", ["mixed", "thirds", "wide", "equal", "full", "ones"])
@pytest.mark.parametrize("n", [0, 1, 7, 600])
def test_plans_are_whole_and_near_the_least(kind, n):
    found = lengths(kind, n)
    counts = np.bincount(found, minlength=4097)
    out = laid_out(counts, 4096)
    gapless(out.values(), 4096)
    assert len(out) >= -(-int(found.sum()) // 4096)
    assert len(out) <= plain_best_fit(found.tolist(), 4096) * 1.02 + 1


def test_groups_round_up_and_configurations_hold_the_actual_lengths():
    # 500 and 499 are one group; two of them leave room for 24 whichever they are.
    counts = np.bincount([500] * 40 + [499] * 40 + [24] * 40, minlength=1025)
    out = laid_out(counts, 1024)
    gapless(out.values(), 1024)
    assert len(out) == 40


def test_configurations_reach_the_fractional_optimum():
    chosen = packing.configurations(np.array([60, 50, 40]), np.array([100, 100, 100]), 100)
    assert all((c * [60, 50, 40]).sum() <= 100 for c, _ in chosen)
    used = sum(c * n for c, n in chosen)
    assert (used <= 100).all() and sum(n for _, n in chosen) == 150


def expected(rows, capacity):
    plain, out = Tokenizer.from_file(PATH), []
    for doc_id, text, *_ in rows:
        ids = np.array(plain.encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4")
        for k, a in enumerate(range(0, len(ids), capacity)):
            part = ids[a : a + capacity]
            out.append((doc_id, k, a, len(part), zlib.crc32(part.tobytes())))
    return out


def key(row):
    return tuple((v is not None, v or 0) for v in row)


@pytest.mark.parametrize("capacity", [4096, 64])
def test_packed_documents(spark, capacity):
    rows = ODD + [(20 + i, "word " * (i % 60), "en", "a") for i in range(300)]
    df = documents(spark, rows, **CLASH).repartition(5, "doc_id")
    got = packing.packed(df, capacity=capacity, keep_ids=True)
    found = got.collect()
    assert sorted([tuple(r)[:5] for r in found], key=key) == sorted(expected(rows, capacity), key=key)
    out = defaultdict(list)
    for r in found:
        out[r.sequence_id].append((r.offset, r.length))
    gapless(out.values(), capacity)
    assert len(out) <= plain_best_fit([r.length for r in found], capacity) * 1.02 + 1
    whole = {r.sequence_id: r for r in packing.sequences(got).collect()}
    for r in found:
        assert whole[r.sequence_id].ids[4 * r.offset : 4 * (r.offset + r.length)] == r.ids
    assert all(len(r.ids) == 4 * r.n_tokens for r in whole.values())


def test_long_texts_are_cut_and_empty_tables_have_no_pieces(spark):
    got = packing.packed(documents(spark, [(1, LONG, "en", "a")])).orderBy("piece").collect()
    assert [r.piece for r in got] == list(range(len(got))) and {r.length for r in got[:-1]} == {4096}
    assert packing.packed(documents(spark, [])).collect() == []
