import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.helpers import CLASH, ODD, documents
from weftgraph.llm import token_codes

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000])
@pytest.mark.parametrize("top", [1, 2, 300, 1 << 16, 1 << 32])
def test_codes_round_trip_and_random_access(n, top):
    ids = (np.random.default_rng(n).random(n) ** 3 * top).astype(np.uint32)
    codes = token_codes.Codes(token_codes.encode(ids))
    assert (codes.all() == ids).all()
    assert all(codes.get(i) == ids[i] for i in range(n))
    with pytest.raises(IndexError):
        codes.get(n)


def test_several_levels_are_used():
    ids = np.random.default_rng(1).zipf(1.3, 20_000).clip(0, 49_000).astype(np.uint32)
    assert len(token_codes.Codes(token_codes.encode(ids)).levels) > 1


def expected(rows):
    plain, out, start = Tokenizer.from_file(PATH), [], 0
    for doc_id, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = plain.encode(text or "", add_special_tokens=False).ids + [1]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def test_files_round_trip(spark, monkeypatch):
    rows = [(d, t, l, s) for d, t, l, s in ODD if d is not None]
    got = [tuple(r) for r in token_codes.round_trip(documents(spark, rows, **CLASH)).orderBy("start").collect()]
    assert got == expected(rows)
    rest = token_codes.round_trip(documents(spark)).collect()
    assert len(rest) == len(ODD) and sorted(r.start for r in rest)[0] == 0
    assert token_codes.round_trip(documents(spark, [])).collect() == []
