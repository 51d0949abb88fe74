"""Fragments to lines, in batch and over restarts of a stream."""

import random

import pytest

from weftgraph.streaming import deltas, reassembly

SCHEMA = "stream_id string, fragment_no bigint, data binary, last boolean"


def cut(stream, data, seed, ends=True):
    r, out, at = random.Random(seed), [], 0
    while at < len(data):
        n = r.choice([0, 1, 2, 3, 5, 40])
        out.append((stream, len(out), data[at : at + n], False))
        at += n
    if ends:
        out.append((stream, len(out), b"", True))
    return out


TEXTS = {
    "a": "data: {\"x\": 1}\r\n\ndata: é日本\nlast".encode(),
    "b": b"data: one\ndata: [DONE]\ndata: never\n",
    "c": b"",
    "d": "\n\n🙂🙂\n".encode(),
    "e": b"bad \xff byte\nopen",
}
WANT = {
    "a": ['data: {"x": 1}', "", "data: é日本", "last"],
    "b": ["data: one"],
    "d": ["", "", "🙂🙂"],
    "e": ["bad � byte", "open"],
}


def by_stream(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.stream_id, r.line_no)):
        assert r.line_no == len(out.setdefault(r.stream_id, []))
        out[r.stream_id].append(r.line)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_batch(spark, seed):
    rows = [f for s, data in TEXTS.items() for f in cut(s, data, seed)]
    random.Random(seed).shuffle(rows)
    got = by_stream(reassembly.lines(spark.createDataFrame(rows + rows[:3], SCHEMA)).collect())
    assert got == WANT


def test_open_lines_stay_open_without_a_last_fragment(spark):
    rows = [("s", 0, b"one\ntw", None), ("s", 2, b"o\nthree", None)]
    assert by_stream(reassembly.lines(spark.createDataFrame(rows, SCHEMA)).collect()) == {"s": ["one"]}


def test_streams_survive_a_restart_between_any_two_fragments(spark, tmp_path):
    everything = [f for s, data in TEXTS.items() for f in cut(s, data, 7)]
    random.Random(3).shuffle(everything)
    runs = [everything[i::3] for i in range(3)]  # fragments come early and late, split inside lines and characters
    for rows in runs:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        fragments = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        query = (
            reassembly.lines(fragments).writeStream.format("parquet").option("path", f"{tmp_path}/out")
            .option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start()
        )
        query.awaitTermination()
    assert by_stream(spark.read.parquet(f"{tmp_path}/out").collect()) == WANT


def test_lines_feed_the_decoders(spark):
    body = 'data: {"choices": [{"delta": {"content": "Hé"}}]}\n\ndata: {"choices": [{"delta": {"content": "llo"}}]}\ndata: [DONE]\n'.encode()
    lines = reassembly.lines(spark.createDataFrame(cut("s", body, 5), SCHEMA))
    (text,) = deltas.full_text(deltas.choice_deltas(deltas.sse_data(lines))).collect()
    assert text.text == "Héllo"
