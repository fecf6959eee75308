"""Packing and token files against plain encoding of every text."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from helioframe.llm import packing, token_files, tokens


def plain(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary())
    return [[*e.ids, 1] for e in t.encode_batch(["" if x is None else x for x in texts], add_special_tokens=False)]


def ids(blob):
    return np.frombuffer(bytes(blob), "<u4").tolist()


def check_pieces(rows, want, length=2048):
    got, places = {}, {}
    for r in rows:
        got.setdefault(r["key"], []).append(r)
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(got) == sorted(want)
    for k, pieces in got.items():
        pieces.sort(key=lambda r: r["start"])
        assert [x for p in pieces for x in ids(p["ids"])] == want[k]
        assert all(p["doc_tokens"] == len(want[k]) for p in pieces)
        assert [p["start"] for p in pieces] == np.cumsum([0] + [p["length"] for p in pieces])[:-1].tolist()
    assert sorted(places) == list(range(len(places)))
    for s, spans in places.items():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at == length or s == len(places) - 1 and at <= length


def test_pack_equals_plain_encoding(spark, docs):
    rows = docs.select("doc_id", "text").collect()
    want = dict(zip([r[0] for r in rows], plain([r[1] for r in rows]), strict=True))
    out = packing.pack(docs.repartition(5)).withColumn("key", F.col("doc_id")).collect()
    check_pieces(out, want)


def test_pack_odd_rows(odd, empty):
    keyed = odd.withColumn("key", F.monotonically_increasing_id()).cache()
    rows = keyed.collect()
    want = dict(zip([r["key"] for r in rows], plain([r["text"] for r in rows]), strict=True))
    out = packing.pack(keyed, length=100)
    assert out.columns[:4] == ["doc_id", "lang", "n_words", "key"] and "text" not in out.columns
    check_pieces(out.collect(), want, 100)
    assert packing.pack(empty).count() == 0


@pytest.mark.parametrize("frame", [64, 1 << 18])
def test_token_files_round_trip(odd, empty, docs, tmp_path, frame):
    for table in (odd, docs):
        index = token_files.write(table, folder=f"file://{tmp_path}/t{frame}", frame_bytes=frame)
        out = token_files.read(index).select("doc_id", "start", "n_tokens", "ids").collect()
        out.sort(key=lambda r: r["start"])
        rows = table.select("doc_id", "text").collect()
        want = sorted((-1 if r[0] is None else r[0], e) for r, e in zip(rows, plain([r[1] for r in rows]), strict=True))
        assert sorted((-1 if r["doc_id"] is None else r["doc_id"], ids(r["ids"])) for r in out) == want
        keys = [-1 if r["doc_id"] is None else r["doc_id"] for r in out]
        assert keys == sorted(keys)
        assert [r["start"] for r in out] == np.cumsum([0] + [r["n_tokens"] for r in out])[:-1].tolist()
    assert token_files.write(empty, folder=f"file://{tmp_path}/none").count() == 0


def test_reader_takes_one_frame_and_finds_damage(docs, tmp_path):
    import zstandard

    index = token_files.write(docs, folder=f"file://{tmp_path}/x", frame_bytes=4096)
    some = index.where("doc_id = 77").first()
    reader = token_files.Reader(some["file"])
    assert len(reader.entries) > 1
    got = reader.frame(some["frame"])[some["frame_offset"] :][: 4 * some["n_tokens"]]
    text = docs.where("doc_id = 77").first()["text"]
    assert ids(got) == plain([text])[0]
    path = some["file"].removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    data[int(reader.start[some["frame"]]) + 20] ^= 255
    open(path, "wb").write(data)
    with pytest.raises((ValueError, zstandard.ZstdError)):
        token_files.Reader(some["file"]).frame(some["frame"])


def test_query_crc(spark):
    from helioframe.llm.queries import op10_token_output

    sf = "/root/testdata/sf0.001"
    rows = {r["doc_id"]: r for r in op10_token_output(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    for r, want in zip(docs, plain([r["text"] for r in docs]), strict=True):
        assert rows[r["doc_id"]]["ids_crc32"] == zlib.crc32(np.array(want, "<u4").tobytes())
        assert rows[r["doc_id"]]["n_tokens"] == len(want)
