import hashlib
import io
import zlib

import numpy as np
import pytest
from cases import documents, empty, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from hypothesis.extra.numpy import arrays

from tessera.llm import media

shapes = st.tuples(st.integers(1, 9), st.integers(1, 9)) | st.tuples(st.integers(1, 5), st.integers(1, 5), st.just(3))


@given(arrays(np.uint8, shapes))
@settings(max_examples=80, deadline=None)
def test_formats_round_trip(samples):
    assert (media.decode(media.encode_pgm(samples)) == samples).all()
    assert (media.decode(media.encode_bmp(samples)) == samples).all()


def test_plain_and_bitmap_netpbm():
    assert media.decode(b"P1\n# note\n3 2\n1 0 1\n0 1 0\n").tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode(b"P4\n3 2\n" + bytes([0b10100000, 0b01000000])).tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode(b"P2 2 1 # top\n255 7 9").tolist() == [[7, 9]]
    assert media.decode(b"P3 1 1 255 1 2 3").tolist() == [[[1, 2, 3]]]
    with pytest.raises(ValueError):
        media.decode(b"GIF89a")


@given(arrays(np.uint8, st.tuples(st.integers(1, 40), st.integers(1, 40))), st.integers(1, 12), st.integers(1, 12))
@settings(max_examples=60, deadline=None)
def test_area_resize_is_the_mean_of_the_area(samples, h, w):
    fine = np.repeat(np.repeat(samples.astype(float), h, axis=0), w, axis=1)
    want = fine.reshape(h, samples.shape[0], w, samples.shape[1]).mean(axis=(1, 3))
    assert np.allclose(media.area_resize(samples, h, w), want)


def test_contract(spark):
    out = {(r.doc_id, r.payload_sha256): r for r in media.text_media(documents(spark), with_media=True).collect()}
    for d, t, *_ in rows():
        raw = (t or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = out[(d, hashlib.sha256(payload).hexdigest())]
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(raw), len(payload), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(r.media), hashlib.sha256(r.media).hexdigest())
        assert media.decode(bytes(r.media)).tobytes() == payload
        assert np.load(io.BytesIO(r.tile)).shape == (16, 16)
    assert media.text_media(empty(spark)).collect() == []


def test_tiles(spark):
    good = media.encode_bmp(np.arange(64, dtype=np.uint8).reshape(8, 8))
    df = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(b"no image")), (3, None)], "id int, image binary")
    out = {r.id: r for r in media.tiles(df).collect()}
    assert out[1].dhash == "ff" * 8 and out[1].tile is not None
    assert out[2].tile is None and out[3].dhash is None


def test_tiles_scale_by_the_maximum(spark):
    want = np.array([[0, 85], [170, 255]])
    images = [b"P5\n2 2\n%d\n" % top + (want * top // 255).astype(kind).tobytes() for top, kind in ((65535, ">u2"), (15, "u1"), (255, "u1"))]
    df = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(images)], "id int, image binary")
    for r in media.tiles(df, size=2).collect():
        assert (np.load(io.BytesIO(r.tile)) == want).all()


ODD = [b"P5 0 0 255\n", b"P5 0 4 255\n", b"P2 1 1 255 300", b"P2 1 1 255 -3", b"P2 1 1 255 x", b"P5 2 2 70000\n" + bytes(8), b"P5 2 2 0\n" + bytes(4), b"P5 9 9 255\n", b"P5", b"", b"BM", b"BM" + bytes(60), media.encode_bmp(np.zeros((2, 2), np.uint8))[:54] + bytes([0, 0, 0, 0]) + b"\xff" * 8]


def test_odd_images_are_null(spark):
    good = media.encode_pgm(np.arange(64, dtype=np.uint8).reshape(8, 8))
    df = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate([*ODD, good])], "id int, image binary").coalesce(1)
    out = {r.id: r for r in media.tiles(df).collect()}
    assert all(out[i].tile is None and out[i].dhash is None for i in range(len(ODD) - 1)) and out[len(ODD)].tile is not None
