from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest

from tessera.llm import media


def test_text_round_trip(docs, rows, none):
    got = media.text_tiles(docs).collect()
    want = []
    for i, t, *_ in rows:
        raw = (t or "").encode()
        payload = raw + b"\0" * (max(1, -(-len(raw) // 64)) * 64 - len(raw))
        want.append((i or -1, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    assert sorted((r.doc_id or -1, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == sorted(want)
    by_payload = {}
    for r in got:
        assert by_payload.setdefault(r.payload_sha256, (r.media_bytes, r.media_sha256, r.feature)) == (r.media_bytes, r.media_sha256, r.feature)
    assert media.text_tiles(none).collect() == []


def test_netpbm_kinds():
    grey = np.arange(6, dtype=np.uint8).reshape(2, 3) * 40
    assert (media.decode(b"P2 # c\n3 2\n255\n" + b" ".join(b"%d" % v for v in grey.ravel())) == grey).all()
    assert (media.decode(media.encode_pgm(grey)) == grey).all()
    rgb = np.arange(18, dtype=np.uint8).reshape(2, 3, 3)
    assert (media.decode(b"P6\n3 2\n255\n" + rgb.tobytes()) == rgb).all()
    assert (media.decode(b"P3\n3 2\n255\n" + b" ".join(b"%d" % v for v in rgb.ravel())) == rgb).all()
    bits = np.array([[1, 0, 1], [0, 1, 1]])
    assert (media.decode(b"P1\n3 2\n1 0 1\n011") == bits).all()
    assert (media.decode(b"P4\n3 2\n" + np.packbits(bits.astype(np.uint8), axis=1).tobytes()) == bits).all()
    wide = np.array([[1, 300, 65535]], np.uint16)
    assert (media.decode(b"P5\n3 1\n65535\n" + wide.astype(">u2").tobytes()) == wide).all()


def test_bmp_round_trip():
    image = np.random.default_rng(1).integers(0, 256, (5, 7, 3)).astype(np.uint8)
    assert (media.decode(media.encode_bmp(image)) == image).all()


@pytest.mark.parametrize("blob", [b"", b"P7", b"P5\n3 2\n255\nab", b"BM" + bytes(60), b"P5 0 0 255 ", b"P2 2 2 9 1 2"])
def test_broken_media_is_an_error(blob):
    with pytest.raises(ValueError):
        media.decode(blob)


def test_area_resize_equals_brute_force():
    rng = np.random.default_rng(2)
    for h, w, th, tw in ((6, 8, 3, 4), (5, 7, 2, 3), (2, 3, 4, 5), (1, 1, 3, 2)):
        image = rng.integers(0, 256, (h, w)).astype(float)
        big = np.repeat(np.repeat(image, th, 0), tw, 1)
        want = big.reshape(th, h, tw, w).mean(axis=(1, 3))
        assert np.allclose(media.area_resize(image, th, tw), want)


def test_tiles_and_errors(spark):
    image = np.tile(np.arange(0, 250, 5, dtype=np.uint8), (40, 1))
    rows = [(1, bytearray(media.encode_pgm(image))), (2, None), (3, bytearray(b"junk")), (1, bytearray(media.encode_pgm(image)))]
    got = media.media_tiles(spark.createDataFrame(rows, "id long, media binary"), "id", "media", 8).collect()
    assert [r.error for r in got if r.id == 2] == ["no media"]
    assert all(r.tile is None for r in got if r.id == 3)
    one = [r for r in got if r.id == 1]
    assert len({(bytes(r.tile), r.feature) for r in one}) == 1 and one[0].feature == "f" * 16
    assert media.from_npy(bytes(one[0].tile)).shape == (8, 8)


def test_a_pixel_outside_its_palette_is_an_error_of_its_row(spark):
    head = lambda n: n.to_bytes(4, "little")
    bmp = lambda pixel: b"BM" + head(0) + head(0) + head(54 + 8) + head(40) + head(1) + head(1) + b"\1\0\x08\0" + head(0) * 4 + head(2) + head(0) + bytes(8) + bytes([pixel, 0, 0, 0])
    rows = spark.createDataFrame([(1, bytearray(bmp(1))), (2, bytearray(bmp(7)))], "k long, m binary")
    got = {r.k: r.error for r in media.media_tiles(rows, "k", "m", 4).collect()}
    assert got == {1: None, 2: "BMP pixel outside its palette"}
