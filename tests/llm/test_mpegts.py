import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from docloom.llm import mpegts


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 150, 170, 171, 184, 16383, 16384, 16385, 50_000, 300_000])
def test_round_trip(n):
    payload = mpegts.padded(random.Random(n).randbytes(n))
    assert len(payload) % 64 == 0 and payload
    media = mpegts.mux(payload)
    found = mpegts.demux(media)
    assert found.payload == payload
    assert len(media) % 188 == 0 and found.stream_type == mpegts.STREAM_TYPE
    assert all(found.random_access) and found.timestamps == [k * mpegts.TICKS for k in range(-(-len(payload) // mpegts.PES_BYTES))]


def test_large_timestamps():
    for t in (0, 1, 3600, (1 << 33) - 1, 0x123456789):
        a, b, c = __import__("struct").unpack(">BHH", mpegts._pts(t))
        assert (a & 0x0E) << 29 | (b & 0xFFFE) << 14 | c >> 1 == t


def test_damage_is_found():
    media = bytearray(mpegts.mux(mpegts.padded(b"x" * 5000)))
    for bad in (media[:-1], media[: 188 * 5] + media[188 * 6 :], b"\0" + media[1:], media[:20] + b"\1" + media[21:]):
        with pytest.raises(ValueError):
            mpegts.demux(bytes(bad))


def packet(pid, counter, payload, start=False, field=None):
    """One packet; a short payload is filled by an adaptation field."""
    room = 184 - len(payload)
    if field is None and room:
        field = b"\0" * (room > 1)
    body = b""
    if field is not None:
        body = bytes([room - 1]) + field + b"\xff" * (room - 1 - len(field))
    flag = (0x20 if field is not None else 0) | (0x10 if payload else 0)
    return bytes([0x47, (0x40 if start else 0) | pid >> 8, pid & 255, flag | counter & 15]) + body + payload


def pes(data, time=None, size=True):
    head = b"\x84\x80\x05" + mpegts._pts(time) if time is not None else b"\x84\0\0" + b""
    return b"\0\0\1\xbd" + (len(head) + len(data) if size else 0).to_bytes(2, "big") + head + data


def test_streams_that_others_write():
    """A table over two packets, two programmes, null packets, packets without payload or sent twice, a jump of the counter, no length, no timestamp."""
    pat = mpegts._section(0, 7, b"".join(n.to_bytes(2, "big") + (0xE000 | p).to_bytes(2, "big") for n, p in ((0, 0x10), (1, 0x30), (2, 0x31))))
    long = b"\x05\xfa" + b"z" * 250  # a descriptor
    first = mpegts._section(2, 1, (0xE100).to_bytes(2, "big") + (0xF000 | len(long)).to_bytes(2, "big") + long + b"\x06\xe1\x00\xf0\x00" + b"\x0f\xe1\x01\xf0\x03\x0a\x01\x00")
    second = mpegts._section(2, 2, b"\xe1\x02\xf0\x00\x1b\xe1\x02\xf0\x00")
    null = packet(0x1FFF, 0, b"\xff" * 184)
    table = lambda pid, s: b"".join(packet(pid, i, part.ljust(184, b"\xff"), i == 0) for i, part in enumerate([(b"\0" + s)[k : k + 184] for k in range(0, len(s) + 1, 184)]))
    a, b, c = pes(b"a" * 300, 5), pes(b"b" * 100, size=False), pes(b"c" * 50, 9)
    media = null + table(0, pat) + table(0x30, first) + table(0x31, second)
    media += packet(0x100, 3, a[:184], True) + null + packet(0x101, 9, c, True, b"\x40") + packet(0x100, 4, a[184:]) * 2
    media += packet(0x100, 4, b"", field=b"\x80") + packet(0x100, 11, b, True, b"\x40") + packet(0x102, 0, pes(b"", 1), True)
    assert [x[:2] for x in mpegts.streams(media)[2]] == [(1, 0x06), (1, 0x0F), (2, 0x1B)]
    one, two, three = (mpegts.demux(media, k) for k in range(3))
    assert (one.payload, one.timestamps, one.random_access, one.pid) == (b"a" * 300 + b"b" * 100, [5, None], [False, True], 0x100)
    assert (two.payload, two.timestamps, two.random_access, two.stream_type) == (b"c" * 50, [9], [True], 0x0F)
    assert (three.payload, three.timestamps) == (b"", [1])
    for bad in (media + packet(0x100, 14, b"x"), media + packet(0x100, 11, b"x" * 184), media + b"\x47\x80" + bytes(186)):
        with pytest.raises(ValueError):
            mpegts.demux(bad)


def test_known_crc():
    assert mpegts.crc32_mpeg(b"123456789") == 0x0376E6E7


def test_rows(spark):
    rows = [(1, None), (2, ""), (3, "é" * 70), (3, "é" * 70), (None, "x"), (5, "y" * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("media", F.lit(1))
    got = mpegts.digests(df).collect()
    assert len(got) == len(rows)
    for r in got:
        raw = {1: "", 2: "", 3: "é" * 70, None: "x", 5: "y" * 200_000}[r["doc_id"]].encode()
        payload = mpegts.padded(raw)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r["media_sha256"] == hashlib.sha256(mpegts.mux(payload)).hexdigest()
    assert mpegts.store(df).count() == len(rows)
    assert mpegts.digests(df.limit(0)).collect() == []
