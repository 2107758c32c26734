"""Transforms, codecs and chunks: plain definitions, round trips and damaged input."""

import math
import random
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from packsmith import errors
from packsmith.functions import chunking, codecs, packages, race, transforms

rng = random.Random(42)
ADVERSARIAL = [b"", b"A", b"Z" * 9999, bytes(4096), b"ab" * 6000, b"abc" * 777, bytes(range(256)) * 50, b"some prose that is not periodic at all, but prose", rng.randbytes(3000), rng.randbytes(5001)]


@pytest.mark.parametrize("name", list(transforms.ENCODERS))
@pytest.mark.parametrize("data", ADVERSARIAL, ids=range(len(ADVERSARIAL)))
def test_round_trips(name, data):
    assert transforms.invert_transform(transforms.apply_transform(data, name), name) == data


@given(st.binary(max_size=300))
@settings(max_examples=150, deadline=None)
def test_round_trips_of_any_bytes(data):
    for name in transforms.ENCODERS:
        assert transforms.invert_transform(transforms.apply_transform(data, name), name) == data


@given(st.binary(max_size=120))
@settings(max_examples=100, deadline=None)
def test_plain_definitions(data):
    prev = [0, *data[:-1]]
    assert transforms.delta8_encode(data) == bytes((b - a) % 256 for a, b in zip(prev, data, strict=False))
    assert transforms.xor8_encode(data) == bytes(b ^ a for a, b in zip(prev, data, strict=False))
    if data:
        padded = data + b"\0" * (len(data) % 2)
        v = struct.unpack(f"<{len(padded) // 2}h", padded)
        steps = [v[0]] + [(b - a + 32768) % 65536 - 32768 for a, b in zip(v, v[1:], strict=False)]
        assert transforms.delta16le_encode(data) == bytes([len(data) % 2]) + struct.pack(f"<{len(v)}h", *steps)
        rot = sorted(range(len(data)), key=lambda i: (data[i:] + data[:i], -i))
        assert transforms.bwt_encode_block(data) == (rot.index(0), bytes(data[i - 1] for i in rot))


def plain_filter(data, stride):
    rows = [data[i : i + stride].ljust(stride, b"\0") for i in range(0, len(data), stride)]
    out, prev = struct.pack(">IHI", len(data), stride, len(rows)), bytes(stride)
    for row in rows:
        best = None
        for f in range(5):
            own = bytearray()
            for i, x in enumerate(row):
                a, b, c = (row[i - 1] if i else 0), prev[i], (prev[i - 1] if i else 0)
                p = a + b - c
                guess = [0, a, b, (a + b) >> 1, min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]][f]
                own.append((x - guess) % 256)
            score = sum(min(v, 256 - v) if v else 0 for v in own)
            if best is None or score < best[0]:
                best = (score, bytes([f]) + bytes(own))
        out, prev = out + best[1], row
    return out


@given(st.binary(min_size=1, max_size=200), st.sampled_from([1, 2, 3, 16, 64]))
@settings(max_examples=80, deadline=None)
def test_filters_match_plain_definition(data, stride):
    assert transforms.filters_encode(data, stride) == plain_filter(data, stride)


def test_stride_of_a_picture():
    row = rng.randbytes(64)
    assert transforms.pick_stride(row * 200) == 64
    assert transforms.pick_stride(b"") == transforms.pick_stride(b"x") == 1


@pytest.mark.parametrize("bad", [b"", b"123", struct.pack(">II", 1, 5), struct.pack(">III", 1, 1, 0) + b"xy", struct.pack(">I", 0) + b"tail"])
def test_damaged_bwt(bad):
    with pytest.raises(ValueError):
        transforms.bwt_decode(bad)


@pytest.mark.parametrize("bad", [b"", b"12345678", struct.pack(">IHI", 4, 4, 1), struct.pack(">IHI", 1, 1, 1) + b"\x05a", struct.pack(">IHI", 1, 1, 1) + b"\x00ab"])
def test_damaged_filters(bad):
    with pytest.raises(ValueError):
        transforms.filters_decode(bad)


def test_dictionaries():
    data = b"".join(b'{"id": %d, "name": "user%d", "active": true}\n' % (i, i * 7) for i in range(3000))
    slices = transforms.pick_slices(data)
    assert len(slices) == 24 and transforms.pick_slices(data[:32767]) == []
    dictionary = transforms.train_dictionary(slices)
    packed = transforms.pack_dictionary(dictionary, transforms.dict_compress(data, dictionary))
    back, body = transforms.unpack_dictionary(packed)
    assert back == dictionary and transforms.dict_decompress(body, back, len(data)) == data
    for bad in (b"", b"\0\0\0\x09abc"):
        with pytest.raises(ValueError):
            transforms.unpack_dictionary(bad)
    assert transforms.train_dictionary(slices[:3]) is None
    with pytest.raises(ValueError):
        transforms.xor_with(b"a", b"ab")


@pytest.mark.parametrize("codec", codecs.available_codecs())
def test_codecs(codec):
    for data in ADVERSARIAL:
        assert codecs.decompress(codecs.compress(data, codec), codec) == data
    big = codecs.compress(b"x" * 3_000_000, codec)
    with pytest.raises(errors.OutputLimitError):
        codecs.decompress(big, codec, 10)
    if codec != "store":
        for bad in (big[: len(big) // 2], b"garbage that is no stream", bytes([big[0] ^ 1]) + big[1:]):
            with pytest.raises(errors.CorruptPackageError):
                codecs.decompress(bad, codec)


def test_codec_choice():
    assert codecs.best_of(rng.randbytes(5000), "fast")[0] == "store"
    assert codecs.available_codecs()[-1] == "store" and "lzma" in codecs.available_codecs()
    with pytest.raises(errors.UnsupportedCodecError):
        codecs.compress(b"", "odd")
    with pytest.raises(ValueError):
        codecs.resolve_cap(-1, 1)


@pytest.mark.parametrize("codec", ["zstd", "lzma", "bz2", "gzip", "store"])
def test_streams(codec):
    """Parts of any size in and out; two streams in a row; caps while decoding; damage."""
    data = (b"a line of a long stream\n" * 200_000) + rng.randbytes(50_000)
    parts = [data[k : k + 70_001] for k in range(0, len(data), 70_001)]
    packed = b"".join(codecs.compress_stream(parts, codec))
    assert codecs.decompress(packed, codec, len(data)) == data
    assert codec == "store" or len(packed) < len(data) / 10
    small = [packed[k : k + 777] for k in range(0, len(packed), 777)]
    blocks = list(codecs.decompress_stream(small, codec, len(data)))
    assert b"".join(blocks) == data and max(map(len, blocks)) <= codecs.BLOCK + 16
    assert b"".join(codecs.decompress_stream([*small, packed], codec, 2 * len(data))) == 2 * data
    assert b"".join(codecs.decompress_stream(codecs.compress_stream([], codec), codec, 10)) == b""
    given = []
    with pytest.raises(errors.OutputLimitError):
        given.extend(codecs.decompress_stream(small, codec, 1000))
    assert sum(map(len, given)) <= 1000
    for cut in (len(packed) // 2, len(packed) - 1) if codec != "store" else ():
        with pytest.raises(errors.CorruptPackageError):
            list(codecs.decompress_stream([packed[:cut]], codec, len(data)))
    with pytest.raises(errors.UnsupportedCodecError):
        list(codecs.decompress_stream([b""], "odd", 1))


def plain_chunks(data, least, average, most):
    h = start = 0
    ends = []
    for i, b in enumerate(data):
        h = (((h << 5) ^ (h >> 27)) ^ b) & 0xFFFFFFFF
        n = i + 1 - start
        if n >= most or n >= least and h & (average - 1) == 0:
            ends.append(i + 1)
            start, h = i + 1, 0
    return ends + [len(data)] * (start < len(data))


@pytest.mark.parametrize("sizes", [(64, 256, 1024), (1, 1, 1), (10, 16, 50), (3, 4096, 9000)])
def test_chunks(sizes):
    for data in [*ADVERSARIAL, rng.randbytes(40_000)]:
        assert chunking.boundaries(data, *sizes) == plain_chunks(data, *sizes)
        gear = chunking.boundaries(data, *sizes, mode="gear")
        assert (gear[-1] if gear else 0) == len(data) and all(b - a <= sizes[2] for a, b in zip([0, *gear], gear, strict=False))
    with pytest.raises(ValueError):
        chunking.boundaries(b"x", 1, 3, 5)


def test_gear_lines_up_after_an_insertion():
    data = rng.randbytes(200_000)
    share = {}
    for mode in ("compat", "gear"):
        parts = [{x[a:b] for a, b in zip([0, *e[:-1]], e, strict=True)} for x in (data, b"!" + data) for e in [chunking.boundaries(x, 256, 1024, 8192, mode)]]
        share[mode] = len(parts[0] & parts[1]) / len(parts[0])
    assert share["gear"] > 0.95 and share["compat"] < 0.2


def test_trials():
    wave = struct.pack("<30000h", *[int(12000 * math.sin(i / 40)) for i in range(30000)])
    rows = race.trials(wave, race.CANDIDATES["audio_wav"])
    assert [r["transform"] for r in rows] == ["none", "delta16le", "delta8"] and {r["tried"] for r in rows} == {60000}
    assert min(rows, key=lambda r: r["size"] / r["tried"])["transform"] == "delta16le"
    text = b"some words and more words " * 6000
    rows = {r["transform"]: r for r in race.trials(text, race.CANDIDATES["text"])}
    assert rows["bwt"]["tried"] == race.BWT_SAMPLE and rows["none"]["tried"] == race.SELECT_SAMPLE
    assert rows["none"]["size"] == len(codecs.compress(text[: race.SELECT_SAMPLE], race.trial_codec(), "fast"))
    assert rows["pngfilter"]["stride"] == transforms.pick_stride(text[: race.SELECT_SAMPLE])
    assert "zdict" not in {r["transform"] for r in race.trials(text[:60000], race.CANDIDATES["text"])}
    assert race.trials(b"", race.CANDIDATES["text"]) == []


def test_packages():
    blocks = [rng.randbytes(70_000) for _ in range(2)]
    data = b"".join(blocks[k % 2] for k in range(12)) + rng.randbytes(5000)
    meta, package = packages.encode(data, "a.bin", "generic", "fast", chunk_sizes=(1024, 4096, 16384))
    assert packages.decode(package, len(data) + 1)[1:] == (data, True)
    assert meta["orig_size"] == len(data)
    text = b"id,name,score\n" + b"".join(b"%d,user%d,%d\n" % (i, i, i * 37 % 101) for i in range(6000))
    plain = packages.encode(text, "a.csv", "csv", "fast")[1]
    for name in race.CANDIDATES["csv"]:
        adv = packages.encode(text, "a.csv", "csv", "fast", chosen={"transform": name, "codec": "zstd", "stride": 8 if name == "pngfilter" else None})[1]
        assert len(adv) <= len(plain) + 60 and packages.decode(adv)[1] == text
    meta, package = packages.encode(rng.randbytes(9000), "a", "generic", "fast", chosen={"transform": "none", "codec": "store", "stride": None})
    assert meta["codec"] == "store"
    assert packages.dedup_body(b"abc", "zstd", "fast") is None
    body = packages.dedup_body(data, "zstd", "fast", (1024, 4096, 16384))
    assert packages.restore_dedup(body, len(data)) == data
    with pytest.raises(errors.OutputLimitError):
        packages.restore_dedup(body, 100)
    for cut in (0, 3, 10, len(body) // 2, len(body) - 1):
        with pytest.raises(errors.CorruptPackageError):
            packages.restore_dedup(body[:cut], len(data))


@pytest.mark.parametrize("bad", [b"", b"TQZ2", b"XXXX" + bytes(20), b"TQZ1\0\0\0\x02{}", b"TQZ2\0\0\0\x05notjs", b"TQZ2\xff\xff\xff\xff{}", b"TQZ2\0\0\0\x02[]", b"TQZ2\0\0\0\x09{}"])
def test_damaged_headers(bad):
    with pytest.raises(errors.CorruptPackageError):
        packages.parse(bad)


def test_refusals():
    make = lambda **k: packages.frame({"codec": "store", "transform": "none"} | k, b"data")
    assert packages.decode(make())[1:] == (b"data", None)
    assert packages.decode(make(sha256="0" * 64))[2] is False
    for bad in (make(transform="odd"), make(codec="delta+zstd"), make(codec="dedup+zstd", transform="bwt"), make(codec="odd")):
        with pytest.raises(errors.UnsupportedCodecError):
            packages.decode(bad)
    for bad in (make(transform="bwt"), make(transform="zdict"), make(transform="pngfilter")):
        with pytest.raises(errors.CorruptPackageError):
            packages.decode(bad)
    meta, package, hit = packages.to_target(b"hello " * 5000, "x", 4000)
    assert hit and packages.decode_any(package)[1] == b"hello " * 5000
    assert packages.to_target(rng.randbytes(9000), "x", 10)[2] is False
    assert np.frombuffer(package[:4], np.uint8).tobytes() == packages.MAGIC_V1
