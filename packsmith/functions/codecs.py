"""Lossless codecs by name, with caps that hold while decoding."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import os
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

from packsmith.errors import CorruptPackageError, OutputLimitError, UnsupportedCodecError
from packsmith.functions.scalars import AUTO_CAP_BYTES, AUTO_CAP_RATIO

# The order in which codecs are preferred among equals, and their levels by mode.
PRIORITY = ("zstd", "brotli", "lzma", "bz2", "gzip", "store")
ZSTD_LEVEL = {"fast": 3, "balanced": 12, "max": 19, "ultra": 22, "extreme": 22, "micro_800k": 22}
LZMA_PRESET = {"fast": 1, "balanced": 6, "max": 9, "ultra": 9, "extreme": 9, "micro_800k": 9}
LZMA_DICTIONARY = {1: 1 << 20, 6: 8 << 20, 9: 64 << 20}
BROTLI_QUALITY = {"fast": 4, "balanced": 8, "max": 11, "ultra": 11, "extreme": 11, "micro_800k": 11}
BLOCK = 1 << 20


def _module(name: str):
    try:
        return __import__(name)
    except ImportError:
        return None


def available_codecs() -> list[str]:
    """The codecs that can be used here, preferred ones first."""
    return [c for c in PRIORITY if c not in ("zstd", "brotli") or _module({"zstd": "zstandard"}.get(c, c))]


def compress(data: bytes, codec: str = "auto", mode: str = "balanced") -> bytes:
    codec = available_codecs()[0] if codec.lower() == "auto" else codec.lower()
    if codec == "store":
        return bytes(data)
    if codec == "zstd":
        return _module("zstandard").ZstdCompressor(level=ZSTD_LEVEL.get(mode, 12)).compress(data)
    if codec == "brotli" and (brotli := _module("brotli")):
        return brotli.compress(data, quality=BROTLI_QUALITY.get(mode, 8))
    if codec == "lzma":
        # A dictionary beyond the data's size only costs time to set up.
        preset = LZMA_PRESET.get(mode, 6)
        size = min(LZMA_DICTIONARY[preset], max(1 << 12, 1 << len(data).bit_length()))
        return lzma.compress(data, filters=[{"id": lzma.FILTER_LZMA2, "preset": preset, "dict_size": size}])
    if codec == "bz2":
        return bz2.compress(data, 9)
    if codec == "gzip":
        packer = zlib.compressobj(9, zlib.DEFLATED, 31)
        return packer.compress(data) + packer.flush()
    raise UnsupportedCodecError(f"unknown codec: {codec}")


def resolve_cap(cap: int | None, size: int) -> int:
    if cap is not None and cap < 0:
        raise ValueError("the cap must be positive")
    return cap or max(AUTO_CAP_BYTES, size * AUTO_CAP_RATIO)


def _limited(parts, cap: int) -> bytes:
    out, size = [], 0
    for part in parts:
        size += len(part)
        if size > cap:
            raise OutputLimitError(f"output exceeds {cap} bytes")
        out.append(part)
    return b"".join(out)


def _members(new, data: bytes, cap: int):
    """Decode concatenated streams, at most a block above the cap at once."""
    while data:
        decoder, fed = new(), data
        while not decoder.eof:
            part = decoder.decompress(fed, min(BLOCK, cap + 1))
            fed = b""
            if not part and not decoder.eof and decoder.needs_input:
                raise EOFError("stream is cut")
            yield part
        data = decoder.unused_data


def _gzip(data: bytes, cap: int):
    while data:
        decoder, rest = zlib.decompressobj(31), data
        while not decoder.eof:
            part = decoder.decompress(rest, min(BLOCK, cap + 1))
            rest = decoder.unconsumed_tail
            if not part and not rest and not decoder.eof:
                raise EOFError("stream is cut")
            yield part
        data = decoder.unused_data


def _brotli(brotli, data: bytes, cap: int):
    """Decode a stream, at most a block above the cap at once; without the library's limit, by small steps of input."""
    decoder = brotli.Decompressor()
    if hasattr(decoder, "can_accept_more_data"):
        fed = data
        while not decoder.is_finished():
            part = decoder.process(fed, output_buffer_limit=min(BLOCK, cap + 1))
            if not part and not fed and decoder.can_accept_more_data():
                raise EOFError("stream is cut")
            fed = b""
            yield part
        return
    for at in range(0, len(data), 64):
        yield decoder.process(data[at : at + 64])
    if not decoder.is_finished():
        raise EOFError("stream is cut")


def decompress(data: bytes, codec: str, cap: int | None = None) -> bytes:
    """Decode; OutputLimitError as soon as more than the cap would come out, CorruptPackageError where the data is damaged."""
    codec, limit = codec.lower(), resolve_cap(cap, len(data))
    try:
        if codec == "store":
            return _limited([bytes(data)], limit)
        if codec == "zstd":
            zstd = _module("zstandard")
            reader = zstd.ZstdDecompressor().stream_reader(data, read_across_frames=True)
            size = zstd.frame_content_size(data)
            out = _limited(iter(lambda: reader.read(BLOCK), b""), limit)
            if size >= 0 and len(out) < size:
                raise EOFError("frame is cut")
            return out
        if codec == "brotli" and (brotli := _module("brotli")):
            return _limited(_brotli(brotli, data, limit), limit)
        if codec == "lzma":
            return _limited(_members(lzma.LZMADecompressor, data, limit), limit)
        if codec == "bz2":
            return _limited(_members(bz2.BZ2Decompressor, data, limit), limit)
        if codec == "gzip":
            return _limited(_gzip(data, limit), limit)
    except OutputLimitError:
        raise
    except Exception as e:
        raise CorruptPackageError(f"{codec}: {type(e).__name__}") from e
    raise UnsupportedCodecError(f"unknown codec: {codec}")


class _Parts(io.RawIOBase):
    """An iterator of bytes as a file to read."""

    def __init__(self, parts: Iterable[bytes]) -> None:
        self.parts, self.rest = iter(parts), memoryview(b"")

    def readable(self) -> bool:
        return True

    def readinto(self, room) -> int:
        while not self.rest:
            if (part := next(self.parts, None)) is None:
                return 0
            self.rest = memoryview(part)
        n = min(len(room), len(self.rest))
        room[:n], self.rest = self.rest[:n], self.rest[n:]
        return n


def compress_stream(parts: Iterable[bytes], codec: str = "auto", mode: str = "balanced") -> Iterator[bytes]:
    """The parts of a stream, compressed as they come; what is held does not grow with the stream."""
    codec = available_codecs()[0] if codec.lower() == "auto" else codec.lower()
    if codec == "store":
        yield from map(bytes, parts)
        return
    if codec == "zstd":
        packer = _module("zstandard").ZstdCompressor(level=ZSTD_LEVEL.get(mode, 12)).compressobj()
    elif codec == "lzma":
        preset = LZMA_PRESET.get(mode, 6)
        packer = lzma.LZMACompressor(filters=[{"id": lzma.FILTER_LZMA2, "preset": preset, "dict_size": LZMA_DICTIONARY[preset]}])
    elif codec == "bz2":
        packer = bz2.BZ2Compressor(9)
    elif codec == "gzip":
        packer = zlib.compressobj(9, zlib.DEFLATED, 31)
    else:
        raise UnsupportedCodecError(f"{codec} is not streamed")
    yield from filter(None, map(packer.compress, parts))
    yield packer.flush()


def _zstd_blocks(parts: Iterable[bytes]) -> Iterator[bytes]:
    """Frames without a size do not tell a cut, so a frame of random bytes is put behind them: it comes out last, or the stream was cut.
    Its checksum keeps its own bytes, which a cut block would take as they are, from ending like its content."""
    zstd, mark = _module("zstandard"), os.urandom(16)
    source = io.BufferedReader(_Parts(chain(parts, [zstd.ZstdCompressor(write_checksum=True).compress(mark)])), BLOCK)
    reader, held = zstd.ZstdDecompressor().stream_reader(source, read_across_frames=True), b""
    while part := reader.read(BLOCK):
        held += part
        if len(held) > len(mark):
            yield held[: -len(mark)]
            held = held[-len(mark) :]
    if held != mark:
        raise EOFError("stream is cut")


def decompress_stream(parts: Iterable[bytes], codec: str, cap: int) -> Iterator[bytes]:
    """The stream decoded a block at a time; the same errors as decompress, the cap's as soon as it is passed."""
    codec, size = codec.lower(), 0
    files = {"store": lambda source: source, "lzma": lzma.LZMAFile, "bz2": bz2.BZ2File, "gzip": lambda source: gzip.GzipFile(fileobj=source)}
    if codec != "zstd" and codec not in files:
        raise UnsupportedCodecError(f"{codec} is not streamed")
    try:
        if codec == "zstd":
            blocks = _zstd_blocks(parts)
        else:
            reader = files[codec](io.BufferedReader(_Parts(parts), BLOCK))
            blocks = iter(lambda: reader.read(BLOCK), b"")
        for part in blocks:
            size += len(part)
            if size > cap:
                raise OutputLimitError(f"output exceeds {cap} bytes")
            yield part
    except OutputLimitError:
        raise
    except Exception as e:
        raise CorruptPackageError(f"{codec}: {type(e).__name__}") from e


def sizes(data: bytes, mode: str, codecs: list[str] | None = None) -> dict[str, int]:
    """The encoded size under every codec that works."""
    return {c: len(compress(data, c, mode)) for c in codecs or available_codecs()}


def best_of(data: bytes, mode: str, codecs: list[str] | None = None) -> tuple[str, bytes]:
    """The codec with the smallest output, and that output; the preferred one of equals."""
    found = [(c, compress(data, c, mode)) for c in codecs or available_codecs()]
    if not found:
        raise UnsupportedCodecError("no codec to choose from")
    return min(found, key=lambda x: len(x[1]))
