"""Transforms as entries of a race: how much of a sample each is tried on, its settings, and its encoding."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from packsmith.errors import PackError, UnsupportedCodecError
from packsmith.functions import codecs, transforms

# Bytes of a sample, those that the block sort is tried on, the least for a dictionary, and a trial dictionary's size.
SELECT_SAMPLE, BWT_SAMPLE, DICT_LEAST, RACE_DICT = 128 << 10, 64 << 10, 64 << 10, 8192
# The transforms that are tried for each kind, in the order that decides among equals.
CANDIDATES = {
    "text": ["none", "delta8", "xor8", "bwt", "pngfilter", "zdict"],
    "csv": ["none", "delta8", "xor8", "bwt", "pngfilter", "zdict"],
    "json": ["none", "delta8", "xor8", "bwt", "zdict"],
    "generic": ["none", "delta8", "xor8", "bwt", "pngfilter", "zdict"],
    "audio_wav": ["none", "delta16le", "delta8"],
    "executable": ["none", "delta8", "bwt", "xor8"],
    "image": ["none"],
    "video": ["none"],
    "audio": ["none"],
    "archive": ["none"],
    "pdf": ["none"],
    "office": ["none"],
}

def trial_codec() -> str:
    return next(c for c in ("zstd", "gzip") if c in codecs.available_codecs())


def with_dictionary(data: bytes, level: str, size: int) -> tuple[bytes, int]:
    """The dictionary and the data compressed with it, and the dictionary's size."""
    found = transforms.train_dictionary(transforms.pick_slices(data), size)
    if found is None:
        raise UnsupportedCodecError("no dictionary could be trained")
    return transforms.pack_dictionary(found, transforms.dict_compress(data, found, codecs.ZSTD_LEVEL[level])), len(found)


@dataclass(frozen=True)
class Entry:
    """One transform: its part of a sample, the least it takes, and how it gives the bytes whose number counts, with its settings."""

    size_of: Callable[[bytes], tuple[int, dict]]
    most: int = SELECT_SAMPLE
    least: int = 1


def _encoded(name: str, settings: Callable[[bytes], dict] = lambda data: {}) -> Callable[[bytes], tuple[int, dict]]:
    def size_of(data: bytes) -> tuple[int, dict]:
        own = settings(data)
        return len(codecs.compress(transforms.apply_transform(data, name, own), trial_codec(), "fast")), own

    return size_of


def _with_trial_dictionary(data: bytes) -> tuple[int, dict]:
    body, size = with_dictionary(data, "fast", RACE_DICT)
    return len(body), {"dict_size": size}


ENTRIES = {name: Entry(_encoded(name)) for name in ("none", "delta8", "xor8", "delta16le")} | {
    "bwt": Entry(_encoded("bwt"), most=BWT_SAMPLE),
    "pngfilter": Entry(_encoded("pngfilter", lambda data: {"stride": transforms.pick_stride(data)})),
    "zdict": Entry(_with_trial_dictionary, least=DICT_LEAST),
}


def trials(sample: bytes, names: list[str]) -> list[dict]:
    """A row for each named transform that works on the sample; one that fails gives none."""
    rows = []
    for name in names:
        entry, own = ENTRIES[name], sample[: ENTRIES[name].most]
        if len(own) >= entry.least:
            try:
                size, settings = entry.size_of(own)
            except (PackError, ValueError, ArithmeticError, MemoryError):
                continue
            rows.append({"transform": name, "tried": len(own), "size": size, "stride": settings.get("stride"), "dict_size": settings.get("dict_size")})
    return rows


def transformed(data: bytes, name: str, stride: int | None, level: str) -> tuple[str, dict, bytes]:
    """(codec, settings, body) of whole data under a transform that was chosen on a sample of it."""
    if name == "zdict":
        body, size = with_dictionary(data, level, transforms.DICT_BYTES)
        return "zstd", {"dict_size": size}, body
    settings = {} if stride is None else {"stride": stride}
    encoded = transforms.apply_transform(data, name, settings)
    codec, body = codecs.best_of(encoded[:SELECT_SAMPLE], level)
    return codec, settings, codecs.compress(encoded, codec, level) if len(encoded) > SELECT_SAMPLE else body
