"""Texts as compressed bytes while they travel through a shuffle."""

from __future__ import annotations

import zstandard

LEVEL = 3


def unpacked(frames: list[bytes]) -> list[bytes]:
    return [zstandard.ZstdDecompressor().decompress(z) for z in frames]
