"""Zstandard dictionaries built from samples of any number and size."""

from __future__ import annotations

import zstandard


def build_dictionary(samples: list[bytes], size: int, segment: int) -> bytes:
    """A dictionary of at most ``size`` bytes learned from ``samples``; empty only if they are.

    It shrinks with the samples, to an eighth of their bytes.  What is too little or too
    alike for the trainer becomes the dictionary itself (raw content): the samples'
    last bytes, the nearest to what follows."""
    total = sum(map(len, samples))
    fit = min(size, total // 8)
    if len(samples) >= 8 and fit >= 1024:
        try:
            return zstandard.train_dictionary(fit, samples, k=min(segment, fit // 4), d=8).as_bytes()
        except zstandard.ZstdError:  # the trainer finds nothing that repeats, or nothing else
            pass
    tail, room = [], size
    for sample in reversed(samples):
        if room <= 0:
            break
        tail.append(sample[-room:])
        room -= len(tail[-1])
    return b"".join(reversed(tail))


def load_dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    """Trained or raw content, told apart by the leading magic number."""
    return zstandard.ZstdCompressionDict(raw) if raw else None
