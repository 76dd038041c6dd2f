"""Hashed word shingles of whole texts, for Arrow string arrays, with numpy.

Words are runs of other than ASCII white space, A-Z lower-cased. A word's hash runs over its bytes eight at a time, each step a
one-to-one mixing of the state and these bytes, from a state that depends on the key and the word's length: it has no algebraic structure
that equates words, unlike a polynomial modulo 2**64. Words over LONG bytes go by BLAKE2b. A shingle's hash combines those of its words.

What is compared afterwards are these 64-bit hashes. Two given shingles share one with a probability of 2**-64; among N distinct ones
about N**2 / 2**65 pairs do, which isn't never for 10**10 and more. A false link takes coincidences in 80 % of two sets, so it is
sets of one shingle that need more: they have a name of 128 bits (see one_shingle_names).
"""

from __future__ import annotations

import hashlib

import numpy as np

BASE = 0x9E3779B97F4A7C15
KEY = 0x2545F4914F6CDD1D
LONG = 256  #: bytes of a word from which on it is hashed on its own
CHUNK = 1 << 19  #: bytes of text hashed at a time, at least one document


def mix(x, factor: int = 0xD6E8FEB86659FD93):
    f = np.uint64(factor)
    x = x ^ (x >> np.uint64(32))
    x = x * f
    x ^= x >> np.uint64(32)
    x *= f
    x ^= x >> np.uint64(32)
    return x


def _word_hashes(words) -> np.ndarray:
    buffers = words.buffers()
    kind = np.int64 if str(words.type).startswith("large") else np.int32
    o = np.frombuffer(buffers[1], kind)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[o[0] : o[-1]] if len(words) and buffers[2] else np.zeros(0, np.uint8)
    o = o - o[0]
    size = np.diff(o)
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 8,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    out = mix(size.astype(np.uint64) * np.uint64(BASE) ^ np.uint64(KEY))
    some, at, left = np.arange(len(size)), o[:-1], size
    while len(some):
        bits = (np.minimum(left, 8) * 8).astype(np.uint64)
        block = eight[at] & (np.uint64(2**64 - 1) >> ((np.uint64(64) - bits) & np.uint64(63)))
        out[some] = mix(out[some] ^ block) + np.uint64(BASE)
        more = (left > 8) & (left <= LONG) if len(some) == len(size) else left > 8
        some, at, left = some[more], at[more] + 8, left[more] - 8
    for k in np.flatnonzero(size > LONG).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[o[k] : o[k + 1]].tobytes(), digest_size=8).digest(), "little")
    return out


def one_shingle_names(texts, words: int) -> list[bytes]:
    """16 bytes for the first shingle of each text."""
    import pyarrow.compute as pc

    return [hashlib.blake2b(b" ".join(t.split(None, words)[:words]), digest_size=16).digest() for t in pc.ascii_lower(texts).cast("binary").to_pylist()]


def _sets(texts, words: int) -> list[np.ndarray]:
    import pyarrow.compute as pc

    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, ends = parts.flatten(), parts.offsets.to_numpy().astype(np.int64)
    ends = ends - ends[0]
    kept = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not kept.all():  # white space at an end of a text leaves an empty word there
        ends = np.concatenate([[0], np.cumsum(kept)])[ends]
        flat = flat.filter(kept)
    w = _word_hashes(flat)
    size = max(0, len(w) - words + 1)
    h = w[:size].copy()
    for j in range(1, words):
        h *= np.uint64(BASE)
        h ^= h >> np.uint64(29)
        h += w[j : j + size]
    h = mix(h)
    out = []
    for s, e in zip(ends[:-1].tolist(), ends[1:].tolist()):
        if e - s >= words:
            x = np.sort(h[s : e - words + 1])
            out.append(x[np.concatenate(([True], x[1:] != x[:-1]))])
        elif e > s:
            one = np.uint64(e - s)
            for v in w[s:e]:
                one = np.uint64((int(one) * BASE + int(v)) % (1 << 64))
            out.append(mix(np.array([one], np.uint64), 0xA0761D6478BD642F))
        else:
            out.append(h[:0])
    return out


def shingle_sets(texts, words: int = 5):
    """For each text of an Arrow array: its distinct shingle hashes in ascending order (a short text is one shingle, an empty one none)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = pc.fill_null(texts, "")
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    before = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy())])
    s = 0
    while s < len(texts):
        e = max(s + 1, int(np.searchsorted(before, before[s] + CHUNK, "right")) - 1)
        yield from _sets(texts.slice(s, e - s), words)
        s = e
