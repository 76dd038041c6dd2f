"""What the operators share: written intermediates, word counts and the byte-level BPE codec."""

from __future__ import annotations

import sys
from array import array
from collections.abc import Iterator
from operator import attrgetter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.workspace import Workspace

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: A table is broadcast only when it is counted first and has at most this many narrow rows (ids and a few numbers, so under ~100 MB).
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast if its counted rows allow it; beyond the limit the plain shuffle join with AQE's skew handling stays."""
    return F.broadcast(df) if rows <= limit else df


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def rows(batch, *columns: str, at_once: int = 256) -> Iterator[tuple]:
    """The rows of an Arrow batch as Python values, few at a time: texts are not all held twice."""
    for k in range(0, batch.num_rows, at_once):
        part = batch.slice(k, at_once)
        yield from zip(*(part.column(c).to_pylist() for c in columns))


def release() -> None:
    """Hands the memory that a Python worker has freed back to the system: workers outlive their tasks."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


LITTLE = sys.byteorder == "little"
LIMIT = 600_000  #: words of a generation of the codec's cache; the older one goes when the newer one is full


class BpeCodec:
    """ids of byte_bpe_50k.json for whole texts, from the tokenizers library's BPE model.

    As in the library, strings of added tokens become their ids and part the text. What lies between is cut at single spaces and
    line feeds that stand between two other than white-space characters: the vocabulary's split pattern always starts a piece at such a
    space, and makes such a line feed a piece of its own, so the ids of the text are those of its words. Other texts are cut by the pattern
    alone. Words are kept in a bounded cache of two generations, as natural text repeats its words.
    """

    def __init__(self, path: str | None = None):
        import json

        import public_tokenizers
        import regex
        from tokenizers.models import BPE

        with open(path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
            whole = json.load(f)
        model = whole["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.tokenize = BPE(vocab=model["vocab"], merges=merges, cache_capacity=0).tokenize
        self.alone = {x for x in model["vocab"] if len(x) == 1} - {x for a, b in merges for x in (a[-1], b[0])}  #: no merge joins them to what lies before or behind
        added = {t["content"]: t for t in whole["added_tokens"]}
        if any(t[flag] for t in added.values() for flag in ("lstrip", "rstrip", "single_word")):
            raise ValueError("added tokens that look at their neighbours are not supported")
        self.added = {name: _bytes([t["id"]]) for name, t in added.items()}
        self.size = max([*model["vocab"].values(), *(t["id"] for t in added.values())]) + 1
        self.part = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.split = regex.compile(public_tokenizers.PATTERN)
        # the byte alphabet of such vocabularies: printable bytes stand for themselves, the others for code points from 256 on
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.bytes = {b: b for b in own} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in set(own))}
        self.space = chr(self.bytes[32])
        self.words = _Words(self)
        self.feed, self.marks = self.piece("\n"), {m: self.piece(m) for m in MARKS}

    def _ids(self, coded: str) -> bytes:
        return _bytes(list(map(ID, self.tokenize(coded))))

    def piece(self, piece: str) -> bytes:
        """ids of one piece of the pattern."""
        if piece.isascii() and piece.isalpha():
            return self._ids(piece)
        return self._ids(piece.encode().decode("latin-1").translate(self.bytes))

    def word(self, word: str) -> bytes:
        """A word that follows a space, or the start of a line. Letters, or such with a mark behind them, are told without the pattern;
        letters beyond U+024F aren't, as Unicode versions differ there."""
        start = word[0] == "\n"
        body = word[1:] if start else word
        marked = body[-1:] in MARKS and len(body) > 1
        letters = body[:-1] if marked else body
        if letters.isalpha() and (letters.isascii() or max(letters) < "\u0250"):
            known = (self.words.get(letters) or self.words.old.get(letters)) if marked and not start else None
            if known is None:
                coded = letters if letters.isascii() else letters.encode().decode("latin-1").translate(self.bytes)
                known = self.feed + self._ids(coded) if start else self._ids(self.space + coded)
            return known + self.marks[body[-1]] if marked else known
        return self.feed + self._any(body) if start else self._any(" " + word)

    def _any(self, text: str) -> bytes:
        return b"".join(map(self.piece, self.split.findall(text)))

    def _plain(self, text: str) -> bytes:
        """A text without added tokens."""
        first, *rest = text.replace("\n", " \n").split(" ")
        try:
            if not first or first[-1] in SPACES:
                raise _Spaces
            return self._any(first) + b"".join(map(self.words.__getitem__, rest))
        except _Spaces:
            return self._any(text)

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 16-bit ids (the vocabulary has under 65,536)."""
        if not text:
            return b""
        if not any(a in text for a in self.added):
            return self._plain(text)
        out, at = [], 0
        for m in self.part.finditer(text):
            out += [self._plain(text[at : m.start()]) if m.start() > at else b"", self.added[m[0]]]
            at = m.end()
        return b"".join([*out, self._plain(text[at:]) if at < len(text) else b""])


def _bytes(ids: list[int]) -> bytes:
    got = array("H", ids)
    if not LITTLE:
        got.byteswap()
    return got.tobytes()


ID = attrgetter("id")
MARKS = frozenset(".,;:!?")
#: Every character that some version of Unicode counts as white space.
SPACES = frozenset(c for c in map(chr, range(0x3001)) if c.isspace() or c == "\u180e")


class _Spaces(Exception):
    """The text has a space or line feed beside other white space, so it can't be cut there."""


class _Words(dict):
    """ids of words that follow a single space, or a line feed that stands before the word."""

    def __init__(self, bpe: BpeCodec):
        super().__init__()
        self.bpe, self.old, self.tokenize, self.space = bpe, {}, bpe.tokenize, bpe.space

    def __missing__(self, word: str) -> bytes:
        got = self.old.get(word)
        if got is None:
            if word.isascii() and word.isalpha() and LITTLE:
                got = array("H", list(map(ID, self.tokenize(self.space + word)))).tobytes()
            else:
                body = word[1:] if word[:1] == "\n" else word
                if not body or body[0] in SPACES or body[-1] in SPACES:
                    raise _Spaces
                got = self.bpe.word(word)
        self[word] = got
        if len(self) > LIMIT:
            self.old = dict(self)
            self.clear()
        return got


_codecs: dict[str | None, BpeCodec] = {}


def codec(path: str | None = None) -> BpeCodec:
    """One codec for each vocabulary file and Python worker."""
    if path not in _codecs:
        _codecs[path] = BpeCodec(path)
    return _codecs[path]
