"""ids of whole columns of texts: Arrow cuts texts into words, numbers them and puts their ids together; only words not yet known are encoded.

The ids are those of BpeCodec.encode, text by text. Words are cut as there: at single spaces, and before line feeds. Most new words are plain:
letters or digits, with punctuation behind them or without. Their bodies are told to the library's BPE model many at a time, with a byte between
them that no merge joins to another one, which is the same as one at a time. Other words go to BpeCodec one by one. Of a run of spaces and line feeds
the last one belongs to the word behind it; those before it are a piece, as in the split pattern, and so is a whole run at the end of a text. Texts that can't be cut so
(other white space beside a cut, runs over RUN, added tokens) and very long ones go to BpeCodec as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

from .common import SPACES, BpeCodec, codec

CHUNK = 16 << 20  #: bytes of text encoded at once; longer texts go to BpeCodec
KEPT = 4  #: words are kept until that many chunks went by without them: each chunk numbers all known words, for about a fifteenth of encoding one anew
KNOWN = 1_000_000  #: words kept at most
JOINED = 64  #: bodies in a call of the model
RUN = 60  #: spaces and line feeds in a row, without the last one
FIRST = "\t\n"  #: stands before the first word of a text: a line feed begins a word, so no other word has one further on
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"  #: beyond, Unicode versions differ
PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  #: all of ASCII but the apostrophe, which the split pattern treats apart
PLAIN = r"\A(?:\t?\n)?(?:[" + LETTERS + r"]+|[0-9]+)[!-&(-/:-@\[-`{-~]*\z"
ODD, SPACE, FEED = 1, 2, 3  #: kinds of words: those whose texts can't be cut, and those that are but the space or line feed before them
HEAD = "\t\n0123456789" + "".join(c for c in map(chr, range(0x250)) if c.isalpha())


class ColumnCodec:
    def __init__(self, bpe: BpeCodec):
        import numpy as np
        import pyarrow as pa

        self.bpe = bpe
        self.words, self.ids = pa.array([], pa.string()), pa.array([], pa.binary())
        self.kind, self.seen, self.now = np.zeros(0, np.int8), np.zeros(0, np.int64), 0  # when a word was last seen
        self.between = next((b for b in range(32) if chr(bpe.bytes[b]) in bpe.alone), None)
        self.alphabet = np.array([bpe.bytes[b] for b in range(256)], "<u2")

    def rows(self, batch, name: str, text: str) -> Iterator[tuple]:
        """(value of name, ids of text) of an Arrow batch's rows."""
        import numpy as np
        import pyarrow.compute as pc

        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, k = np.cumsum(size), 0
        while k < batch.num_rows:
            stop = max(k + 1, int(np.searchsorted(ends, ends[k] - size[k] + CHUNK, "right")))
            part = batch.slice(k, stop - k)
            yield from zip(part.column(name).to_pylist(), self.encode(part.column(text)))
            k = stop

    def encode(self, texts) -> list[bytes]:
        """Little-endian unsigned 16-bit ids of each text of an Arrow array."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pc.fill_null(texts, "")
        whole = pc.greater(pc.binary_length(texts), CHUNK)
        for token in self.bpe.added:
            whole = pc.or_(whole, pc.match_substring(texts, token))
        whole = whole.to_numpy(zero_copy_only=False).copy()
        cut = (pc.if_else(pa.array(whole), pa.scalar("", texts.type), texts) if whole.any() else texts).cast(pa.string())
        lists = pc.split_pattern(pc.binary_join_element_wise(FIRST, pc.replace_substring(cut, "\n", " \n"), ""), " ")
        starts = lists.offsets.to_numpy()
        index = self._known(lists.values)
        kind = self.kind[index]
        runs, odd = self._runs(index, kind)
        whole[np.searchsorted(starts, np.concatenate([np.flatnonzero(kind == ODD), odd]), "right") - 1] = True
        coded = (pa.concat_arrays([self.ids, runs]) if len(runs) else self.ids).take(pa.array(index))
        at = np.frombuffer(coded.buffers()[1], np.int32, len(coded) + 1, coded.offset * 4)[starts]
        data = memoryview(coded.buffers()[2] or b"")
        out = [data[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        for k in np.flatnonzero(whole).tolist():
            out[k] = self.bpe.encode(texts[k].as_py())
        self._forget()
        return out

    def _runs(self, index, kind):
        """ids of the distinct runs of two and more words without a body, which are one piece each, and the places of runs that are too long.
        In index a run's first word becomes the run, numbered behind the known words, and its others become the last of these ids, which is empty."""
        import numpy as np
        import pyarrow as pa

        at = np.flatnonzero(kind >= SPACE)
        first = np.flatnonzero(np.diff(at, prepend=-2) != 1)
        length = np.diff(np.append(first, len(at)))
        some = (length > 1) & (length <= RUN)
        odd = at[first[length > RUN]]
        if not some.any():
            return pa.array([], pa.binary()), odd
        place = np.arange(len(at)) - np.repeat(first, length)
        feeds = np.add.reduceat((kind[at] == FEED).astype(np.int64) << np.minimum(place, RUN), first)
        codes, which = np.unique(feeds[some] | np.int64(1) << length[some], return_inverse=True)  # a bit for each word, and one behind them
        blanks = ["".join("\n" if c >> k & 1 else " " for k in range(c.bit_length() - 1)) for c in codes.tolist()]
        index[at[np.repeat(some, length)]] = len(self.words) + len(codes)
        index[at[first[some]]] = len(self.words) + which
        return pa.array([*map(self.bpe.piece, blanks), b""], pa.binary()), odd

    def _known(self, words):
        """The place of each word among the known ones, to which new ones are added."""
        import numpy as np
        import pyarrow as pa

        n, own = len(self.words), words.dictionary_encode()
        numbered = pa.concat_arrays([self.words, own.dictionary]).dictionary_encode()  # known words keep their numbers
        place = numbered.indices.to_numpy()[n:]
        index = place[own.indices.to_numpy()]
        if len(numbered.dictionary) > n:
            ids, kind = self._learn(numbered.dictionary[n:])
            self.words, self.ids, self.kind = numbered.dictionary, pa.concat_arrays([self.ids, ids]), np.concatenate([self.kind, kind])
            self.seen = np.concatenate([self.seen, np.zeros(len(kind), np.int64)])
        self.now += 1
        self.seen[place] = self.now
        return index

    def _forget(self) -> None:
        import numpy as np
        import pyarrow as pa

        kept = np.flatnonzero(self.seen > self.now - KEPT)
        if len(kept) > KNOWN:
            kept = np.sort(np.argsort(-self.seen, kind="stable")[:KNOWN])
        if len(kept) < len(self.words):
            some = pa.array(kept)
            self.words, self.ids, self.kind, self.seen = self.words.take(some), self.ids.take(some), self.kind[kept], self.seen[kept]

    def _learn(self, words):
        """ids of each word, and its kind."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        plain = np.zeros(len(words), bool) if self.between is None else pc.match_substring_regex(words, PLAIN).to_numpy(zero_copy_only=False)
        kind, others = np.zeros(len(words), np.int8), []
        at = np.flatnonzero(~plain)
        for k, word in zip(at.tolist(), words.take(pa.array(at)).to_numpy(zero_copy_only=False)):
            got = self._word(word)
            kind[k] = ODD if got is None else {"": SPACE, "\n": FEED}.get(word, 0)
            others.append(got or b"")
        ids = [pa.array(others, pa.binary())]
        if plain.any():
            ids.append(self._plain(words.filter(pa.array(plain))))
        place = np.empty(len(words), np.int64)
        place[at] = np.arange(len(at))
        place[plain] = len(at) + np.arange(len(words) - len(at))
        return pa.concat_arrays(ids).take(pa.array(place)), kind

    def _word(self, word: str) -> bytes | None:
        """ids of any word; None if it has white space of its own at its ends."""
        first = word.startswith(FIRST)
        body = word[len(FIRST) :] if first else word[1:] if word[:1] == "\n" else word
        if not body:
            return b"" if first else self.bpe.piece(word or " ")
        if body[-1] in SPACES or (body[0] in SPACES and not first):
            return None
        return self.bpe._any(body) if first else self.bpe.word(word)

    def _plain(self, words):
        """ids of plain words: of a line feed, the body and the punctuation, which are pieces of the split pattern."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        feed, first = pc.starts_with(words, "\n"), pc.starts_with(words, FIRST)
        space = pc.if_else(pc.or_(feed, first), "", " ")
        body = pc.utf8_ltrim(pc.utf8_rtrim(words, PUNCTUATION), "\t\n")
        numbered = pc.binary_join_element_wise(space, body, chr(self.between), "").dictionary_encode()
        bodies = numbered.dictionary
        offsets = np.frombuffer(bodies.buffers()[1], np.int32, len(bodies) + 1, bodies.offset * 4)
        text = self.alphabet[np.frombuffer(bodies.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]].tobytes().decode("utf-16-le")
        ends = [*(offsets[:-1:JOINED] - offsets[0]).tolist(), len(text)]
        coded = np.frombuffer(b"".join([self.bpe._ids(text[a:b]) for a, b in zip(ends, ends[1:])]), "<u2")
        between = coded == np.frombuffer(self.bpe._ids(chr(self.bpe.bytes[self.between])), "<u2")[0]
        starts = np.concatenate([[0], np.flatnonzero(between) - np.arange(len(bodies))]).astype(np.int32) * np.int32(2)
        pieces = pa.Array.from_buffers(pa.binary(), len(bodies), [None, pa.py_buffer(starts), pa.py_buffer(coded[~between])])
        tails = pc.utf8_ltrim(words, HEAD).dictionary_encode()
        tail_ids = pa.array([self.bpe.piece(t) if t else b"" for t in tails.dictionary.to_pylist()], pa.binary())
        return pc.binary_join_element_wise(pc.if_else(feed, pa.scalar(self.bpe.feed, pa.binary()), pa.scalar(b"", pa.binary())), pieces.take(numbered.indices), tail_ids.take(tails.indices), pa.scalar(b"", pa.binary()))


_codecs: dict[str | None, ColumnCodec] = {}


def column_codec(path: str | None = None) -> ColumnCodec:
    """One for each vocabulary file and Python worker."""
    if path not in _codecs:
        _codecs[path] = ColumnCodec(codec(path))
    return _codecs[path]
