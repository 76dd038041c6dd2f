"""Toxicity scores from a weighted lexicon, matched by one Aho-Corasick automaton over folded text.

Folding lower-cases, maps homoglyphs to Latin letters, undoes digit and sign substitutions inside words and turns other
punctuation into spaces. Lexicon entries are whole words or word beginnings; both are learned from labelled rows.
Exception phrases (an entry with the word before or behind it) take the hits in them back, each hit once however many phrases
it is in. A document's score is a logistic function of its summed weights, as such and by length.

fit() reads at most about SAMPLE labelled documents, picked by a hash: a documented bound, from which follows what it
brings to the driver. Frequencies are counted on the executors. Labels, language, source and id are no inputs of a score.

Defined cases: null and empty texts get the score of no hit; very long texts are scanned whole; repeated rows each get
their row; an empty table gives no rows; a label that is null is none, and a document labelled twice is toxic if one
label says so. Without labels of both kinds the lexicon is empty and every score is the share of toxic labels. Other columns are kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, release

SAMPLE = 12_000
STEM = (3, 10)  #: lengths of word beginnings, from and under
LEAST = 4  #: toxic documents that an entry must be in
CHANCE = 0.02  #: expected number of entries that pass the test by chance
PURITY = 0.75  #: least share of toxic documents, with both kinds weighed as if equally many

# Look-alike letters of other scripts, and substitutions inside words.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "ԁ": "d", "ɡ": "g", "ӏ": "l", "һ": "h", "ԝ": "w",
    "α": "a", "ο": "o", "ρ": "p", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "η": "n", "ω": "w",
    "ı": "i", "ł": "l", "ø": "o", "’": "'",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l"}


def _fold_table() -> dict[int, str]:
    table = {ord(k): v for k, v in HOMOGLYPHS.items()}
    table |= {0xFF01 + k: chr(0x21 + k) for k in range(94)}  # full-width forms
    table |= {c: "" for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}  # invisible characters
    return table


FOLD = _fold_table()
SPACED = {c: " " for c in map(chr, range(128)) if not c.isalnum() and c not in SUBSTITUTES and c != "'"}
SPACED_CODES = {ord(k): v for k, v in SPACED.items()}
_inside = None


def fold(text: str | None) -> str:
    """Words of the folded text, with one space around each."""
    global _inside
    if _inside is None:
        import re

        signs = re.escape("".join(SUBSTITUTES))
        # a sign counts as a letter with a letter before it and a letter or sign behind it, or (marks of exclamation and bars aside) at a word's start before a letter
        _inside = re.compile(rf"(?<=[^\W\d_])[{signs}]+(?=[^\W\d_])|(?<![^\s])[0134578@$](?=[^\W\d_])"), str.maketrans(SUBSTITUTES), re.compile(r"[@$!|']+(?=\s|$)|(?<!\S)[@$!|']+"), re.compile(rf"[{signs}]")
    if not text:
        return " "
    inside, letters, ends, any_sign = _inside
    t = text.lower()
    if not t.isascii():
        t = t.translate(FOLD)
    t = t.translate(SPACED_CODES)
    if any_sign.search(t):
        t = inside.sub(lambda m: m[0].translate(letters), t)
        t = ends.sub(" ", t)
    return " " + " ".join(t.split()) + " "


@dataclass
class Lexicon:
    """entries: text as it stands in folded text (" word " or " beginning") and its weight; exceptions: phrases in the same form."""

    entries: dict[str, float] = field(default_factory=dict)
    exceptions: set[str] = field(default_factory=set)
    bias: float = 0.0
    slope: tuple[float, float] = (0.0, 0.0)

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for phrase, w in self.entries.items():
            a.add_word(phrase, (phrase, w, False))
        for phrase in self.exceptions - self.entries.keys():
            a.add_word(phrase, (phrase, 0.0, True))
        if len(a):
            a.make_automaton()
        return a

    def features(self, automaton, text: str | None) -> tuple[float, float, int]:
        """Summed weight, the same by length (a thousand words are about one unit for one entry), hits."""
        t = fold(text)
        found, harmless = [], set()
        if len(automaton):
            for end, (phrase, w, exception) in automaton.iter(t):
                start = end - len(phrase) + 1
                if exception:  # hits begin with the space before a word
                    harmless.update(start + k for k, c in enumerate(phrase[:-1]) if c == " ")
                else:
                    found.append((start, w))
        left = [w for start, w in found if start not in harmless]
        n = t.count(" ") - 1
        total = max(sum(left), 0.0)
        return total, total / (n + 20.0) * 1000.0, len(left)

    def score(self, automaton, text: str | None) -> float:
        total, by_length, _ = self.features(automaton, text)
        z = self.bias + self.slope[0] * math.log1p(total) + self.slope[1] * math.log1p(by_length)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _candidates(folded: str) -> set[str]:
    words = set(folded.split())
    return {f" {w} " for w in words} | {" " + w[:n] for w in words for n in range(*STEM) if len(w) > n}


def _keyed(batches: Iterator) -> Iterator:
    import pyarrow as pa

    from .shingles import shingle_sets

    for b in batches:
        ends = [(int(s[0] >> 1), int(s[-1] >> 1)) if len(s) else (None, None) for s in shingle_sets(b.column("text"))]
        yield pa.RecordBatch.from_arrays([b.column("text"), b.column("y"), pa.array([x for x, _ in ends], pa.int64()), pa.array([x for _, x in ends], pa.int64())], names=["text", "y", "k1", "k2"])


def _frequencies(batches: Iterator) -> Iterator:
    """Partial document frequencies of candidates, for toxic and other documents."""
    from collections import Counter

    import pyarrow as pa

    toxic, other = Counter(), Counter()

    def row() -> pa.RecordBatch:
        # what no toxic document here has may have them elsewhere, so all are sent
        names = list(toxic.keys() | other.keys())
        out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([toxic[n] for n in names], pa.int64()), pa.array([other[n] for n in names], pa.int64())], names=["entry", "toxic", "other"])
        toxic.clear()
        other.clear()
        return out

    for b in batches:
        for text, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist()):
            (toxic if y else other).update(_candidates(fold(text)))
            if len(toxic) + len(other) >= 200_000:
                yield row()
    yield row()
    release()


def _evidence(pos: int, neg: int, all_pos: int, all_neg: int) -> float:
    """Log-likelihood ratio of an entry in pos of all_pos toxic and neg of all_neg other documents; 0 unless toxic ones are more."""
    rate = all_pos / (all_pos + all_neg)
    n = pos + neg
    if not n or pos <= rate * n:
        return 0.0
    return pos * math.log(pos / n / rate) + (neg * math.log(neg / n / (1 - rate)) if neg else 0.0)


def choose(found: list[tuple[list[int], int]], names: list[str], all_pos: int, all_neg: int, tests: int) -> list[str]:
    """Entries from the candidates that each document (ids, toxic) has.

    First all that are far more often in toxic documents than chance allows, given how many candidates were looked
    at. Then, of the documents without a chosen entry, again and again the entry with the most evidence. Of entries that
    extend each other, the one with most evidence stands for those that mostly share its documents; a whole word goes before beginnings of about the same documents.
    """
    limit = math.log(tests / CHANCE)
    docs_of: dict[int, set[int]] = {}
    for d, (ids, _) in enumerate(found):
        for i in set(ids):
            docs_of.setdefault(i, set()).add(d)
    toxic = {d for d, (_, y) in enumerate(found) if y}

    def facts(docs: set[int], pos_all: int, neg_all: int) -> tuple[float, float]:
        pos = len(docs & toxic)
        neg = len(docs) - pos
        share = pos / pos_all if pos_all else 0.0
        return _evidence(pos, neg, pos_all, neg_all), share / (share + neg / max(neg_all, 1)) if pos else 0.0

    def unlike(candidates: list[int], chosen: list[int]) -> list[int]:
        out: list[int] = []
        for i in candidates:
            mine = docs_of[i] & toxic
            stem = names[i].rstrip(" ")
            if any((names[c].rstrip(" ").startswith(stem) or stem.startswith(names[c].rstrip(" "))) and len(mine & docs_of[c]) >= 0.5 * min(len(mine), len(docs_of[c] & toxic)) for c in chosen + out):
                continue
            out.append(i)
        return out

    def order(scored: list[tuple[float, float, int]]) -> list[int]:
        # most evidence first, of equals the longest; a whole word counts for a little more than a beginning of it
        return [i for _, _, i in sorted(((-g * (1.05 if names[i].endswith(" ") else 1.0), -len(names[i]), i) for g, _, i in scored))]

    scored = [(*facts(docs, all_pos, all_neg), i) for i, docs in docs_of.items()]
    chosen = unlike(order([x for x in scored if x[0] >= limit and x[1] >= PURITY and len(docs_of[x[2]] & toxic) >= LEAST]), [])
    left = set(range(len(found)))
    for i in chosen:
        left -= docs_of[i]
    bare_pos, bare_neg = all_pos - len(toxic - left), all_neg - (len(found) - len(toxic) - len(left - toxic))
    while bare_pos > 0:
        scored = [(*facts(docs & left, bare_pos, bare_neg), i) for i, docs in docs_of.items() if i not in chosen and len(docs & left & toxic) >= LEAST]
        more = unlike(order([x for x in scored if x[0] >= limit and x[1] >= PURITY]), chosen)[:1]
        if not more:
            break
        new = docs_of[more[0]] & left
        chosen += more
        left -= new
        bare_pos, bare_neg = bare_pos - len(new & toxic), bare_neg - len(new - toxic)
    return [names[i] for i in chosen]


def _logistic(x, y, rounds: int = 60, ridge: float = 1e-2):
    import numpy as np

    x = np.concatenate([np.ones((len(x), 1)), x], 1)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(h, x.T @ (p - y) + ridge * w)
    return w


def fit(docs: DataFrame, labels: DataFrame, train=None, sample: int = SAMPLE) -> Lexicon:
    """A lexicon from the labelled documents that the condition `train` picks; of more than `sample`, by hash about so many."""
    import numpy as np

    work = Workspace(docs.sparkSession, "toxicity")
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("y"))
    known = known.filter(train) if train is not None else known
    n = known.count()
    picked = known.filter(F.pmod(F.xxhash64(F.lit(29), "doc_id"), F.lit(1_000_000)) < F.lit(round(1_000_000 * min(1.0, sample / max(n, 1)))))
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "y")  # picked: about `sample` ids
    rows = work.write(rows.mapInArrow(_keyed, "text string, y int, k1 long, k2 long"), "labelled")
    # near copies count once: they mostly share the least or the greatest shingle hash
    rows = work.write(rows.filter("k1 IS NOT NULL").dropDuplicates(["y", "k1"]).dropDuplicates(["y", "k2"]).select("text", "y").repartition(16), "sample")
    pos, neg = rows.agg(F.coalesce(F.sum("y"), F.lit(0)), F.coalesce(F.sum(1 - F.col("y")), F.lit(0))).first()
    if not pos or not neg:
        return Lexicon(bias=math.log((pos + 0.5) / (neg + 0.5)))
    counts = rows.mapInArrow(_frequencies, "entry string, toxic long, other long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    rare = F.col("other") / F.lit(neg) <= 0.1 * F.col("toxic") / F.lit(pos)
    counts = work.write(counts, "counts")
    tests = counts.filter(F.col("toxic") + F.col("other") >= LEAST).count()
    names = [r.entry for r in counts.filter((F.col("toxic") >= LEAST) & rare).orderBy(F.desc("toxic"), "entry").collect()]  # at most the words and beginnings that LEAST of the sample's toxic documents have
    numbers = {x: k for k, x in enumerate(names)}

    def matches(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            ids = [[numbers[c] for c in _candidates(fold(t)) if c in numbers] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.list_(pa.int32())), b.column("y")], names=["ids", "y"])

    got = rows.mapInArrow(matches, "ids array<int>, y int").filter("size(ids) > 0").toArrow()
    chosen = choose(list(zip(got.column("ids").to_pylist(), got.column("y").to_pylist())), names, pos, neg, max(tests, 2))
    weights = {r.entry: math.log((r.toxic + 0.5) / (pos + 1)) - math.log((r.other + 0.5) / (neg + 1)) for r in counts.filter(F.col("entry").isin(chosen)).collect()} if chosen else {}
    draft = Lexicon(entries={c: weights[c] for c in chosen})

    def phrases(batches: Iterator) -> Iterator:
        """Hits with a neighbouring word, by document."""
        from collections import Counter

        import pyarrow as pa

        automaton, toxic, other = draft.automaton(), Counter(), Counter()
        for b in batches:
            for text, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist()):
                (toxic if y else other).update(set(_phrases(automaton, fold(text))))
        names = list(toxic.keys() | other.keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([toxic[n] for n in names], pa.int64()), pa.array([other[n] for n in names], pa.int64())], names=["phrase", "toxic", "other"])

    if chosen:
        around = rows.mapInArrow(phrases, "phrase string, toxic long, other long").groupBy("phrase").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
        clean = (1 - PURITY) * F.col("other") / F.lit(neg) > PURITY * F.col("toxic") / F.lit(pos)  # with both kinds weighed as if equally many
        harmless = around.filter((F.col("other") >= 3) & clean).collect()  # as above, of the sample's clean documents
        draft.exceptions = {r.phrase for r in harmless}

    def features(batches: Iterator) -> Iterator:
        import pyarrow as pa

        automaton = draft.automaton()
        for b in batches:
            f = [draft.features(automaton, t)[:2] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in f], pa.float64()), pa.array([x for _, x in f], pa.float64()), b.column("y")], names=["a", "b", "y"])

    table = rows.mapInArrow(features, "a double, b double, y int").toArrow()
    x = np.log1p(np.stack([table.column("a").to_numpy(), table.column("b").to_numpy()], 1))
    w = _logistic(x, table.column("y").to_numpy().astype(float))
    draft.bias, draft.slope = float(w[0]), (float(w[1]), float(w[2]))
    for tag in ("labelled", "sample", "counts"):
        work.drop(tag)
    return draft


def _phrases(automaton, folded: str) -> list[str]:
    if not len(automaton):
        return []
    out = []
    for end, (phrase, _, _) in automaton.iter(folded):
        start = end - len(phrase) + 1
        stop = folded.find(" ", start + 1)
        before, behind = folded.rfind(" ", 0, start) if start else -1, folded.find(" ", stop + 1)
        if before >= 0:
            out.append(folded[before : stop + 1])
        if behind >= 0:
            out.append(folded[start : behind + 1])
    return out


def score(docs: DataFrame, lexicon: Lexicon, name: str = "score", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns `keep`) and the score of each text."""
    columns = docs.columns if keep is None else keep
    kept = [c for c in columns if c != name]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        automaton = lexicon.automaton()
        for b in batches:
            s = [lexicon.score(automaton, t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(s, pa.float64())], names=[*kept, name])
        release()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept)
    return docs.select(*dict.fromkeys([*kept, "text"])).mapInArrow(run, f"{fields}, `{name}` double")
