"""Toxicity: disguised words are restored by a noisy channel, then a linear model scores the restored text.

The channel's source is a character trigram model of the whole corpus; its lattice offers, for each written character,
the letters it may stand for, and Viterbi decoding takes the likeliest reading.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, id_and_text, id_type, restored, slices, stored

#: Labelled rows that the classifier is fitted on, those with the least hash of their id; the features it keeps, and the
#: positive rows that must hold one. All three are parameters of train().
SAMPLE_ROWS = 20_000
FEATURES, FEATURE_ROWS = 512, 3
#: Word beginnings that are features besides whole words, in characters.
PREFIXES = (4, 5, 6)
#: A labelled row trains if crc32(id as text) leaves another remainder than the held-out one.
FOLDS, HELD_OUT = 5, 0
SHORT = 50
MEMO_ENTRIES = 200_000

#: What a written character may stand for.
READINGS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "*": "aeiou", "€": "e", "£": "l",
}
_MARKS = re.escape("".join(READINGS))
#: Marks that often stand beside a word as themselves. They may be kept there for nothing, other marks at Channel.keep.
_BESIDE = "!*(+|"
#: Marks set apart like letters; a star between them is a separator.
_ONE = _MARKS.replace(r"\*", "")
#: Letters or look-alikes, each perhaps repeated, three or more of them set apart; tokens with a letter and a look-alike
#: or a letter three times anywhere; a letter three times within other characters of words.
#: No stretch begins later than at the second character of a run, so a long run is tried twice and not at each character.
_SPACED = rf"(?<![^\W_])(?:([a-z{_ONE}])(?<!\1\1\1)\1*+[\s.,\-_*~/:;]++){{2,}}([a-z{_ONE}])\2*+(?![^\W_])"
_MIXED = rf"(?<![\w{_MARKS}])(?=[{_MARKS}]*[a-z])(?=[a-z]*[{_MARKS}]|[a-z]*?([a-z])\3\3)[a-z{_MARKS}]++(?!\w)"
_LONG = r"(?<![a-z])[a-z]*?([a-z])\4\4[a-z]*+"
_SUSPECT = re.compile(f"{_SPACED}|{_MIXED}|{_LONG}")
_APART = re.compile(_SPACED)
_WORD = re.compile(r"[^\W\d_]+")
_LETTER = re.compile("[a-z]")
_RUN = re.compile(rf"([a-z{_MARKS}])\1{{2,}}|.", re.S)

#: Character codes of the source model: 1-26 for letters, 0 for all else.
_CODES = np.zeros(256, np.int64)
_CODES[97:123] = _CODES[65:91] = np.arange(1, 27)
_TRIGRAMS = 27**3


def crc_remainder(id_col, folds: int):
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(folds))


def trigram_counts(text: str) -> np.ndarray:
    """Counts of the 27^3 letter trigrams of one text, a boundary before and after it."""
    codes = np.concatenate([[0, 0], _CODES[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)], [0]])
    return np.bincount(codes[:-2] * 729 + codes[1:-1] * 27 + codes[2:], minlength=_TRIGRAMS)


@dataclass
class Channel:
    """log P(c | a, b) of the source model and the costs of the channel."""

    source: np.ndarray
    swap: float = -1.0
    drop: float = -6.0
    keep: float = -6.0

    @classmethod
    def trained(cls, counts: np.ndarray) -> Channel:
        table = counts.reshape(27, 27, 27).astype(float) + 0.05
        return cls(np.log(table / table.sum(2, keepdims=True)))

    def _options(self, written: str) -> Iterator[tuple[str, list[tuple[str, float]]]]:
        """What is written, a run of one character at a time, and what each may be read as."""
        apart = _APART.fullmatch(written) is not None
        for m in _RUN.finditer(written):
            c = m.group(0)[0]
            if apart and c not in _ONE and not c.isalpha():
                yield m.group(0), [("", 0.0), (" ", -6.0)]
                continue
            single = [*((r, self.swap) for r in READINGS[c]), ("", self.drop)] if c in READINGS else [(c, 0.0)]
            if apart and c in READINGS:
                single.append((c, self.keep / 2))
            if m.group(1):
                yield m.group(0), [(r * n, cost - 0.5) for r, cost in single for n in ((1, 2) if r else (1,))]
            else:
                yield m.group(0), single

    def restore(self, written: str, beside: bool = False) -> str:
        """The likeliest reading of one suspicious stretch; words are separated by single blanks.

        With beside, marks before and after the word may also stay as they are written.
        """
        best: dict[tuple[int, int, int], tuple] = {(0, 0, 0): (0.0, None)}  # part (before, in, after), codes
        for c, options in chain(self._options(written), [("", [(" ", 0.0)])]):
            after: dict[tuple[int, int, int], tuple] = {}  # a reading is its last letters and the reading before them

            def put(state, score, read, letters, after=after):
                if state not in after or score > after[state][0]:
                    after[state] = score, (read, letters)

            for (part, a, b), (score, read) in best.items():
                if beside and (not c or c[0] in READINGS):
                    kept = score + (0.0 if not c or c[0] in _BESIDE else self.keep * len(c))
                    if part != 1:
                        put((part, 0, 0), kept, read, c)
                    elif c:
                        put((2, 0, 0), kept + self.source[a, b, 0], read, c)
                if part == 2 or (beside and not c and part == 0):
                    continue
                for letters, cost in options:
                    x, y, total = a, b, score + cost
                    for ch in letters:
                        code = ord(ch) - 96 if "a" <= ch <= "z" else 0
                        total += self.source[x, y, code]
                        x, y = y, code
                    put((1, x, y), total, read, letters)
            best = after
        read, parts = max(best.values(), key=lambda found: found[0])[1], []
        while read:
            read, letters = read
            parts.append(letters)
        return "".join(reversed(parts)).strip()


class Restorer:
    """Lower-cased text with every suspicious stretch read through the channel; readings are memoised."""

    def __init__(self, channel: Channel):
        self.channel, self.memo = channel, {}

    def __call__(self, text: str) -> str:
        return _SUSPECT.sub(self._read, text.lower())

    def _read(self, m: re.Match) -> str:
        written = m.group(0)
        if m.group(1) and len(_LETTER.findall(written)) < 2:  # a list of numbers
            return written
        if len(written) > 64:
            return self.channel.restore(written, True)
        if written not in self.memo:
            if len(self.memo) > MEMO_ENTRIES:
                self.memo.clear()
            self.memo[written] = self.channel.restore(written, True)
        return self.memo[written]


def features(word: str) -> list[str]:
    return [word, *(word[:n] + "~" for n in PREFIXES if len(word) >= n)]


@dataclass
class Model:
    channel: Channel
    names: list[str]
    weights: np.ndarray  # the last is the intercept

    def __post_init__(self):
        self.number = {n: i for i, n in enumerate(self.names)}
        self.restore = Restorer(self.channel)
        self.memo: dict[str, tuple[int, ...]] = {}

    def vector(self, text: str) -> dict[int, float]:
        """Feature number -> log(1 + occurrences per hundred words); short texts count as SHORT words."""
        words = _WORD.findall(self.restore(text))
        if len(self.memo) > MEMO_ENTRIES:
            self.memo.clear()
        hits: Counter[int] = Counter()
        for w, n in Counter(words).items():
            found = self.memo.get(w)
            if found is None:
                found = tuple(self.number[f] for f in features(w) if f in self.number)
                self.memo[w] = found
            for f in found:
                hits[f] += n
        return {f: math.log1p(100 * n / max(SHORT, len(words))) for f, n in hits.items()}

    def score(self, text: str) -> float:
        z = self.weights[-1] + sum(self.weights[f] * v for f, v in self.vector(text).items())
        return float(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))


def fit(vectors: list[dict[int, float]], labels: np.ndarray, width: int, penalty: float = 1.0, steps: int = 25) -> np.ndarray:
    """Logistic regression by Newton steps with an L2 penalty; classes count equally only through the intercept."""
    x = np.zeros((len(vectors), width + 1), np.float32)
    for i, v in enumerate(vectors):
        for f, value in v.items():
            x[i, f] = value
    x[:, -1] = 1
    w, ridge = np.zeros(width + 1), np.full(width + 1, penalty)
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - labels) + ridge * w
        curve = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T.astype(np.float64) @ x + np.diag(ridge)
        step = np.linalg.solve(curve, grad)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return w


def corpus_trigrams(texts: DataFrame) -> np.ndarray:
    """Letter trigrams of all texts: each task adds up its own, so what meets is 27^3 sums a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_TRIGRAMS, np.int64)
        for b in slices(batches):
            for t in b.column("text").to_pylist():
                total += trigram_counts(t) if len(t) > 20_000 else 0
            total += trigram_counts(" ".join(t for t in b.column("text").to_pylist() if len(t) <= 20_000))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["k", "n"])

    counts = np.zeros(_TRIGRAMS, np.int64)
    for r in texts.select("text").mapInArrow(run, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        counts[r["k"]] = r["n"]
    return counts


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS, width: int = FEATURES, least: int = FEATURE_ROWS) -> Model:
    """The source model from all of docs; the classifier from up to sample_rows labelled rows outside the held-out fold,
    with the `width` features that part the classes best among those that `least` positive rows hold.

    Only ids and labels of the sample (its size is the parameter) are broadcast, so no text is shuffled. Of several
    labels for one id the greatest counts; null ids, null labels and labels without a document are left out. Without
    both classes the model's score is the share of positive labels, or one half.
    """
    texts = id_and_text(docs, id_col, text_col)
    channel = Channel.trained(corpus_trigrams(texts))
    spark = docs.sparkSession
    chosen = (
        labels.select(F.col(id_col).alias("key"), F.col(label_col).cast("int").alias("label")).where("key is not null and label is not null")
        .where(crc_remainder(F.col("key"), FOLDS) != HELD_OUT).groupBy("key").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("key"), "key").limit(sample_rows)
    )
    chosen = stored(chosen, "label-sample")
    sample = stored(texts.join(F.broadcast(chosen), texts["id"] == chosen["key"]).select("text", "label"), "labelled").repartition(8)
    shared = spark.sparkContext.broadcast(channel)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore, seen = Restorer(shared.value), (Counter(), Counter())
        for b in slices(batches):
            for text, label in zip(b.column("text").to_pylist(), b.column("label").to_pylist(), strict=True):
                seen[label > 0].update({f for w in set(_WORD.findall(restore(text))) for f in features(w)})
        names = [*seen[1]]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([seen[1][f] for f in names], pa.int64()), pa.array([seen[0][f] for f in names], pa.int64())], ["f", "pos", "neg"])
        for names in _chunks([f for f in seen[0] if f not in seen[1]], 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([0] * len(names), pa.int64()), pa.array([seen[0][f] for f in names], pa.int64())], ["f", "pos", "neg"])

    sizes = {bool(r["y"]): r["n"] for r in sample.groupBy((F.col("label") > 0).alias("y")).agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(True, 0), sizes.get(False, 0)
    if not n1 or not n0:
        return Model(channel, [], np.array([30.0 if n1 else -30.0 if n0 else 0.0]))
    both = sample.mapInArrow(count, "f string, pos long, neg long").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    share = F.col("pos") / n1 - F.col("neg") / n0
    spread = (F.col("pos") + F.col("neg")) / (n1 + n0)
    gain = share / F.sqrt(spread * (1.0 + 1.0 / (n1 + n0) - spread) * (1.0 / n1 + 1.0 / n0))
    best = both.where(F.col("pos") >= least).orderBy(gain.desc(), "f").limit(width).select("f").collect()
    model = Model(channel, sorted(r["f"] for r in best), np.zeros(len(best) + 1))
    given = spark.sparkContext.broadcast((channel, model.names, model.weights))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*given.value)
        for b in slices(batches):
            rows = [m.vector(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array([[*r] for r in rows], pa.list_(pa.int32())), pa.array([[*r.values()] for r in rows], pa.list_(pa.float64()))], ["label", "f", "v"])

    rows = sorted((r["label"], r["f"], r["v"]) for r in sample.mapInArrow(vectors, "label int, f array<int>, v array<double>").collect())
    weights = fit([dict(zip(f, v, strict=True)) for _, f, v in rows], np.array([float(y > 0) for y, _, _ in rows]), len(best))
    return Model(channel, model.names, weights)


def _chunks(items: list, n: int) -> Iterator[list]:
    for i in range(0, len(items), n):
        yield items[i : i + n]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """One row per row of docs: id, held_out, score (0 to 1), predicted (score >= 0.5), columns of keep. No shuffle.

    Null and empty texts get the score of a text without features. Whole texts are read; other columns are ignored;
    rows with one id are scored apart; an empty table gives an empty result.
    """
    given = docs.sparkSession.sparkContext.broadcast((model.channel, model.names, model.weights))
    extra, more, names = carried(docs, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*given.value)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([m.score(t) for t in b.column("text").to_pylist()], pa.float64()), *(b.column(n) for n in names)], ["id", "score", *names])

    out = id_and_text(docs, id_col, text_col, extra).mapInArrow(run, f"id {id_type(docs, id_col)}, score double{more}")
    held = F.coalesce(crc_remainder(F.col("id"), FOLDS) == HELD_OUT, F.lit(False))
    return out.select(F.col("id").alias(id_col), held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *restored(names, keep))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """train() on docs and labels, then score() every row of docs."""
    return score(docs, train(docs, labels, id_col, text_col, label_col), id_col, text_col)
