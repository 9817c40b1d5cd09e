"""Language-model scores by context-tree weighting over bytes, beside an add-one unigram base.

Each byte is eight binary decisions. A decision has a context tree of its own whose nodes are the last 0..DEPTH bytes;
every node keeps a Krichevsky-Trofimov estimate, and the estimates of all depths are mixed with the weights that the
training text gives them.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, id_and_text, id_type, slices, stored

#: Bytes of context. With the next byte they must fit 56 bits.
DEPTH = 5
#: A row trains if crc32(id as text) leaves another remainder than the held-out one.
FOLDS, HELD_OUT = 7, 2
#: Entries (16 bytes each) of a model that is broadcast. A larger one is joined to the windows of slices of the texts,
#: of so many bytes each.
BROADCAST_ENTRIES, SLICE_BYTES = 6_000_000, 64 << 20
END = b"\n"
#: Documents of one step of a scoring or counting task, and distinct keys that a counting task holds before it emits.
STEP, HELD_KEYS = 256, 2_000_000


def held_out(id_col):
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split()


def word_keys(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)).view(np.int64)


def streams(texts: list[list[bytes]], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of all texts and how many each has. A window is (last byte, the one before, ..., next byte).

    A text is its words, single-spaced, and an end byte; before it stand end bytes. What a probability of it sums over
    are thus sequences of words, as with the base.
    """
    pad = END * depth
    bodies = [b" ".join(w) + END for w in texts]
    flat = np.frombuffer(b"".join([pad + b for b in bodies]), np.uint8).astype(np.int64)
    size = np.array([len(b) for b in bodies], np.int64)
    n = len(flat) - depth
    window = np.zeros(n, np.int64)
    for back in range(1, depth + 1):
        window |= flat[depth - back : depth - back + n] << (8 * (depth + 1 - back))
    window |= flat[depth:]
    begin = np.cumsum(size + depth) - size - depth
    own = np.ones(n, bool)
    for k in range(depth):
        at = begin[1:] - depth + k
        own[at] = False
    return window[own], size


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x of a half or more: Stirling's series at x + 8, taken back by the recurrence."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """log of the probability that the estimator gives to a sequence with these counts."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - math.log(math.pi) - log_gamma(n0 + n1 + 1)


def mixed(kt: np.ndarray, below: np.ndarray) -> np.ndarray:
    """log of half of either, of their logs."""
    return np.logaddexp(kt, below) - math.log(2)


class Level:
    """The trees of one binary decision depth l for the windows of one task, from `depth` bytes of context up to `top`."""

    def __init__(self, window: np.ndarray, n: np.ndarray, l: int, depth: int, top: int):
        byte = window & 255
        self.bit = (byte >> (7 - l)) & 1
        code = (window >> 8 << 8) | (1 << l) | (byte >> (8 - l))
        self.depth, self.top = depth, top
        self.nodes: list[tuple[np.ndarray, ...]] = []  # from the deepest: n0, n1, log KT, log weighted, row of each window
        weight0, weight1 = n * (1 - self.bit), n * self.bit
        row = below = last = None
        for _ in range(depth, top - 1, -1):
            codes, inverse = np.unique(code if row is None else (last >> 16 << 8) | (last & 255), return_inverse=True)
            n0, n1 = (np.bincount(inverse, weights=w, minlength=len(codes)) for w in (weight0, weight1))
            kt = log_kt(n0, n1)
            lw = kt if below is None else mixed(kt, np.bincount(inverse, weights=below, minlength=len(codes)))
            row = inverse if row is None else inverse[row]
            self.nodes.append((n0, n1, kt, lw, row))
            weight0, weight1, below, last = n0, n1, lw, codes
        self.codes = last

    def chance(self) -> np.ndarray:
        """P(the window's own bit) as far as the trees from `top` down tell it."""
        out = None
        for k, (n0, n1, kt, lw, row) in enumerate(self.nodes):
            own = (np.where(self.bit == 1, n1[row], n0[row]) + 0.5) / (n0 + n1 + 1)[row]
            if k == 0:
                out = own
            else:
                w = np.exp(kt - lw - math.log(2))[row]
                out = w * own + (1 - w) * out
        return out


class Top:
    """The trees' nodes of no byte and of one byte of context: 256 * 255 at most, whatever the corpus."""

    def __init__(self, code: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray):
        """code: (last byte << 8) | decision; below: the sum of log weighted probabilities of the children."""
        size = 1 << 16
        one = [np.zeros(size) for _ in range(3)]
        for table, values in zip(one, (n0, n1, below), strict=True):
            table[code] = values
        kt1 = log_kt(one[0], one[1])
        lw1 = mixed(kt1, one[2])
        zero = [t.reshape(256, 256).sum(0) for t in (one[0], one[1], lw1)]
        kt0 = log_kt(zero[0], zero[1])
        lw0 = mixed(kt0, zero[2])
        w1, w0 = np.exp(kt1 - lw1 - math.log(2)).reshape(256, 256), np.exp(kt0 - lw0 - math.log(2))
        self.base = np.empty((2, size))
        for bit in (0, 1):
            p1 = (one[bit] + 0.5) / (one[0] + one[1] + 1)
            p0 = (zero[bit] + 0.5) / (zero[0] + zero[1] + 1)
            self.base[bit] = (w0 * p0 + (1 - w0) * w1 * p1.reshape(256, 256)).ravel()
        self.rest = ((1 - w0) * (1 - w1)).ravel()

    def over(self, level: Level, window: np.ndarray, l: int, depth: int) -> np.ndarray:
        code = (window >> (8 * depth) << 8) | (1 << l) | ((window & 255) >> (8 - l))
        return np.where(level.bit == 1, self.base[1][code], self.base[0][code]) + self.rest[code] * level.chance()


def counted(texts: DataFrame, depth: int) -> DataFrame:
    """(word boolean, key, n): training counts of every window, and of every token, that any text holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, words = [], [], Counter()

        def windows_out() -> pa.RecordBatch:
            codes, names = pd.factorize(np.concatenate(keys))
            n = np.bincount(codes, weights=np.concatenate(counts), minlength=len(names))
            keys.clear(), counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(names), bool)), pa.array(names), pa.array(n.astype(np.int64))], ["word", "key", "n"])

        def words_out() -> pa.RecordBatch:
            k, n = word_keys([*words]), np.fromiter(words.values(), np.int64, len(words))
            words.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(k), bool)), pa.array(k), pa.array(n)], ["word", "key", "n"])

        for b in slices(batches, STEP):
            texts, train = [words_of(t) for t in b.column("text").to_pylist()], b.column("train").to_numpy(zero_copy_only=False)
            window, size = streams(texts, depth)
            codes, names = pd.factorize(window)
            keys.append(names)
            counts.append(np.bincount(codes, weights=np.repeat(train, size), minlength=len(names)))
            for w, t in zip(texts, train, strict=True):
                if t:
                    words.update(w)
            if sum(map(len, keys)) > HELD_KEYS:
                merged = windows_out()
                if merged.num_rows > HELD_KEYS // 2:
                    yield merged
                else:
                    keys.append(merged.column("key").to_numpy()), counts.append(merged.column("n").to_numpy().astype(float))
            if len(words) > HELD_KEYS // 4:
                yield words_out()
        if keys:
            yield windows_out()
        if words:
            yield words_out()

    return texts.select("text", "train").mapInArrow(run, "word boolean, key long, n long").groupBy("word", "key").agg(F.sum("n").alias("n"))


def _whole(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    parts = [(b.column("key").to_numpy(), b.column("n").to_numpy()) for b in batches]
    if not parts:
        return np.empty(0, np.int64), np.empty(0)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).astype(float)


def byte_chances(windows: DataFrame, depth: int) -> DataFrame:
    """windows(key, n) -> (key, lp): log10 P(next byte | context) of each window under the weighted trees.

    A subtree below two bytes of context is whole in one task: all of its at most 256^(depth - 1) windows share them.
    """
    dealt = windows.repartition(F.shiftrightunsigned("key", 8 * (depth - 1)))
    spark = windows.sparkSession

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window, n = _whole(batches)
        for l in range(8) if len(window) else ():
            level = Level(window, n, l, depth, 2)
            n0, n1, _, lw, _ = level.nodes[-1]
            codes, row = np.unique((level.codes >> 16 << 8) | (level.codes & 255), return_inverse=True)
            sums = [pa.array(np.bincount(row, weights=x, minlength=len(codes))) for x in (n0, n1, lw)]
            yield pa.RecordBatch.from_arrays([pa.array(codes), *sums], ["code", "n0", "n1", "below"])

    sums = dealt.mapInArrow(tops, "code long, n0 double, n1 double, below double").groupBy("code").agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "below"))).toArrow()
    shared = spark.sparkContext.broadcast(Top(*(sums.column(c).to_numpy() for c in ("code", "n0", "n1", "below"))))

    def chances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window, n = _whole(batches)
        if len(window):
            lp = sum(np.log10(shared.value.over(Level(window, n, l, depth, 2), window, l, depth)) for l in range(8))
            yield pa.RecordBatch.from_arrays([pa.array(window), pa.array(lp)], ["key", "lp"])

    return dealt.mapInArrow(chances, "key long, lp double")


def _sorted(table: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
    key, value = table.column("key").to_numpy(), table.column(column).to_numpy()
    order = np.argsort(key)
    return key[order], value[order]


def _find(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray, missing: float) -> np.ndarray:
    known, values = table
    if not len(known):
        return np.full(len(keys), missing)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, values[at], missing)


def _scored(texts: list[str], lps: tuple[np.ndarray, np.ndarray], counts: tuple[np.ndarray, np.ndarray], depth: int) -> list[pa.Array]:
    """n_tokens, n_known, seen, score and n_bytes of each text, by tables of windows and of words."""
    split = [words_of(t) for t in texts]
    n_words = np.array([len(w) for w in split])
    window, size = streams(split, depth)
    codes, names = pd.factorize(window)
    score = np.add.reduceat(_find(lps, names, 0.0)[codes], np.cumsum(size) - size)
    codes, names = pd.factorize(word_keys([w for ws in split for w in ws]))
    n = _find(counts, names, 0.0)
    per, hit = np.r_[0.0, np.cumsum(np.log10(n + 1)[codes])], np.r_[0, np.cumsum((n > 0)[codes])]
    ends = np.cumsum(n_words)
    seen, known = per[ends] - per[ends - n_words], hit[ends] - hit[ends - n_words]
    n_bytes = np.array([sum(map(len, w)) + max(len(w), 1) for w in split])
    return [pa.array(x) for x in (n_words + 1, known, seen, score, n_bytes)]


_FACTS = ["n_tokens", "n_known", "seen", "score", "n_bytes"]


def _by_broadcast(rows: DataFrame, lps: DataFrame, words: DataFrame, depth: int, kind: str) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast((_sorted(lps.toArrow(), "lp"), _sorted(words.toArrow(), "n")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, STEP):
            yield pa.RecordBatch.from_arrays([b.column("id"), *_scored(b.column("text").to_pylist(), *shared.value, depth)], ["id", *_FACTS])

    return rows.select("id", "text").mapInArrow(run, f"id {kind}, n_tokens long, n_known long, seen double, score double, n_bytes long")


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.r_[True, values[1:] != values[:-1], True]).tolist()
    return list(zip(edges, edges[1:], strict=False))


def _by_join(rows: DataFrame, lps: DataFrame, words: DataFrame, depth: int, kind: str, slice_bytes: int) -> DataFrame:
    """The texts are dealt into slices of some slice_bytes. The distinct windows and words of a slice are joined to the
    model by key and go back to their slice, where they stand before its texts: so the model meets every text once."""
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // slice_bytes))
    dealt = rows.select("id", "text", F.pmod(F.xxhash64("text", "id"), F.lit(n)).cast("int").alias("slice"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bool], list[np.ndarray]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (k, word), parts in held.items():
                keys = np.unique(np.concatenate(parts))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), k, np.int32)), pa.array(np.full(len(keys), word)), pa.array(keys)], ["slice", "word", "key"])
            held.clear()

        for b in slices(batches, STEP):
            number, texts = b.column("slice").to_numpy(), [words_of(t) for t in b.column("text").to_pylist()]
            for k in np.unique(number).tolist():
                own = [t for t, x in zip(texts, number.tolist(), strict=True) if x == k]
                held.setdefault((k, False), []).append(np.unique(streams(own, depth)[0]))
                held.setdefault((k, True), []).append(np.unique(word_keys([w for t in own for w in t])))
            if sum(len(x) for parts in held.values() for x in parts) > HELD_KEYS:
                for key, parts in held.items():
                    held[key] = [np.unique(np.concatenate(parts))]
                if sum(len(parts[0]) for parts in held.values()) > HELD_KEYS // 2:
                    yield from out()
        yield from out()

    asked = dealt.repartition(n, "slice").mapInArrow(ask, "slice int, word boolean, key long").distinct()
    model = lps.select(F.lit(False).alias("word"), "key", F.col("lp").alias("value")).unionAll(words.select(F.lit(True).alias("word"), "key", F.col("n").cast("double").alias("value")))
    known = stored(asked.join(model, ["word", "key"]), "slice-model")
    none = lambda t: F.lit(None).cast(t)
    entries = known.select("slice", F.lit(False).alias("text_row"), none(kind).alias("id"), none("string").alias("text"), "word", "key", "value")
    texts = dealt.select("slice", F.lit(True).alias("text_row"), "id", "text", none("boolean").alias("word"), none("long").alias("key"), none("double").alias("value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, tables = None, [], None
        for batch in batches:
            for lo, hi in _runs(batch.column("slice").to_numpy()):
                part = batch.slice(lo, hi - lo)
                if part.column("slice")[0].as_py() != now:
                    now, parts, tables = part.column("slice")[0].as_py(), [], None
                is_text = part.column("text_row").to_numpy(zero_copy_only=False)
                first = int(np.argmax(is_text)) if is_text.any() else len(is_text)
                if first:
                    parts.append(tuple(part.column(c).slice(0, first).to_numpy(zero_copy_only=False) for c in ("word", "key", "value")))
                for b in slices(iter([part.slice(first)]), STEP) if first < len(is_text) else ():
                    if tables is None:
                        word, key, value = (np.concatenate([p[i] for p in parts]) if parts else np.empty(0, t) for i, t in enumerate((bool, np.int64, float)))
                        word = word.astype(bool)
                        tables, parts = [(key[m][np.argsort(key[m])], value[m][np.argsort(key[m])]) for m in (~word, word)], []
                    yield pa.RecordBatch.from_arrays([b.column("id"), *_scored(b.column("text").to_pylist(), *tables, depth)], ["id", *_FACTS])

    both = entries.unionAll(texts).repartition(n, "slice").sortWithinPartitions("slice", "text_row")
    return both.mapInArrow(run, f"id {kind}, n_tokens long, n_known long, seen double, score double, n_bytes long")


def language_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, broadcast_entries: int = BROADCAST_ENTRIES, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """One row per row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Tokens are lower-cased words and an end. base_score sums log10((c + 1) / (N + V + 1)) over them. score is the
    model's log10 probability of the same sequence, spelled in bytes (see streams()); bits_per_byte is its code length.
    Both learn from rows outside the held-out fold, all of them. Words are known by 64-bit hashes.

    The corpus is counted by window and word, in partial sums a task; trees are weighted in tasks that hold whole
    subtrees; and texts are scored against the model's tables: broadcast up to broadcast_entries, beyond that joined to
    the distinct windows of slices of the texts, so each text is read as often whatever the model's size. Null and empty texts are one end token. A null id is not held out. Rows repeating an id are scored
    apart; other columns are ignored; an empty table gives an empty result.
    """
    rows = id_and_text(docs, id_col, text_col).withColumn("train", ~held_out(F.col("id")))
    table = stored(counted(rows, depth), "counts")
    sizes = {r["word"]: r for r in table.groupBy("word").agg(F.count("*").alias("size"), F.sum("n").alias("n")).collect()}
    ends = rows.where("train").count()
    vocabulary = (sizes[True]["size"] if True in sizes else 0) + (ends > 0)
    total = (sizes[True]["n"] if True in sizes else 0) + ends
    windows, words = table.where("not word").select("key", "n"), table.where("word").select("key", "n")
    lps = stored(byte_chances(windows, depth), "chances")
    count = lambda k: sizes[k]["size"] if k in sizes else 0
    kind = id_type(docs, id_col)
    if count(False) + count(True) <= broadcast_entries:
        out = _by_broadcast(rows, lps, words, depth, kind)
    else:
        out = _by_join(rows, lps, words, depth, kind, slice_bytes)
    scale = math.log10(total + vocabulary + 1)
    end = math.log10(ends + 1)
    return out.select(
        F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "n_tokens", (F.col("n_known") + int(ends > 0)).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("seen") + end - F.col("n_tokens") * scale).alias("base_score"), F.col("score"), (-F.col("score") / math.log10(2) / F.col("n_bytes")).alias("bits_per_byte"),
    )
