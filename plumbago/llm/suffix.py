"""Removal of strings that occur more than once, decided by suffix arrays from a difference cover.

Sorting every suffix of the corpus would take some twenty bytes for each byte of text. So a reduction comes first that
is exact in both directions: it settles windows whose surroundings are unique or equal as a whole, and leaves those at
the ends of repeated stretches. These are dealt out by the content that equal windows share, and each task sorts the
suffixes of its stretches: sampled triples, names, recursion, the merge of the other suffixes. Adjacent suffixes are
compared over the length that counts.

Strings are of bytes, or of words: then a text is the sequence of its words' XXH64, eight bytes a word.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, id_and_text, id_type, lean, new_table, slices, stored

#: Bytes of a string that counts as repeated; words of a passage that does.
LENGTH, PASSAGE = 400, 50
#: log2 of the bits of a broadcast filter: 32 MB whatever the corpus. It lets through too much, never too little; full,
#: it lets all texts through to the joins that decide.
FILTER_BITS = 28
#: Stretches that one suffix array takes, and distinct stretches of one kernel beyond which its windows are counted by
#: their digests in many tasks instead of being sorted in one.
SORT_STRETCHES, HOT = 1_000, 1_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64((1 << 20) - 1)
_WORD = re.compile(rb"[^\t-\r ]+")


# -- suffix arrays ----------------------------------------------------------------------------------------------------


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The starts of all suffixes of s (whole numbers of one or more) in order, by the difference cover {1, 2} mod 3."""
    n = len(s)
    if n < 2:
        return np.arange(n)
    if s.max() > n:
        s = np.unique(s, return_inverse=True)[1] + 1
    top = int(s.max()) + 1
    text = np.concatenate([s.astype(np.int64), np.zeros(3, np.int64)])
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    name = _names(text[sample], text[sample + 1], text[sample + 2], top)
    if name.max() + 1 < len(sample):
        order = suffix_array(name + 1)
        name = np.empty(len(sample), np.int64)
        name[order] = np.arange(len(sample))
    else:
        order = np.argsort(name)
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = name + 1
    first = sample[order]
    if n % 3 == 1:
        first = first[first < n]
    zeros = np.arange(0, n, 3)
    key = text[zeros] * (len(sample) + 2) + rank[zeros + 1]
    at = np.argsort(key, kind="stable")
    zeros, key = zeros[at], key[at]
    one, two = first[first % 3 == 1], first[first % 3 == 2]
    lo = np.searchsorted(text[one] * (len(sample) + 2) + rank[one + 1], key)
    pair = text[:-1] * top + text[1:]
    if top * top * (len(sample) + 2) >= 1 << 63:
        pair = np.unique(pair, return_inverse=True)[1]
    lo += np.searchsorted(pair[two] * (len(sample) + 2) + rank[two + 2], pair[zeros] * (len(sample) + 2) + rank[zeros + 2])
    out = np.empty(n, np.int64)
    place = lo + np.arange(len(zeros))
    out[place] = zeros
    rest = np.ones(n, bool)
    rest[place] = False
    out[rest] = first
    return out


def _names(a: np.ndarray, b: np.ndarray, c: np.ndarray, top: int) -> np.ndarray:
    """The rank of each triple among the distinct triples."""
    if top < 1 << 21:
        return np.unique((a * top + b) * top + c, return_inverse=True)[1]
    order = np.lexsort((c, b, a))
    a, b, c = a[order], b[order], c[order]
    new = np.concatenate([[0], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])])
    out = np.empty(len(a), np.int64)
    out[order] = np.cumsum(new)
    return out


def repeated_starts(stretches: list[bytes], counts: np.ndarray, length: int = LENGTH, scale: int = 1) -> list[np.ndarray]:
    """For each stretch, those of its first `counts` starts at which it has a string that starts elsewhere too."""
    size = np.array([len(s) // scale for s in stretches])
    marks = np.cumsum(size + 1) - 1
    base = marks - size
    text = np.frombuffer((b"\0" * scale).join(stretches) + b"\0" * (scale + 8), np.uint8)
    n = marks[-1] + 1
    if scale == 1:
        s = text[:n].astype(np.int64) + 1
    else:
        s = np.unique(text[: n * scale].view("<u8"), return_inverse=True)[1] + 1
    s[marks] = 0
    owner = np.repeat(np.arange(len(stretches)), counts)
    starts = base[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    asked = np.zeros(n, bool)
    asked[starts] = True
    order = suffix_array(s + 1)
    order = order[asked[order]]
    same = np.zeros(len(order), bool)
    eights = np.ndarray((len(text) - 7,), "<u8", text, 0, (1,))  # the eight bytes from each place on
    span = np.append(np.arange(0, length * scale - 8, 8), length * scale - 8)
    for k in range(0, len(order) - 1, 16384):
        at = order[k : k + 16385] * scale
        pair = np.arange(len(at) - 1)
        for part in np.array_split(span, 5):  # most neighbours differ early, or not at all
            pair = pair[(eights[at[pair][:, None] + part] == eights[at[pair + 1][:, None] + part]).all(1)]
        same[k + pair] = True
        same[k + 1 + pair] = True
    hit = np.zeros(n, bool)
    hit[order[same]] = True
    return [np.flatnonzero(hit[b : b + c]) for b, c in zip(base, counts, strict=True)]


# -- the exact reduction ----------------------------------------------------------------------------------------------


def gram(symbols: np.ndarray) -> int:
    """Symbols hashed to choose anchors: eight bytes, or two words."""
    return 8 if symbols.dtype.itemsize == 1 else 2


def anchors(symbols: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window) for each run of windows of `length` symbols that choose one anchor.

    A window chooses the leftmost of its grams with the least hash: a function of its content alone, so equal windows
    choose the same place in them.
    """
    if len(symbols) < length:
        return (np.empty(0, np.int64),) * 3
    wide = gram(symbols)
    places, limit = length - wide + 1, (1 << 20) - length
    chosen = []
    for begin in range(0, len(symbols) - length + 1, limit):
        part = np.ascontiguousarray(symbols[begin : begin + limit + length - 1])
        if wide == 8:
            h = np.ndarray((len(part) - 7,), "<u8", part, 0, (1,)) * _MIX
        else:
            h = part[:-1] * _MIX + part[1:]
        h ^= h >> np.uint64(31)
        h *= _MIX
        h = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while 2 * width <= places:
            h = np.minimum(h[:-width], h[width:])
            width *= 2
        if width < places:
            h = np.minimum(h[: len(h) - (places - width)], h[places - width :])
        chosen.append((h & _LOW).astype(np.int64) + begin)
    g = np.concatenate(chosen)
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    return g[first], first, np.append(first[1:], len(g)) - 1


@dataclass(frozen=True)
class Windows:
    """Strings of `length` bytes, or words, and how a text's windows are put into units.

    A unit is a run of windows with one anchor, all of which begin less than half a length before it, or all of which
    begin farther off. The kernel is what any such window of any text with that anchor's surroundings holds, so equal
    windows are in units of equal kernels. The union is what the unit's windows cover.
    """

    length: int
    words: bool = False

    @property
    def scale(self) -> int:
        return 8 if self.words else 1

    def symbols(self, text: bytes) -> np.ndarray:
        if not self.words:
            return np.frombuffer(text, np.uint8)
        from xxhash import xxh64_intdigest

        return np.array([xxh64_intdigest(w) for w in text.split()], np.uint64)

    def units(self, text: bytes) -> list[tuple[int, int, int | None, int, int]]:
        """(first window, windows, kernel's digest, union's digest, times) of each distinct unit of a text.

        A unit that the text holds several times has its number of times; the others of its kind are repeated for sure
        and listed without a kernel, adjacent ones as one. The union's digest holds the first window's distance from
        the anchor, so units of equal digests have equal windows one by one.
        """
        from xxhash import xxh3_64_intdigest, xxh64_intdigest

        length, half, scale, symbols = self.length, self.length // 2, self.scale, self.symbols(text)
        wide, data = gram(symbols), text if scale == 1 else symbols.tobytes()
        found: dict[tuple[int, int], list] = {}
        again: list[list[int]] = []

        def put(p: int, end: int, off: int, kernel: bytes, seed: int) -> None:
            pair = xxh64_intdigest(kernel, seed), xxh3_64_intdigest(data[p * scale : end * scale], off)
            if pair not in found:
                found[pair] = [p, end - length - p + 1, 1]
                return
            found[pair][2] += 1
            if again and sum(again[-1]) == p:
                again[-1][1] += end - length - p + 1
            else:
                again.append([p, end - length - p + 1])

        for a, first, last in zip(*(x.tolist() for x in anchors(symbols, length)), strict=True):
            near = max(first, a - half + 1)  # windows from here on look right
            if first < near:
                stop = min(last, near - 1)
                put(first, stop + length, a - first, data[(a - half) * scale : (a + wide) * scale], 2)
            if near <= last:
                put(near, last + length, a - near, data[a * scale : (a + length - half + 1) * scale], 1)
        return [(p, n, key, union, times) for (key, union), (p, n, times) in found.items()] + [(p, n, None, 0, 2) for p, n in again]


def _long(values: Sequence[int | None]) -> pa.Array:
    plain = np.array([v or 0 for v in values], np.uint64).view(np.int64)
    return pa.array(plain, mask=np.array([v is None for v in values], bool))


def _filter(keys: DataFrame, column: str, bits: int = FILTER_BITS) -> np.ndarray:
    """A bitmap of the keys' low bits, put together as words of 64 bits: at most 2^(bits - 6) rows."""
    low = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    words = keys.select(F.shiftrightunsigned(low, 6).alias("w"), F.expr(f"shiftleft(1L, cast({column} & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return out.view(np.uint64)


def _digests() -> list:
    """A text's MD5 as two longs."""
    md5 = F.md5("text")
    half = lambda k: F.conv(F.substring(md5, k, 16), 16, -10).cast("long")
    return [half(1).alias("d1"), half(17).alias("d2")]


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).select("text", *_digests())


def _named(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """texts(text, d1, d2), each once, joined to wanted(d1, d2, ...).

    A filter of wanted digests keeps most other texts out of the shuffle; the join decides. Copies meet as partial
    aggregates.
    """
    seen = texts.sparkSession.sparkContext.broadcast(_filter(wanted, "d1"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            low = b.column("d1").to_numpy().view(np.uint64) & np.uint64((1 << FILTER_BITS) - 1)
            hit = (seen.value[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))) & np.uint64(1)
            yield b.filter(pa.array(hit.astype(bool)))

    once = texts.mapInArrow(run, "text string, d1 long, d2 long").groupBy("d1", "d2").agg(F.first("text").alias("text"))
    return once.join(wanted, ["d1", "d2"])


def repeated_spans(docs: DataFrame, text_col: str = "text", length: int = LENGTH, words: bool = False, hot: int = HOT) -> DataFrame:
    """(d1, d2, spans array<struct<start, stop>>): ranges of texts, named by their MD5, that repeated strings cover; in
    bytes, or in numbers of words (runs without ASCII white space).

    1. Every unit of windows is written with the digests of its kernel and of its union. Units of a kernel that occurs
       once are unique. Where all unions of a kernel are equal, all windows are repeated.
    2. Of the other kernels, unions that occur more than once are repeated, and one unit of each union is cut out of
       its text; those of one kernel go to one task and suffix_array() decides them.
    3. Kernels of more than `hot` distinct unions have their windows counted by SHA-256 in many tasks.
    Copies of a text are separate occurrences; every count is a partial sum before it is shuffled.
    """
    windows, scale = Windows(length, words), 8 if words else 1
    lean(docs.sparkSession)
    texts = _texts(docs, text_col).where(F.octet_length("text") >= (2 * length - 1 if words else length))

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [windows.units(t.encode()) for t in b.column("text").to_pylist()]
            row = np.repeat(np.arange(b.num_rows), [len(f) for f in found])
            rows = [u for f in found for u in f]
            plain = [pa.array([u[k] for u in rows], pa.int32()) for k in (0, 1, 4)]
            digests = [pa.array(b.column(c).to_numpy()[row]) for c in ("d1", "d2")]
            yield pa.RecordBatch.from_arrays([*digests, plain[0], plain[1], _long([u[2] for u in rows]), _long([u[3] for u in rows]), plain[2]], ["d1", "d2", "p", "n", "kernel", "u", "c"])

    table = stored(texts.mapInArrow(units, "d1 long, d2 long, p int, n int, kernel long, u long, c int"), "units")
    kernels = table.where("kernel is not null").groupBy("kernel").agg(F.sum("c").alias("c"), F.min("u").alias("lo"), F.max("u").alias("hi"))
    kernels = stored(kernels.where("c > 1").select("kernel", (F.col("lo") < F.col("hi")).alias("mixed")), "kernels")
    shared = stored(table.join(kernels, "kernel"), "shared")
    mixed = shared.where("mixed")
    unions = stored(mixed.groupBy("kernel", "u").agg(F.sum("c").alias("c"), F.min(F.struct("d1", "d2", "p", "n")).alias("at")), "unions")
    open_ = stored(unions.groupBy("kernel").agg(F.count("*").alias("kinds"), F.min("c").alias("least")).where("least = 1"), "open")
    one = unions.join(open_, "kernel").select("at.*", "kernel", "kinds")
    refs = stored(one.groupBy("d1", "d2").agg(F.collect_list(F.struct("kernel", "kinds", "p", "n")).alias("units")), "references")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for d1, d2, t, asked in zip(*(b.column(c).to_pylist() for c in ("d1", "d2", "text", "units")), strict=True):
                data = windows.symbols(t.encode()).tobytes()
                rows += [(d1, d2, u["p"], u["n"], u["kernel"], u["kinds"], data[u["p"] * scale : (u["p"] + u["n"] - 1 + length) * scale]) for u in asked]
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["d1", "d2", "p", "n", "kernel", "kinds", "bytes"])

    stretches = stored(_named(texts, refs).select("d1", "d2", "text", "units").mapInArrow(cut, "d1 long, d2 long, p int, n int, kernel long, kinds long, bytes binary"), "stretches")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def decide(rows: pa.Table) -> pa.RecordBatch:
            counts, p = (rows.column(c).to_numpy().astype(np.int64) for c in ("n", "p"))
            row, start, stop = [], [], []
            for i, hits in enumerate(repeated_starts(rows.column("bytes").to_pylist(), counts, length, scale)):
                for run in np.split(hits, np.flatnonzero(np.diff(hits) > 1) + 1) if len(hits) else ():
                    row.append(i), start.append(p[i] + run[0]), stop.append(p[i] + run[-1] + length)
            d1, d2 = (rows.column(c).to_numpy()[row] if row else np.empty(0, np.int64) for c in ("d1", "d2"))
            return pa.RecordBatch.from_arrays([pa.array(d1), pa.array(d2), pa.array(start, pa.int32()), pa.array(stop, pa.int32())], ["d1", "d2", "start", "stop"])

        for b in slices(batches, SORT_STRETCHES):
            held.append(b)
            if sum(x.num_rows for x in held) >= SORT_STRETCHES:
                rows = pa.Table.from_batches(held)
                kernel = rows.column("kernel").to_numpy()
                last = int(np.searchsorted(kernel, kernel[-1]))  # the last kernel may go on
                if last:
                    yield decide(rows.slice(0, last))
                    held = rows.slice(last).to_batches()
        if held:
            yield decide(pa.Table.from_batches(held))

    few = stretches.where(F.col("kinds") <= hot)
    tasks = max(1, -(-few.count() // (4 * SORT_STRETCHES)))
    sorted_ = few.repartition(tasks, "kernel").sortWithinPartitions("kernel").mapInArrow(sort, "d1 long, d2 long, start int, stop int")
    each = stretches.where(F.col("kinds") > hot).select("d1", "d2", F.posexplode(F.expr(f"transform(sequence(0, n - 1), i -> sha2(substring(bytes, i * {scale} + 1, {length * scale}), 256))")).alias("i", "window"), "p")
    each = stored(each.select("d1", "d2", "window", (F.col("p") + F.col("i")).alias("start")), "windows")
    many = stored(each.groupBy("window").agg(F.count("*").alias("c")).where("c > 1"), "many")
    counted = each.join(many, "window", "left_semi").select("d1", "d2", "start", (F.col("start") + length).alias("stop"))
    whole = lambda df: df.select("d1", "d2", F.col("p").alias("start"), (F.col("p") + F.col("n") - 1 + length).cast("int").alias("stop"))
    path = new_table(docs.sparkSession, "spans")
    for part in (whole(table.where("kernel is null")), whole(shared.where("not mixed")), whole(mixed.join(unions.where("c > 1"), ["kernel", "u"], "left_semi")), sorted_, counted):
        part.write.mode("append").parquet(path)
    spans = docs.sparkSession.read.schema("d1 long, d2 long, start int, stop int").parquet(path)
    spans = spans.groupBy("d1", "d2", "start").agg(F.max("stop").alias("stop")).groupBy("d1", "d2").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    return stored(spans.withColumn("spans", F.expr(_MERGED)), "covered")


#: Sorted spans, those that touch as one.
_MERGED = """aggregate(spans, slice(spans, 1, 0), (a, s) -> CASE WHEN size(a) = 0 OR element_at(a, -1).stop < s.start THEN concat(a, array(s))
WHEN element_at(a, -1).stop >= s.stop THEN a ELSE concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'stop', s.stop))) END)"""


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = (), length: int | None = None, words: bool = False, passage: int | None = None, **options) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes as binary) and
    the columns named in keep.

    With `passage`, n_passage_words follows: the words that lie in passages of so many words which start elsewhere too.

    Every byte that lies in a string of `length` bytes (LENGTH; 8 at least) which starts anywhere else too, in any row, is removed;
    strings are judged on the input. With `words`, strings are of `length` words (PASSAGE), that is runs without ASCII
    white space, and the white space between removed words goes with them. Null and shorter texts keep all their bytes
    (a null text is empty). Rows repeating an id are separate texts, and equal rows are copies of each other. Other
    columns are ignored; an empty table gives an empty result.

    Only texts that lose bytes go through Python; where `kept` is not asked for, no other text is shuffled.
    """
    spans = repeated_spans(docs, text_col, length or (PASSAGE if words else LENGTH), words, **options)
    extra, _, names = carried(docs, keep)
    rows = id_and_text(docs, id_col, text_col, extra).select("id", "text", *_digests(), *names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = []
            for text, found in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                data, kept, at = text.encode(), [], 0
                at_words = [m.span() for m in _WORD.finditer(data)] if words else ()
                for s in found:
                    start, stop = (at_words[s["start"]][0], at_words[s["stop"] - 1][1]) if words else (s["start"], s["stop"])
                    kept.append(data[at:start])
                    at = stop
                left = b"".join([*kept, data[at:]])
                out.append((len(data) - len(left), len(found), hashlib.sha256(left).hexdigest(), left))
            arrays = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([b.column("d1"), b.column("d2"), *arrays], ["e1", "e2", "removed", "runs", "sha", "left"])

    facts = _named(_texts(docs, text_col), spans).select("d1", "d2", "text", "spans").mapInArrow(run, "e1 long, e2 long, removed long, runs long, sha string, left binary")
    both = rows.join(facts, (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2")), "left")
    none, more = F.lit(0).cast("long"), []
    if passage:
        covered = repeated_spans(docs, text_col, passage, True, **options).select("d1", "d2", F.expr("aggregate(spans, 0L, (a, s) -> a + s.stop - s.start)").alias("passage"))
        both, more = both.join(covered, ["d1", "d2"], "left"), [F.coalesce("passage", none).alias("n_passage_words")]
    return both.select(
        F.col("id").alias(id_col), F.octet_length("text").cast("long").alias("n_bytes"), F.coalesce("removed", none).alias("n_removed"), F.coalesce("runs", none).alias("n_spans"),
        F.coalesce("sha", F.sha2("text", 256)).alias("kept_sha256"), F.coalesce("left", F.col("text").cast("binary")).alias("kept"), *more, *(F.col(n).alias(c) for n, c in zip(names, keep, strict=True)),
    )
