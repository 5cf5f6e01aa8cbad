"""Removal of repeated passages: a suffix array cut at the threshold depth, built by radix passes.

A byte is removed if a string of LENGTH bytes that covers it also starts earlier (smaller id, or the same
document and an earlier start). So suffixes need ordering through LENGTH bytes only: they are dealt by
digits, most significant first, groups of one are dropped after each pass, and the groups that are equal
after the last pass are exactly the repeated windows.

Pass 1, in Spark. The first digit of a window is its anchor: the 32-byte gram of least hash in it (the
leftmost on ties). Equal windows have equal anchors at equal offsets, and consecutive windows share one, so
about 35 windows travel as one record (anchor hash, two independent hashes of the run's whole span, place). Records are dealt
by anchor and sorted; runs with equal spans (128 bits of two hashes) fall into one class, all of whose members but the earliest are
repeats; an anchor with a single class needs no further pass.
Further passes, per bucket of anchors. The first member of each class of the remaining anchors brings the
bytes of its span; its windows are ordered by their bytes, eight at a time and the first ones first, through
LENGTH bytes, groups of one being dropped after each pass. What is equal at the end is equal byte by byte.

Scale. Records are 4% of the windows and the text itself is shuffled by id twice. Before the first shuffle,
each batch keeps only the earliest record of a class, so a passage that a third of all documents hold sends
one record a batch, not one a document. Passes stream over sorted partitions; a worker holds one bucket's
remaining windows, in slices of the offset when a bucket is large. An anchor with more than HOT classes left (a
passage of very many documents, each with its own surroundings, at the passage's edges) is never held in one task:
its windows travel one by one, by 128 bits of their bytes' hashes, and the earliest of each is a partial aggregation.

Edge cases: null text is empty; texts under LENGTH bytes lose nothing; rows that repeat an id and its text
count as one document and get the same result; of several texts of one id only the one of least hash is
compared, the others neither lose bytes nor make others lose them; rows with a null id are not compared and lose nothing; very
long texts are cut into overlapping chunks for hashing; other columns are not read (or pass through, in
`remove_repeats`).
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.llm import common

LENGTH = 100
GRAM = 32
GRAMS = LENGTH - GRAM + 1
DIGIT = 8
#: Classes of one anchor that a worker may hold.
HOT = 20_000
CHUNK = 1 << 18
#: Windows that a worker refines at a time.
SLICE = 750_000

#: A base for each of the two hashes: what is periodic for one is not for the other.
_BASE, _BASE_AGAIN = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9
_BYTE, _BYTE_AGAIN = common.mix(np.arange(7001, 7001 + 512, dtype=np.uint64)).reshape(2, 256)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_LOW = np.uint64(255)
_SALT = np.uint64(0xD6E8FEB86659FD93)


def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = max(n, CHUNK + 2 * LENGTH)
        up, down = (np.cumprod(np.full(size, np.uint64(b), dtype=np.uint64)) for b in (base, pow(base, -1, 1 << 64)))
        _POWERS[base] = up, down
    up, down = _POWERS[base]
    return up[:n], down[:n]


def _prefix(flat: np.ndarray, again: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of the first or the second polynomial hash, and the factors that make substrings comparable."""
    up, down = _powers(len(flat) + 1, _BASE_AGAIN if again else _BASE)
    sums = np.zeros(len(flat) + 1, dtype=np.uint64)
    np.cumsum((_BYTE_AGAIN if again else _BYTE)[flat] * up[:-1], out=sums[1:])
    return sums, down


def _hash(sums: np.ndarray, down: np.ndarray, at, length) -> np.ndarray:
    return common.mix((sums[at + length] - sums[at]) * down[at])


def anchors(flat: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows of one anchor. flat: bytes; room[i]: whether a window that starts at i may be taken.

    Returns anchor hash, two span hashes, first window's start, the anchor's offset in it, number of windows.
    """
    n = len(flat) - LENGTH + 1
    empty = np.empty(0, dtype=np.int64)
    if n <= 0 or not room[:n].any():
        return *[empty.astype(np.uint64)] * 3, empty, empty, empty
    sums, down = _prefix(flat)
    grams = len(flat) - GRAM + 1
    h = common.mix((sums[GRAM:] - sums[:-GRAM]) * down[:grams])
    blocks = -(-grams // GRAMS) + 1
    v = np.full(blocks * GRAMS, np.uint64(0xFFFFFFFFFFFFFFFF), dtype=np.uint64)
    v[:grams] = h & ~_LOW
    v = v.reshape(blocks, GRAMS)
    place = np.arange(GRAMS, dtype=np.uint64)
    left = np.minimum.accumulate((v | place)[:, ::-1], axis=1)[:, ::-1].ravel()
    right = np.minimum.accumulate(v | (place + np.uint64(GRAMS)), axis=1).ravel()
    least = np.minimum(left[:n], right[GRAMS - 1 : GRAMS - 1 + n])
    at = np.arange(n, dtype=np.int64)
    anchor = at - at % GRAMS + (least & _LOW).astype(np.int64)
    ok = room[:n]
    new = np.ones(n, dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | ~ok[:-1]
    first = np.flatnonzero(new & ok)
    ends = np.ones(n, dtype=bool)
    ends[:-1] = new[1:] | ~ok[1:]
    last = np.flatnonzero(ends & ok)
    count = last - first + 1
    both = (sums, down), _prefix(flat, again=True)
    return h[anchor[first]], *(_hash(*x, first, count - 1 + LENGTH) for x in both), first, anchor[first] - first, count


def _pieces(texts: list[bytes]):
    """Lists of (index, offset, bytes) of about CHUNK bytes together; longer texts overlap by LENGTH - 1."""
    group, size = [], 0
    for k, t in enumerate(texts):
        for start in range(0, max(1, len(t) - LENGTH + 1), CHUNK):
            part = t[start : start + CHUNK + LENGTH - 1]
            if len(part) < LENGTH:
                continue
            group.append((k, start, part))
            size += len(part)
            if size >= CHUNK:
                yield group
                group, size = [], 0
    if group:
        yield group


def _firsts(keys: list[np.ndarray], doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by keys, document, place, and where in that order a new key begins."""
    order = np.lexsort((place, doc, *keys[::-1]))
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    return order, new


def _pack(start, offset, count) -> np.ndarray:
    return (np.asarray(start, dtype=np.int64) << 14) | (np.asarray(offset, dtype=np.int64) << 7) | np.asarray(count, dtype=np.int64)


RECORDS = "anchor bigint, span bigint, again bigint, doc_id bigint, place bigint, repeat boolean"


def _records(rows: DataFrame) -> DataFrame:
    """rows: doc_id, text. place packs start, the anchor's offset and the number of windows."""

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            found = []
            for group in _pieces(common.texts_as_bytes(batch.column(1))):
                sizes = np.array([len(p) for *_, p in group])
                begins = np.cumsum(sizes) - sizes
                flat = np.frombuffer(b"".join(p for *_, p in group), dtype=np.uint8)
                room = np.ones(len(flat), dtype=bool)
                for e in np.cumsum(sizes):
                    room[max(0, e - LENGTH + 1) : e] = False
                a, s, c, first, offset, count = anchors(flat, room)
                piece = np.searchsorted(begins, first, "right") - 1
                start = first - begins[piece] + np.array([o for _, o, _ in group], dtype=np.int64)[piece]
                found.append((a, s, c, ids[np.array([k for k, *_ in group], dtype=np.int64)[piece]], _pack(start, offset, count)))
            if not found:
                continue
            a, s, c, doc, place = (np.concatenate(x) for x in zip(*found))
            order, new = _firsts([a, s, c, place & 16383], doc, place)
            a, s, c, doc, place = (x[order] for x in (a, s, c, doc, place))
            lead = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            repeat = (doc != doc[lead]) | (place != place[lead])
            keep = new | repeat  # a row that repeats an id and its text gives no record of its own
            #: Repeats only pass through the shuffle: their own place spreads them.
            a = np.where(repeat, common.mix(doc.view(np.uint64) * _SALT + place.view(np.uint64)), a)
            s = np.where(repeat, np.uint64(0), s)
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (a.view(np.int64), s.view(np.int64), c.view(np.int64), doc, place, repeat)], names=["anchor", "span", "again", "doc_id", "place", "repeat"])

    return rows.mapInArrow(common.tidied(work), RECORDS)


def _sort_out(records: DataFrame) -> DataFrame:
    """Sorted records -> repeats, and the runs that need further passes (repeat is false)."""

    def work(batches):
        import pyarrow as pa

        last, held, many = None, None, False  # the last class's first record; a record held back; whether its anchor has several classes
        names = ["anchor", "doc_id", "place", "repeat"]

        def out(a, d, p, r):
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(d, pa.int64()), pa.array(p, pa.int64()), pa.array(r, pa.bool_())], names=names)

        for batch in batches:
            a, s, c, d, p = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
            passing = batch.column(5).to_numpy(zero_copy_only=False).astype(bool)
            if passing.any():
                yield out(a[passing], d[passing], p[passing], passing[passing])
                a, s, c, d, p = (x[~passing] for x in (a, s, c, d, p))
            if not len(a):
                continue
            shape = p & 16383
            new = np.ones(len(a), dtype=bool)
            new[1:] = (a[1:] != a[:-1]) | (s[1:] != s[:-1]) | (c[1:] != c[:-1]) | (shape[1:] != shape[:-1])
            if last is not None:
                new[0] = last[:4] != (a[0], s[0], c[0], shape[0])
            lead = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
            lead_d = np.where(lead >= 0, d[lead], last[4] if last else 0)
            lead_p = np.where(lead >= 0, p[lead], last[5] if last else 0)
            again = ~new & ((d != lead_d) | (p != lead_p))
            at = np.flatnonzero(new)
            fa, fd, fp = a[at], d[at], p[at]
            if held is not None:
                fa, fd, fp = (np.concatenate([[x], y]) for x, y in zip(held, (fa, fd, fp), strict=True))
            if len(fa):
                more = np.zeros(len(fa), dtype=bool)
                more[1:] = fa[1:] == fa[:-1]
                several = more.copy()
                several[:-1] |= more[1:]
                if many and last is not None:
                    several |= fa == last[0]
                end_held = not several[-1]
                use = several.copy()
                yield out(fa[use], fd[use], fp[use], np.zeros(int(use.sum()), dtype=bool))
                held, many = ((fa[-1], fd[-1], fp[-1]), False) if end_held else (None, True)
            if again.any():
                yield out(a[again], d[again], p[again], again[again])
            last = (a[-1], s[-1], c[-1], shape[-1], int(lead_d[-1]), int(lead_p[-1]))

    return records.mapInArrow(common.tidied(work), "anchor bigint, doc_id bigint, place bigint, repeat boolean")


def _spans(runs: DataFrame, rows: DataFrame) -> DataFrame:
    """The bytes of the runs that need further passes."""
    by_doc = runs.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "place")).alias("runs"))
    joined = by_doc.join(rows, "doc_id").select("doc_id", "text", F.col("runs.anchor").alias("anchors"), F.col("runs.place").alias("places"))

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            a, d, p, raw = [], [], [], []
            ids, texts = batch.column(0).to_pylist(), common.texts_as_bytes(batch.column(1))
            for doc, text, some, places in zip(ids, texts, batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                for anchor, place in zip(some, places, strict=True):
                    start = place >> 14
                    a.append(anchor), d.append(doc), p.append(place), raw.append(text[start : start + (place & 127) - 1 + LENGTH])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(d, pa.int64()), pa.array(p, pa.int64()), pa.array(raw, pa.binary())], names=["anchor", "doc_id", "place", "raw"])

    return joined.mapInArrow(common.tidied(work), "anchor bigint, doc_id bigint, place bigint, raw binary")


def _digits(flat: np.ndarray) -> np.ndarray:
    """At each place the next eight bytes as a number, so that numbers are ordered as the bytes are."""
    out = np.zeros(max(0, len(flat) - DIGIT + 1), dtype=np.uint64)
    for k in range(DIGIT):
        out |= flat[k : len(flat) - DIGIT + 1 + k].astype(np.uint64) << np.uint64(8 * (DIGIT - 1 - k))
    return out


def radix_groups(group: np.ndarray, digits: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows (indices, in their given order) that equal an earlier one of their group, ordered by most significant digits first.

    Returns the windows and, for each, the first of its equals."""
    live = np.arange(len(at))
    key = group
    for place in (*range(0, LENGTH - DIGIT, DIGIT), LENGTH - DIGIT):
        digit = digits[at[live] + place]
        order = np.lexsort((digit, key))
        k, digit = key[order], digit[order]
        same = np.zeros(len(k), dtype=bool)
        same[1:] = (k[1:] == k[:-1]) & (digit[1:] == digit[:-1])
        pair = same.copy()
        pair[:-1] |= same[1:]
        live, key = live[order][pair], np.cumsum(~same)[pair]
        if not len(live):
            break
    order = np.lexsort((live, key))
    live, key = live[order], key[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    lead = live[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))] if len(live) else live
    return live[~new], lead[~new]


def _refine(anchor, doc, place, raw) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows sorted by anchor, document, place. Repeated windows as runs: document, first start, windows."""
    start, offset, count = place >> 14, (place >> 7) & 127, place & 127
    flat = np.frombuffer(b"".join(raw), dtype=np.uint8)
    digits = _digits(flat)
    begin = np.cumsum(count + LENGTH - 1) - (count + LENGTH - 1)
    docs, starts = [], []
    slices = max(1, -(-int(count.sum()) // SLICE))
    for part in range(slices):
        row = np.repeat(np.arange(len(count)), count)
        j = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        if slices > 1:
            mine = (offset[row] - j) % slices == part
            row, j = row[mine], j[mine]
        group = common.mix(anchor[row].view(np.uint64) + (offset[row] - j).astype(np.uint64) * _SALT)
        hit, lead = radix_groups(group, digits, begin[row] + j)
        other = (doc[row[hit]] != doc[row[lead]]) | (start[row[hit]] + j[hit] != start[row[lead]] + j[lead])
        hit = hit[other]
        docs.append(doc[row[hit]]), starts.append(start[row[hit]] + j[hit])
    d, s = np.concatenate(docs), np.concatenate(starts)
    order = np.lexsort((s, d))
    d, s = d[order], s[order]
    if not len(d):
        return d, s, s
    new = np.ones(len(d), dtype=bool)
    new[1:] = (d[1:] != d[:-1]) | (s[1:] > s[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(d)) - 1
    return d[first], s[first], s[last] - s[first] + 1


def _windows(spans: DataFrame) -> DataFrame:
    """spans: sorted by anchor, document, place."""

    def work(batches):
        import pyarrow as pa

        held = None

        def done(t):
            d, s, n = _refine(*(t.column(k).to_numpy().astype(np.int64) for k in range(3)), t.column(3).to_pylist())
            return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(s, pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "start", "n"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            a = held.column(0).to_numpy()
            cut = int(np.flatnonzero(a != a[-1]).max(initial=-1)) + 1
            if cut and len(a) >= 8000:
                yield done(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield done(held)

    return spans.mapInArrow(common.tidied(work), "doc_id bigint, start bigint, n bigint")


def _single(spans: DataFrame) -> DataFrame:
    """The windows of spans, one by one: hashes of their bytes (two, independent), document, start."""

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            doc, place = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (1, 2))
            flat = np.frombuffer(b"".join(batch.column(3).to_pylist()), dtype=np.uint8)
            count = place & 127
            row = np.repeat(np.arange(len(count)), count)
            j = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            at = (np.cumsum(count + LENGTH - 1) - (count + LENGTH - 1))[row] + j
            keys = [_hash(*_prefix(flat, t), at, LENGTH).view(np.int64) if len(flat) else np.empty(0, dtype=np.int64) for t in (False, True)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, keys), pa.array(doc[row]), pa.array((place >> 14)[row] + j)], names=["key", "again", "doc_id", "start"])

    return spans.mapInArrow(common.tidied(work), "key bigint, again bigint, doc_id bigint, start bigint")


def _compared(rows: DataFrame, shelf: common.Shelf) -> DataFrame:
    """Of each id the rows that are compared: those of the text of least hash."""
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    several = shelf.put(rows.select("doc_id", text.alias("h")).groupBy("doc_id").agg(F.min("h").alias("least"), F.max("h").alias("last")).filter("least < last").select("doc_id", "least"))
    return rows.join(several, "doc_id", "left").withColumn("compared", F.col("doc_id").isNotNull() & F.coalesce(text == F.col("least"), F.lit(True))).drop("least")


def repeated_runs(rows: DataFrame, shelf: common.Shelf) -> DataFrame:
    """rows: doc_id, text, of one text an id. Per document with repeats: doc_id, runs array<struct<start, n>>: windows that occur earlier, by their starts in bytes."""
    common.small_batches(rows.sparkSession)
    sorted_out = shelf.put(_sort_out(_records(rows).repartition("anchor").sortWithinPartitions("anchor", "span", "again", F.expr("place & 16383"), "doc_id", "place")))
    runs = sorted_out.filter("NOT repeat").select("anchor", "doc_id", "place")
    hot = shelf.put(runs.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select("anchor"))
    one = rows.dropDuplicates(["doc_id"])
    found = shelf.put(_windows(_spans(runs.join(hot, "anchor", "left_anti"), one).repartition("anchor").sortWithinPartitions("anchor", "doc_id", "place")))
    whole = sorted_out.filter("repeat").select("doc_id", F.expr("place >> 14").alias("start"), F.expr("place & 127").alias("n")).union(found)
    if not hot.isEmpty():
        single = shelf.put(_single(_spans(runs.join(hot, "anchor", "left_semi"), one)))
        place = F.struct("doc_id", "start")
        first = single.groupBy("key", "again").agg(F.min(place).alias("first"), F.count("*").alias("times")).filter("times > 1").drop("times")
        whole = whole.union(single.join(first, ["key", "again"]).filter(place != F.col("first")).select("doc_id", "start", F.lit(1).cast("bigint")))
    return whole.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("runs"))


def _covered(starts, counts, size: int) -> list[tuple[int, int]]:
    """Maximal removed spans of a text."""
    out: list[list[int]] = []
    for s, n in sorted(zip(starts or (), counts or ())):
        e = min(size, s + n - 1 + LENGTH)
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _kept(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for s, e in spans:
        parts.append(text[at:s])
        at = e
    return b"".join([*parts, text[at:]])


SPANS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("n_spans", T.LongType()),
        T.StructField("kept_sha256", T.StringType()),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
    ]
)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: sizes, the removed spans (bytes, half open) and the SHA-256 of what is left."""
    shelf = common.Shelf(docs.sparkSession)
    rows = _compared(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")), shelf)
    runs = repeated_runs(rows.filter("compared").drop("compared"), shelf).withColumn("compared", F.lit(True))
    joined = rows.join(runs, ["doc_id", "compared"], "left").select("doc_id", "text", F.col("runs.start").alias("s"), F.col("runs.n").alias("n"))

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            texts = common.texts_as_bytes(batch.column(1))
            spans = [_covered(s, n, len(t)) for t, s, n in zip(texts, batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([sum(e - s for s, e in x) for x in spans], pa.int64()),
                    pa.array([len(x) for x in spans], pa.int64()),
                    pa.array([hashlib.sha256(_kept(t, x)).hexdigest() for t, x in zip(texts, spans)], pa.string()),
                    pa.array([[list(x) for x in y] for y in spans], pa.list_(pa.list_(pa.int64()))),
                ],
                names=SPANS.names,
            )

    return joined.mapInArrow(common.tidied(work), SPANS)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """The rows with shortened texts, all columns. Characters that lose a part of their bytes go as a whole."""
    names = docs.columns
    shelf = common.Shelf(docs.sparkSession)
    rows = _compared(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.struct(*names).alias("row")), shelf)
    runs = repeated_runs(rows.filter("compared").select("doc_id", "text"), shelf).withColumn("compared", F.lit(True))
    joined = rows.join(runs, ["doc_id", "compared"], "left").select(*(F.col("row").getField(c).alias(c) for c in names), F.col("runs.start").alias("__s"), F.col("runs.n").alias("__n"))
    at, size_at = names.index(text_col), names.index(size_col) if size_col in names else None

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(at).to_pylist()
            for k, (s, n) in enumerate(zip(batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist(), strict=True)):
                if s:
                    raw = texts[k].encode()
                    texts[k] = _kept(raw, _covered(s, n, len(raw))).decode("utf-8", "ignore")
            cols = list(batch.columns[: len(names)])
            cols[at] = pa.array(texts, cols[at].type)
            if size_at is not None:
                cols[size_at] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(cols[size_at].type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return joined.mapInArrow(common.tidied(work), docs.schema)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(common.table(spark, sf_dir, "documents")).drop("spans")
