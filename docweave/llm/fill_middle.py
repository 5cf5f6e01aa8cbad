"""Fill-in-middle transformation: one numpy kernel over whole Arrow batches of UTF-8 text.

Method. The bytes of all texts of a batch are one array. A lookup gives each byte's class, a table over the
classes of adjacent bytes marks where a unit begins (every code point, every word or every line), and a cumulative
sum that starts anew at each document numbers the units. The cuts of all rows are found together by searchsorted
in that sum, and prefix, middle, suffix and markers of all rows are gathered into one output buffer.

The two cuts and the form of a document come from the SHA-256 of "seed:doc_id", in the JVM, so they are the same
however rows are dealt. `restore` rebuilds the texts from outputs and forms by the same kind of kernel.

Scale. No shuffle: documents are transformed where they are. A batch is bounded by its rows and cut again by
bytes (STEP), so memory is a small multiple of STEP or of the longest single text.

Edge cases: a null or empty text is plain and empty, with n = 0; a text that holds a marker is plain; a null id
hashes as the seed alone and comes back null; repeated rows give repeated results; an empty table gives no rows;
columns of the input other than the two named are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm import common

# The markers of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, PSM, SPM = 0, 1, 2
FORMS = np.array(["plain", "psm", "spm"], dtype=object)
#: Bytes of text that the kernel takes at a time.
STEP = 4_000_000
#: Of each byte: 0 begins a code point, 1 goes on with one, 2 is white space, 3 is a line's end.
CLASS = np.zeros(256, dtype=np.uint8)
CLASS[0x80:0xC0] = 1
CLASS[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = 2
CLASS[0x0A] = 3
#: STARTS[unit][class before, class here]: whether a unit begins here. A document's first byte always begins one.
STARTS = {
    "code_point": np.array([[c != 1 for c in range(4)] for _ in range(4)]),
    "word": np.array([[b >= 2 and c < 2 for c in range(4)] for b in range(4)]),
    "line": np.array([[b == 3 for _ in range(4)] for b in range(4)]),
}


def strings(column) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and bytes of an Arrow string column; null is empty."""
    import pyarrow as pa

    flat = column.cast(pa.large_binary())
    n = len(flat)
    if not n:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = flat.buffers()
    at = np.frombuffer(offsets, np.int64)[flat.offset : flat.offset + n + 1]
    held = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return at - at[0], held


def found(data: np.ndarray, marker: bytes) -> np.ndarray:
    """Places where a three-byte marker begins, ascending."""
    if len(data) < 3:
        return np.zeros(0, np.int64)
    return np.flatnonzero((data[:-2] == marker[0]) & (data[1:-1] == marker[1]) & (data[2:] == marker[2]))


def gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of rows whose pieces are data[start : start + length], piece by piece (2-d: row, piece)."""
    s, k = starts.ravel(), lengths.ravel()
    ends = np.cumsum(k)
    place = np.repeat(s - (ends - k), k) + np.arange(ends[-1] if len(ends) else 0)
    return np.concatenate([[0], ends[lengths.shape[1] - 1 :: lengths.shape[1]]]), data[place]


def cut(offsets: np.ndarray, data: np.ndarray, h: np.ndarray, unit: str, plain_percent: int, spm_percent: int):
    """n, form, prefix units, middle units, output offsets, output bytes of all rows; h: four numbers a row."""
    rows = len(offsets) - 1
    kind = CLASS[data]
    begins = np.ones(len(data), dtype=bool)
    begins[1:] = STARTS[unit][kind[:-1], kind[1:]]
    begins[offsets[:-1][offsets[:-1] < len(data)]] = True
    count = np.concatenate([[0], np.cumsum(begins)])  # units that begin before each byte
    base = count[offsets[:-1]]
    n = count[offsets[1:]] - base

    a, b = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
    first, last = np.minimum(a, b), np.maximum(a, b)
    marked = np.zeros(rows, dtype=bool)
    for m in (PREFIX, SUFFIX, MIDDLE):
        at = found(data, m)
        marked |= np.searchsorted(at, offsets[:-1]) < np.searchsorted(at, np.maximum(offsets[1:] - 2, offsets[:-1]))
    form = np.where((n == 0) | marked | (h[:, 2] % 100 >= plain_percent), PLAIN, np.where(h[:, 3] % 100 < spm_percent, SPM, PSM))

    def place(k):
        """The byte where unit k (from 0) of each row begins; its end for k = n."""
        return np.minimum(np.searchsorted(count, base + k + 1) - 1, offsets[1:])

    p, q, plain = place(first), place(last), form == PLAIN
    head, tail, end = offsets[:-1], offsets[1:], len(data)
    marks = {m: np.full(rows, end + 3 * k) for k, m in enumerate((PREFIX, SUFFIX, MIDDLE))}
    three, spm = np.where(plain, 0, 3), form == SPM
    pre, suf, mid = (head, p - head), (q, tail - q), (p, q - p)
    swap = lambda x, y: tuple(np.where(spm, v, u) for u, v in zip(x, y))
    pieces = [
        (np.where(spm, marks[SUFFIX], marks[PREFIX]), three),
        swap(pre, suf),
        (np.where(spm, marks[PREFIX], marks[SUFFIX]), three),
        swap(suf, pre),
        (marks[MIDDLE], three),
        mid,
    ]
    starts, lengths = (np.stack([x[k] for x in pieces], axis=1) for k in (0, 1))
    starts[plain, 1], lengths[plain] = head[plain], 0
    lengths[plain, 1] = (tail - head)[plain]
    out = gather(np.concatenate([data, np.frombuffer(PREFIX + SUFFIX + MIDDLE, np.uint8)]), starts, lengths)
    return n, form, first, last - first, *out


def joined(offsets: np.ndarray, data: np.ndarray, form: np.ndarray):
    """Offsets and bytes of the texts that outputs of the given forms were made of."""
    head, tail, plain = offsets[:-1], offsets[1:], form == PLAIN
    spm = form == SPM

    def first(marker, after):
        at = np.append(found(data, marker), len(data))
        return np.minimum(at[np.searchsorted(at, np.minimum(after, len(data)))], tail)

    second = np.where(spm, first(PREFIX, head + 3), first(SUFFIX, head + 3))
    third = first(MIDDLE, second + 3)
    one, two, mid = (head + 3, second - head - 3), (second + 3, third - second - 3), (third + 3, tail - third - 3)
    pieces = [tuple(np.where(spm, v, u) for u, v in zip(one, two)), mid, tuple(np.where(spm, v, u) for u, v in zip(two, one))]
    starts, lengths = (np.stack([x[k] for x in pieces], axis=1) for k in (0, 1))
    starts[plain, 0], lengths[plain] = head[plain], 0
    lengths[plain, 0] = (tail - head)[plain]
    return gather(data, starts, lengths)


def _steps(offsets: np.ndarray, step: int):
    """Runs of rows with `step` bytes or one row."""
    a, rows = 0, len(offsets) - 1
    while a < rows:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + step, side="right")) - 1)
        yield a, min(b, rows)
        a = b


def _text(offsets: np.ndarray, data: np.ndarray):
    import pyarrow as pa

    wide = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
    return wide.cast(pa.string())


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "code_point", plain_percent: int = 90, spm_percent: int = 20, seed: str = "1", step: int = STEP) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_units, middle_units (null if plain), output.

    plain_percent: a document whose third number modulo 100 is this or more stays plain. step: bytes of text that the
    kernel takes at a time."""
    if unit not in STARTS:
        raise KeyError(unit)
    common.small_batches(docs.sparkSession)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    numbers = F.array(*[F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)])

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            offsets, data = strings(batch.column("text"))
            h = batch.column("h").flatten().to_numpy().reshape(-1, 4)
            for a, b in _steps(offsets, step):
                n, form, first, middle, at, out = cut(offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]], h[a:b], unit, plain_percent, spm_percent)
                plain = form == PLAIN
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[a:b], pa.array(n.astype(np.int64)), pa.array(FORMS[form], pa.string()), pa.array(first.astype(np.int64), mask=plain), pa.array(middle.astype(np.int64), mask=plain), _text(at, out)],
                    names=["doc_id", "n", "form", "prefix_units", "middle_units", "output"],
                )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), numbers.alias("h"))
    return rows.mapInArrow(common.tidied(work), f"doc_id {dict(docs.dtypes)[id_col]}, n bigint, form string, prefix_units bigint, middle_units bigint, output string")


def restore(made: DataFrame, output_col: str = "output", form_col: str = "form", step: int = STEP) -> DataFrame:
    """The rows with a column `restored`: the text before the transformation, from output and form alone."""
    common.small_batches(made.sparkSession)
    numbers = {"plain": PLAIN, "psm": PSM, "spm": SPM}

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            offsets, data = strings(batch.column(output_col))
            form = np.array([numbers[f] for f in batch.column(form_col).to_pylist()], dtype=np.int64)
            for a, b in _steps(offsets, step):
                text = _text(*joined(offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]], form[a:b]))
                yield pa.RecordBatch.from_arrays([*(c[a:b] for c in batch.columns), text], names=[*batch.schema.names, "restored"])

    from pyspark.sql.types import StringType, StructType

    return made.mapInArrow(common.tidied(work), StructType([*made.schema.fields]).add("restored", StringType()))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = restore(transform(common.table(spark, sf_dir, "documents")))
    digest = lambda name: F.sha2(F.col(name).cast("binary"), 256)
    return made.select("doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"), digest("output").alias("output_sha256"), digest("restored").alias("restored_sha256"))
