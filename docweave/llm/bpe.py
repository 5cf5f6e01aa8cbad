"""Byte-level BPE encoding and decoding as DuckDB recursive queries, one database per partition.

Method. A text is cut by the tokenizer's pattern; each distinct piece that is no token by itself becomes
token-position rows (word, position, token). A recursive query joins neighbouring rows with the merge
table, finds each word's pair of least rank (the leftmost one on ties), contracts it, and goes on until no
word has a pair left. Decoding joins ids with the vocabulary and aggregates the bytes in position order.

Long pieces (over LONG bytes) contract, in one step, every non-overlapping occurrence of the least pair
where this provably equals one contraction after another: no token that starts or ends with the merged
token ranks below it. All other pairs are contracted one at a time.

Edge cases: a null or empty text has no ids and decodes to no bytes; special tokens do not exist (their
strings are ordinary text); repeated rows give repeated results; other columns of the input are not read.
"""

from __future__ import annotations

import base64
import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from docweave.llm import common

LONG = 48
#: Pieces whose ids a worker remembers: it bounds memory and changes no result.
REMEMBERED = 1_000_000
BATCH_BYTES = 12_000_000

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
        T.StructField("decoded", T.BinaryType()),
    ]
)
DIGEST = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
)

_STEP = """
WITH RECURSIVE step(w, p, t, live) AS (
  SELECT w, p, t, true FROM positions
  UNION ALL
  (WITH pairs AS MATERIALIZED (
     SELECT a.w, a.p, a.t, a.np, (m.r << 20) | a.p AS k
     FROM (SELECT w, p, t, lead(t) OVER word AS nt, lead(p) OVER word AS np
           FROM step WHERE live WINDOW word AS (PARTITION BY w ORDER BY p)) a
     LEFT JOIN merges m ON m.a = a.t AND m.b = a.nt),
   best AS MATERIALIZED (
     SELECT w, min(k) AS k, arg_min(np, k) AS gone FROM pairs WHERE k IS NOT NULL GROUP BY w)
   SELECT x.w, x.p, CASE WHEN x.k = b.k THEN b.k >> 20 ELSE x.t END, b.k IS NOT NULL
   FROM pairs x LEFT JOIN best b ON b.w = x.w
   WHERE b.gone IS NULL OR x.p <> b.gone)
)
SELECT w, t FROM step WHERE NOT live ORDER BY w, p
"""

#: The same for long words: where the merge is `safe`, every second pair of each run of equal least pairs.
_STEP_LONG = """
WITH RECURSIVE step(w, p, t, live) AS (
  SELECT w, p::BIGINT, t, true FROM positions
  UNION ALL
  SELECT w, p, CASE WHEN hit THEN mr ELSE t END, mr IS NOT NULL
  FROM (
    SELECT w, p, t, mr, hit, lag(hit) OVER (PARTITION BY w ORDER BY p) AS gone
    FROM (
      SELECT w, p, t, mr,
             coalesce(r = mr AND (CASE WHEN safe
               THEN (row_number() OVER (PARTITION BY w, r = mr, rn - nth ORDER BY p)) % 2 = 1
               ELSE nth = 1 END), false) AS hit
      FROM (
        SELECT *, row_number() OVER (PARTITION BY w, r = mr ORDER BY p) AS nth
        FROM (
          SELECT a.*, m.r, m.safe, min(m.r) OVER (PARTITION BY a.w) AS mr
          FROM (SELECT w, p, t, lead(t) OVER word AS nt, row_number() OVER word AS rn
                FROM step WHERE live WINDOW word AS (PARTITION BY w ORDER BY p)) a
          LEFT JOIN merges m ON m.a = a.t AND m.b = a.nt))))
  WHERE gone IS NULL OR NOT gone
)
SELECT w, t FROM step WHERE NOT live ORDER BY w, p
"""

_DECODE = """
SELECT i.doc, string_agg(v.piece, '' ORDER BY i.pos)
FROM ids i JOIN vocabulary v ON v.id = i.id GROUP BY i.doc
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def white_space_pattern(pattern: str) -> str:
    """The pattern for the regex module: its \\s also holds \\x1c-\\x1f, which are not White_Space."""
    return pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")


class Codec:
    """One per Python worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import duckdb
        import pyarrow as pa
        import regex

        self.ranks, self.cut = ranks, regex.compile(white_space_pattern(pattern)).findall
        self.remembered, self.showing = REMEMBERED, True
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self._forget()
        #: What a query of one long text cannot hold goes to the worker's own temporary folder, within a bound, and is gone with it.
        self.spill = tempfile.TemporaryDirectory(prefix="bpe-")
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": self.spill.name, "max_temp_directory_size": "8GB"})
        a, b, r = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    a.append(left), b.append(right), r.append(rank)
        a, b, r = (np.array(x, dtype=np.int64) for x in (a, b, r))
        unsafe = np.unique(np.concatenate([a[r < a], b[r < b]]))
        self.db.register("m", pa.table({"a": a, "b": b, "r": r, "safe": ~np.isin(r, unsafe)}))
        self.db.execute("CREATE TABLE merges AS SELECT * FROM m")
        #: A byte is the character of the same number, so that texts of bytes can be aggregated.
        self.db.register("v", pa.table({"id": list(ranks.values()), "piece": [t.decode("latin-1") for t in ranks]}))
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM v")
        self.db.unregister("m"), self.db.unregister("v")

    def _forget(self) -> None:
        """known: piece -> its number; then, by number, its ids as one text, and all ids with the places where a piece's begin."""
        self.known: dict[str, int] = {}
        self.shown: list[str] = []
        self.ids, self.begin = np.empty(0, dtype=np.int32), np.zeros(1, dtype=np.int64)

    def _contract(self, words: list[bytes], query: str) -> list[list[int]]:
        import pyarrow as pa

        lengths = np.array([len(w) for w in words])
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.db.register("positions", pa.table({"w": np.repeat(np.arange(len(words)), lengths), "p": np.arange(len(flat)) - starts, "t": self.byte[flat]}))
        got = self.db.execute(query).fetchnumpy()
        self.db.unregister("positions")
        return [x.tolist() for x in np.split(got["t"], np.flatnonzero(np.diff(got["w"])) + 1)]

    def learn(self, pieces: set[str]) -> None:
        """Ids of pieces that are not known yet."""
        if len(self.known) > self.remembered or self.showing != bool(self.shown) and self.known:
            self._forget()
        new, ids, short, long = [], [], [], []
        for piece in pieces:
            if piece not in self.known:
                raw = piece.encode()
                if (whole := self.ranks.get(raw)) is not None:
                    new.append(piece), ids.append([whole])
                else:
                    (short if len(raw) <= LONG else long).append((piece, raw))
        for some, query in ((short, _STEP), (long, _STEP_LONG)):
            for at in range(0, len(some), 60_000):
                part = some[at : at + 60_000]
                new += [piece for piece, _ in part]
                ids += self._contract([raw for _, raw in part], query)
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        if self.showing:
            self.shown += [",".join(map(str, x)) for x in ids]
        flat = [i for x in ids for i in x]
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum([len(x) for x in ids], dtype=np.int64)])
        self.ids = np.concatenate([self.ids, np.array(flat, dtype=np.int32)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
        """All ids of the texts, the number of each text's, and each text's pieces by number."""
        cut = [self.cut(t) for t in texts]
        self.learn(set().union(*cut) if cut else set())
        known = self.known
        numbers = [[known[p] for p in pieces] for pieces in cut]
        each = np.array([len(x) for x in numbers], dtype=np.int64)
        flat = np.fromiter((i for x in numbers for i in x), dtype=np.int64, count=int(each.sum()))
        lengths = self.begin[flat + 1] - self.begin[flat]
        place = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(each)])]
        return self.ids[np.repeat(self.begin[flat], lengths) + place], np.diff(ends), numbers

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> list[bytes]:
        import pyarrow as pa

        out = [b""] * len(lengths)
        if len(ids):
            self.db.register("ids", pa.table({"doc": np.repeat(np.arange(len(lengths), dtype=np.int32), lengths), "pos": np.arange(len(ids), dtype=np.int32), "id": ids}))
            for doc, text in self.db.execute(_DECODE).fetchall():
                out[doc] = text.encode("latin-1")
            self.db.unregister("ids")
        return out


_CODECS: dict[str, Codec] = {}


def _codec(key: str, ranks: dict[bytes, int], pattern: str) -> Codec:
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(ranks, pattern)
    return _CODECS[key]


def _runs(texts: list[str], most: int) -> Iterator[slice]:
    """Slices of about `most` characters: bounds the rows of one DuckDB query. A text is never cut."""
    start = size = 0
    for at, text in enumerate(texts):
        size += len(text)
        if size >= most:
            yield slice(start, at + 1)
            start, size = at + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, digest: bool = False, remembered: int = REMEMBERED, batch_bytes: int = BATCH_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its ids and the bytes that they decode to, or (digest) their count and SHA-256.

    The rank file is read on the driver and broadcast: its size is that of a vocabulary (about 1 MB),
    whatever the corpus. No shuffle. remembered and batch_bytes bound a worker's memory and change no result.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for part in _runs(texts, batch_bytes):
                codec = _codec(ranks_path, ranks.value, pattern)
                codec.remembered, codec.showing = remembered, digest
                ids, lengths, numbers = codec.encode(texts[part])
                raw = codec.decode(ids, lengths)
                out = {"doc_id": batch.column(0)[part.start : part.stop]}
                if digest:
                    out |= {
                        "n_tokens": pa.array(lengths, pa.int64()),
                        "ids_sha256": [hashlib.sha256(",".join([codec.shown[i] for i in x]).encode()).hexdigest() for x in numbers],
                        "decoded_sha256": [hashlib.sha256(x).hexdigest() for x in raw],
                    }
                else:
                    out |= {"ids": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(ids, pa.int32())), "decoded": pa.array(raw, pa.binary())}
                yield pa.RecordBatch.from_pydict(out)

    rows = docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"cast(`{text_col}` as string) as text")
    return rows.mapInArrow(common.tidied(work), DIGEST if digest else SCHEMA)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digest=True)
