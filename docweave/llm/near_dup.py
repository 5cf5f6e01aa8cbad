"""Near-duplicate documents by MinHash.

Method. A document's set is its distinct 5-word shingles (words lower-cased A-Z; a text of fewer words is
one shingle), as 64-bit hashes. 128 universal hash functions (a * x + b mod 2**64) give 128 minima, dealt
into 32 bands of 4. Documents of one set form a class, a node with a number of its own (the least of its rows'
numbers); only one text of a class goes on. Those that share a band are candidates; candidates whose signatures agree too little
are dropped, the others are confirmed on their full sets. Components come from alternating large-star and
small-star.

No pairs of a whole bucket are made. Round one compares each member of a bucket with the bucket's smallest
number. Where this leaves a bucket with one component, every further link in it would join what is joined.
Round two takes the other buckets: members outside the bucket's largest component (odd ones) are compared with the
members of other components, in tiles of two blocks of at most about TILE members: odd ones go to all tiles, the
others to one for each block of odd ones, so that a bucket of n members and few odd ones has about n rows. A tile compares bitmaps
of the full sets: each bit that one set has and the other lacks is a member that they do not share, which
bounds the similarity from above; only pairs that the bound lets through leave the tile, and are confirmed
on their full sets. So no component differs from that of all links that share a band; a link at similarity
0.85 shares none with probability 1e-10 (0.8: 1e-7).

Scale. Signatures (0.4 kB a document) are written once. Whole texts are shuffled once, for the documents
that share a bucket (a bitmap of bounded size keeps most others from the shuffle). Hot keys (a third of all documents in one class or bucket) are the skewed side of
sort-merge joins, which adaptive execution splits, or are counted with partial aggregation.

Edge cases: null, empty or wordless texts have an empty set: n_shingles 0, linked with nothing, kept; rows
that repeat an id have a result row each and one component: the different sets of an id are classes that the id
links; a null id links nothing, and is returned with the component of its text's class (null if it is the only one) and kept;
ties go to the smallest id; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.llm import common
from docweave.llm.components import connected_components

SHINGLE, BANDS, ROWS = 5, 32, 4
HASHES = BANDS * ROWS
TILE = 512
#: A set of n members has a bitmap of 8 to 16 n bits, up to this many bytes; the bound holds at any size.
BITMAP_BYTES = 1 << 15
_STEPS = common.mix(np.arange(1, SHINGLE + 1, dtype=np.uint64)) | np.uint64(1)
_A = common.mix(np.arange(1001, 1001 + HASHES, dtype=np.uint64)) | np.uint64(1)
_B = common.mix(np.arange(5001, 5001 + HASHES, dtype=np.uint64))
_BAND = common.mix(np.arange(9001, 9001 + BANDS, dtype=np.uint64))

SIGNATURES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("print", T.LongType()),
        T.StructField("n_shingles", T.LongType()),
        T.StructField("set_a", T.LongType()),
        T.StructField("set_b", T.LongType()),
        T.StructField("sketch", T.BinaryType()),
        T.StructField("bands", T.ArrayType(T.LongType(), False)),
    ]
)


def shingle_set(text: bytes, hashes: common.WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    words = text.lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = hashes(words)
    if len(h) < SHINGLE:
        h = np.concatenate([h, np.full(SHINGLE - len(h), np.uint64(len(h)), dtype=np.uint64)])
    n = len(h) - SHINGLE + 1
    total = np.zeros(n, dtype=np.uint64)
    for k in range(SHINGLE):
        total += h[k : k + n] * _STEPS[k]
    return np.unique(common.mix(total))


def minima(s: np.ndarray) -> np.ndarray:
    best = np.full(HASHES, np.uint64(0xFFFFFFFFFFFFFFFF), dtype=np.uint64)
    for at in range(0, len(s), 512):
        h = s[at : at + 512, None] * _A
        h += _B
        np.minimum(best, h.min(axis=0), out=best)
    return best


def signatures(rows: DataFrame) -> DataFrame:
    """rows: doc_id, text, print (a hash of the text, passed through)."""

    def work(batches):
        import pyarrow as pa
        import xxhash

        hashes = common.WordHashes()
        for batch in batches:
            n, a, b, sketch, bands = [], [], [], [], []
            for text in common.texts_as_bytes(batch.column(1)):
                s = shingle_set(text, hashes)
                n.append(len(s))
                if not len(s):
                    a.append(None), b.append(None), sketch.append(None), bands.append([])
                    continue
                whole = xxhash.xxh3_128_intdigest(s.tobytes())
                a.append((whole >> 64) - (1 << 63)), b.append((whole & 0xFFFFFFFFFFFFFFFF) - (1 << 63))
                m = minima(s)
                key = _BAND.copy()
                for row in m.reshape(BANDS, ROWS).T:
                    key = common.mix(key ^ row)
                sketch.append(common.mix(m).astype(np.uint8).tobytes())
                bands.append(key.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sketch, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=SIGNATURES.names)

    return rows.mapInArrow(common.tidied(work), SIGNATURES)


def _similar_sketches(pairs: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """Signature verification: pairs (a, b) whose minima agree often enough."""
    joined = pairs.join(sketches.select(F.col("doc_id").alias("a"), F.col("sketch").alias("x")), "a").join(sketches.select(F.col("doc_id").alias("b"), F.col("sketch").alias("y")), "b").select("a", "b", "x", "y")

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.uint8).reshape(-1, HASHES) for k in (2, 3))
            yield batch.select([0, 1]).filter(pa.array((x == y).mean(axis=1) >= least))

    return joined.mapInArrow(common.tidied(work), "a bigint, b bigint")


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs linked by their full sets."""
    joined = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "x", "y")

    def work(batches):
        import pyarrow as pa

        hashes, last, of_last = common.WordHashes(), None, None
        for batch in batches:
            keep = []
            for b, x, y in zip(batch.column(1).to_pylist(), common.texts_as_bytes(batch.column(2)), common.texts_as_bytes(batch.column(3)), strict=True):
                if b != last:
                    last, of_last = b, shingle_set(y, hashes)
                s = shingle_set(x, hashes)
                both = len(np.intersect1d(s, of_last, assume_unique=True))
                keep.append(100 * both >= percent * (len(s) + len(of_last) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(common.tidied(work), "a bigint, b bigint")


def bitmap(members: np.ndarray) -> np.ndarray:
    """Bits of a set, in a power of two of 64-bit words."""
    words = min(BITMAP_BYTES // 8, 1 << max(0, (max(1, len(members)) - 1).bit_length() - 3))
    bits = np.zeros(words * 64, dtype=bool)
    bits[(members >> np.uint64(20)).astype(np.int64) & (len(bits) - 1)] = True
    return np.packbits(bits).view(np.uint64)


def _folded(bits: np.ndarray) -> np.ndarray:
    """Bitmaps (by row) of half the size: a member's place loses its top bit."""
    half = bits.shape[1] // 2
    return bits[:, :half] | bits[:, half:]


def open_pairs(ids, sizes, bits, parts, main, side, percent: int) -> list[tuple[int, int]]:
    """Pairs of a tile, of different parts, whose bitmaps don't rule a link out. side: 0 or 1; pairs are made across, or within if there is one side."""
    found, both = [], len(np.unique(side)) > 1
    words = np.array([len(b) // 8 for b in bits])
    for level in np.unique(words):
        at = np.flatnonzero((words == level) | (words == 2 * level))
        if len(at) < 2:
            continue
        own = words[at] == level
        table = np.empty((len(at), level), dtype=np.uint64)
        table[own] = np.frombuffer(b"".join(bits[k] for k in at[own]), dtype=np.uint64).reshape(-1, level)
        if not own.all():
            table[~own] = _folded(np.frombuffer(b"".join(bits[k] for k in at[~own]), dtype=np.uint64).reshape(-1, 2 * level))
        n, part, where = sizes[at], parts[at], side[at]
        for k in np.flatnonzero(part != main):
            ok = (part != part[k]) & ((part == main) | (ids[at] > ids[at[k]])) & (own | own[k]) & (100 * np.minimum(n, n[k]) >= percent * np.maximum(n, n[k]))
            if both:
                ok &= where != where[k]
            others = np.flatnonzero(ok)
            if not len(others):
                continue
            mine, theirs = table[k], table[others]
            shared = np.minimum(n[k] - np.bitwise_count(mine & ~theirs).sum(axis=1, dtype=np.int64), n[others] - np.bitwise_count(theirs & ~mine).sum(axis=1, dtype=np.int64))
            found += [(int(ids[at[k]]), int(ids[at[j]])) for j in others[100 * shared >= percent * (n[k] + n[others] - shared)]]
    return found


def tiles(apart: DataFrame) -> DataFrame:
    """apart: key, id, part. Each row once for every tile (key, i, j) that it has a side in; main is the bucket's largest part."""
    parts = apart.groupBy("key", "part").agg(F.count("*").alias("n"))
    sizes = parts.groupBy("key").agg(F.max_by("part", F.struct("n", F.negative("part"))).alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("n"))
    sizes = sizes.select("key", "main", F.ceil((F.col("n") - F.col("n_main")) / TILE).alias("odd_blocks"), F.ceil(F.col("n_main") / TILE).alias("main_blocks"))
    placed = apart.join(sizes, "key").withColumn("odd", F.col("part") != F.col("main"))
    placed = placed.withColumn("own", F.when(F.col("odd"), F.expr("pmod(xxhash64(id), odd_blocks)")).otherwise(F.expr("odd_blocks + pmod(xxhash64(id), main_blocks)")))
    others = F.sequence(F.lit(0).cast("bigint"), F.when(F.col("odd"), F.col("odd_blocks") + F.col("main_blocks")).otherwise(F.col("odd_blocks")) - 1)
    tiled = placed.select("key", "id", "part", "main", "own", F.explode(others).alias("other"))
    return tiled.select("key", "id", "part", "main", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"))


def _across(named: DataFrame, texts: DataFrame, shelf: common.Shelf, percent: int) -> DataFrame:
    """Round two. named: key, id, part. Pairs (a, b) of different parts that share a bucket and may be linked."""
    mixed = named.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).filter("lo < hi").select("key")
    apart = shelf.put(named.join(mixed, "key"))

    def drawn(batches):
        import pyarrow as pa

        hashes = common.WordHashes()
        for batch in batches:
            sets = [shingle_set(t, hashes) for t in common.texts_as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array([bitmap(x).tobytes() for x in sets], pa.binary())], names=["id", "n", "bits"])

    maps = texts.join(apart.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(common.tidied(drawn), "id bigint, n bigint, bits binary")
    tiled = tiles(apart)
    rows = tiled.join(maps, "id").select("key", "i", "j", "id", "part", "main", "side", "n", "bits").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def work(batches):
        import pyarrow as pa

        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            same = np.logical_and.reduce([(c := held.column(k).to_numpy()) == c[-1] for k in range(3)])
            cut = int(np.flatnonzero(~same).max(initial=-1)) + 1
            if cut:
                yield done(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield done(held)

    def done(t):
        import pyarrow as pa

        key, i, j, ids, part, main, side, n = (t.column(k).to_numpy() for k in range(8))
        bits = t.column(8).to_pylist()
        edge = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        found: set[tuple[int, int]] = set()
        for a, b in zip([0, *edge], [*edge, len(key)], strict=True):
            found.update(open_pairs(ids[a:b], n[a:b], bits[a:b], part[a:b], main[a], side[a:b], percent))
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], names=["a", "b"])

    return rows.mapInArrow(common.tidied(work), "a bigint, b bigint").distinct()


def _likely(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """rows whose id is likely among ids: no false drops. A bitmap of 16 bits an id, 8 MB at most, is broadcast;
    past that size more rows pass, and the join that follows decides."""
    bits = 1 << min(26, max(20, (16 * max(1, ids.count()) - 1).bit_length()))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    maps = ids.select((place / 32768).cast("int").alias("slot"), (place % 32768).alias("at")).groupBy("slot").agg(F.expr("bitmap_construct_agg(at)").alias("map"))
    bit = "shiftright(cast(conv(hex(substring(map, cast(at div 8 as int) + 1, 1)), 16, 10) as int), cast(at % 8 as int)) & 1 = 1"
    return rows.withColumn("slot", (place / 32768).cast("int")).withColumn("at", place % 32768).join(F.broadcast(maps), "slot").filter(bit).drop("slot", "at", "map")


def _of_one_id(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes that share an id: the first of an id's classes with each other one."""
    several = sets.groupBy("doc_id").agg(*(f(c).alias(f"{n}_{c}") for c in ("set_a", "set_b") for n, f in (("min", F.min), ("max", F.max)))).filter("min_set_a <> max_set_a OR min_set_b <> max_set_b")
    held = sets.join(several.select("doc_id"), "doc_id", "left_semi").select("doc_id", "set_a", "set_b").distinct().join(classes, ["set_a", "set_b"]).select("doc_id", "node")
    first = held.groupBy("doc_id").agg(F.min("node").alias("b"))
    return held.join(first, "doc_id").filter("node <> b").select(F.col("node").alias("a"), "b")


def _named(classes: DataFrame, found: DataFrame) -> DataFrame:
    """classes with component_id: the smallest id of all classes of the component (found: node, root)."""
    placed = found.select("node", "root").union(found.select(F.col("root").alias("node"), "root").distinct())
    least = placed.join(classes.select("node", "least"), "node").groupBy("root").agg(F.min("least").alias("component_id"))
    return classes.join(placed.join(least, "root").select("node", "component_id"), "node", "left").select("set_a", "set_b", "size", F.coalesce("component_id", "least").alias("component_id"))


def near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept (one document of each component)."""
    spark = docs.sparkSession
    common.small_batches(spark)
    shelf = common.Shelf(spark)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("print", F.xxhash64("text"))
    signed = shelf.put(signatures(rows).withColumn("row", F.monotonically_increasing_id()))

    sets = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = shelf.put(sets.groupBy("set_a", "set_b").agg(F.min("row").alias("node"), F.min("doc_id").alias("least"), F.count("*").alias("size")))
    #: From here to the naming of components doc_id is a class's node; id and print find its text.
    chosen = shelf.put(sets.join(classes.select(F.col("node").alias("row")), "row").select(F.col("row").alias("doc_id"), F.col("doc_id").alias("id"), "print", "sketch", "bands"))

    banded = chosen.select(F.col("doc_id").alias("id"), F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last").select("key", "first")
    members = shelf.put(banded.join(shared, "key").select("key", "id", "first"))
    sketches = shelf.put(chosen.select("doc_id", "id", "print", "sketch").join(members.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi"))
    wanted = sketches.select(F.col("doc_id").alias("node"), F.col("id").alias("doc_id"), "print")
    #: An inner join (the nodes are distinct): the optimizer would move a semi join below the bitmap.
    texts = shelf.put(_likely(rows, wanted.select("doc_id")).join(wanted, ["doc_id", "print"]).dropDuplicates(["node"]).select(F.col("node").alias("doc_id"), "text"))
    #: 128 minima at similarity s agree in s of the places, give or take sqrt(s * (1 - s) / 128): seven times that is left.
    share = percent / 100
    least = share - 7 * (share * (1 - share) / HASHES) ** 0.5

    stars = members.filter("id != first").select(F.col("id").alias("a"), F.col("first").alias("b")).distinct()
    confirmed = _confirmed(_similar_sketches(stars, sketches, least), texts, percent)
    links = shelf.put(confirmed.union(_of_one_id(sets, classes)))
    found = connected_components(links, shelf, "a", "b")

    named = members.join(found.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("root", "id").alias("part"))
    more = shelf.put(_confirmed(_across(named, texts, shelf, percent), texts, percent))
    if not more.isEmpty():
        found = connected_components(links.union(more), shelf, "a", "b")
    for done in (texts, sketches, members, chosen, links, more):
        shelf.drop(done)

    named = shelf.put(_named(classes, found))

    #: Classes of a thousandth of all rows and more are a thousand at most: they are broadcast, so that a hot
    #: class is named where its rows lie; the other classes meet theirs by key.
    keyed = signed.select("doc_id", "n_shingles", "set_a", "set_b")
    hot = shelf.put(named.filter(F.col("size") > max(1000, signed.count() // 1000)).select("set_a", "set_b", F.col("component_id").alias("hot")))
    marked = keyed.filter("n_shingles > 0").join(F.broadcast(hot), ["set_a", "set_b"], "left")
    cold = marked.filter("hot IS NULL").drop("hot").join(named.drop("size"), ["set_a", "set_b"], "left")
    whole = cold.select("doc_id", "n_shingles", "component_id").unionByName(marked.filter("hot IS NOT NULL").select("doc_id", "n_shingles", F.col("hot").alias("component_id")))
    #: Empty texts have no class: joined by null they would meet in one task.
    whole = whole.unionByName(keyed.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return whole.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_first_copies(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of the kept documents, all columns."""
    dropped = near_duplicates(docs, percent, id_col, text_col).filter(~F.col("kept")).select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(dropped, id_col, "left_anti").select(*docs.columns)


def op6_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"), percent=85)
