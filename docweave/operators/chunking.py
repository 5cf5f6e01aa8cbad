"""Splitting text into chunks: fixed windows, size-bounded folds, row bundles, semantic merges, detection.

Window chunking is one expression. The folds carry state from block to block, so they run once per document
in Arrow groups; a document is the bound of a group.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions import vectors as vx
from docweave.operators.groups import by_group

TokenCounter = Callable[[str], int]


_TOKENS = re.compile(r"\w{1,4}|[^\w\s]")
#: A word that starts with `_` is one token.
_TOKENS_MARKED = re.compile(r"\b_\w*|\w{1,4}|[^\w\s]")


def approximate_tokens(text: str) -> int:
    """A deterministic stand-in for a subword counter: one token per four letters of a word, one per mark."""
    return len((_TOKENS_MARKED if "_" in text else _TOKENS).findall(text))


def fixed_windows(docs: DataFrame, size: int = 800, overlap: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """chunk_id, doc_id, chunk_index, content, char_count; a window that reaches the end is the last."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and under size")
    step, n = size - overlap, F.length(text_col)
    count = F.when(n <= size, F.when(n > 0, 1).otherwise(0)).otherwise(1 + F.ceil((n - size) / step)).cast("int")
    at = F.explode(F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>")))
    cut = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), at.alias("chunk_index"))
    content = F.col("text").substr(F.col("chunk_index") * step + 1, F.lit(size))
    return cut.select(F.concat_ws("-", "doc_id", "chunk_index").alias("chunk_id"), "doc_id", "chunk_index", content.alias("content")).withColumn("char_count", F.length("content"))


#: White space as Python's str.isspace has it, so that both sides count the same characters.
SPACE = "[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def solid(text) -> Column:
    """How many characters are no white space."""
    return F.length(F.regexp_replace(text, SPACE, "")).cast("bigint")


def fixed_blocks(blocks: DataFrame, size: int = 800, overlap: int = 100, max_tokens: int | None = None, count: TokenCounter = approximate_tokens) -> DataFrame:
    """doc_id, chunk_index, content, char_count, tokens (null without a bound), block_no, page, section.

    blocks: doc_id, block_no, text, page, section; a document is its blocks' texts joined by newlines. It is cut into
    windows as in `fixed_windows`; blank windows are left out; one of more than max_tokens is split again by sentences,
    which drops and normalises white space between them. A chunk belongs to the block that holds its first character: what is
    no white space keeps its number through all of this, so chunks and blocks meet by that running count, as an as-of
    join over one sorted sequence per document. Null texts are empty; documents without a visible character have no chunk."""
    rows = blocks.select("doc_id", "block_no", F.coalesce("text", F.lit("")).alias("text"), "page", "section")
    whole = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("block_no", "text"))).alias("b")).select("doc_id", F.array_join(F.col("b.text"), "\n").alias("text"))
    step = size - overlap
    cut = fixed_windows(whole, size, overlap).select("doc_id", F.col("chunk_index").alias("window"), "content")
    by_window = Window.partitionBy("doc_id").orderBy("window").rowsBetween(Window.unboundedPreceding, -1)
    windows = cut.withColumn("at", F.coalesce(F.sum(solid(F.substring("content", 1, step))).over(by_window), F.lit(0))).filter(solid("content") > 0)
    parts = windows.select("doc_id", "window", F.lit(0).alias("part"), "at", "content", F.lit(None).cast("int").alias("tokens")) if max_tokens is None else _split_windows(windows, size, max_tokens, count)

    by_block = Window.partitionBy("doc_id").orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.withColumn("n", solid("text")).filter("n > 0").withColumn("at", F.coalesce(F.sum("n").over(by_block), F.lit(0)))
    events = parts.withColumn("origin", F.lit(None).cast("struct<block_no:int,page:int,section:string>")).unionByName(
        starts.select("doc_id", "at", F.struct(F.col("block_no").cast("int").alias("block_no"), F.col("page").cast("int").alias("page"), F.col("section").cast("string").alias("section")).alias("origin")), allowMissingColumns=True
    )
    as_of = Window.partitionBy("doc_id").orderBy("at", F.col("window").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    placed = events.withColumn("origin", F.last("origin", ignorenulls=True).over(as_of)).filter("window IS NOT NULL")
    index = F.row_number().over(Window.partitionBy("doc_id").orderBy("window", "part")) - 1
    return placed.select("doc_id", index.alias("chunk_index"), "content", F.length("content").alias("char_count"), "tokens", "origin.block_no", "origin.page", "origin.section")


def _split_windows(windows: DataFrame, size: int, max_tokens: int, count: TokenCounter) -> DataFrame:
    kind = dict(windows.dtypes)["doc_id"]

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                whole = count(r["content"])
                at = r["at"]
                for k, text in enumerate([r["content"]] if whole <= max_tokens else split_to_limit(r["content"], max_tokens, size, count)):
                    out.append((r["doc_id"], r["window"], k, at, text, whole if whole <= max_tokens else count(text)))
                    at += sum(not c.isspace() for c in text)
            columns = list(zip(*out)) if out else [()] * 6
            types = [batch.schema.field("doc_id").type, pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "window", "part", "at", "content", "tokens"])

    return windows.select("doc_id", "window", "at", "content").mapInArrow(work, f"doc_id {kind}, window int, part int, at bigint, content string, tokens int")


def sentences_of(text: str) -> list[str]:
    return [s.strip() for s in re.split(r"(?<=[.!?。！？])\s+", text) if s.strip()]


def hard_split(text: str, max_tokens: int, max_chars: int, count: TokenCounter = approximate_tokens) -> list[str]:
    """Pieces within both bounds, cut between characters; each piece has one character at least."""
    out, at = [], 0
    while at < len(text):
        size = min(max_chars, len(text) - at)
        while size > 1 and (n := count(text[at : at + size])) > max_tokens:
            size = max(1, min(size - 1, size * max_tokens // n))
        out.append(text[at : at + size])
        at += size
    return out


def split_to_limit(text: str, max_tokens: int, max_chars: int, count: TokenCounter = approximate_tokens) -> list[str]:
    """Sentences packed greedily; a sentence over a bound is split hard."""
    parts = sentences_of(text)
    if not parts:
        return hard_split(text, max_tokens, max_chars, count) if text else []
    out, now = [], ""
    for s in parts:
        joined = f"{now} {s}" if now else s
        if count(joined) <= max_tokens and len(joined) <= max_chars:
            now = joined
            continue
        if now:
            out.append(now)
        pieces = hard_split(s, max_tokens, max_chars, count) if count(s) > max_tokens or len(s) > max_chars else [s]
        out += pieces[:-1]
        now = pieces[-1]
    return [*out, now] if now else out


def aligned_tail(text: str, overlap: int) -> str:
    """The last `overlap` characters from a sentence's start on, if at least half of them are left."""
    if overlap <= 0:
        return ""
    tail = text[-overlap:]
    rest = sentences_of(tail)[1:] if len(text) > overlap else sentences_of(tail)
    kept = " ".join(rest)
    return kept if 2 * len(kept) >= overlap else tail.strip()


@dataclass
class Candidate:
    content: str
    section: str | None
    page: int | None
    tokens: int


def size_bounded(blocks: list[dict], max_tokens: int, target_chars: int, overlap: int, count: TokenCounter = approximate_tokens) -> list[Candidate]:
    """Blocks folded into chunks: a heading opens one (and is carried into its text), so does passing the target
    or the limit; only a cut forced by size takes over the tail of the chunk before."""
    out: list[Candidate] = []
    parts: list[str] = []
    place: tuple = (None, None)
    only_heading = False

    def close():
        nonlocal parts
        if parts:
            text = "\n".join(parts)
            out.append(Candidate(text, place[0], place[1], count(text)))
        parts = []

    for b in blocks:
        heading = b["block_type"] == "heading"
        if heading:
            if parts and not only_heading:
                close()
            if b["text"].strip():
                if not parts:
                    place = (b.get("section"), b.get("page"))
                parts.append(b["text"])
                only_heading = True
                place = (b.get("section"), place[1])
            continue
        for piece in split_to_limit(b["text"], max_tokens, max(target_chars, 1), count):
            joined = "\n".join([*parts, piece])
            if parts and not only_heading and (len(joined) > target_chars or count(joined) > max_tokens):
                before = "\n".join(parts)
                close()
                tail = aligned_tail(before, overlap)
                if tail and count(f"{tail}\n{piece}") <= max_tokens:
                    parts = [tail]
            elif parts and only_heading and count(joined) > max_tokens:
                close()
            if not parts or (len(parts) == 1 and not only_heading and parts[0] != piece):
                place = (b.get("section"), b.get("page"))
            parts.append(piece)
            only_heading = False
    close()
    return out


def row_bundles(rows: list[dict], max_tokens: int, target_chars: int, count: TokenCounter = approximate_tokens) -> list[Candidate]:
    """Table rows packed whole, broken on a change of section, without overlap; an oversized row is split."""
    out: list[Candidate] = []
    held: list[str] = []
    used, section = 0, None

    def close():
        nonlocal held, used
        if held:
            text = "\n".join(held)
            out.append(Candidate(text, section, None, count(text)))
        held, used = [], 0

    for r in rows:
        if r["block_type"] == "heading":
            close()
            section = r["text"]
            continue
        if r.get("section") != section:
            close()
            section = r.get("section")
        n = count(r["text"])
        if n > max_tokens:
            close()
            out.extend(Candidate(p, section, None, count(p)) for p in split_to_limit(r["text"], max_tokens, target_chars, count))
            continue
        if used + n > max_tokens:
            close()
        held.append(r["text"])
        used += n
    close()
    return out


CHUNK_SCHEMA = "doc_id bigint, chunk_index int, content string, token_count int, char_count int, page int, section string"


def chunk_blocks(blocks: DataFrame, max_tokens: int = 1300, target_chars: int = 1000, overlap: int = 150, strategy: str = "size", count: TokenCounter = approximate_tokens) -> DataFrame:
    """blocks: doc_id, block_no, text, block_type, section (page optional). strategy: size or rows."""
    if strategy not in ("size", "rows"):
        raise ValueError(f"unknown strategy {strategy}")

    def fold(rows):
        found = size_bounded(rows, max_tokens, target_chars, overlap, count) if strategy == "size" else row_bundles(rows, max_tokens, target_chars, count)
        return [(rows[0]["doc_id"], k, c.content, c.tokens, len(c.content), c.page, c.section) for k, c in enumerate(found)]

    return by_group(blocks, "doc_id", ["block_no"], fold, CHUNK_SCHEMA)


def neighbour_similarity(chunks: DataFrame) -> DataFrame:
    """chunks: doc_id, chunk_index, embedding. The cosine with the chunk before, by its own vector."""
    w = Window.partitionBy("doc_id").orderBy("chunk_index")
    return chunks.withColumn("before", F.lag("embedding").over(w)).withColumn("similarity", F.when(F.col("before").isNotNull(), vx.cosine(F.col("before"), F.col("embedding")))).drop("before")


def semantic_merge(chunks: list[dict], threshold: float, max_tokens: int, target_chars: int, count: TokenCounter = approximate_tokens) -> list[dict]:
    """Adjacent chunks joined while the similarity (to the previous chunk's own vector) and both bounds hold;
    a joined chunk has no vector, and its tokens are told as `counted`."""
    out: list[dict] = []
    for c in chunks:
        near = bool(out) and c["similarity"] is not None and c["similarity"] >= threshold
        joined = f"{out[-1]['content']}\n{c['content']}" if near else ""
        if near and len(joined) <= target_chars and (n := count(joined)) <= max_tokens:
            out[-1] = {**out[-1], "content": joined, "embedding": None, "joined": out[-1].get("joined", 1) + 1, "counted": n}
        else:
            out.append(dict(c))
    return out


SEMANTIC_SCHEMA = "doc_id bigint, chunk_index int, content string, token_count int, joined int, embedding array<double>"


def chunk_semantic(chunks: DataFrame, threshold: float = 0.75, max_tokens: int = 1300, target_chars: int = 1000, count: TokenCounter = approximate_tokens) -> DataFrame:
    """chunks: doc_id, chunk_index, content, embedding. Adjacent ones of a document joined by meaning; `joined` tells of how many.

    Similarities are a window in Spark; only the joining itself, whose bounds depend on what is joined so far, is a fold."""

    def fold(rows):
        out = []
        for k, c in enumerate(semantic_merge(rows, threshold, max_tokens, target_chars, count)):
            out.append((rows[0]["doc_id"], k, c["content"], c["counted"] if "counted" in c else count(c["content"]), c["joined"], c["embedding"]))
        return out

    return by_group(neighbour_similarity(chunks).withColumn("joined", F.lit(1)), "doc_id", ["chunk_index"], fold, SEMANTIC_SCHEMA)


def table_sections(blocks: DataFrame, marker: str, break_before: str | None = None) -> DataFrame:
    """Adds run_no: the number of section openers up to a block, per document; opener marks them."""
    opener = F.col("text").rlike(marker)
    opens = opener | F.col("text").rlike(break_before) if break_before else opener
    w = Window.partitionBy("doc_id").orderBy("block_no").rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("opener", opener).withColumn("run_no", F.sum(opens.cast("int")).over(w))


def detect(blocks: DataFrame, spine: str, citation: str, least: int = 5, high: tuple[float, float] = (0.010, 0.030), low: tuple[float, float] = (0.003, 0.012)) -> DataFrame:
    """Per document whether it refers to numbered provisions of its own: none, ambiguous or high."""
    counted = blocks.groupBy("doc_id").agg(
        F.count("*").alias("n_blocks"),
        F.count_if(F.col("text").rlike(spine)).alias("n_spine"),
        F.count_if((F.col("block_type") != "heading") & F.col("text").rlike(citation)).alias("n_cited"),
    )
    s, c = F.col("n_spine") / F.col("n_blocks"), F.col("n_cited") / F.col("n_blocks")
    verdict = F.when((F.col("n_spine") < least) | ((s < low[0]) & (c < low[1])), "none").when((s >= high[0]) & (c >= high[1]), "high").otherwise("ambiguous")
    return counted.withColumn("spine_ratio", s).withColumn("citation_ratio", c).withColumn("verdict", verdict).withColumn("character", F.when(verdict == "high", "reference_dependent").otherwise("self_contained"))
