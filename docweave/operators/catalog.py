"""Catalogue queries over documents, folders and versions: filters, trees, lineages, upserts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.sources.storage import stored


def owner_visible(owner: Column, user, scope: str) -> Column:
    """shared: without owner; mine: the user's; all: either. Without a user only shared rows are seen."""
    if scope == "shared" or user is None:
        return owner.isNull()
    return owner == user if scope == "mine" else owner.isNull() | (owner == user)


def scoped(rows: DataFrame, column: str, ids: list | None) -> DataFrame:
    """None is unscoped; an empty list finds nothing."""
    return rows if ids is None else rows.filter(F.col(column).isin(ids) if ids else F.lit(False))


def narrow(allowed: list, asked: list | None) -> list | None:
    """An empty allow list is unrestricted; an empty intersection is an error, not an empty result."""
    if not allowed:
        return asked
    if asked is None:
        return list(allowed)
    both = [x for x in asked if x in set(allowed)]
    if not both:
        raise ValueError("nothing of what was asked for is allowed")
    return both


def narrowed(asked: DataFrame, allowed: DataFrame, owner: str, item: str) -> DataFrame:
    """Rows of `asked` whose item their owner allows; an owner with no row in `allowed` restricts nothing."""
    listed = allowed.select(owner, item).distinct()
    limited = asked.join(listed, [owner, item], "left_semi")
    return limited.unionByName(asked.join(listed.select(owner).distinct(), owner, "left_anti").select(*limited.columns))


def explorer_page(docs: DataFrame, *, filters: list[Column] = (), sort: str = "created", descending: bool = True, offset: int = 0, limit: int = 50, key: str = "id") -> DataFrame:
    """One page and the total before paging (as a column); ties go by key."""
    rows = docs
    for f in filters:
        rows = rows.filter(f)
    total = rows.agg(F.count("*").alias("total"))
    order = F.desc(sort) if descending else F.asc(sort)
    return rows.orderBy(order, key).offset(offset).limit(max(1, min(200, limit))).join(F.broadcast(total))


def like_text(column: Column, text: str) -> Column:
    """Case-blind containment; % and _ in the text are plain characters."""
    return F.contains(F.lower(column), F.lit(text.lower()))


def is_stale(effective: Column, created: Column, today: Column, days: int) -> Column:
    return F.coalesce(effective.cast("date"), created.cast("date")) < F.date_sub(today, days)


def climbed(folders: DataFrame, keep: Callable[[DataFrame], DataFrame] = stored) -> DataFrame:
    """folders: id (unique), parent_id, name. id, path, depth, above: names joined from the root, by pointer doubling.

    Every folder starts with its own name and its parent; in each round it takes over the path of the folder that its
    pointer leads to, and that folder's pointer, so that a tree of depth n takes about log2(n) rounds, each one
    equi-join. `keep` stores a round's new rows (lineage is cut there), each folder's path once it has it. An unknown parent is a root. As long as a folder
    is left that hangs from a root, a round ends some of these; a round that ends none leaves cycles and what hangs
    from them, whose `above` stays."""
    known = folders.select(F.col("id").alias("k"))
    now = keep(folders.join(known, folders["parent_id"] == F.col("k"), "left").select("id", F.when(F.col("k").isNotNull(), F.col("parent_id")).alias("above"), F.concat("name", F.lit("/")).alias("path"), F.lit(1).alias("depth")))
    ended, open_ = now.filter("above IS NULL"), now.filter("above IS NOT NULL")
    before, waiting = None, open_.count()
    while waiting and waiting != before:
        #: Paths compress to a small part of their size, by which Spark would take them for a table to broadcast.
        up = ended.unionByName(open_).select(F.col("id").alias("at"), F.col("path").alias("head"), F.col("above").alias("next"), F.col("depth").alias("more")).hint("merge")
        longer = keep(open_.join(up, F.col("above") == F.col("at")).select("id", F.col("next").alias("above"), F.concat("head", "path").alias("path"), (F.col("depth") + F.col("more")).alias("depth")))
        ended, open_ = ended.unionByName(longer.filter("above IS NULL")), longer.filter("above IS NOT NULL")
        before, waiting = waiting, open_.count()
    return ended.unionByName(open_)


def folder_paths(folders: DataFrame, keep: Callable[[DataFrame], DataFrame] = stored) -> DataFrame:
    """id, path (`/a/b/`), depth of every folder that hangs from a root, however deep."""
    return climbed(folders, keep).filter("above IS NULL").select("id", F.concat(F.lit("/"), "path").alias("path"), "depth")


def folder_cycles(folders: DataFrame, keep: Callable[[DataFrame], DataFrame] = stored) -> DataFrame:
    """id of every folder that is in a cycle of parents or hangs from one."""
    return climbed(folders, keep).filter("above IS NOT NULL").select("id")


def subtree_totals(docs: DataFrame, value: Column) -> DataFrame:
    """docs: folder (path `/a/b/`), updated. Per folder on the way up: documents, total, last update.

    A document's path gives all its ancestors, so that no prefix join is needed."""
    parts = F.filter(F.split("folder", "/"), lambda p: p != "")
    ups = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n), "/"), F.lit("/")))
    rows = docs.withColumn("value", value).withColumn("at", F.explode(F.when(F.size(parts) > 0, ups).otherwise(F.array(F.lit("/")))))
    return rows.groupBy(F.col("at").alias("folder")).agg(F.count("*").alias("documents"), F.sum("value").alias("total"), F.max("updated").alias("updated"))


def move_folder(folders: DataFrame, source: str, target: str, depth: int = 8) -> DataFrame:
    """Rewrites the subtree's paths; moving under itself or beyond the depth is refused (problem)."""
    name = source.rstrip("/").rsplit("/", 1)[-1]
    new = f"{target.rstrip('/')}/{name}/"
    inside = F.col("path").startswith(source)
    moved = F.concat(F.lit(new), F.substring("path", len(source) + 1, 1 << 30))
    levels = F.size(F.filter(F.split(moved, "/"), lambda p: p != ""))
    refused = F.lit(target.startswith(source)) | (inside & (levels > depth))
    any_refused = folders.agg(F.max(refused).alias("bad"))
    return folders.join(F.broadcast(any_refused)).select("id", F.when(inside & ~F.col("bad"), moved).otherwise(F.col("path")).alias("path"), F.when(inside & F.col("bad"), "refused").alias("problem"))


def current_versions(versions: DataFrame) -> DataFrame:
    """lineage_id, version, status: the highest indexed version of a lineage is current."""
    w = Window.partitionBy("lineage_id").orderBy(F.desc(F.when(F.col("status") == "indexed", F.col("version"))))
    return versions.withColumn("is_current", (F.col("status") == "indexed") & (F.row_number().over(w) == 1))


def revert(versions: DataFrame) -> DataFrame:
    """The version that a lineage goes back to: the highest indexed one under the current."""
    now = versions.filter("is_current").select("lineage_id", F.col("version").alias("now"))
    return versions.filter("status = 'indexed'").join(now, "lineage_id").filter("version < now").groupBy("lineage_id").agg(F.max("version").alias("version"))


def duplicate_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows replace old ones of their key; a key that comes twice in new is an error at run time."""
    twice = duplicate_keys(new, key).agg(F.count("*").alias("twice"))
    checked = new.join(F.broadcast(twice)).withColumn("twice", F.when(F.col("twice") > 0, F.raise_error(F.lit("a key comes twice"))).otherwise(F.lit(0)))
    return old.join(new.select(*key), key, "left_anti").unionByName(checked.filter(F.coalesce(F.col("twice").cast("int"), F.lit(0)) == 0).drop("twice"))


def replace_groups(old: DataFrame, new: DataFrame, group: str) -> DataFrame:
    """Full replacement of each group that new has, e.g. a document's chunks or edges."""
    return old.join(new.select(group).distinct(), group, "left_anti").unionByName(new)


def overlay(base: DataFrame, overrides: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """Overrides win; a key that only overrides have is taken."""
    o = overrides.select(key, F.col(value).alias("__o"), F.lit(True).alias("__hit"))
    return base.join(o, key, "full_outer").select(key, F.when(F.col("__hit"), F.col("__o")).otherwise(F.col(value)).alias(value), F.coalesce("__hit", F.lit(False)).alias("overridden"))


def marker_lookup(chunks: DataFrame, keyword: str, limit: int, marker: str = r"^\[[^\]]+\]", candidates: DataFrame | None = None) -> DataFrame:
    """One chunk per section marker that the keyword occurs under, then other chunks up to the limit.

    The first of a marker by file name and place stands for it. snippet: 40 characters before the first hit, 60 after.
    candidates: chunk_id of the chunks that can hold the keyword (`trigrams.TrigramIndex.holding`); others aren't tested."""
    if candidates is not None:
        chunks = chunks.join(candidates, "chunk_id", "left_semi")
    hits = chunks.filter(like_text(F.col("content"), keyword))
    marked = F.col("section").rlike(marker)
    key = F.concat(F.split_part("section", F.lit("]"), F.lit(1)), F.lit("]"))
    order = Window.partitionBy("key").orderBy("filename", "chunk_index")
    first = hits.filter(marked).withColumn("key", key).withColumn("n", F.row_number().over(order)).filter("n = 1").select("key", "filename", "chunk_index", "content", F.lit(0).alias("part"))
    rest = hits.filter(~F.coalesce(marked, F.lit(False))).select(F.coalesce(F.nullif("section", F.lit("")), "filename").alias("key"), "filename", "chunk_index", "content", F.lit(1).alias("part"))
    at = F.instr(F.lower("content"), keyword.lower())
    begin = F.greatest(at - 40, F.lit(1))
    snippet = F.translate(F.col("content").substr(begin, at - begin + len(keyword) + 60), "\n", " ")
    return first.unionByName(rest).orderBy("part", "key", "filename", "chunk_index").limit(limit).withColumn("snippet", snippet).drop("content")
