"""Page geometry over all documents at once: words and lines with places as DataFrames.

Words become lines, and gutters, furniture, body sizes and headings come from windows and aggregations, so that a
document may have any number of pages; only what one page's column holds is brought together. `pdf_lines` has the
fold that turns one document's lines into blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.sources.pdf_lines import BAND, FURNITURE_PAGES, HEADING_RATIO, MAX_HEADING_CHARS, MAX_HEADING_WORDS, MIN_COLUMN, MIN_GUTTER, X_TOLERANCE, Y_TOLERANCE

PAGE = ["doc_id", "page"]


def gutters(words: DataFrame) -> DataFrame:
    """words: doc_id, page, x0, x1. Adds cuts: the middles of the gaps of a word's page that no word crosses (ascending):
    at least MIN_GUTTER wide, MIN_COLUMN from the outermost words. Words stay where they are: all is windows of pages."""
    page = Window.partitionBy(*PAGE)
    before = page.orderBy("x0", "x1").rowsBetween(Window.unboundedPreceding, -1)
    placed = words.withColumn("__reach", F.max("x1").over(before)).withColumn("__first", F.min("x0").over(page)).withColumn("__last", F.max("x1").over(page))
    wide = (F.col("x0") - F.col("__reach") >= MIN_GUTTER) & (F.col("__reach") - F.col("__first") >= MIN_COLUMN) & (F.col("__last") - F.col("x0") >= MIN_COLUMN)
    cut = F.when(wide, (F.col("__reach") + F.col("x0")) / 2)
    return placed.withColumn("cuts", F.sort_array(F.collect_set(cut).over(page))).drop("__reach", "__first", "__last")


def in_columns(words: DataFrame) -> DataFrame:
    """Adds column: how many of its page's gutters are left of a word."""
    return gutters(words).withColumn("column", F.size(F.filter("cuts", lambda c: c < F.col("x0")))).drop("cuts")


def rows_of(words: DataFrame) -> DataFrame:
    """words: doc_id, page, column, x0, top. Adds row_top: the top of the word that opened the word's row.

    From the top down (tops to one digit, then x0) a word that is more than Y_TOLERANCE below the row's first word
    opens a new row, so that a slanting run of words does not drift into one row. A gap that wide always does: gaps
    cut a column into islands by windows, and only inside an island, a row or a few, are tops gone through in order.
    An island's words are brought together once and dealt out again with its rows, without a join."""
    order = [F.round("top", 1), F.col("x0")]
    column = Window.partitionBy(*PAGE, "column").orderBy(*order)
    gap = F.coalesce((F.col("top") - F.max("top").over(column.rowsBetween(Window.unboundedPreceding, -1)) > Y_TOLERANCE).cast("int"), F.lit(0))
    islands = words.withColumn("__gap", gap).withColumn("__island", F.sum("__gap").over(column.rowsBetween(Window.unboundedPreceding, 0)))
    key = [*PAGE, "column", "__island"]
    others = [c for c in words.columns if c not in key]
    tops = F.transform(F.array_sort(F.collect_set(F.struct(F.round("top", 1).alias("r"), "x0", "top"))), lambda w: w["top"])
    opened = F.aggregate(tops, F.array().cast("array<double>"), lambda a, t: F.when((F.size(a) == 0) | (t - F.element_at(a, -1) > Y_TOLERANCE), F.concat(a, F.array(t))).otherwise(a))
    found = islands.groupBy(*key).agg(opened.alias("__rows"), F.collect_list(F.struct(*others)).alias("__words"))
    dealt = found.select(*PAGE, "column", "__rows", F.explode("__words").alias("w")).select(*PAGE, "column", "__rows", "w.*")
    held = F.filter("__rows", lambda t: F.abs(F.col("top") - t) <= Y_TOLERANCE)
    return dealt.withColumn("row_top", held[0]).select(*words.columns, "row_top")


def page_lines(words: DataFrame) -> DataFrame:
    """words: doc_id, page, word, x0, x1, top, size, bold, and optionally blank (whether a blank stands before the word on
    the page). doc_id, page, line_no (from 0, column by column, downwards), column, band, text, size, bold.

    Words of one column and one row are joined from left to right, with a space where they are more than X_TOLERANCE
    apart or a blank stands between them. A line is as large as its largest word, and bold if any word is."""
    blank = F.coalesce(F.col("blank"), F.lit(False)) if "blank" in words.columns else F.lit(False)
    placed = rows_of(in_columns(words))
    line = [*PAGE, "column", "row_top"]
    before = F.lag("x1").over(Window.partitionBy(*line).orderBy("x0", "x1", "word"))
    spaced = placed.withColumn("lead", F.when(before.isNotNull() & ((F.col("x0") - before > X_TOLERANCE) | blank), F.lit(" ")).otherwise(F.lit("")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("x0", "x1", "word", "lead"))), lambda w: F.concat(w["lead"], w["word"]))
    lines = spaced.groupBy(*line).agg(F.btrim(F.array_join(parts, "")).alias("text"), F.max("size").alias("size"), F.max("bold").alias("bold")).filter("text <> ''")
    order = Window.partitionBy(*PAGE).orderBy("column", "row_top")
    return lines.select(*PAGE, (F.row_number().over(order) - 1).alias("line_no"), "column", F.bround(F.col("row_top") / BAND).cast("bigint").alias("band"), "text", "size", "bold")


def with_furniture(lines: DataFrame) -> DataFrame:
    """lines: doc_id, page, band, text. Adds furniture: the same text in the same band on FURNITURE_PAGES pages or more."""
    key = ["doc_id", "band", "text"]
    often = lines.groupBy(*key).agg(F.count_distinct("page").alias("n")).filter(F.col("n") >= FURNITURE_PAGES).select(*key, F.lit(True).alias("furniture"))
    return lines.join(often, key, "left").withColumn("furniture", F.coalesce("furniture", F.lit(False)))


def body_sizes(lines: DataFrame) -> DataFrame:
    """doc_id, body: the size most characters have (to one digit); the smaller of two that are equally frequent."""
    sizes = lines.groupBy("doc_id", F.round("size", 1).alias("size")).agg(F.sum(F.length("text")).alias("chars"))
    return sizes.groupBy("doc_id").agg(F.max_by("size", F.struct("chars", -F.col("size"))).alias("body"))


def heading(text: Column, following: Column, marker: str | None = None) -> Column:
    """Whether a line's form is a heading's. following: the line after it on the page, null if none."""
    s = F.regexp_replace(text, r"^\s+|\s+$", "")
    n = F.size(F.split(s, r"\s+"))
    plain = (F.length(s) <= MAX_HEADING_CHARS) & ~s.rlike(r"[.!?。！？:;,]$") & ~s.rlike(r"[.·․‥…]{4,}")
    capitals = (F.upper(s) == s) & (F.lower(s) != s) & (n <= MAX_HEADING_WORDS)
    title = s.rlike(r"\p{Lu}") & ~s.rlike(r"(^|[^\p{L}])\p{Ll}") & ~s.rlike(r"\p{L}\p{Lu}") & (n <= 8) & ~F.coalesce(following, F.lit("")).rlike(r"^\p{Ll}")
    shaped = s.rlike(r"^\d+(\.\d+)+\.?\s+\S") | (~s.rlike("[가-힣ᄀ-ᇿ㄰-㆏一-鿿]") & (capitals | title))
    opens = s.rlike(f"^(?:{marker})") if marker else F.lit(False)
    return (F.length(s) > 0) & (opens | (plain & shaped))


def with_headings(lines: DataFrame, marker: str | None = None) -> DataFrame:
    """lines: doc_id, page, line_no, text, size, bold. Adds heading: by form, or by a size over HEADING_RATIO of the body's, or bold."""
    after = F.lead("text").over(Window.partitionBy(*PAGE).orderBy("line_no"))
    font = (F.length("text") <= MAX_HEADING_CHARS) & ((F.col("size") > F.col("body") * HEADING_RATIO) | F.col("bold"))
    return lines.withColumn("following", after).join(body_sizes(lines), "doc_id").withColumn("heading", heading(F.col("text"), F.col("following"), marker) | font).drop("following", "body")
