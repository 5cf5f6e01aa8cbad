"""Text, table and page sources that become ordered blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions.text import clean_text


def text_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines as blocks: doc_id, block_no, text, block_type, section. A `#` line is a heading and the section of what follows."""
    line = F.regexp_replace(F.col("line"), r"^\s+|\s+$", "")
    kind = F.when(F.col("raw").startswith("#"), "heading").when(F.col("raw").startswith("- ") | F.col("raw").startswith("* "), "list_item").otherwise("paragraph")
    shown = F.when(F.col("block_type") == "heading", F.regexp_replace("raw", r"^#+\s*", "")).when(F.col("block_type") == "list_item", F.regexp_replace(F.substring("raw", 3, 2147483647), r"^\s+", "")).otherwise(F.col("raw"))
    before = Window.partitionBy("doc_id").orderBy("block_no").rowsBetween(Window.unboundedPreceding, 0)
    return (
        docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, "\n")).alias("block_no", "line"))
        .select("doc_id", "block_no", line.alias("raw"))
        .filter("raw <> ''")
        .withColumn("block_type", kind)
        .withColumn("text", clean_text(shown))
        .withColumn("section", F.last(F.when(F.col("block_type") == "heading", F.col("text")), ignorenulls=True).over(before))
        .select("doc_id", "block_no", "text", "block_type", "section")
    )


def row_line(columns: list[str]) -> Column:
    """A table row as `column: value | ...`, blank values left out."""
    cells = F.array(*[F.when(F.trim(F.col(c).cast("string")) != "", F.concat(F.lit(f"{c}: "), F.trim(F.col(c).cast("string")))) for c in columns])
    return F.concat_ws(" | ", F.filter(cells, lambda x: x.isNotNull()))


def folder_path(path: Column, depth: int = 8) -> Column:
    """The folders of a file path as `/a/b/`; parts beyond the depth fold into the last folder."""
    parts = F.filter(F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))), lambda p: p != "")
    return F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, depth), "/"), F.when(F.size(parts) > 0, "/").otherwise(""))


def validated_uploads(files: DataFrame) -> DataFrame:
    """files: path, content (binary), content_type. Adds file_type and problem (null if none)."""
    head = F.hex(F.substring("content", 1, 4))
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    types = {"txt": "text/plain", "md": "text/markdown", "html": "text/html", "csv": "text/csv", "pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"}
    binary = head.startswith("25504446") | head.startswith("504B0304") | head.startswith("89504E47") | (F.instr(F.hex(F.substring("content", 1, 1024)), "00") % 2 == 1)
    problem = (
        F.when(~kind.isin(*types), "extension")
        .when(~F.coalesce(F.col("content_type"), F.lit("application/octet-stream")).isin("application/octet-stream", *types.values()), "content type")
        .when((kind == "pdf") & ~head.startswith("25504446"), "magic bytes")
        .when(kind.isin("docx", "xlsx") & ~head.startswith("504B0304"), "magic bytes")
        .when(kind.isin("txt", "md", "html", "csv") & binary, "magic bytes")
    )
    return files.withColumn("file_type", kind).withColumn("problem", problem)
