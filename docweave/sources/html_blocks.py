"""HTML pages as ordered blocks, read with the standard library's parser."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import DataFrame

_BLOCK = {"h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading", "p": "paragraph", "li": "list_item", "td": "table_cell", "th": "table_cell"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SCHEMA = "page_id bigint, block_no int, text string, block_type string, section string"


class _Reader(HTMLParser):
    """Outermost block elements only: a block inside another adds its text to it. A p ends at the next block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.open, self.parts, self.skip, self.section = [], None, [], 0, None

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        elif tag in _BLOCK:
            if self.open == "p":
                self._close()
            if self.open is None:
                self.open, self.parts = tag, []

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag == self.open:
            self._close()

    def handle_data(self, data):
        if self.open and not self.skip and data.strip():
            self.parts.append(data.strip())

    def _close(self):
        text, kind = " ".join(" ".join(self.parts).split()), _BLOCK[self.open]
        self.open = None
        if text:
            self.section = text if kind == "heading" else self.section
            self.out.append((text, kind, self.section))

    def blocks(self, page: str):
        self.feed(page)
        self.close()
        if self.open:
            self._close()
        return self.out


def html_blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    def work(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [(i, k, *b) for i, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for k, b in enumerate(_Reader().blocks(page or ""))]
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()), strict=True)], names=["page_id", "block_no", "text", "block_type", "section"])

    return pages.selectExpr(f"cast(`{id_col}` as bigint) as page_id", f"`{html_col}` as html").mapInArrow(work, SCHEMA)
