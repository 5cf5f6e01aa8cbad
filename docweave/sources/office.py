"""docx, xlsx and csv files, read with the standard library, and the dispatch by file type.

Files come from Spark's `binaryFile` source (path, content); each gives ordered blocks, or one row with an
error where it cannot be read.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

from pyspark.sql import DataFrame

from docweave.sources.html_blocks import _Reader

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
SCHEMA = "path string, block_no int, text string, block_type string, section string, error string"
#: A member of a package may unpack to this many bytes, as a guard against bombs.
MOST_BYTES = 200_000_000
Block = tuple[str, str, str | None]


class ParseError(ValueError):
    pass


def _member(z: zipfile.ZipFile, name: str) -> ElementTree.Element:
    try:
        if z.getinfo(name).file_size > MOST_BYTES:
            raise ParseError(f"{name} is too large")
        return ElementTree.fromstring(z.read(name))
    except (KeyError, ElementTree.ParseError) as e:
        raise ParseError(f"{name}: {e}") from None


def _open(raw: bytes) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(io.BytesIO(raw))
    except zipfile.BadZipFile as e:
        raise ParseError(str(e)) from None


def _text(node: ElementTree.Element) -> str:
    out = []
    for x in node.iter():
        out.append(x.text or "" if x.tag == f"{_W}t" else "\n" if x.tag in (f"{_W}br", f"{_W}cr") else "\t" if x.tag == f"{_W}tab" else "")
    return "".join(out).strip()


def docx_blocks(raw: bytes) -> list[Block]:
    """Paragraphs, then table cells; a merged cell counts once."""
    z = _open(raw)
    body = _member(z, "word/document.xml").find(f"{_W}body")
    names = {}
    if "word/styles.xml" in z.namelist():
        for s in _member(z, "word/styles.xml").iter(f"{_W}style"):
            name = s.find(f"{_W}name")
            names[s.get(f"{_W}styleId")] = name.get(f"{_W}val", "") if name is not None else ""
    out: list[Block] = []
    section = None
    for p in body.findall(f"{_W}p") if body is not None else ():
        if not (text := _text(p)):
            continue
        style = p.find(f"{_W}pPr/{_W}pStyle")
        key = style.get(f"{_W}val", "") if style is not None else ""
        name = names.get(key, key)
        if name.lower().startswith("heading") or name == "Title":
            section = text
            out.append((text, "heading", section))
        else:
            out.append((text, "list_item" if name.startswith("List") else "paragraph", section))
    for cell in (c for t in (body.findall(f"{_W}tbl") if body is not None else ()) for r in t.findall(f"{_W}tr") for c in r.findall(f"{_W}tc")):
        merge = cell.find(f"{_W}tcPr/{_W}vMerge")
        if (merge is None or merge.get(f"{_W}val") == "restart") and (text := "\n".join(filter(None, map(_text, cell.findall(f"{_W}p"))))):
            out.append((text, "table_cell", section))
    return out


def table_blocks(rows: list[list[str]], section: str | None) -> list[Block]:
    """The first row with a value is the header; each other row is `column: value | ...` without blanks."""
    rows = [[c.strip() for c in r] for r in rows]
    rows = [r for r in rows if any(r)]
    if not rows:
        return []
    out: list[Block] = [(section, "heading", section)] if section else []
    for r in rows[1:]:
        cells = [f"{h}: {c}" if h else c for h, c in zip([*rows[0], *[""] * len(r)], r) if c]
        out.append((" | ".join(cells), "paragraph", section))
    return out


def _column(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref)[0]:
        n = 26 * n + ord(ch) - 64
    return n - 1


def xlsx_blocks(raw: bytes) -> list[Block]:
    z = _open(raw)
    shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in _member(z, "xl/sharedStrings.xml").findall(f"{_S}si")] if "xl/sharedStrings.xml" in z.namelist() else []
    links = {r.get("Id"): r.get("Target", "") for r in _member(z, "xl/_rels/workbook.xml.rels")}
    out: list[Block] = []
    for sheet in _member(z, "xl/workbook.xml").iter(f"{_S}sheet"):
        target = links.get(sheet.get(f"{_R}id"), "").lstrip("/")
        rows = []
        for row in _member(z, target if target.startswith("xl/") else f"xl/{target}").iter(f"{_S}row"):
            cells: list[str] = []
            for c in row.findall(f"{_S}c"):
                at = _column(c.get("r", "A")) if c.get("r") else len(cells)
                cells += [""] * (at + 1 - len(cells))
                v = c.find(f"{_S}v")
                if c.get("t") == "inlineStr":
                    cells[at] = "".join(t.text or "" for t in c.iter(f"{_S}t"))
                elif v is not None and v.text:
                    cells[at] = shared[int(v.text)] if c.get("t") == "s" else v.text
            rows.append(cells)
        out += table_blocks(rows, sheet.get("name"))
    if not out:
        raise ParseError("the workbook is empty")
    return out


def csv_blocks(raw: bytes) -> list[Block]:
    """UTF-8 (with or without mark), else cp949, else refused: never a replacement character."""
    for name in ("utf-8-sig", "cp949"):
        try:
            return table_blocks(list(csv.reader(io.StringIO(raw.decode(name)))), None)
        except UnicodeDecodeError:
            continue
    raise ParseError("neither UTF-8 nor cp949")


def plain_blocks(raw: bytes) -> list[Block]:
    out: list[Block] = []
    section = None
    for line in map(str.strip, raw.decode("utf-8").split("\n")):
        if line.startswith("#"):
            section = line.lstrip("#").strip()
            out.append((section, "heading", section))
        elif line:
            out.append((line[2:].strip(), "list_item", section) if line.startswith(("- ", "* ")) else (line, "paragraph", section))
    return out


def xml_lines(raw: bytes, most: int = 4000) -> str:
    """Leaf elements as `tag: value` lines, up to a number of characters."""
    lines = [f"{e.tag.rsplit('}', 1)[-1]}: {e.text.strip()}" for e in ElementTree.fromstring(raw).iter() if not len(e) and e.text and e.text.strip()]
    return "\n".join(lines)[:most]


PARSERS: dict[str, Callable[[bytes], list[Block]]] = {"txt": plain_blocks, "md": plain_blocks, "html": lambda raw: _Reader().blocks(raw.decode("utf-8", "replace")), "docx": docx_blocks, "xlsx": xlsx_blocks, "csv": csv_blocks}


def get_parser(file_type: str) -> Callable[[bytes], list[Block]]:
    try:
        return PARSERS[file_type.lower()]
    except KeyError:
        raise ParseError(f"no parser for {file_type}") from None


def file_blocks(files: DataFrame) -> DataFrame:
    """files: path, content, as binaryFile gives them."""

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    found = get_parser(path.rsplit(".", 1)[-1])(raw or b"")
                    rows += [(path, k, t, kind, s, None) for k, (t, kind, s) in enumerate(found)]
                except (ParseError, UnicodeDecodeError) as e:
                    rows.append((path, None, None, None, None, str(e)))
            kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(list(zip(*rows)) or [[]] * 6, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return files.select("path", "content").mapInArrow(work, SCHEMA)
