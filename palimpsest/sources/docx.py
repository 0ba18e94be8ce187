"""Word documents as ordered tables of blocks, read and written with the standard library.

A document is a binary row, as `spark.read.format("binaryFile")` gives it, and is parsed whole
inside one Arrow batch row; results are rows of blocks, styles, relationships and counts. Only
w:t text counts: deleted text (w:delText) never shows, inserted text does."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names of the format.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
PARTS = {
    "document": "word/document.xml",
    "styles": "word/styles.xml",
    "numbering": "word/numbering.xml",
    "comments": "word/comments.xml",
    "rels": "word/_rels/document.xml.rels",
}
BLOCKS = (
    "doc_id long, pos int, kind string, level int, style_id string, text string, "
    "runs array<struct<text:string,bold:boolean,italic:boolean,underline:boolean>>, cells array<string>, "
    "table_id int, has_drawing boolean, has_sdt boolean"
)


def parts_of(content: bytes) -> dict[str, ElementTree.Element]:
    """The parsed parts; a missing or broken optional part is left out."""
    out = {}
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for name, member in PARTS.items():
            try:
                out[name] = ElementTree.fromstring(z.read(member))
            except (KeyError, ElementTree.ParseError):
                if name == "document":
                    raise
    return out


def _value(parent: ElementTree.Element | None, tag: str) -> str | None:
    found = parent.find(f"{W}{tag}") if parent is not None else None
    return None if found is None else found.get(f"{W}val")


def style_rows(styles: ElementTree.Element | None) -> list[dict]:
    """Paragraph styles in order: style_id, name, outline_lvl, based_on."""
    out = []
    for s in styles.iter(f"{W}style") if styles is not None else ():
        if s.get(f"{W}type") == "paragraph" and s.get(f"{W}styleId"):
            level = _value(s.find(f"{W}pPr"), "outlineLvl")
            out.append(
                {"style_id": s.get(f"{W}styleId"), "name": _value(s, "name") or "", "outline_lvl": int(level) if level and level.isdigit() else None, "based_on": _value(s, "basedOn")}
            )
    return out


def levels_of(rows: list[dict]) -> dict[str, int]:
    """Heading levels: HeadingN by name, an outline level of 0 to 8 plus one, or the parent's."""
    known = {r["style_id"]: r for r in rows}
    out: dict[str, int] = {}
    for start in known:
        seen, at = [], start
        while at in known and at not in seen and at not in out:
            seen.append(at)
            row = known[at]
            named = re.fullmatch(r"(?i)heading([1-9])", at)
            if named:
                out[at] = int(named[1])
            elif row["outline_lvl"] is not None and row["outline_lvl"] <= 8:
                out[at] = row["outline_lvl"] + 1
            else:
                at = row["based_on"] or ""
        if at in out:
            out.update(dict.fromkeys(seen, out[at]))
    return out


def bullet_numbers(numbering: ElementTree.Element | None) -> set[str]:
    """Ids of the numberings whose first level is a bullet."""
    if numbering is None:
        return set()
    kinds = {}
    for a in numbering.iter(f"{W}abstractNum"):
        first = next((x for x in a.iter(f"{W}lvl") if x.get(f"{W}ilvl") == "0"), None)
        kinds[a.get(f"{W}abstractNumId")] = _value(first, "numFmt")
    return {n.get(f"{W}numId") for n in numbering.iter(f"{W}num") if kinds.get(_value(n, "abstractNumId")) == "bullet"}


def relationship_ids(rels: ElementTree.Element | None) -> set[str]:
    return {x.get("Id") for x in rels.iter() if x.get("Id")} if rels is not None else set()


def used_relationships(document: ElementTree.Element) -> list[str]:
    """Relationship ids that the body refers to, in order."""
    names = {f"{R}id", f"{R}embed", f"{R}link"}
    return [v for e in document.iter() for k, v in e.attrib.items() if k in names]


def change_counts(parts: dict[str, ElementTree.Element]) -> tuple[int, int, int]:
    """Tracked insertions, deletions, and comments."""
    doc = parts["document"]
    comments = parts.get("comments")
    return (
        sum(1 for _ in doc.iter(f"{W}ins")),
        sum(1 for _ in doc.iter(f"{W}del")),
        sum(1 for _ in comments.iter(f"{W}comment")) if comments is not None else 0,
    )


def _run(r: ElementTree.Element) -> dict:
    style = r.find(f"{W}rPr")
    flag = lambda tag: style is not None and style.find(f"{W}{tag}") is not None
    text = "".join(x.text or "" if x.tag == f"{W}t" else "\n" if x.tag == f"{W}br" else "" for x in r)
    return {"text": text, "bold": flag("b"), "italic": flag("i"), "underline": flag("u")}


def _paragraph(p: ElementTree.Element, levels: dict[str, int], sdt: bool) -> dict:
    style = p.find(f"{W}pPr")
    style_id = _value(style, "pStyle")
    runs = [_run(r) for r in p.iter(f"{W}r")]
    text = "".join(r["text"] for r in runs)
    letters = [c for c in text if c.isalpha()]
    level = levels.get(style_id or "")
    if level is None and style_id and (named := re.fullmatch(r"(?i)heading([1-9])", style_id)):
        level = int(named[1])
    if level is None and any(r["bold"] for r in runs) and 8 <= len(text.strip()) <= 80 and len(letters) >= 4 and all(c.isupper() for c in letters):
        kind = "separator"
    elif level is not None:
        kind = "heading"
    elif style is not None and style.find(f"{W}numPr") is not None:
        kind = "list"
    else:
        kind = "para" if text.strip() else "blank"
    drawing = any(e.tag in (f"{W}drawing", f"{W}pict") for e in p.iter())
    return {
        "kind": kind, "level": level or 0, "style_id": style_id, "text": text, "runs": runs, "cells": None, "table_id": None,
        "has_drawing": drawing, "has_sdt": sdt or p.find(f".//{W}sdt") is not None,
    }


def block_rows(parts: dict[str, ElementTree.Element]) -> list[dict]:
    """The body's blocks in order; tables give a block for each row, content controls are opened."""
    levels = levels_of(style_rows(parts.get("styles")))
    out: list[dict] = []
    tables = 0

    def walk(parent: ElementTree.Element, sdt: bool) -> None:
        nonlocal tables
        for e in parent:
            if e.tag == f"{W}p":
                out.append(_paragraph(e, levels, sdt))
            elif e.tag == f"{W}tbl":
                for tr in e.iter(f"{W}tr"):
                    cells = [" ".join(t.text or "" for t in tc.iter(f"{W}t")).strip() for tc in tr.findall(f"{W}tc")]
                    out.append(
                        {"kind": "table_row", "level": 0, "style_id": None, "text": " ".join(cells), "runs": [], "cells": cells, "table_id": tables, "has_drawing": False, "has_sdt": sdt}
                    )
                tables += 1
            elif e.tag in (f"{W}sdt", f"{W}sdtContent", f"{W}ins"):
                walk(e, sdt or e.tag == f"{W}sdt")

    body = parts["document"].find(f"{W}body")
    walk(body if body is not None else parts["document"], False)
    return [{"pos": i, **b} for i, b in enumerate(out)]


def _frames(files: DataFrame, schema: str, rows_of) -> DataFrame:
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples():
                rows = [{"doc_id": r.doc_id, **x} for x in rows_of(parts_of(bytes(r.content)))]
                out = pd.DataFrame(rows, columns=names)
                for c in ("table_id", "outline_lvl"):
                    if c in out:
                        out[c] = out[c].astype("Int32")
                yield out

    return files.select("doc_id", "content").mapInPandas(run, schema)


def read_blocks(files: DataFrame) -> DataFrame:
    """(doc_id, content) to blocks."""
    return _frames(files, BLOCKS, block_rows)


def read_styles(files: DataFrame) -> DataFrame:
    return _frames(files, "doc_id long, style_id string, name string, outline_lvl int, based_on string", lambda p: style_rows(p.get("styles")))


def read_conflicts(files: DataFrame) -> DataFrame:
    return _frames(
        files, "doc_id long, insertions int, deletions int, comments int", lambda p: [dict(zip(("insertions", "deletions", "comments"), change_counts(p), strict=True))]
    )


def read_missing_relationships(files: DataFrame) -> DataFrame:
    """Relationship ids used in the body but not declared; nothing where none is declared at all."""

    def rows(p: dict) -> list[dict]:
        known = relationship_ids(p.get("rels"))
        return [{"rel_id": x} for x in dict.fromkeys(used_relationships(p["document"])) if known and x not in known]

    return _frames(files, "doc_id long, rel_id string", rows)


def read_bullet_numbers(files: DataFrame) -> DataFrame:
    return _frames(files, "doc_id long, num_id string", lambda p: [{"num_id": x} for x in sorted(bullet_numbers(p.get("numbering")))])


_SPACE = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_TYPES = """<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/><Override PartName="/word/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.styles+xml"/></Types>"""
_ROOT = """<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>"""
_RELS = """<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/styles" Target="styles.xml"/></Relationships>"""
_BAD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff￾￿]")


def _runs_xml(runs: list[dict]) -> str:
    out = []
    for r in runs:
        flags = "".join(f"<w:{t}/>" for t, k in (("b", "bold"), ("i", "italic")) if r.get(k)) + ('<w:u w:val="single"/>' if r.get("underline") else "")
        lines = _BAD.sub("", r["text"]).split("\n")
        text = "<w:br/>".join(f'<w:t xml:space="preserve">{escape(x)}</w:t>' for x in lines)
        out.append(f"<w:r>{f'<w:rPr>{flags}</w:rPr>' if flags else ''}{text}</w:r>")
    return "".join(out)


def make_docx(blocks: list[dict]) -> bytes:
    """A document of the blocks, in order; headings get styles Heading1 to Heading9."""
    body, open_table = [], None
    for b in blocks:
        table = b.get("table_id") if b["kind"] == "table_row" else None
        if open_table is not None and table != open_table:
            body.append("</w:tbl>")
        if table is not None and table != open_table:
            body.append("<w:tbl>")
        open_table = table
        runs = b.get("runs") or [{"text": b["text"]}]
        if b["kind"] == "table_row":
            body.append("<w:tr>" + "".join(f"<w:tc><w:p>{_runs_xml([{'text': c}])}</w:p></w:tc>" for c in b["cells"]) + "</w:tr>")
            continue
        style = f'<w:pStyle w:val="Heading{min(9, b["level"])}"/>' if b["kind"] == "heading" else ""
        number = '<w:numPr><w:ilvl w:val="0"/><w:numId w:val="1"/></w:numPr>' if b["kind"] == "list" else ""
        body.append(f"<w:p><w:pPr>{style}{number}</w:pPr>{_runs_xml(runs) if b['text'] else ''}</w:p>")
    if open_table is not None:
        body.append("</w:tbl>")
    document = f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{_SPACE}"><w:body>{"".join(body)}<w:sectPr/></w:body></w:document>'
    styles = "".join(
        f'<w:style w:type="paragraph" w:styleId="Heading{i}"><w:name w:val="heading {i}"/><w:pPr><w:outlineLvl w:val="{i - 1}"/></w:pPr></w:style>' for i in range(1, 10)
    )
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in (
            ("[Content_Types].xml", _TYPES), ("_rels/.rels", _ROOT), ("word/document.xml", document), ("word/_rels/document.xml.rels", _RELS),
            ("word/styles.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:styles xmlns:w="{_SPACE}">{styles}</w:styles>'),
        ):
            z.writestr(zipfile.ZipInfo(name, (2024, 1, 1, 0, 0, 0)), text)
    return buffer.getvalue()


def with_document(content: bytes, document: bytes) -> bytes:
    """A copy of a document with its main part replaced; every other entry is copied as it is."""
    ElementTree.fromstring(document)
    buffer = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as old, zipfile.ZipFile(buffer, "w") as new:
        for item in old.infolist():
            new.writestr(item, document if item.filename == PARTS["document"] else old.read(item.filename), item.compress_type)
    return buffer.getvalue()


def with_body_end(content: bytes, markup: str, parts: dict[str, bytes]) -> bytes:
    """A copy of a document made here with markup at the end of its body and more parts."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        document = z.read(PARTS["document"]).replace(b"<w:sectPr/></w:body>", markup.encode() + b"<w:sectPr/></w:body>")
    buffer = io.BytesIO(with_document(content, document))
    with zipfile.ZipFile(buffer, "a") as z:
        for name, part in parts.items():
            z.writestr(zipfile.ZipInfo(name, (2024, 1, 1, 0, 0, 0)), part)
    return buffer.getvalue()


def render(blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Blocks (doc, pos, kind, level, text, cells, table_id) to (doc_id, content). A document's
    blocks meet in one row, as they must in one file."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "kind", "level", "text", "cells", "table_id")))
    grouped = blocks.groupBy(F.col(doc).alias("doc_id")).agg(ordered.alias("blocks"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            made = [make_docx([dict(b) if isinstance(b, dict) else b.asDict() for b in r.blocks]) for r in pdf.itertuples()]
            yield pd.DataFrame({"doc_id": pdf.doc_id, "content": made})

    return grouped.mapInPandas(run, "doc_id long, content binary")


def openable(files: DataFrame) -> DataFrame:
    """(doc_id, error): null where the content opens and its parts parse."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            errors = []
            for c in pdf.content:
                try:
                    block_rows(parts_of(bytes(c)))
                    errors.append(None)
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                    errors.append(f"{type(e).__name__}: {e}"[:200])
            yield pd.DataFrame({"doc_id": pdf.doc_id, "error": errors})

    return files.select("doc_id", "content").mapInPandas(run, "doc_id long, error string")


def blocks_to_md(blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Blocks as Markdown text, one row per document."""
    line = (
        F.when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), F.greatest(F.col("level"), F.lit(1))), F.lit(" "), F.col("text")))
        .when(F.col("kind") == "separator", F.concat(F.lit("**"), F.col("text"), F.lit("**")))
        .when(F.col("kind") == "list", F.concat(F.lit("* "), F.col("text")))
        .when(F.col("kind") == "table_row", F.concat(F.lit("| "), F.array_join("cells", " | "), F.lit(" |")))
        .otherwise(F.col("text"))
    )
    ordered = F.array_sort(F.collect_list(F.struct("pos", line.alias("line"))))
    return blocks.groupBy(doc).agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))
