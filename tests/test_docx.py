"""Word documents made here, read back, and changed in place."""

import zipfile
from io import BytesIO

from palimpsest.plans.revise import revise
from palimpsest.sources import docx as D

BLOCKS = [
    {"kind": "heading", "level": 1, "text": "Title & <more>"},
    {"kind": "para", "level": 0, "text": "plain bold end", "runs": [{"text": "plain "}, {"text": "bold", "bold": True}, {"text": " end", "italic": True}]},
    {"kind": "list", "level": 0, "text": "item"},
    {"kind": "blank", "level": 0, "text": ""},
    {"kind": "table_row", "level": 0, "text": "a b", "cells": ["a", "b"], "table_id": 0},
    {"kind": "table_row", "level": 0, "text": "c ", "cells": ["c", ""], "table_id": 0},
    {"kind": "table_row", "level": 0, "text": "d", "cells": ["d"], "table_id": 1},
    {"kind": "separator", "level": 0, "text": "SIGNATURE PAGE", "runs": [{"text": "SIGNATURE PAGE", "bold": True}]},
]


def frame(spark, *contents):
    return spark.createDataFrame([(i, c) for i, c in enumerate(contents)], "doc_id long, content binary")


def test_round_trip(spark):
    rows = D.read_blocks(frame(spark, D.make_docx(BLOCKS))).orderBy("pos").collect()
    assert [(r.kind, r.level, r.text, r.cells, r.table_id) for r in rows] == [(b["kind"], b["level"], b["text"], b.get("cells"), b.get("table_id")) for b in BLOCKS]
    assert [(x.text, x.bold, x.italic) for x in rows[1].runs] == [("plain ", False, False), ("bold", True, False), (" end", False, True)]


def changed(body, **parts):
    made = D.make_docx([])
    doc = f'<w:document xmlns:w="{D.W[1:-1]}" xmlns:r="{D.R[1:-1]}"><w:body>{body}</w:body></w:document>'.encode()
    out = BytesIO(D.with_document(made, doc))
    with zipfile.ZipFile(out, "a") as z:
        for name, text in parts.items():
            z.writestr(D.PARTS[name], text)
    return out.getvalue()


def test_changes_and_references(spark):
    body = (
        "<w:p><w:ins><w:r><w:t>new</w:t></w:r></w:ins><w:del><w:r><w:delText>old</w:delText></w:r></w:del></w:p>"
        '<w:p><w:r><w:drawing r:embed="rId9"/></w:r></w:p><w:sdt><w:sdtContent><w:p><w:r><w:t>inside</w:t></w:r></w:p></w:sdtContent></w:sdt>'
    )
    numbering = (
        f'<w:numbering xmlns:w="{D.W[1:-1]}"><w:abstractNum w:abstractNumId="3"><w:lvl w:ilvl="0"><w:numFmt w:val="bullet"/></w:lvl></w:abstractNum>'
        '<w:num w:numId="7"><w:abstractNumId w:val="3"/></w:num></w:numbering>'
    )
    comments = f'<w:comments xmlns:w="{D.W[1:-1]}"><w:comment/><w:comment/></w:comments>'
    files = frame(spark, changed(body, numbering=numbering, comments=comments))
    rows = D.read_blocks(files).orderBy("pos").collect()
    assert [(r.text, r.has_drawing, r.has_sdt) for r in rows] == [("new", False, False), ("", True, False), ("inside", False, True)]
    assert tuple(D.read_conflicts(files).first()) == (0, 1, 1, 2)
    assert [r.rel_id for r in D.read_missing_relationships(files).collect()] == ["rId9"]
    assert [r.num_id for r in D.read_bullet_numbers(files).collect()] == ["7"]
    assert {r.style_id for r in D.read_styles(files).collect()} == {f"Heading{i}" for i in range(1, 10)}
    errors = {r.doc_id: r.error for r in D.openable(frame(spark, changed(body), b"no zip")).collect()}
    assert errors[0] is None and "BadZipFile" in errors[1]


def test_files(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(D.make_docx(BLOCKS))
    files = spark.read.format("binaryFile").load(str(tmp_path)).selectExpr("1L AS doc_id", "content")
    assert D.blocks_to_md(D.read_blocks(files)).first().text.startswith("# Title & <more>\nplain bold end\n* item\n")


def test_revise(spark):
    base = "## One\n\nThe quick brown fox jumps over it\n\n* alpha item\n* beta item\n\n## Second part\n\nSame text here\n"
    new = "## One\n\nThe quick brown fox jumped over it\n\n* alpha item\n* gamma 99\n\n## Second part bis\n\nSame text here\n\n## Three\n\nbrand new\n"
    f = lambda t: spark.createDataFrame([(1, t)], "id long, text string")
    out = revise(f(base), f(new), "id")
    texts = [r.text for r in out.blocks.orderBy("pos").collect()]
    assert texts[:2] == ["One", "The quick brown fox jumped over it"] and texts[-2:] == ["Second part bis", "Same text here"]
    assert [r.source_heading for r in out.skipped.collect()] == ["Three"]
    # Revising a document by itself changes nothing.
    again = revise(f(base), f(base), "id")
    assert again.actions.filter("action not in ('keep', 'present')").count() == 0
