"""Tables into files. Data formats are written by Spark; pages for people are built from a bounded result."""

from __future__ import annotations

import html
import io
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a page for people may hold; larger results go to CSV, JSON or Parquet.
PAGE_ROWS = 100_000
#: Column profiles of the vocabulary.
PROFILES = {"terms_only": ["term"], "basic": ["term", "total", "score"], "all": None}


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, profile: str = "all") -> None:
    columns = PROFILES[profile]
    df.select(*(columns or df.columns)).write.mode("overwrite").option("header", True).csv(path)


def write_terms(df: DataFrame, path: str, term: str = "term") -> None:
    df.select(F.col(term).cast("string").alias("value")).where("value is not null").write.mode("overwrite").text(path)


def _rows(df: DataFrame) -> tuple[list[str], list[list[str]]]:
    rows = df.limit(PAGE_ROWS + 1).collect()
    if len(rows) > PAGE_ROWS:
        raise ValueError(f"over {PAGE_ROWS} rows: write a data format instead")
    return df.columns, [["" if x is None else str(x) for x in r] for r in rows]


def html_page(df: DataFrame, title: str) -> str:
    """A table that sorts on a click and filters as one types."""
    columns, rows = _rows(df)
    cell = lambda tag, x: f"<{tag}>{html.escape(x)}</{tag}>"
    head = "".join(cell("th", c) for c in columns)
    body = "\n".join(f"<tr>{''.join(cell('td', x) for x in r)}</tr>" for r in rows)
    script = (
        "const b=document.querySelector('tbody');document.querySelector('input').oninput=e=>{for(const r of b.rows)"
        "r.hidden=!r.textContent.toLowerCase().includes(e.target.value.toLowerCase())};"
        "document.querySelectorAll('th').forEach((h,i)=>h.onclick=()=>{const s=h.dataset.s=h.dataset.s==='1'?'-1':'1';"
        "[...b.rows].sort((x,y)=>s*(x.cells[i].textContent.localeCompare(y.cells[i].textContent,undefined,{numeric:true}))).forEach(r=>b.append(r))});"
    )
    return f"<!DOCTYPE html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><input placeholder=filter><table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table><script>{script}</script>"


def text_report(df: DataFrame, title: str) -> str:
    columns, rows = _rows(df)
    return "\n".join([title, "=" * len(title), "", *(" | ".join(r) for r in [columns, *rows]), ""])


def docx_report(df: DataFrame, title: str) -> bytes:
    """A Word document with a heading and a table."""
    columns, rows = _rows(df)
    p = lambda x: f'<w:p><w:r><w:t xml:space="preserve">{html.escape(x)}</w:t></w:r></w:p>'
    table = "".join("<w:tr>" + "".join(f"<w:tc>{p(x)}</w:tc>" for x in r) + "</w:tr>" for r in [columns, *rows])
    document = f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{p(title)}<w:tbl>{table}</w:tbl></w:body></w:document>'
    types = '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
    rels = '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in (("[Content_Types].xml", types), ("_rels/.rels", rels), ("word/document.xml", document)):
            z.writestr(name, data)
    return out.getvalue()
