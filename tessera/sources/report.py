"""HTML reports."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame

from ..functions.values import display, quoted

#: Page, text, card, line, head and stripe colours.
_LIGHT, _DARK = ("#ffffff", "#1e293b", "#f8fafc", "#e2e8f0", "#2563eb", "#f1f5f9"), ("#0f172a", "#f8fafc", "#1e293b", "#334155", "#3b82f6", "#141e33")


def html_report(df: DataFrame, title: str, dark: bool = False, max_rows: int = 10_000) -> str:
    """A page of its own with the table's first rows; everything is escaped. A report is for reading, so its
    rows are bounded, and it says so where there are more."""
    page, text, card, line, head, stripe = _DARK if dark else _LIGHT
    rows = df.select(*[display(quoted(f.name), f.dataType) for f in df.schema]).limit(max_rows + 1).collect()
    more = len(rows) > max_rows
    style = (
        f"body{{font-family:sans-serif;background:{page};color:{text};padding:24px}}main{{max-width:1200px;margin:auto;background:{card};border:1px solid {line};border-radius:12px;padding:24px}}"
        f"table{{width:100%;border-collapse:collapse;font-size:14px}}th{{background:{head};color:#fff;text-align:left}}th,td{{padding:10px 16px;border:1px solid {line}}}tr:nth-child(even){{background:{stripe}}}"
        "@media print{body{padding:0}main{border:none}}"
    )
    heads = "".join(f"<th>{escape(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{escape(v)}</td>" for v in r) + "</tr>\n" for r in rows[:max_rows])
    note = f"<p>The first {max_rows} rows.</p>" if more else ""
    return f'<!DOCTYPE html>\n<html lang="en"><head><meta charset="UTF-8"><title>{escape(title)}</title><style>{style}</style></head>\n<body><main><h1>{escape(title)}</h1>\n<table><thead><tr>{heads}</tr></thead>\n<tbody>\n{body}</tbody></table>{note}</main></body></html>\n'
