"""HTML to text in one pass over each page, in Arrow batches."""

from __future__ import annotations

import re
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_REFERENCE = re.compile(r"&(?:#([0-9]+);?|#[xX]([0-9a-fA-F]+);?|([A-Za-z][A-Za-z0-9]*)(;?))")
_OLDEST = max(len(k) for k in html5 if not k.endswith(";"))
#: The rest of a tag, whose quoted values may hold `>`.
_TAG_END = re.compile(r"""[^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+>""")
_RAW = re.compile(r"<(script|style)(?![A-Za-z0-9_])", re.I)
_RAW_END = {k: re.compile(rf"</{k}\s*>", re.I) for k in ("script", "style")}
_C1 = {k: bytes([k]).decode("cp1252", "ignore") or chr(k) for k in range(0x80, 0xA0)}
_MANY = re.compile(r"\n{3,}")


def _meaning(m: re.Match) -> str:
    name = m[3]
    if name is not None:
        if m[4]:
            return html5.get(name + ";", m[0])
        for n in range(min(len(name), _OLDEST), 1, -1):
            if name[:n] in html5:
                return html5[name[:n]] + name[n:]
        return m[0]
    digits, base = (m[1], 10) if m[1] is not None else (m[2], 16)
    digits = digits.lstrip("0")
    code = int(digits or "0", base) if len(digits) <= 8 else 0
    if not code or code > 0x10FFFF or 0xD800 <= code < 0xE000:
        return "�"
    return _C1.get(code) or chr(code)


def unescape(text: str) -> str:
    """Character references decoded, once; names are looked up in the standard table, unknown ones stay."""
    return _REFERENCE.sub(_meaning, text) if "&" in text else text


def page_text(html: str | None) -> str:
    """Text nodes on lines of their own; scripts, styles, comments, declarations and tags go; character references are
    decoded; three line ends or more become two. A quoted value may hold `>`. A script, style or comment that is not closed
    takes what is left of the page; a CDATA section is text. `<` before anything else is text, as is a tag without an end."""
    html = html or ""
    out: list[str] = []  # text between borders
    add = lambda x: out.append(unescape(x)) if x else None
    at = text_from = 0
    quotes, last_end = True, html.rfind(">")
    while (at := html.find("<", at)) >= 0:
        following = html[at + 1 : at + 2]
        if not (following.isascii() and following.isalpha()) and following not in ("/", "!", "?"):
            at += 1
            continue
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            end = len(html) if end < 0 else end + 3
        elif html.startswith("<![CDATA[", at):
            end = html.find("]]>", at + 9)
            stop = len(html) if end < 0 else end
            add(html[text_from:at])
            out += [html[at + 9 : stop]] if stop > at + 9 else []  # not decoded
            at = text_from = min(stop + 3, len(html))
            continue
        else:
            if last_end < at:
                break
            m = _TAG_END.match(html, at + 1) if quotes and (following.isalpha() or following == "/") else None
            if m is None:
                quotes = quotes and following in ("!", "?")  # a quote that is never closed protects nothing from here on
                end = html.index(">", at) + 1
            else:
                end = m.end()
            if (raw := _RAW.match(html, at)) and (closing := _RAW_END[raw[1].lower()].search(html, end)):
                end = closing.end()
            elif raw:
                end = len(html)
        add(html[text_from:at])
        at = text_from = end
    add(html[text_from:])
    return _MANY.sub("\n\n", "\n".join(out)).strip()


@F.arrow_udf(StringType())
def _page_texts(pages: pa.Array) -> pa.Array:
    return pa.array([page_text(x.as_py()) for x in pages], pa.string())


def html_text(html: Column) -> Column:
    """page_text() of a column; null becomes empty."""
    return _page_texts(html)
