"""Column expressions on text."""

from __future__ import annotations

import functools
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
NO_SPAN = "<no relevant span>"
PROBE = 100
#: White space as Python's split() and strip() know it, no-break space among it; also in the patterns of chunkers.
WHITE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SENTENCE_END = rf"(?<=[.!?])[{WHITE}]+|\n{{2,}}"
#: The same for Java's matcher, which is asked first whether a character is a plain one.
SPACE = f"[[^!-~]&&[{WHITE}]]+"
TOKEN = f"[!-~[^{WHITE}]]+"


def strip(c: Column, space: str = SPACE) -> Column:
    """Without white space at both ends; trim() would know spaces only."""
    return F.regexp_replace(c, f"^{space}|{space}$", "")


def collapse(c: Column, space: str = SPACE) -> Column:
    return strip(F.regexp_replace(c, space, " "), space)


def white_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(TOKEN), F.lit(0))


def lexical_tokens(c: Column) -> Column:
    """Lower-cased runs of a-z and 0-9."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


@functools.cache
def _references() -> tuple[str, Column]:
    """The pattern of character references, and the named ones with their characters, from the standard table. Old names
    count without a semicolon too."""
    old = "|".join(sorted((k for k in html5 if not k.endswith(";")), key=lambda k: (-len(k), k)))
    table = F.create_map(*[F.lit(x) for kv in sorted(html5.items()) for x in kv])
    return rf"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;|(?:{old}))", table


def unescaped(c: Column) -> Column:
    """Character references decoded, once: numbers in decimal and hexadecimal (those of the C1 range as Windows-1252, what is
    no character as U+FFFD) and names; unknown names stay."""
    pattern, names = _references()
    c1 = F.array(*[F.lit(bytes([k]).decode("cp1252", "ignore") or chr(k)) for k in range(0x80, 0xA0)])

    def means(ref: Column) -> Column:
        digits = F.regexp_extract(ref, r"^&#[xX]?([0-9a-fA-F]+)", 1)
        code = F.when(F.length(F.ltrim(digits, F.lit("0"))) <= 8, F.conv(digits, 16, 10)).otherwise("4294967295")
        code = F.when(ref.rlike("^&#[xX]"), code).when(F.length(digits) <= 18, digits).otherwise("4294967295").cast("long")
        bad = (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        number = F.when(bad, F.lit("\ufffd")).when(code.between(0x80, 0x9F), F.get(c1, (code - 0x80).cast("int"))).otherwise(char)
        return F.when(ref.startswith("&#"), number).otherwise(F.coalesce(F.try_element_at(names, F.substr(ref, F.lit(2))), ref))

    found, gaps = F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), F.split(c, pattern)
    pieces = F.zip_with(gaps, F.transform(found, means), lambda g, r: F.concat(g, F.coalesce(r, F.lit(""))))
    return F.when(F.contains(c, F.lit("&")), F.array_join(pieces, "")).otherwise(c)


def normal_span(c: Column) -> Column:
    """A source span, stripped; the sentinel and null count as none."""
    s = strip(F.coalesce(c, F.lit("")))
    return F.when(s == NO_SPAN, F.lit("")).otherwise(s)


def comparable(c: Column) -> Column:
    return F.lower(collapse(F.coalesce(c, F.lit(""))))


def span_in(span: Column, text: Column) -> Column:
    """Whether comparable text holds the comparable span, or its first or last 100 characters if it is longer."""
    long = F.length(span) > PROBE
    return (
        (span != "")
        & (text != "")
        & (F.contains(text, span) | (long & (F.contains(text, F.substring(span, F.lit(1), F.lit(PROBE))) | F.contains(text, F.right(span, F.lit(PROBE))))))
    )


def sentences(c: Column) -> Column:
    """Split after . ! ? and white space, or at blank lines."""
    parts = F.split(strip(F.coalesce(c, F.lit(""))), SENTENCE_END)
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def token_estimate(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(c, F.lit(""))) / 4)).cast("long")


def route(question: Column, qa_type: Column | None = None) -> Column:
    """Strategy for a question by fixed rules: anchors and short lookups are lexical, the rest is hybrid."""
    q = F.lower(F.coalesce(question, F.lit("")))
    kind = F.lower(strip(F.coalesce(qa_type, F.lit("")))) if qa_type is not None else F.lit("")
    lexical = (kind == "out-of-scope") | q.rlike(r"\bitem\s+\d+[a-z]?\b") | F.contains(q, F.lit("section")) | (F.size(white_tokens(q)) <= 5)
    return F.when(lexical, F.lit("bm25")).otherwise(F.lit("hybrid"))


def title(c: Column, width: int = 42, blank: str = "New chat") -> Column:
    """White space collapsed; longer ones cut at the last space within the width, with an ellipsis."""
    s = collapse(F.coalesce(c, F.lit("")))
    cut = F.substring(s, F.lit(1), F.lit(width))
    whole = F.regexp_extract(cut, r"^(.*) ", 1)
    return F.when(s == "", F.lit(blank)).when(F.length(s) <= width, s).otherwise(F.concat(F.when(whole == "", cut).otherwise(whole), F.lit("…")))


def question_key(c: Column) -> Column:
    """A question as the answer cache compares it."""
    return collapse(F.lower(F.coalesce(c, F.lit(""))))


def point_id(c: Column) -> Column:
    """The first 16 hex digits of the MD5 as an unsigned 64-bit number."""
    return F.conv(F.substring(F.md5(c.cast("binary")), 1, 16), 16, 10).cast("decimal(20,0)")
