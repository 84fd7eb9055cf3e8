"""String functions with PostgreSQL's meaning where Spark's differs. All are Column expressions; NULL in, NULL out, but for concat_ws."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = " \t\n\r\x0b\x0c"


def substring(s: Column, start: int, length: int | None = None) -> Column:
    """From a place counted from 1; a place before the text is its beginning."""
    at = max(start, 1)
    return F.substring(s, F.lit(at), F.lit(length) if length is not None else F.length(s))


def substr(s: Column, start: int, length: int | None = None) -> Column:
    """As substring, but a place before the text shortens the length."""
    if length is None:
        return substring(s, start)
    return F.substring(s, F.lit(max(start, 1)), F.lit(max(0, length + min(start - 1, 0))))


def left(s: Column, n: int) -> Column:
    return F.when(s.isNotNull(), F.left(s, F.lit(n))) if n > 0 else F.when(s.isNotNull(), F.lit(""))


def right(s: Column, n: int) -> Column:
    return F.right(s, F.lit(n)) if n > 0 else F.when(s.isNotNull(), F.lit(""))


def btrim(s: Column, chars: str = WHITE) -> Column:
    return F.trim(s, F.lit(chars))


def ltrim(s: Column, chars: str = WHITE) -> Column:
    return F.ltrim(s, F.lit(chars))


def rtrim(s: Column, chars: str = WHITE) -> Column:
    return F.rtrim(s, F.lit(chars))


def concat_ws(sep: str | None, *parts: Column) -> Column:
    return F.lit(None).cast("string") if sep is None else F.concat_ws(sep, *parts)


def replace(s: Column, old: str, new: str) -> Column:
    return F.replace(s, F.lit(old), F.lit(new)) if old else s


def strpos(s: Column, part: str) -> Column:
    return F.instr(s, part)


def repeat(s: Column, n: int) -> Column:
    return F.repeat(s, max(n, 0))


def initcap(s: Column) -> Column:
    """A word is a run of letters and digits: each begins upper-case and goes on lower-case."""
    parts = F.regexp_extract_all(F.lower(s), F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.substring(p, F.lit(2), F.length(p)))), "")


def ascii_code(s: Column) -> Column:
    """Of the first character; of an empty text NULL."""
    return F.ascii(F.nullif(s, F.lit("")))


def chr_of(n: Column) -> Column:
    """0 to 255, else NULL."""
    return F.when(n.between(0, 255), F.chr(n.cast("long")))


def split_part(s: Column, sep: str, n: int) -> Column:
    """The n-th field, from the end if negative; '' outside, and for 0."""
    return F.split_part(s, F.lit(sep), F.lit(n)) if n else F.when(s.isNotNull(), F.lit(""))


def to_hex(n: Column) -> Column:
    return F.lower(F.hex(n.cast("long")))


def quote_literal(s: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(s, F.lit("'"), F.lit("''")), F.lit("'"))


def quote_ident(s: Column) -> Column:
    plain = s.rlike("^[a-z_][a-z0-9_]*$")
    return F.when(plain, s).otherwise(F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"')))


def format_text(pattern: str, *args: Column) -> Column:
    """%s plain (NULL as nothing), %I as an identifier, %L as a literal (NULL as NULL), %% a percent sign."""
    out, rest, text = [], list(args), ""
    i = 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two in ("%s", "%I", "%L"):
            if not rest:
                raise ValueError("too few arguments for the format")
            a = rest.pop(0)
            out += [F.lit(text), {"%s": F.coalesce(a.cast("string"), F.lit("")), "%I": quote_ident(a.cast("string")), "%L": F.coalesce(quote_literal(a.cast("string")), F.lit("NULL"))}[two]]
            text, i = "", i + 2
        else:
            text += "%" if two == "%%" else pattern[i]
            i += 2 if two == "%%" else 1
    return F.concat(*out, F.lit(text))


def encode(s: Column, kind: str) -> Column:
    """Bytes of a text as hex, base64 or escape (bytes outside printable ASCII as \\nnn)."""
    if kind == "hex":
        return F.lower(F.hex(s.cast("binary")))
    if kind == "base64":
        return F.base64(s.cast("binary"))
    if kind == "escape":
        codes = F.transform(F.sequence(F.lit(1), F.octet_length(s)), lambda i: F.conv(F.hex(F.substring(s.cast("binary"), i, F.lit(1))), 16, 10).cast("int"))
        octal = lambda c: F.concat(F.lit("\\"), F.lpad(F.conv(c.cast("string"), 10, 8), 3, "0"))
        return F.when(F.octet_length(s) == 0, "").otherwise(F.array_join(F.transform(codes, lambda c: F.when(c == 92, F.lit("\\\\")).when(c.between(32, 126), F.chr(c.cast("long"))).otherwise(octal(c))), ""))
    raise ValueError(f"no encoding {kind}")


def decode(s: Column, kind: str) -> Column:
    """The bytes that hex, base64 or escape stand for."""
    if kind == "escape":
        parts = F.regexp_extract_all(s, F.lit(r"\\\\|\\[0-7]{3}|[^\\]"), F.lit(0))
        one = lambda p: F.when(p == "\\\\", "5C").when(F.length(p) == 4, F.lpad(F.conv(F.substring(p, 2, 3), 8, 16), 2, "0")).otherwise(F.hex(p))
        return F.unhex(F.array_join(F.transform(parts, one), ""))
    if kind not in ("hex", "base64"):
        raise ValueError(f"no encoding {kind}")
    return F.unhex(s) if kind == "hex" else F.unbase64(s)


def similar_to(s: Column, pattern: str) -> Column:
    """SQL's SIMILAR TO: % and _ as in LIKE, and | * + ? ( ) [ ] { } as in regular expressions; the whole text must match."""
    out, inside = "", False
    for c in pattern:
        if inside:
            out, inside = out + c, c != "]"
        else:
            inside = c == "["
            out += {"%": ".*", "_": "."}.get(c, c if c in "|*+?()[]{}" or c.isalnum() else "\\" + c)
    return s.rlike(f"(?s)^(?:{out})$")
