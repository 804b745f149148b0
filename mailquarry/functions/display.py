"""How values are shown to readers: dates, counts, durations, wrapped text and entities; all as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lines that begin a list item, a quote, a header or a rule, and the least length of a wrapped line.
STRUCTURED = r"^\s*(?:[-*•>]|[0-9]+[.)]\s|[A-Z][A-Za-z0-9_ ]{0,24}:\s|_{3,}|={3,})"
WRAPPED_FROM = 45
#: Named entities, decoded before ``&amp;``.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": " "}
_NUMERIC = r"(?i)&#(?:x[0-9a-f]+|[0-9]+);"
#: The greatest code point.
LAST_POINT = 0x10FFFF


def short_date(at: Column) -> Column:
    """Day, short month and year, such as ``4 Aug 2001``."""
    return F.date_format(at, "d MMM yyyy")


def long_date(at: Column) -> Column:
    """The short date with hours and minutes, UTC."""
    return F.date_format(at, "d MMM yyyy 'at' HH:mm 'UTC'")


def month_label(at: Column) -> Column:
    """Short month and year."""
    return F.date_format(at, "MMM yyyy")


def end_of_month(at: Column) -> Column:
    """The last day of a month, as text."""
    return F.date_format(F.last_day(at), "yyyy-MM-dd")


def grouped(n: Column) -> Column:
    """A whole number with commas between thousands."""
    return F.format_number(n.cast("bigint"), 0)


def plural(n: Column, one: str, many: str | None = None) -> Column:
    """The number with the word in its right form."""
    return F.concat(grouped(n), F.lit(" "), F.when(n == 1, one).otherwise(many or f"{one}s"))


def milliseconds(n: Column) -> Column:
    """Whole milliseconds from 100 on, else one decimal."""
    whole = F.floor(n + 0.5).cast("bigint").cast("string")
    tenths = F.floor(n * 10 + 0.5).cast("bigint")
    small = F.concat((tenths / 10).cast("bigint").cast("string"), F.lit("."), (tenths % 10).cast("string"))
    return F.concat(F.when(n >= 100, whole).otherwise(small), F.lit(" ms"))


def bar_width(n: Column, most: Column) -> Column:
    """Width of a bar in per cent of the longest, at least 4."""
    return F.greatest(F.lit(100.0) * n / most, F.lit(4.0))


def _reflowed(paragraph: Column) -> Column:
    """A paragraph whose hard-wrapped lines are joined; whether a line continues depends on it and the one before only."""
    lines = F.split(paragraph, "\n")
    right, left = lambda x: F.regexp_replace(x, r"\s+$", ""), lambda x: F.regexp_replace(x, r"^\s+", "")
    rule = r"^\s*-{3,}"

    def laid_out(x: Column) -> Column:
        return x.rlike(STRUCTURED) | x.rlike(rule)

    def goes_on(i: Column) -> Column:
        """Whether line i is the wrapped rest of line i - 1."""
        now, before = F.get(lines, i), F.get(lines, i - 1)
        return (i > 0) & F.coalesce((F.length(right(before)) >= WRAPPED_FROM) & (F.trim(now) != "") & ~laid_out(now) & ~laid_out(before), F.lit(False))

    def piece(x: Column, i: Column) -> Column:
        own = F.when(goes_on(i), left(x)).otherwise(x)
        own = F.when(goes_on(i + 1), right(own)).otherwise(own)
        return F.concat(F.when(i == 0, "").when(goes_on(i), " ").otherwise("\n"), own)

    return F.array_join(F.transform(lines, piece), "")


def reflow(text: Column) -> Column:
    """Text without the wrapping of old mail clients: within a paragraph, long unstructured lines are joined."""
    return F.array_join(F.transform(F.split(text, "\n{2,}"), _reflowed), "\n\n")


def decode_entities(text: Column) -> Column:
    """Numeric and named entities as their characters, ``&amp;`` last, so that ``&amp;lt;`` stays ``&lt;``.

    A number that is no code point stays as it is.
    """
    parts, codes = F.split(text, _NUMERIC), F.regexp_extract_all(text, F.lit(f"({_NUMERIC})"), 1)

    def character(entity: Column) -> Column:
        digits = F.substr(entity, F.lit(3), F.length(entity) - 3)
        hexadecimal = F.lower(F.substr(digits, F.lit(1), F.lit(1))) == "x"
        point = F.when(hexadecimal, F.conv(F.substr(digits, F.lit(2)), 16, 10)).otherwise(digits).cast("decimal(20,0)")
        ok = (point > 0) & (point <= LAST_POINT) & ~point.between(0xD800, 0xDFFF)
        # UTF-32 bytes of the code point, read as text
        padded = F.lpad(F.hex(F.when(ok, point).otherwise(F.lit(63)).cast("bigint")), 8, "0")
        return F.when(ok, F.decode(F.unhex(padded), "UTF-32")).otherwise(entity)

    out = F.array_join(F.transform(parts, lambda x, i: F.concat(x, F.coalesce(F.get(F.transform(codes, character), i), F.lit("")))), "")
    for entity, sign in ENTITIES.items():
        out = F.replace(out, F.lit(entity), F.lit(sign))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))
