"""Scalar text functions as columns; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Reply and forward marks, lines that begin quoted text, and an archive's mangled punctuation.
REPLY_MARKS = r"(?i)^\s*(?:(?:re|fw|fwd|aw|sv)\s*:\s*)+"
FORWARD_CHAIN = r"(?i)^\s*(?:(?:re|aw|sv)\s*:\s*)*(?:fw|fwd)\s*:"
QUOTE_LINE = r"(?i)^(?:\s*-{2,}\s*Original Message\s*-{2,}.*|\s*-{2,}\s*Forwarded by\b.*|\s*_{10,}\s*|\s*On\b.{0,160}\bwrote:\s*|\s*>.*)$"
MANGLED = (
    ("\x01,", "’"), ("\x01%", "’"), ("\x02\x07", "’"), ("\x01'", "’"), ("\x01+", "‘"), ("\x01&", "“"), ("\x018", "”"),
    ("\x01)", "—"), ("\x01*", "—"), ("\x01(", "—"), ("\x01\x07", "•"), ("\x01 ", "• "), ("\x01v", "™"), ("\x01;", " "),
)
STOPWORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
#: The characters that count as white space, in any script.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LINE_END = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\x{2028}\x{2029}]"


def strip(c: Column) -> Column:
    """Without white space, of any kind, at both ends."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def normalise_subject(c: Column) -> Column:
    """Without reply and forward marks, runs of blanks as one; null counts as empty."""
    return strip(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), REPLY_MARKS, ""), r"[ \t]+", " "))


def is_reply_or_forward(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(REPLY_MARKS)


def is_forward(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(FORWARD_CHAIN)


def clean_text(c: Column) -> Column:
    """Mangled punctuation repaired in the listed order, other control characters dropped; line structure stays."""
    for bad, good in MANGLED:
        c = F.replace(c, F.lit(bad), F.lit(good))
    return F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")


def split_quoted(c: Column) -> Column:
    """struct(new_text, quoted_text): cut at the first line that begins quoted text; both halves stripped."""
    lines = F.split(F.coalesce(c, F.lit("")), LINE_END)
    first = F.coalesce(F.array_position(F.transform(lines, lambda x: x.rlike(QUOTE_LINE)), True), F.lit(0))
    cut = F.when(first > 0, first.cast("int") - 1).otherwise(F.size(lines))
    new = F.array_join(F.slice(lines, F.lit(1), cut), "\n")
    old = F.array_join(F.slice(lines, cut + 1, F.size(lines)), "\n")
    return F.struct(strip(new).alias("new_text"), strip(old).alias("quoted_text"))


def normalise_address(c: Column) -> Column:
    """Lower case, without angle brackets and white space at the ends."""
    return F.lower(strip(F.regexp_replace(strip(c), r"^<+|>+$", "")))


def display_name(c: Column) -> Column:
    """Best human name of a sender, or an empty text; "Last, First" is turned; at most 64 characters."""
    name = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"<[^>]*>", " "), f"{SPACE}+", " ")
    name = strip(F.regexp_replace(F.regexp_replace(strip(name), r'^"+|"+$', ""), r"^'+|'+$", ""))
    last, first = strip(F.split_part(name, F.lit(","), F.lit(1))), strip(F.split_part(name, F.lit(","), F.lit(2)))
    one_comma = F.length(name) - F.length(F.replace(name, F.lit(","), F.lit(""))) == 1
    turned = F.when(one_comma & (last != "") & (first != ""), F.concat(first, F.lit(" "), last)).otherwise(name)
    return F.when((name == "") | name.rlike(r"[=/@]"), F.lit("")).otherwise(F.substring(turned, 1, 64))


def person_name(address: Column) -> Column:
    """Local part of an address as words with capital first letters."""
    parts = F.filter(F.split(F.split_part(address, F.lit("@"), F.lit(1)), r"[._-]"), lambda p: p != "")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))), " ")


def recipients_label(names: Column) -> Column:
    """The first two names and how many more there are."""
    more = F.size(names) - 2
    head = F.array_join(F.slice(names, 1, 2), ", ")
    return F.when(F.size(names) > 2, F.concat(head, F.lit(" and "), more.cast("string"), F.lit(" more"))).otherwise(head)


def tokens(c: Column) -> Column:
    """Words (runs of letters or digits) in lower case."""
    return F.array_remove(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def english_tokens(c: Column) -> Column:
    """Words without stop words, with plural endings cut."""
    kept = F.filter(tokens(c), lambda t: ~t.isin(*STOPWORDS))
    return F.transform(kept, stem)


def stem(t: Column) -> Column:
    """A word without its plural ending: ``ies`` becomes ``y``, else a single ``s`` goes; by string functions, which are cheaper than patterns here."""
    return F.when(F.endswith(t, F.lit("ies")), F.concat(F.substr(t, F.lit(1), F.length(t) - 3), F.lit("y"))).when(F.endswith(t, F.lit("s")) & ~F.endswith(t, F.lit("ss")) & (F.length(t) > 1), F.substr(t, F.lit(1), F.length(t) - 1)).otherwise(t)


def collapse_space(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def csv_cell(c: Column) -> Column:
    """Null as empty; a leading formula sign is guarded by an apostrophe."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def one_edit(a: Column, b: Column) -> Column:
    """Whether two words differ by one insertion, deletion, substitution or swap of neighbours, or are equal."""
    n = F.length(a)
    places = F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))
    swapped = F.exists(
        places,
        lambda i: F.concat(F.substr(a, F.lit(1), i - 1), F.substr(a, i + 1, F.lit(1)), F.substr(a, i, F.lit(1)), F.substr(a, i + 2)) == b,
    )
    return (F.levenshtein(a, b) <= 1) | ((n == F.length(b)) & (n >= 2) & (F.levenshtein(a, b) == 2) & swapped)
