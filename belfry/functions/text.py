"""Text columns: trimming, addresses, identity keys, one-line renderings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The only postal-address shape that is split, and the cache-folder alphabet.
ADDRESS_PATTERN = r"^(.+?),\s*(.+?),\s*([A-Z]{2})\s+(\d{5}(?:-\d{4})?)$"
CACHE_UNSAFE = r"[^\p{L}\p{N}._-]"
CACHE_READABLE_CHARS = 80
CACHE_DIGEST_CHARS = 12

# The characters that count as white space.
WHITE_SPACE = (" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
               "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")

KEY_PARTS = ["church_slug", "event_type", "event_kind", "day_of_week", "date",
             "start_time", "end_time", "cancelled"]


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bound(df: DataFrame, **values: Column) -> DataFrame:
    """``df`` with further columns that are computed once a row: filters on them are not moved into what they are made of."""
    for name, value in values.items():
        df = df.select("*", F.explode(F.array(value)).alias(name))
    return df


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def empty_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def blank_to_null(text: Column) -> Column:
    """Trimmed text, null when nothing is left."""
    return empty_to_null(strip(text))


def is_blank(text: Column) -> Column:
    return blank_to_null(text).isNull()


def csv_bool(text: Column) -> Column:
    return F.when(F.lower(strip(text)) == "true", 1).otherwise(0)


def csv_float(text: Column) -> Column:
    """Double or null for blank; other text fails the job (ANSI cast)."""
    return blank_to_null(text).cast("double")


def title_case(text: Column) -> Column:
    """Upper-case the first letter and leave the rest alone."""
    return F.concat(F.upper(F.substring(text, 1, 1)), text.substr(F.lit(2), F.length(text)))


def xml_escape(text: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def format_address(line1, line2, city, state, postal_code) -> Column:
    """``line1, line2, city, ST ZIP`` without the missing parts; ``''`` when all are."""
    e = empty_to_null
    state_zip = e(F.concat_ws(" ", e(state), e(postal_code)))
    return F.concat_ws(", ", e(line1), e(line2), e(city), state_zip)


def address_key(*parts: Column) -> Column:
    return F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts])


def parse_address(text: Column) -> Column:
    """Struct of line1, line2, city, state, postal_code."""
    def read(clean: Column) -> Column:
        split = clean.rlike(ADDRESS_PATTERN)
        part = lambda i: F.when(split, strip(F.regexp_extract(clean, ADDRESS_PATTERN, i)))
        whole = F.when(~split, empty_to_null(clean))
        return F.struct(
            F.coalesce(part(1), whole).alias("line1"), F.lit(None).cast("string").alias("line2"),
            part(2).alias("city"), part(3).alias("state"), part(4).alias("postal_code"))
    return let(strip(text), read)


def event_key() -> Column:
    """Eight-part identity of an event row; note and page are commentary, not identity."""
    required = {"church_slug", "event_type", "event_kind", "start_time"}
    def part(name: str) -> Column:
        if name in required:
            return F.coalesce(F.col(name), F.lit("")).alias(name)
        if name == "cancelled":
            return F.coalesce(F.col(name), F.lit(False)).alias(name)
        return F.col(name)
    return F.struct(*[part(n) for n in KEY_PARTS])


def sortable_key(key: Column) -> Column:
    """The identity key with every part as text, null as empty text."""
    parts = [F.initcap(key[n].cast("string")) if n == "cancelled" else F.coalesce(key[n], F.lit(""))
             for n in KEY_PARTS]
    return F.struct(*[p.alias(n) for p, n in zip(parts, KEY_PARTS)])


def weekly_key() -> Column:
    return F.struct("church_id", "event_type",
                    F.coalesce("day_of_week", F.lit("")).alias("day_of_week"), "start_time")


def event_line(ev: Column | None = None) -> Column:
    """One line of text per event: parts joined by `` | ``, empty parts left out."""
    g = (lambda n: ev[n]) if ev is not None else F.col
    e = empty_to_null
    return F.concat_ws(
        " | ", e(g("church_slug")),
        e(F.concat_ws(" ", e(g("event_type")), e(g("event_kind")))),
        F.coalesce(e(g("date")), e(g("day_of_week"))),
        e(F.concat_ws("-", e(g("start_time")), e(g("end_time")))),
        F.when(g("cancelled"), F.lit("cancelled")),
        F.concat(F.lit("page "), g("page_number").cast("string")),
        e(g("note")))


def cache_version(version: Column) -> Column:
    """Readable prefix plus a digest, so that two versions never share a cache entry."""
    raw = F.coalesce(blank_to_null(version), F.lit("unknown"))
    readable = F.substring(F.regexp_replace(raw, CACHE_UNSAFE, "_"), 1, CACHE_READABLE_CHARS)
    return F.concat(readable, F.lit("-"), F.substring(F.sha2(raw, 256), 1, CACHE_DIGEST_CHARS))


def verify_flag(status: Column) -> Column:
    return F.when(status == "verified", "true").otherwise("false")
