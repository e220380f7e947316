"""Extraction and verification payloads: JSON text to typed rows.

Payloads come from extractors nobody controls, so values are read as VARIANT and
kept only when their own type fits; a typed parse would turn numbers into text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from belfry.functions.dates import iso_shape
from belfry.functions.text import blank_to_null, is_blank, let
from belfry.schemas import EXTRACTED_EVENT, RESULT, VERDICTS, VERIFICATION

# Payload sections, buckets and the keys each level allows.
SECTIONS = [("weekly_schedule", "weekly", False), ("single_events", "specific_date", False),
            ("cancellations", "specific_date", True)]
BUCKETS = [("masses", "mass"), ("confessions", "confession"), ("adorations", "adoration")]
ROOT_KEYS = ["weekly_schedule", "single_events", "cancellations",
             "church_list_needs_review", "published_date", "wrong_bulletin"]
SLOT_KEYS = ["church_slug", "start_time", "end_time", "page_number", "note"]
TRUE_WORDS = ["1", "true", "t", "yes", "y", "on"]
FALSE_WORDS = ["0", "false", "f", "no", "n", "off"]


def as_map(v: Column) -> Column:
    """The fields of an object value; null for anything that is not an object."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def get(fields: Column, key: str) -> Column:
    return F.try_element_at(fields, F.lit(key))


def kind_of(v: Column) -> Column:
    return F.schema_of_variant(v)


def is_missing(v: Column) -> Column:
    """Absent, or JSON null."""
    return v.isNull() | F.is_variant_null(v)


def text_of(v: Column) -> Column:
    """The text when the value is text, else null."""
    return let(v, lambda x: F.when(kind_of(x) == "STRING", F.try_variant_get(x, "$", "string")))


def int_of(v: Column) -> Column:
    """Whole numbers; booleans count as 1 and 0."""
    return let(v, lambda x: F.when(kind_of(x) == "BIGINT", F.try_variant_get(x, "$", "int"))
               .when(kind_of(x) == "BOOLEAN", F.try_variant_get(x, "$", "boolean").cast("int")))


def truthy(v: Column) -> Column:
    """False for absent, null, false, zero and empty values."""
    def test(x: Column) -> Column:
        k = kind_of(x)
        return (F.when(k == "BOOLEAN", F.try_variant_get(x, "$", "boolean"))
                .when(k == "STRING", F.try_variant_get(x, "$", "string") != "")
                .when(k.startswith("OBJECT") | k.startswith("ARRAY"), ~F.to_json(x).isin("{}", "[]"))
                .when(k == "VOID", F.lit(False))
                .otherwise(F.try_variant_get(x, "$", "double") != 0))
    return F.coalesce(let(v, test), F.lit(False))


def items_of(v: Column) -> Column:
    """Elements of an array value; empty for anything else."""
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))


def objects_of(v: Column) -> Column:
    """Field maps of the elements of an array value, null for elements that are no objects."""
    return F.transform(items_of(v), as_map)


def parse_object(text: Column) -> Column:
    """Fields of a JSON object; unparsable text and other top-level values have none."""
    return F.coalesce(as_map(F.try_parse_json(text)), F.create_map().cast("map<string,variant>"))


def _fixed(fn, *args):
    """One-argument form of ``fn`` for the array functions."""
    return lambda element: fn(element, *args)


def slots_of(root: Column) -> Column:
    """Every slot with its bucket's meaning, in section order: type, kind, cancelled, when_key, slot."""
    def tag(slot: Column, event_type: str, kind: str, cancelled: bool) -> Column:
        return F.struct(
            F.lit(event_type).alias("type"), F.lit(kind).alias("kind"), F.lit(cancelled).alias("cancelled"),
            F.lit("day_of_week" if kind == "weekly" else "date").alias("when_key"), slot.alias("slot"))

    parts = []
    for section, kind, cancelled in SECTIONS:
        for bucket, event_type in BUCKETS:
            found = objects_of(get(as_map(get(root, section)), bucket))
            parts.append(F.transform(found, _fixed(tag, event_type, kind, cancelled)))
    return F.concat(*parts)


def when_of(s: Column) -> Column:
    """The weekday of a weekly slot, the date of a dated one."""
    return text_of(F.try_element_at(s["slot"], s["when_key"]))


def _events(slots: Column, page_of) -> Column:
    def build(s: Column) -> Column:
        value = lambda key: get(s["slot"], key)
        weekly = s["kind"] == "weekly"
        return F.struct(
            text_of(value("church_slug")).alias("church_slug"), s["type"].alias("type"), s["kind"].alias("kind"),
            F.when(weekly, when_of(s)).alias("day_of_week"), F.when(~weekly, when_of(s)).alias("date"),
            text_of(value("start_time")).alias("start_time"), text_of(value("end_time")).alias("end_time"),
            s["cancelled"].alias("cancelled"), page_of(value("page_number")).alias("page_number"),
            blank_to_null(text_of(value("note"))).alias("note"))
    return F.transform(slots, build)


def _result(root: Column, events: Column, flag) -> Column:
    return F.struct(
        events.cast(f"array<{EXTRACTED_EVENT}>").alias("events"),
        F.coalesce(flag(get(root, "church_list_needs_review")), F.lit(False)).alias("church_list_needs_review"),
        iso_shape(text_of(get(root, "published_date"))).alias("published_date"),
        F.coalesce(flag(get(root, "wrong_bulletin")), F.lit(False)).alias("wrong_bulletin"))


def lenient_result(root: Column, slots: Column) -> Column:
    """Keep the slots that are usable, drop the rest."""
    def usable(s: Column) -> Column:
        return (s["slot"].isNotNull() & ~is_blank(text_of(get(s["slot"], "church_slug")))
                & ~is_blank(text_of(get(s["slot"], "start_time"))) & ~is_blank(when_of(s)))

    return _result(root, _events(F.filter(slots, usable), int_of), truthy)


# --- strict reading ------------------------------------------------------------------------

def _only_keys(fields: Column, allowed: list[str]) -> Column:
    known = F.array(*[F.lit(k) for k in allowed])
    return F.forall(F.map_keys(fields), lambda k: F.array_contains(known, k))


def coerced_bool(v: Column) -> Column:
    def read(x: Column) -> Column:
        word = F.regexp_replace(F.lower(F.coalesce(text_of(x), F.to_json(x))), r"^([01])\.0$", "$1")
        return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)
    return let(v, read)


def coerced_int(v: Column) -> Column:
    """Whole number, whole-valued fraction, boolean, or number text; null where no int can hold it."""
    def read(x: Column) -> Column:
        whole = F.regexp_extract(F.trim(F.coalesce(text_of(x), F.to_json(x))), r"^([+-]?\d+)(?:\.0*)?$", 1)
        return F.coalesce(int_of(x), F.when(whole != "", whole).try_cast("int"))
    return let(v, read)


def _text_or_missing(v: Column) -> Column:
    return is_missing(v) | text_of(v).isNotNull()


def _valid_slot(s: Column) -> Column:
    slot = s["slot"]
    unknown = F.filter(F.map_keys(slot), lambda k: ~k.isin(*SLOT_KEYS) & (k != s["when_key"]))
    page = get(slot, "page_number")
    ok = (slot.isNotNull() & (F.size(unknown) == 0) & (F.length(text_of(get(slot, "church_slug"))) > 0)
          & (F.length(text_of(get(slot, "start_time"))) > 0) & (F.length(when_of(s)) > 0)
          & _text_or_missing(get(slot, "end_time")) & _text_or_missing(get(slot, "note"))
          & (is_missing(page) | coerced_int(page).isNotNull()))
    return F.coalesce(ok, F.lit(False))


def is_valid(root: Column, slots: Column) -> Column:
    """Does the whole payload satisfy the schema (no extra keys, right types, required text)?"""
    names, sections = [b for b, _ in BUCKETS], F.array(*[F.lit(n) for n, _, _ in SECTIONS])

    def section_ok(name: Column) -> Column:
        v = F.try_element_at(root, name)
        lists = lambda m: F.forall(F.map_values(m), lambda x: F.try_variant_get(x, "$", "array<variant>").isNotNull())
        good = let(as_map(v), lambda m: m.isNotNull() & _only_keys(m, names) & lists(m))
        return v.isNull() | F.coalesce(good, F.lit(False))

    ok = _only_keys(root, ROOT_KEYS) & F.forall(sections, section_ok) & F.forall(slots, _valid_slot)
    for flag in ("church_list_needs_review", "wrong_bulletin"):
        v = get(root, flag)
        ok = ok & (v.isNull() | coerced_bool(v).isNotNull())
    return F.coalesce(ok & _text_or_missing(get(root, "published_date")), F.lit(False))


def strict_result(root: Column, slots: Column) -> Column:
    """Every slot of a payload that passed :func:`is_valid`."""
    return _result(root, _events(slots, coerced_int), coerced_bool)


def read_payload(text: Column, read) -> Column:
    """``read(root, slots)`` of a payload text, parsed once."""
    return let(parse_object(text), lambda root: let(slots_of(root), lambda slots: read(root, slots)))


def payload_reading(text: Column) -> Column:
    """Struct (valid, result): strict when the whole document is valid, lenient otherwise."""
    def read(root: Column, slots: Column) -> Column:
        return let(is_valid(root, slots), lambda valid: F.struct(
            valid.alias("valid"),
            F.when(valid, strict_result(root, slots)).otherwise(lenient_result(root, slots)).alias("result")))
    return read_payload(text, read)


def payload_result(text: Column) -> Column:
    """Payload text to result struct."""
    return payload_reading(text)["result"]


# --- flat results (what extractors return and the cache stores) ------------------------------

def guarded_result(text: Column) -> Column:
    """Flat result JSON (``events`` array and flags) to the typed result struct."""
    def plain(v: Column) -> Column:
        return F.coalesce(F.try_variant_get(v, "$", "string"), F.lit(""))

    def event(e: Column) -> Column:
        return F.struct(
            text_of(get(e, "church_slug")).alias("church_slug"), plain(get(e, "type")).alias("type"),
            plain(get(e, "kind")).alias("kind"), text_of(get(e, "day_of_week")).alias("day_of_week"),
            text_of(get(e, "date")).alias("date"), plain(get(e, "start_time")).alias("start_time"),
            text_of(get(e, "end_time")).alias("end_time"), truthy(get(e, "cancelled")).alias("cancelled"),
            int_of(get(e, "page_number")).alias("page_number"),
            blank_to_null(text_of(get(e, "note"))).alias("note"))

    def read(root: Column) -> Column:
        slots = F.filter(objects_of(get(root, "events")), lambda e: text_of(get(e, "church_slug")).isNotNull())
        return F.struct(
            F.transform(slots, event).cast(f"array<{EXTRACTED_EVENT}>").alias("events"),
            truthy(get(root, "church_list_needs_review")).alias("church_list_needs_review"),
            text_of(get(root, "published_date")).alias("published_date"),
            truthy(get(root, "wrong_bulletin")).alias("wrong_bulletin")).cast(RESULT)

    return let(parse_object(text), read)


# --- verification ----------------------------------------------------------------------------

def verification_result(text: Column) -> Column:
    """Verification payload to typed arrays, dropping unusable entries."""
    def address(v: Column) -> Column:
        return let(as_map(v), lambda m: F.when(m.isNotNull(), F.struct(*[
            text_of(get(m, k)).alias(k) for k in ("line1", "line2", "city", "state", "postal_code")])))

    def verdict(v: Column) -> Column:
        return let(text_of(v), lambda word: F.when(word.isin(*VERDICTS), word).otherwise("unverifiable"))

    def existing(c: Column) -> Column:
        name, addr = verdict(get(c, "name_status")), verdict(get(c, "address_status"))
        return F.struct(
            text_of(get(c, "church_slug")).alias("church_slug"),
            name.alias("name_status"), addr.alias("address_status"),
            F.when(name == "incorrect", text_of(get(c, "corrected_name"))).alias("corrected_name"),
            F.when(addr == "incorrect", address(get(c, "corrected_address"))).alias("corrected_address"),
            truthy(get(c, "slug_needs_review")).alias("slug_needs_review"))

    def new_church(c: Column) -> Column:
        return F.struct(text_of(get(c, "name")).alias("name"), text_of(get(c, "slug")).alias("slug"),
                        address(get(c, "address")).alias("address"))

    def named(c: Column, key: str) -> Column:
        return c.isNotNull() & ~is_blank(text_of(get(c, key)))

    def read(root: Column) -> Column:
        old = F.filter(objects_of(get(root, "existing_churches")), _fixed(named, "church_slug"))
        new = F.filter(objects_of(get(root, "new_churches")), _fixed(named, "name"))
        return F.struct(F.transform(old, existing).alias("existing_churches"),
                        F.transform(new, new_church).alias("new_churches")).cast(VERIFICATION)

    return let(parse_object(text), read)
