import json

from belfry.functions import payload

SLOT = {"church_slug": "c", "day_of_week": "Monday", "start_time": "8:00 AM"}


def weekly(*slots, **rest):
    return json.dumps({"weekly_schedule": {"masses": list(slots)}, **rest})


def test_sections_in_order(apply):
    dated = {"church_slug": "c", "date": "2026-01-01", "start_time": "9:00 AM", "note": " n "}
    text = json.dumps({"cancellations": {"confessions": [dated]}, "single_events": {"adorations": [dated]}, "weekly_schedule": {"masses": [SLOT]}})
    events = apply(payload.payload_result, text)[0]["events"]
    assert [(e["type"], e["kind"], e["cancelled"]) for e in events] == [
        ("mass", "weekly", False), ("adoration", "specific_date", False), ("confession", "specific_date", True)]
    assert events[1]["note"] == "n" and events[0]["date"] is None and events[1]["day_of_week"] is None


def test_strict_keeps_what_lenient_drops(apply):
    blank = {**SLOT, "church_slug": " "}
    valid, extra = apply(payload.payload_result, weekly(SLOT, blank), weekly(SLOT, blank, comment="x"))
    assert len(valid["events"]) == 2 and len(extra["events"]) == 1


def test_invalid_documents_fall_back_as_a_whole(apply):
    good = {**SLOT, "page_number": "3"}
    strict, lenient = apply(payload.payload_result, weekly(good), weekly(good, 5))
    assert strict["events"][0]["page_number"] == 3
    assert len(lenient["events"]) == 1 and lenient["events"][0]["page_number"] is None


def test_lenient_type_guards(apply):
    slots = [{**SLOT, "page_number": True, "end_time": 5}, {**SLOT, "church_slug": 7}, {**SLOT, "start_time": None}, "text"]
    events = apply(payload.payload_result, weekly(*slots, extra=1))[0]["events"]
    assert len(events) == 1 and events[0]["page_number"] == 1 and events[0]["end_time"] is None


def test_flags_and_dates(apply):
    rows = apply(payload.payload_result, weekly(wrong_bulletin="yes", published_date=" 2026-99-99 "),
                 weekly(wrong_bulletin=[], church_list_needs_review="no", published_date="May 1"), weekly(published_date=5, church_list_needs_review=1))
    assert rows[0]["wrong_bulletin"] and rows[0]["published_date"] == "2026-99-99"
    assert not rows[1]["wrong_bulletin"] and rows[1]["church_list_needs_review"] and rows[1]["published_date"] is None
    assert rows[2]["church_list_needs_review"] and rows[2]["published_date"] is None


def test_bad_json_is_an_empty_result(apply):
    for row in apply(payload.payload_result, "no", "[1]", '"x"', "", None):
        assert row["events"] == [] and not row["wrong_bulletin"]


def test_null_section_is_not_valid_but_is_read(apply):
    row = apply(payload.payload_reading, json.dumps({"weekly_schedule": None, "single_events": {"masses": []}}))[0]
    assert not row["valid"] and row["result"]["events"] == []


def test_flat_result_guards(apply):
    text = json.dumps({"events": [{"church_slug": "c", "start_time": 5, "page_number": 2.5, "cancelled": 1, "note": "  "}, {"church_slug": 5}, 3],
                       "published_date": 7, "wrong_bulletin": 0})
    row = apply(payload.guarded_result, text)[0]
    assert len(row["events"]) == 1 and row["events"][0]["start_time"] == "5" and row["events"][0]["cancelled"]
    assert row["events"][0]["page_number"] is None and row["published_date"] is None and not row["wrong_bulletin"]


def test_verification(apply):
    text = json.dumps({"existing_churches": [
        {"church_slug": "a", "name_status": "maybe", "address_status": "incorrect", "corrected_name": "N", "corrected_address": {"line1": "1 A"}},
        {"church_slug": "b", "name_status": "incorrect", "address_status": "verified", "corrected_name": 5, "corrected_address": {"line1": "x"}},
        {"church_slug": " "}, 4], "new_churches": [{"name": "New", "slug": 3, "address": "text"}, {"name": " "}]})
    row = apply(payload.verification_result, text)[0]
    a, b = row["existing_churches"]
    assert (a["name_status"], a["corrected_name"], a["corrected_address"]["line1"]) == ("unverifiable", None, "1 A")
    assert (b["corrected_name"], b["corrected_address"]) == (None, None)
    assert [tuple(n) for n in row["new_churches"]] == [("New", None, None)]
