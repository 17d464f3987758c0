"""Properties that hold for any text or time."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evidentry.functions import texts, times
from evidentry.operators.provenance import harvest
from evidentry.plans.render import packed_cites
from evidentry.sources import formats, k8s, postmortems, records
from tests.plain import mask_text


@given(st.text())
def test_masking_is_stable_in_space(message):
    masked = mask_text(message)
    assert masked == " ".join(masked.split()) or not masked.isascii()
    assert mask_text("  " + message + "\n") == masked


@given(st.datetimes(datetime(2000, 1, 1), datetime(2030, 1, 1)), st.integers(1, 10**10))
def test_windows_cover_and_adjoin(start, micros):
    window = times.resolve_window(start, start + timedelta(microseconds=micros))
    assert window.start <= start and window.end >= start + timedelta(microseconds=micros)
    assert window.before().end == window.start and window.before().end - window.before().start == window.end - window.start
    assert window.snapped == ((window.start, window.end) != (start, start + timedelta(microseconds=micros)))


@given(st.lists(st.text("ab:/", min_size=1, max_size=8)), st.integers(0, 40))
def test_citations_are_never_cut(cites, limit):
    text, left = packed_cites(cites, limit)
    shown = text.split(" ") if text else []
    assert len(text) <= limit and len(shown) == len(cites) - left
    rest = iter(cites)
    assert all(c in rest for c in shown)  # in their order
    used = list(cites)
    for c in shown:
        used.remove(c)
    room = limit - len(text) - bool(shown)
    assert all(len(c) > room for c in used)  # what is left out has no room


@given(st.text(alphabet=st.characters(blacklist_categories=["Cs"])))
@settings(max_examples=200)
def test_parsers_take_any_line(line):
    for parse in (formats.parse_logfmt_line, lambda x: records.parse_traceback([x], False)):
        record = parse(line)
        assert (record["reason"] is None) == (record["message"] is not None)


@given(st.lists(st.dictionaries(st.text(max_size=3), st.text(max_size=5)), max_size=5), st.sampled_from([None, 0, 2]), st.booleans())
def test_items_keep_their_bytes(items, indent, wrapped):
    import json

    text = json.dumps({"kind": "List", "items": items} if wrapped else items, indent=indent, ensure_ascii=False)
    found = list(k8s.array_items(text))
    assert [json.loads(raw) for _, raw in found] == items
    assert all(text.encode()[at:].startswith(raw.encode()) for at, raw in found)


def test_chunks_keep_every_word(spark):
    rng = random.Random(9)
    rows = []
    for _ in range(120):
        paragraphs = ["".join(rng.choice("ab \n") for _ in range(rng.randint(0, 20))) for _ in range(rng.randint(0, 6))]
        rows.append(("\n\n".join(["## One", *paragraphs, "## Two", *paragraphs]), rng.randint(1, 5)))
    for body, cap, chunks in spark.createDataFrame(rows, "body string, cap int").select("body", "cap", postmortems.chunks_of(F.col("body"), F.col("cap")).alias("c")).collect():
        assert " ".join(c.content for c in chunks).split() == body.split()
        assert all(len(c.content.split()) <= cap or "\n\n" not in c.content.strip() for c in chunks)


def test_harvest_goes_deep():
    assert sorted(harvest({"a": [{"cite": "x"}, {"b": {"source_cites": ["y", "z"], "resolution_cite": None}}]})) == ["x", "y", "z"]
