from __future__ import annotations

import random
import unicodedata
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from evidentry.functions import citations, identity, jsondiff, texts, times, vectors
from evidentry.plans.catalog import QUERIES
from tests.plain import mask_text


@pytest.mark.parametrize(
    ("message", "masked"),
    [
        ("database pool exhausted waiting 5000ms", "database pool exhausted waiting <DUR>"),
        ("GET /assets/app.js", "GET <PATH>"),
        ("at 2026-08-19T14:03:22.5Z from 10.0.0.1:80", "at <TS> from <IP>"),
        ("see https://a.b/c?d=1 or mail x.y@z.org", "see <URL> or mail <EMAIL>"),
        ("id 0f8fad5b-d9cb-469f-a165-70867728950e hex deadbeef 12345678", "id <UUID> hex <HEX> <NUM>"),
        ('user "a \\" b" took -3.5s  and 2GiB', "user <STR> took <DUR> and <SIZE>"),
        ("literal <NUM> and 7", "literal <ESCNUM> and <NUM>"),
        ("db-1.local:5432 refused", "<HOSTPORT> refused"),
        ("", ""),
    ],
)
def test_mask(message, masked):
    assert mask_text(message) == masked


def test_template_hashes(spark):
    #: Hashes that other implementations of the same templates give.
    known = {
        "database pool exhausted waiting 5000ms": "9455b8328bc5a51548dd7a2edad17080",
        "GET /assets/app.js": "fdf40384d296484f64dc229bd0514234",
        "POST /oauth/token/refresh": "2a88ec5ee0ba190adbba9d4f7db6e357",
        "OOMKilled: container indexer terminated (exit 137)": "5f59483a953816866882d521e3b28390",
    }
    rows = spark.createDataFrame([(m,) for m in [*known, None]], "m string")
    found = {r.m: r.h for r in rows.select("m", texts.template_hash(texts.mask("m")).alias("h")).collect()}
    assert found == known | {None: None}


def test_levels_and_statuses(spark):
    rows = spark.createDataFrame([("WARN", 200), (" Crit ", None), ("odd", 503), ("", 503), (None, 404), (None, 99), (None, 600), (None, None)], "l string, c int")
    found = rows.select(texts.canonical_level(F.col("l"), F.col("c")).alias("l"), texts.status_class(F.col("c")).alias("c")).collect()
    assert [tuple(r) for r in found] == [("warning", "2xx"), ("fatal", "none"), ("info", "5xx"), ("error", "5xx"), ("warning", "4xx"), ("info", "none"), ("info", "none"), ("info", "none")]


def test_text_forms(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first().x
    assert get(texts.normalize_raw(F.lit("é x\r\n"))) == "é x"
    assert get(texts.normalize_raw(F.lit("a\n\n"))) == "a\n"
    assert get(texts.repository(F.lit("Org/Name.git"))) == "org/name"
    assert get(texts.repository(F.lit("a/b/c"))) is None
    assert get(texts.component(F.lit("svc.a_b@1-x"))) == "svc.a_b@1-x"
    assert get(texts.component(F.lit("a b"))) is None
    assert get(texts.source_path(F.lit("logs\\a.log"))) == "logs/a.log"
    for bad in ("/a", "", "../a", "a/../b", "."):
        assert get(texts.source_path(F.lit(bad))) is None
    assert get(texts.snippet(F.lit("word " * 200))) == ("word " * 99 + "word")
    assert get(texts.truncate(F.lit("abcdef"), 4)) == "abc…"
    assert get(texts.sha40(F.lit("a" * 40))) == "a" * 40
    assert get(texts.redact_url(F.lit("postgresql://u:p@h/db"))) == "postgresql://u:***@h/db"


def test_windows():
    at = lambda *a: datetime(2026, 8, 19, *a, tzinfo=UTC)
    w = times.resolve_window(at(14, 0, 20), at(14, 5))
    assert (w.start, w.end, w.snapped) == (at(14, 0), at(14, 5), True)
    assert times.resolve_window(at(14, 0), at(14, 4, 1)).end == at(14, 5)
    assert w.before() == times.Window(at(13, 55), at(14, 0))
    assert w.contains(at(14, 4, 59)) and not w.contains(at(14, 5))
    assert w.widened(60).start == at(13, 0)
    with pytest.raises(ValueError):
        times.resolve_window(at(14, 0), at(14, 0))


def test_zone_attachment(spark):
    zone = ZoneInfo("America/New_York")
    for r in QUERIES["dst_attach"](spark, "").collect():
        there = lambda fold: r.local.replace(tzinfo=zone, fold=fold).astimezone(UTC)  # noqa: E731, B023
        back = [there(f).astimezone(zone).replace(tzinfo=None) == r.local for f in (0, 1)]
        assert r.instant == there(0).replace(tzinfo=None), r
        assert r.tz_nonexistent == (not any(back)) and r.tz_ambiguous == (all(back) and there(0) != there(1)), r
    five = spark.createDataFrame([(datetime(2026, 1, 1, 10, 59, 59),)], "t timestamp_ntz").select(times.bucket(F.col("t"), 5).alias("b")).first().b
    assert str(five).startswith("2026-01-01 10:55:00")


def test_identities(spark):
    raw = 'a "quoted" \\ line\twith\x01control é\x1f'
    row = spark.createDataFrame([("logs/a.log", 7, raw)], "f string, o long, r string")
    found = row.select(identity.log_uid(F.col("f"), F.col("o"), F.col("r")).alias("u")).first().u
    assert found == identity.python_uid("log", file="logs/a.log", offset=7, raw=raw)
    when = F.lit("2026-08-19 14:03:22.5").cast("timestamp")
    get = lambda c: spark.range(1).select(c.alias("x")).first().x
    wire = "2026-08-19T14:03:22.500000Z"
    assert get(identity.deployment_uid(F.lit("a" * 40), F.lit("prod"), when)) == identity.python_uid("deploy", commit_sha="a" * 40, environment="prod", started_at=wire)
    assert get(identity.k8s_event_uid(F.lit("e"), F.lit(7), when)) == identity.python_uid("k8s-event", event_uid="e", count=7, last_timestamp=wire)
    assert get(identity.k8s_pod_uid(F.lit("p"), F.lit("c"), F.lit(2), when)) == identity.python_uid("k8s-pod", pod_uid="p", container="c", restart_count=2, finished_at=wire)
    assert identity.python_uid("x", a=None) != identity.python_uid("x", a="") != identity.python_uid("x", a=1)


def test_citations(spark):
    good = ["commit:" + "a" * 40, "deploy:" + "b" * 32, "infra:" + "c" * 32, "log:" + "d" * 32, "rollup:svc/2026-08-19T14:03:00Z/5xx/error/" + "e" * 32, "postmortem:pool.a@01234567#0"]
    bad = ["commit:" + "A" * 40, "log:x", "nope", "other:1", "rollup:svc/2026-13-19T14:03:00Z/5xx/error/x", "rollup:a/b", "postmortem:a@b@01234567#1", "postmortem:a@01234567#01", "log:" + "d" * 32 + "\n", None]
    rows = spark.createDataFrame([(c,) for c in good + bad], "c string").select(citations.well_formed(F.col("c")).alias("ok"), citations.components(F.col("c")).alias("parts")).collect()
    assert [r.ok for r in rows] == [True] * len(good) + [False] * len(bad)
    assert rows[4].parts == ["svc", "2026-08-19T14:03:00Z", "5xx", "error", "e" * 32] and rows[5].parts == ["pool.a", "01234567", "0"]


def test_diffs():
    assert jsondiff.changed({"a": 1, "b": {"c": 2}}, {"a": 1, "b": {"c": 3}, "d": None}, {}, {}) == {"b": {"c": {"before": 2, "after": 3}}}
    assert jsondiff.changed({"k": "x"}, {"k": "x"}, {}, {"k": True}) == {"k": jsondiff.HIDDEN}
    assert jsondiff.changed({"k": [1]}, {"k": [1]}, {}, {"k": [True]}) == {}
    assert jsondiff.changed({"k": [1]}, {"k": [2]}, {}, {"k": [{"x": True}]}) == {"k": jsondiff.HIDDEN}
    assert jsondiff.changed({"k": 1}, {}, {"k": True}, {}) == {}
    assert jsondiff.changed({"k": 1}, {}, {"k": True}, {"k": True}) == {"k": jsondiff.HIDDEN}
    assert jsondiff.changed({"k": [1, 2]}, {"k": [2, 1]}, {}, {}) == {"k": {"before": [1, 2], "after": [2, 1]}}
    assert jsondiff.marks({"a": [False]}, {"a": [False, True], "b": True}) == {("a", 1), ("b",)}
    assert jsondiff.marks({"a": [False]}, {"a": {"c": True}}) == set()
    assert jsondiff.changed({"a": {"b": 1}}, {"a": None}, {}, {}) == {"a": {"b": {"before": 1, "after": None}}}
    assert jsondiff.changed({"a": {"b": 1}}, {"a": [1]}, {}, {}) == {"a": {"before": {"b": 1}, "after": [1]}}
    assert jsondiff.changed({"a": {"b": {"c": 1}}}, {"a": 5}, {}, {"a": {"b": True}}) == {"a": {"b": jsondiff.HIDDEN}}
    assert jsondiff.changed({"a": {}}, {"a": {}}, {}, {"a": True}) == {"a": jsondiff.HIDDEN}
    assert jsondiff.changed({"a": {"b": 1, "c": 2}}, {"a": {"b": 2, "c": 3}}, {"a": {"b": True}}, {}, {"a": {"c": True}}) == {"a": {"c": jsondiff.HIDDEN}}
    assert jsondiff.changed({"k": 1}, {"k": 2}, {}, True) == jsondiff.HIDDEN
    with pytest.raises(ValueError):
        jsondiff.sorted_json({1: 2})


def test_vectors(spark):
    row = spark.createDataFrame([([0.6, 0.8], [1.0, 0.0])], "a array<float>, b array<float>")
    r = row.select(vectors.cosine_distance(F.col("a"), F.col("b")).alias("d"), vectors.valid(F.col("a"), 2).alias("v"), vectors.valid(F.col("a"), 3).alias("w")).first()
    assert abs(r.d - 0.4) < 1e-6 and r.v and not r.w
    assert timedelta(0) == timedelta()


def test_masks_of_columns_are_the_plain_ones(spark):
    rng = random.Random(3)
    parts = ["a", "é", "_", "0x", "1", "23", "deadbeef", "12345678", ".", ":", "-", "/", "//", "://", "http", "@", "b.c", "10.0.0.1", "2026-08-19T14:03:22", "Z", "+02:00", ",5", "550e8400-e29b-41d4-a716-446655440000"]
    parts += ['"', "'", "\\", "\n", " ", "  ", " ", "\t", "ms", "µs", "s", "GiB", "KB", "<NUM>", "<", "[", "]", "fe80::1", "²", "٣", "日本", "x.y:80", "́", "\x1f", "½"]
    texts_ = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(8000)]
    texts_ += ["a" * 200_000, "1 " * 50_000, "/a" * 50_000, "a.b:" * 30_000, '"' + "x\\\\" * 30_000 + '"', '"' * 20_001, None, ""]
    rows = spark.createDataFrame(list(enumerate(texts_)), "i int, m string")
    for r in rows.select("i", texts.mask("m").alias("t")).collect():
        m = texts_[r.i]
        assert r.t == (mask_text(m) if m is not None else None), m[:300]


def test_normal_form_of_texts_below_and_above_the_first_mark(spark):
    given = ["", "plain", "é ß", "é", "가", "Ω", "日本 é", None, "˿", "à"]
    rows = spark.createDataFrame([(t,) for t in given], "t string")
    assert [r.n for r in rows.select(texts.nfc(F.col("t")).alias("n")).collect()] == [t if t is None else unicodedata.normalize("NFC", t) for t in given]
    assert all(unicodedata.is_normalized("NFC", a + b) for a in map(chr, range(0x300)) for b in map(chr, range(0x300)))
