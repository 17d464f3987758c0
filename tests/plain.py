"""Plain re-statements that columns are tested against."""

from __future__ import annotations

import json
import re
from datetime import UTC, datetime, timedelta

from evidentry.functions.texts import MASKS
from evidentry.sources import formats, records

_ANY = re.compile("|".join(f"(?P<{name}>{pattern})" for name, pattern in MASKS))
_PLACEHOLDER = re.compile("<(" + "|".join(name for name, _ in MASKS) + ")>")


def mask_text(message: str) -> str:
    apart = _PLACEHOLDER.sub(r"<ESC\1>", message)
    return re.sub(r"\s+", " ", _ANY.sub(lambda m: f"<{m.lastgroup}>", apart)).strip()


def iso(text: str) -> datetime:
    """Python's reading of ISO 8601, without its leniency for one odd character before the zone or at the end."""
    time = datetime.fromisoformat(text)
    clock = text[11 if text[4] == "-" else 9 :]
    if clock and not re.fullmatch(r"\d\d(:\d\d(:\d\d)?|\d\d(\d\d)?)?([.,]\d+)?(Z|[+-]\d\d(:?\d\d(:?\d\d(\.\d+)?)?)?)?", clock):
        raise ValueError(text)
    return time


def json_line(line: str) -> dict | None:
    """What a JSON line holds, or its reason; no NaN and no infinities."""

    def refuse(name: str):
        raise ValueError(name)

    try:
        value = json.loads(line, parse_constant=refuse)
    except (ValueError, RecursionError):
        return {"reason": "unparseable"}
    if not isinstance(value, dict) or not isinstance(value.get("msg"), str):
        return {"reason": "unparseable"}
    try:
        time = iso(value["ts"]) if isinstance(value.get("ts"), str) else None
    except ValueError:
        time = None
    if time is None:
        return {"reason": "no_timestamp"}
    attrs = {k: v for k, v in value.items() if k not in formats.CONSUMED}
    dropped = []
    if "duration_ms" in value:
        if type(value["duration_ms"]) in (int, float):
            attrs["duration_ms"] = value["duration_ms"]
        else:
            dropped.append("duration_ms")
    status = value.get("status")
    code = status if type(status) is int else int(status) if isinstance(status, str) and re.fullmatch("[0-9]+", status) else None
    if code is None and status is not None:
        dropped.append("status")
    if dropped:
        attrs["coercion_dropped"] = dropped
    text = lambda k: value[k] if isinstance(value.get(k), str) else None
    utc = time if time.tzinfo else time.replace(tzinfo=UTC)
    micros = (utc - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(microseconds=1)
    return {"reason": None, "micros": micros, "naive": time.tzinfo is None, "service": text("service"), "level": text("level"), "status": code if code is None or abs(code) < 1 << 31 else None, "trace_id": text("trace_id"), "message": text("msg"), "attrs": attrs}


def parse_traceback(lines: list[str], cut_by_header: bool, roots: tuple[str, ...] = ()) -> dict:
    """One record from all its lines: where each traceback begins and ends is looked up, nothing is carried."""
    head = re.match(records.HEADER, lines[0])
    if head is None:
        return records.record(reason="unparseable")
    # Where each traceback begins and where its exception stands; what lies between has the frames.
    first = lambda at, holds: next((i for i in range(at, len(lines)) if holds(lines[i])), None)
    raised = lambda line: line[:1] not in (" ", "\t") and not re.match(records.FRAME, line) and re.match(records.EXCEPTION, line)
    frames, exception, detail = [], None, []
    begins, ends = first(1, records.START.__eq__), None
    while begins is not None:
        ends = first(begins + 1, raised)
        found = [re.match(records.FRAME, line) for line in lines[begins + 1 : ends]]
        frames += [{"file": m[1], "line": int(m[2]), "func": m[3] or "<module>"} for m in found if m]
        if ends is None:
            break
        begins = first(ends + 1, records.CHAINED.__contains__)
        named = re.match(records.EXCEPTION, lines[ends])
        exception, detail = named[1], [named[2] or "", *lines[ends + 1 : begins]]
    unfinished = begins is not None
    if unfinished and not cut_by_header:
        return records.record(reason="incomplete_traceback")
    attrs: dict = {"logger": head[4]}
    if unfinished:
        attrs["assembly"] = "incomplete"
    message = head[5]
    if exception is not None:
        attrs["exc_type"] = exception
        rest = "\n".join(detail).strip()
        message = f"{exception}: {rest}" if rest else exception
    if frames:
        attrs["stack"] = frames
        own = [f for f in frames if not f["file"].startswith(roots)] if roots else frames
        if own:
            attrs["top_frame"] = own[-1]
    try:
        time = datetime.strptime(head[1], "%Y-%m-%d %H:%M:%S,%f")
    except ValueError:
        return records.record(reason="no_timestamp")
    return records.record(micros=records.micros_of(time), naive=True, service=head[3], level=head[2], message=message, attrs=json.dumps(attrs, ensure_ascii=False))
