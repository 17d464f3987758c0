"""Summaries and traces as text; every claim is followed by its citations."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from evidentry.functions.texts import SPACE
from evidentry.operators.provenance import CITE_KEYS, harvest


def _claims(value: Any) -> Iterable[Mapping]:
    if isinstance(value, Mapping):
        yield value
    elif isinstance(value, list):
        yield from value


def _cites(claim: Mapping) -> list[str]:
    found = claim.get("cites") or [c for k in CITE_KEYS for c in ([claim[k]] if isinstance(claim.get(k), str) else claim.get(k) or [])]
    return list(dict.fromkeys(found))


def markdown(summary: Mapping[str, Any]) -> str:
    """A section for each field of claims (objects with text and cites), in the summary's order."""
    out = []
    for name, value in summary.items():
        claims = [c for c in _claims(value) if "text" in c]
        if claims:
            out.append("## " + name.replace("_", " ").capitalize())
            out += [f"- {c['text'].strip(SPACE)} " + " ".join(f"[{x}]" for x in _cites(c)) for c in claims]
            out.append("")
    return "\n".join(out).rstrip() + "\n"


def packed_cites(cites: list[str], limit: int) -> tuple[str, int]:
    """Whole citations that fit in ``limit`` characters, in order, and how many had no room; a shorter one may fit after a longer one didn't."""
    kept: list[str] = []
    room = limit
    for cite in cites:
        size = len(cite) + bool(kept)
        if size <= room:
            kept.append(cite)
            room -= size
    return " ".join(kept), len(cites) - len(kept)


def trace(events: list[Mapping[str, Any]], summary_cites: list[str], payloads: bool = False) -> str:
    """Numbered events, then each cited citation with the first event that captured it."""
    first: dict[str, int] = {}
    lines = []
    for number, event in enumerate(events, 1):
        for cite in harvest(event.get("result", {})):
            first.setdefault(cite, number)
        lines.append(f"{number}. {event.get('kind')} {event.get('tool', '')}".rstrip() + (f" {event.get('result')}" if payloads else ""))
    lines += [f"{cite} <- {first[cite] if cite in first else 'MISSING FROM TRACE'}" for cite in summary_cites]
    return "\n".join(lines)
