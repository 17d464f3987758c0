"""Personal data: fixed patterns, and more of it by bootstrapped contextual extraction.

Emails, addresses, cards and phone numbers that the fixed patterns find are the seeds. The
words around a seed are lexical patterns. Patterns and the identifier-like tokens that they
enclose form a bipartite graph of distinct (pattern, value) edges, so copies of a text add
nothing. Spark scores both sides in turn: a pattern by its values known for a kind against those
known for another or unfit for it (unknown ones hardly count, as they are what is looked for), a
value by what its patterns say together; values above the threshold are known in the next round.
Patterns of high confidence then mark unseen identifiers in all texts.
"""

from __future__ import annotations

import logging
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentry.llm.columns import pieces, unused
from evidentry.session import discard, materialize

_LOG = logging.getLogger(__name__)

#: The kinds, in their order.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9][0-9 .()-]*")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_MARK = re.compile(r"[0-9@]")
_REST = re.compile(r"\S*")
_TRIM = " \t\r\n.,;:!?\"'()[]{}<>*%$#&"
_EDGE = frozenset(_TRIM + "+-") - frozenset(" \t\r\n")
_JOIN = " .()-"
_WORD = re.compile(r"\S+")
#: A longer context word is read as one that has this length at least, whatever its characters.
LONG_WORD = 100


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start: leftmost matches that don't overlap within a kind, failing ones dropped."""
    emails, ips, cards, phones = [], [], [], []
    at, floor = text.find("@"), 0
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            emails.append(("email", start, m.end()))
        floor = m.end() if m else at + 1
        at = text.find("@", floor)
    for run in _DIGITS.finditer(text):
        low, high = run.span()
        if high - low < 7:
            continue
        for m in _IP.finditer(text, low, high):
            if all(len(p) <= 9 and int(p) <= 255 or not p.lstrip("0") or int(p.lstrip("0")[:4]) <= 255 and len(p.lstrip("0")) <= 3 for p in m.groups()):
                ips.append(("ip", *m.span()))
        if high - low >= 16:
            for m in _CARD.finditer(text, low, high):
                digits = m.group().replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and _luhn(digits):
                    cards.append(("card", *m.span()))
    at = text.find("+")
    while at >= 0:
        m = _PHONE.match(text, at)
        if m and 8 <= sum(c.isdigit() for c in m.group()) <= 15:
            phones.append(("phone", *m.span()))
        at = text.find("+", m.end() if m else at + 1)
    return emails + ips + cards + phones


def _shape(value: str) -> str | None:
    """The kinds a token may be taken for: one with an at sign, dotted numbers, or long numbers."""
    digits = sum(c.isdigit() for c in value)
    if "@" in value.strip("@"):
        return "email"
    if digits >= 4 and value.count(".") >= 3 and not any(c.isalpha() for c in value):
        return "ip"
    if digits >= 7 and not any(c.isalpha() for c in value):
        return "number"
    return None


def _number_runs(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(start, end) of the maximal runs of digit groups joined by spaces, dots, hyphens and brackets, of 7 digits at least.

    A run ends at a base span (``taken``, sorted) and leaves out groups that are part of a word.
    """
    out, i = [], 0
    for run in _DIGITS.finditer(text):
        low, high = run.span()
        if high - low < 7:
            continue
        while i < len(taken) and taken[i][1] <= low:
            i += 1
        k, parts, floor = i, [], taken[i - 1][1] if i else 0
        while k < len(taken) and taken[k][0] < high:
            parts.append((floor, low, taken[k][0]))
            low = floor = max(low, taken[k][1])
            k += 1
        for floor, start, end in [*parts, (floor, low, high)]:
            while start < end and not text[start].isdigit():
                start += 1
            while end > start and not text[end - 1].isdigit():
                end -= 1
            at = start
            while at and text[at - 1] in _EDGE:
                at -= 1
            if at and not text[at - 1].isspace():  # the first group goes on in a word
                start = text.find(" ", start, end)
                start = end if start < 0 else start
            at = end
            while at < len(text) and text[at] in _EDGE:
                at += 1
            if at < len(text) and not text[at].isspace():  # so does the last one
                end = max(start, text.rfind(" ", start, end))
            while start < end and text[start] in _JOIN:
                start += 1
            while end > start and text[end - 1] in _JOIN:
                end -= 1
            if sum(c.isdigit() for c in text[start:end]) < 7:
                continue
            inside = text[start:end]
            if start > floor and text[start - 1] == "(" and inside.count(")") > inside.count("("):
                start -= 1
            if start > floor and text[start - 1] == "+":
                start -= 1
            out.append((start, end))
    return out


def _tokens(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of each run without blanks that has a digit or an at sign, in time that is linear in the text."""
    end = 0
    while m := _MARK.search(text, end):
        start = m.start()
        while start > end and not text[start - 1].isspace():
            start -= 1
        end = _REST.match(text, m.end()).end()
        yield start, end


def _may_be(shape: str, value: str) -> int:
    """The kinds that a token without a base span may be, as bits in the order of the kinds.

    A card has 12 to 19 digits, and where 16 or more its check digit fits; a phone number has 7 to
    16; an address of four numbers up to 255 is a base span already.
    """
    if shape == "email":
        return 1
    if shape == "ip":
        return 0
    digits = "".join(filter(str.isdecimal, value))
    card = 12 <= len(digits) <= 19 and digits.isascii() and (len(digits) < 16 or _luhn(digits))
    return 4 * card + 8 * (7 <= len(digits) <= 16)


def _read(word: str) -> str:
    if len(word) > LONG_WORD:
        return "~"
    word = word.lower()
    return "#" if _MARK.search(word) else word.strip(_TRIM) or word


class _Contexts:
    """The words around spans of one text, found near them, or in a table of all words where they are farther off."""

    def __init__(self, text: str, near: int = 240):
        self.text, self.near, self.words = text, near, None

    def _far(self, start: int, end: int) -> tuple[list[str], list[str]]:
        if self.words is None:
            spans = [m.span() for m in _WORD.finditer(self.text)]
            self.words = [s for s, _ in spans], [e for _, e in spans]
        starts, ends = self.words
        cut = lambda s, e: self.text[s : min(e, s + LONG_WORD + 1)]  # noqa: E731  as much as tells a long word
        last, after = bisect_left(starts, start), bisect_right(ends, end)
        lead = [cut(starts[i], min(ends[i], start)) for i in range(max(0, last - 2), last)]
        return lead, [cut(max(starts[after], end), ends[after])] if after < len(ends) else []

    def _around(self, start: int, end: int) -> tuple[list[str], list[str]]:
        text, low, high = self.text, max(0, start - self.near), min(len(self.text), end + self.near)
        lead, tail = text[low:start].split(), text[end:high].split(None, 1)
        # The first word of a window is whole only at the text's beginning; the last one only if something follows it.
        if low and len(lead) < 3 or high < len(text) and len(tail) < 2:
            return self._far(start, end)
        return lead[-2:], tail[:1]

    def patterns(self, start: int, end: int) -> list[str]:
        """Lexical patterns around a span: the two words before, and one word on either side.

        Words with digits read as "#", those of more than ``LONG_WORD`` characters as "~". What
        stands between a span and the blank before or after it is a word.
        """
        lead, tail = (list(map(_read, words)) for words in self._around(start, end))
        out = []
        if len(lead) == 2:
            out.append(f"{lead[0]} {lead[1]} _")
        if lead and tail:
            out.append(f"{lead[-1]} _ {tail[0]}")
        return out


_SPAN = "struct<kind:string,start:int,end:int>"
_FOUND = f"row long, doc_id long, text_hash long, base array<{_SPAN}>, seen array<struct<kind:string,shape:string,value:string,may:int,start:int,end:int,patterns:array<string>>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, text_hash, base, seen): each text's spans, and its identifier-like tokens and runs of numbers with the patterns around them (kind null outside spans)."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    token = pa.struct([("kind", pa.string()), ("shape", pa.string()), ("value", pa.string()), ("may", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("patterns", pa.list_(pa.string()))])

    def tokens(text: str, base: list) -> list[dict]:
        around = _Contexts(text)

        def told(kind: str | None, shape: str, start: int, end: int) -> dict:
            value = text[start:end].lower()
            may = 1 << KINDS.index(kind) if kind else _may_be(shape, value)
            return {"kind": kind, "shape": shape, "value": value, "may": may, "start": start, "end": end, "patterns": around.patterns(start, end)}

        out = [told(k, k if k in ("email", "ip") else "number", s, e) for k, s, e in base]
        taken = sorted((s, e) for _, s, e in base)
        runs = _number_runs(text, taken)
        out += [told(None, "number", s, e) for s, e in runs]
        i = j = 0
        for low, high in _tokens(text):
            raw = text[low:high]
            value = raw.strip(_TRIM)
            shape = _shape(value)
            if shape is None:
                continue
            start = low + len(raw) - len(raw.lstrip(_TRIM))
            end = start + len(value)
            while i < len(taken) and taken[i][1] <= start:
                i += 1
            while j < len(runs) and runs[j][1] <= start:
                j += 1
            if shape == "number" and j < len(runs) and low <= runs[j][0] <= start and end <= runs[j][1] <= high:
                continue  # the run is this token
            if not any(s < end and start < e for s, e in taken[i : i + 4]):
                out.append(told(None, shape, start, end))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for batch in pieces(batches):
            base, seen = [], []
            for text in batch.column(1).to_pylist():
                found = base_spans(text) if text else []
                base.append([{"kind": k, "start": s, "end": e} for k, s, e in found])
                seen.append(tokens(text, found) if text else [])
            rows = pa.array(range(row, row + batch.num_rows), pa.int64())
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays([rows, batch.column(0), batch.column(2), pa.array(base, pa.list_(span)), pa.array(seen, pa.list_(token))], ["row", "doc_id", "text_hash", "base", "seen"])

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    return plain.mapInArrow(run, _FOUND)


def _fits(kind: str) -> Column:
    """Whether the token's bits ``may`` have the kind that the column names."""
    bit = reduce(lambda rest, k: F.when(F.col(kind) == KINDS[k], 1 << k).otherwise(rest), range(len(KINDS)), F.lit(0))
    return F.col("may").bitwiseAND(bit) != 0


def confident_patterns(
    found: DataFrame, rounds: int | None = None, support: int = 5, confidence: float = 0.9, promote: float = 0.95, unknown: float = 0.02, prior: float = 0.1
) -> DataFrame:
    """(kind, shape, pattern): the patterns whose score for a kind is ``confidence`` at least.

    Of a pattern's distinct values, p are known for the kind, n are known for another or can't be
    of it, u are neither; its score is p / (p + n + ``unknown`` * u + ``prior``), times
    log(1 + p) / log(2 + p), and it needs p of ``support``. Each round promotes values that fit
    a kind and whose patterns' scores for it, taken as independent, reach ``promote``; a known value keeps
    its kind. It ends with the round that promotes none, or with a warning after ``rounds``
    where that is given.
    """
    tokens = found.select(F.explode("seen").alias("t")).select("t.kind", "t.shape", "t.value", "t.may", F.explode("t.patterns").alias("pattern"))
    edges = materialize(tokens.groupBy("shape", "pattern", "value").agg(F.min("kind").alias("seed"), F.bit_or("may").alias("may")), "pii-edges")
    known = edges.where("seed IS NOT NULL").groupBy("shape", "value").agg(F.min("seed").alias("kind"))
    unseen = edges.where("seed IS NULL").select("shape", "pattern", "value", "may")

    def score_patterns(known: DataFrame) -> DataFrame:
        told = edges.join(known, ["shape", "value"], "left")
        own = lambda k: F.count_if(F.col("kind") == k)
        unfit = lambda i: F.count_if(F.col("kind").isNull() & (F.col("may").bitwiseAND(1 << i) == 0))
        counts = told.groupBy("shape", "pattern").agg(F.count("kind").alias("known"), F.count("*").alias("n"), *(own(k).alias(f"p_{k}") for k in KINDS), *(unfit(i).alias(f"x_{k}") for i, k in enumerate(KINDS)))
        kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"p_{k}").alias("p"), F.col(f"x_{k}").alias("unfit")) for k in KINDS)))
        each = counts.select("shape", "pattern", "known", "n", kinds.alias("k")).select("shape", "pattern", "known", "n", "k.*").where(F.col("p") >= support)
        against = F.col("known") - F.col("p") + F.col("unfit")
        share = F.col("p") / (F.col("p") + against + unknown * (F.col("n") - F.col("p") - against) + prior)
        return each.select("shape", "pattern", "kind", (share * F.log1p("p") / F.log1p(F.col("p") + 1)).alias("score"))

    known = materialize(known, "pii-known")
    n, done = known.count(), 0
    while n:
        if rounds is not None and done >= rounds:
            _LOG.warning("stopped after %d rounds; values may still grow", rounds)
            break
        scored = score_patterns(known)
        said = unseen.join(scored, ["shape", "pattern"]).where(_fits("kind"))
        said = said.groupBy("shape", "value", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.least("score", F.lit(0.999)))))).alias("score"))
        best = said.groupBy("shape", "value").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"), F.max("score").alias("score"))
        fresh = best.where(F.col("score") >= promote).select("shape", "value", "kind").join(known, ["shape", "value"], "left_anti")
        grown = materialize(known.unionByName(fresh), "pii-known")
        before, n, done = n, grown.count(), done + 1
        discard(known)
        known = grown
        if n == before:
            break
    return score_patterns(known).where(F.col("score") >= confidence).select("kind", "shape", "pattern")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **bootstrap) -> DataFrame:
    """(doc_id, text_hash, base, more): one row for each row of ``docs``; arrays of (kind, start, end) in code points, the end exclusive.

    base has the fixed patterns' spans by kind and start, more the discovered ones, which overlap
    no base span. Null and empty texts have none; repeated rows stay; an empty table gives none.
    """
    found = materialize(scan(docs, id_col, text_col), "pii-scan")
    patterns = materialize(confident_patterns(found, **bootstrap), "pii-patterns")
    tokens = found.select("row", F.explode("seen").alias("t")).where("t.kind IS NULL").select("row", "t.shape", "t.may", "t.start", "t.end", F.explode("t.patterns").alias("pattern"))
    hits = tokens.join(patterns, ["shape", "pattern"]).where(_fits("kind")).groupBy("row", "start", "end").agg(F.min("kind").alias("kind"))
    before = Window.partitionBy("row").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    hits = hits.withColumn("reached", F.max("end").over(before)).where("reached IS NULL OR reached <= start")  # of a run and a token in it the run
    more = hits.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("more"))
    none = F.array().cast(f"array<{_SPAN}>")
    return found.select("row", "doc_id", "text_hash", "base").join(more, "row", "left").select("doc_id", "text_hash", "base", F.coalesce("more", none).alias("more"))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, by kind as listed, then start."""
    rank = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(rank(s).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **bootstrap) -> DataFrame:
    """``docs`` with every span, base and discovered, replaced by its kind in angle brackets; of overlapping spans the first one's.

    All columns stay, whatever their names; a null text stays null. Spans are joined to their texts on the id and the
    text's hash, so repeated ids with different texts keep their own spans.
    """
    own_id, own_hash, own_spans = unused(docs, "pii_id", "pii_hash", "pii_spans")
    found = personal_data(docs, id_col, text_col, **bootstrap).select(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash), F.concat("base", "more").alias(own_spans))
    # A table of its own, so that the planner sees how small it is beside the texts.
    spans = materialize(found.where(F.size(own_spans) > 0).dropDuplicates([own_id, own_hash]), "pii-spans")
    same = F.col(id_col).cast("long").eqNullSafe(F.col(own_id)) & F.xxhash64(text_col).eqNullSafe(F.col(own_hash))
    at = docs.columns.index(text_col)

    def cover(text: str | None, spans: list | None) -> str | None:
        if not text or not spans:
            return text
        out, end = [], 0
        for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
            if s["start"] >= end:
                out += [text[end : s["start"]], f"<{s['kind']}>"]
            end = max(end, s["end"])
        return "".join([*out, text[end:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_col):
            texts = [cover(t, s) for t, s in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist())]
            columns = [c if i != at else pa.array(texts, c.type) for i, c in enumerate(batch.columns[:-1])]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    return docs.join(spans, same, "left").drop(own_id, own_hash).mapInArrow(run, docs.schema)
