"""Conversation structure repair: the cheapest edits that make roles read ``(s?(ua)+)?``.

A conversation's rows are walked once in order. The grammar has four states: nothing yet, after a
system row, after a user row, after an assistant row. Each state carries the least (cost, audit),
the audit being one letter an edit (Delete, Insert, Keep, Rerole). A row steps each state by its
edits; then at most two inserts close the layer, as more would only come back to a state.

Rows are streamed in sorted order, so memory does not grow with a conversation, whose audit alone
is kept whole: after each block of rows the audits of the four states are set aside in chains
of pieces, and go on as ranks. Before a layer is closed, no audit of it is the beginning of
another (they hold as many letters of rows and end in one), so a rank decides what follows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentry.llm.columns import pieces
from evidentry.session import materialize

#: The edits' costs.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
_BLANK = r"[\x20\x09-\x0D]"
_BLOCK = 64
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
#: The state after a row of this initial is kept.
_KEPT = {(_START, "s"): _SYSTEM, (_START, "u"): _USER, (_SYSTEM, "u"): _USER, (_USER, "a"): _ASSISTANT, (_ASSISTANT, "u"): _USER}
#: The state after a row is given the role that fits, or such a row is inserted.
_FITTING = {_START: _USER, _SYSTEM: _USER, _USER: _ASSISTANT, _ASSISTANT: _USER}
_ROLE = {_USER: "user", _ASSISTANT: "assistant"}

Layer = list[tuple[int, int, str] | None]


def _closed(layer: Layer) -> Layer:
    """The layer after up to two inserts."""
    out = list(layer)
    for _ in range(2):
        before = list(out)
        for state, best in enumerate(before):
            if best:
                to, way = _FITTING[state], (best[0] + INSERT, best[1], best[2] + "I")
                out[to] = min(out[to], way) if out[to] else way
    return out


def _stepped(layer: Layer, symbol: str) -> Layer:
    """The layer after a row: 'x' must go; else its role's initial (o: none of s, u, a), upper case if it is truncated."""
    out: Layer = [None] * 4
    more = TRUNCATED if symbol.isupper() else 0

    def offer(state: int, way: tuple[int, int, str]) -> None:
        if out[state] is None or way < out[state]:
            out[state] = way

    for state, best in enumerate(layer):
        if not best:
            continue
        cost, rank, audit = best
        offer(state, (cost + DELETE, rank, audit + "D"))
        if symbol == "x":
            continue
        offer(_FITTING[state], (cost + REROLE + more, rank, audit + "R"))
        if (to := _KEPT.get((state, symbol.lower()))) is not None:
            offer(to, (cost + KEEP + more, rank, audit + "K"))
    return out


@lru_cache(1 << 14)
def _walked(entry: tuple, symbols: str) -> Layer:
    """The unclosed layer after a block of rows; ``entry`` has each state's (cost, rank), or None."""
    layer: Layer = [(*e, "") if e else None for e in entry]
    for symbol in symbols:
        layer = _stepped(_closed(layer), symbol)
    return layer


class Repair:
    """The walk over one conversation; ``add`` takes rows' symbols in order, ``result`` gives (cost, audit)."""

    def __init__(self):
        self.base, self.entry, self.chains, self.waiting = 0, ((0, 0), None, None, None), {0: None}, []

    def add(self, symbol: str) -> None:
        self.waiting.append(symbol)
        if len(self.waiting) == _BLOCK:
            layer = _walked(self.entry, "".join(self.waiting))
            self.waiting = []
            least = min(w[0] for w in layer if w)
            ranks = {way: i for i, way in enumerate(sorted({w[1:] for w in layer if w}))}
            self.chains = {i: (self.chains[rank], tail) for (rank, tail), i in ranks.items()}
            self.base += least
            self.entry = tuple((w[0] - least, ranks[w[1:]]) if w else None for w in layer)

    def result(self) -> tuple[int, str]:
        layer = _closed(_walked(self.entry, "".join(self.waiting)))
        cost, rank, tail = min(w for w in (layer[_START], layer[_ASSISTANT]) if w)
        out, chain = [tail], self.chains[rank]
        while chain:
            chain, tail = chain
            out.append(tail)
        return self.base + cost, "".join(reversed(out))


def least_edits(symbols: str) -> tuple[int, str]:
    """(cost, audit) of a conversation given as its rows' symbols."""
    walk = Repair()
    for symbol in symbols:
        walk.add(symbol)
    return walk.result()


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text; null roles and texts read as one space) after the damage that crc32 of ``conv_id:turn`` modulo 20 names: 0 drops the row, 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes it a user's."""
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(key("conv_id"), F.lit(":"), key("turn")).cast("binary")) % 20
    plain = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return plain.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("copy")).drop("copy")


def _is_blank(text: Column) -> Column:
    return ~text.rlike(f"[^{_BLANK[1:]}")


def _is_truncated(text: Column) -> Column:
    return ~text.rlike(rf"[.!?]{_BLANK}*\z")


def _keyed(rows: DataFrame) -> DataFrame:
    """The rows with what they are ordered by: turn (null first), role, the text's first 64 characters, a hash of role and text."""
    return rows.withColumns({"head": F.substring("text", 1, 64), "same": F.unhex(F.sha2(F.concat(F.length("role"), F.lit(":"), "role", "text").cast("binary"), 256))})


_ORDER = ("turn", "role", "head", "same")
_REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_ROWS = "conv_id long, position long, turn long, role string, text string, edit string"


def _in_order(rows: DataFrame, *first: str) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *first, *_ORDER)


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (conv_id, turn, same, initial, blank, truncated, later) -> one row for each conversation."""
    names = [f.strip().split(" ")[0] for f in _REPORT.split(",")]
    out: list[tuple] = []
    now = walk = None

    def packed() -> pa.RecordBatch:
        columns = [pa.array([r[i] for r in out], pa.string() if n == "audit" else pa.int64()) for i, n in enumerate(names)]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, names)

    def close() -> None:
        gaps = top - low + 1 - turns if low is not None else 0
        out.append((now[0], gaps, blanks, doubles, cut, illegal, *walk.result()))

    for batch in batches:
        for conv, turn, same, initial, blank, truncated, later in zip(*(c.to_pylist() for c in batch.columns)):
            if now is None or now[0] != conv:
                if now is not None:
                    close()
                    if len(out) >= 4096 or len(out[-1][-1]) > 1 << 20:
                        yield packed()
                now, walk = (conv, None, None, None), Repair()
                low = top = None
                turns = blanks = doubles = cut = illegal = 0
            _, last_turn, last_same, last = now
            if last is not None and last + initial not in ("su", "ua", "au"):
                illegal += 1
            if turn is not None:
                turns += top is None or turn != top
                low, top = turn if low is None else low, turn
            repeat = later or last is not None and same == last_same and turn == last_turn
            if blank or repeat:
                blanks, doubles = blanks + blank, doubles + (not blank)
                walk.add("x")
            else:
                cut += truncated
                symbol = initial if initial in ("s", "u", "a") else "o"
                walk.add(symbol.upper() if truncated else symbol)
            now = (conv, turn, same, initial)
    if now is not None:
        close()
    yield packed()


def reports(rows: DataFrame) -> DataFrame:
    """One row for each conversation of ``rows`` (conv_id, turn, role, text): its faults and its cheapest repair.

    gaps (last turn - first turn + 1 - distinct turns, null turns aside; 0 if all are null); blank,
    duplicate and truncated (a row counts for its first fault in this order); illegal (adjacent
    rows whose roles' initials are not su, ua or au); cost; audit (ties go to the ASCII-least).
    Rows are taken by turn, null first, then by role, the text's first 64 characters and a hash;
    equal rows follow each other, and all but the first are duplicates. Null roles and texts
    read as one space; null conv_ids are one conversation. An empty table gives no rows.

    Whether a row was seen earlier is asked of the grouped first turn of repeated (conversation,
    role and text); texts themselves are not shuffled here.
    """
    plain = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    plain = _keyed(plain).withColumns({"initial": F.substring("role", 1, 1), "blank": _is_blank(F.col("text")), "truncated": _is_truncated(F.col("text"))}).drop("text")
    place = lambda turn: F.struct(F.col(turn).isNotNull().alias("known"), F.col(turn).alias("turn"))
    firsts = plain.groupBy(F.col("conv_id").alias("own"), F.col("same").alias("of")).agg(F.min(place("turn")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    marked = plain.join(firsts, F.col("conv_id").eqNullSafe(F.col("own")) & (F.col("same") == F.col("of")), "left")
    marked = marked.withColumn("later", F.coalesce(place("turn") > F.col("first"), F.lit(False)))
    return _in_order(marked.drop("own", "of", "first")).select("conv_id", "turn", "same", "initial", "blank", "truncated", "later").mapInArrow(_reports, _REPORT)


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Sorted (conv_id, audit, turn, role, text), a conversation's audit first -> lists of (conv_id, position, turn, role, text, edit)."""
    audit, at, state, position = "", 0, _START, 0
    out: list[tuple] = []

    def inserts(conv) -> None:
        nonlocal at, state, position
        while at < len(audit) and audit[at] == "I":
            state = _FITTING[state]
            out.append((conv, position, None, _ROLE[state], "", "I"))
            at, position = at + 1, position + 1

    for batch in pieces(batches):
        for conv, mine, turn, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if mine is not None:
                audit, at, state, position = mine, 0, _START, 0
                inserts(conv)
                continue
            edit, at = audit[at], at + 1
            if edit != "D":
                state = _FITTING[state] if edit == "R" else _KEPT[state, role[:1]]
                out.append((conv, position, turn, _ROLE[state] if edit == "R" else role, text, edit))
                position += 1
            inserts(conv)
        yield out
        out = []


def _with_audits(rows: DataFrame, found: DataFrame) -> DataFrame:
    plain = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    audits = found.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "audit")
    both = audits.unionByName(plain.withColumn("audit", F.lit(None).cast("string")))
    keyed = _keyed(both).withColumn("row", F.col("audit").isNull())
    return _in_order(keyed, "row").select("conv_id", "audit", "turn", "role", "text")


def repaired_rows(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, position, turn, role, text, edit): the rows that stay, and those inserted (null turn, empty text), as the audits of :func:`reports` for the same ``rows`` say."""
    names = [f.strip().split(" ")[0] for f in _ROWS.split(",")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _repaired(batches):
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], k) for i, k in enumerate(kinds)], names)

    return _with_audits(rows, found).mapInArrow(run, _ROWS)


def repaired_digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): SHA-256 of each repaired conversation that isn't empty, as ``role:text`` joined by newlines.

    One hash runs through a conversation's rows in order, so they are one task's stream; no row is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = mark = None
        done: list[tuple] = []
        for part in _repaired(batches):
            for conv, position, _, role, text, _ in part:
                if not position:
                    if mark:
                        done.append((now, mark.hexdigest()))
                    now, mark = conv, hashlib.sha256()
                mark.update((f"\n{role}:{text}" if position else f"{role}:{text}").encode())
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in done], pa.int64()), pa.array([r[1] for r in done], pa.string())], ["conv_id", "repaired_sha256"])
            done = []
        if mark:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([mark.hexdigest()], pa.string())], ["conv_id", "repaired_sha256"])

    return _with_audits(rows, found).mapInArrow(run, "conv_id long, repaired_sha256 string")


def described(rows: DataFrame, all_ids: DataFrame) -> DataFrame:
    """:func:`reports` with repaired_sha256, one row for each conv_id of ``all_ids``; those without rows have zeros, an empty audit and the hash of nothing."""
    found = materialize(reports(rows), "dialogue-reports")
    marks = repaired_digests(rows, found).withColumnRenamed("conv_id", "own")
    full = found.join(marks, F.col("conv_id").eqNullSafe(F.col("own")), "left").drop("own")
    ids = all_ids.select(F.col("conv_id").alias("own")).distinct()
    full = ids.join(full, F.col("conv_id").eqNullSafe(F.col("own")), "left").drop("conv_id").withColumnRenamed("own", "conv_id")
    return full.na.fill(0, ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]).na.fill({"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()})
