"""Secret scan with a trigram inverted index, in DataFrame operations alone.

Each rule's regex is read once on the driver and turned into a Boolean query of trigrams that
any match must contain. The index has a posting for each trigram that some query names and
each document whose lower-cased text contains it. Postings are intersected by document, the
query picks each rule's candidates, and only those are searched with the regex. A rule whose
regex has no mandatory trigram is searched in every text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as C
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentry.session import materialize


@dataclass(frozen=True)
class Rule:
    """``pattern`` in the syntax that Java and Python share; a match counts if ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: What counts as a secret. Runs of access keys and hex digits are matched whole, so that their least
#: length can stand in the pattern: what it leaves out would not have counted, and takes no room in the walk.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("ghp", r"ghp_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[0-9A-Za-z-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)

#: A query is True (no trigram is mandatory), a trigram, or ("and" | "or", [queries]).
Query = bool | str | tuple


def _all_of(queries: list) -> Query:
    kept = list(dict.fromkeys(q for q in queries if q is not True))
    return True if not kept else kept[0] if len(kept) == 1 else ("and", tuple(kept))


def _any_of(queries: list) -> Query:
    kept = list(dict.fromkeys(queries))
    flat = {q: frozenset(q[1]) if isinstance(q, tuple) and q[0] == "and" else frozenset([q]) for q in kept}
    kept = [q for q in kept if not any(flat[o] < flat[q] for o in kept)]  # what needs more than another adds nothing
    return True if True in kept or not kept else kept[0] if len(kept) == 1 else ("or", tuple(kept))


def _holds(strings: set[str]) -> Query:
    """What a text must contain if it contains one of the strings."""
    return _any_of([_all_of([s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _node(op, arg, most: int) -> tuple[set[str] | None, Query]:
    """The strings that a node matches, if they are few, and its query otherwise."""
    if op is C.LITERAL:
        return {chr(arg).lower()}, True
    if op is C.IN and len(arg) <= 4 and all(o is C.LITERAL for o, _ in arg):
        return {chr(a).lower() for _, a in arg}, True
    if op is C.SUBPATTERN:
        return _sequence(arg[3], most)
    if op is C.BRANCH:
        found = [_sequence(x, most) for x in arg[1]]
        if all(s is not None for s, _ in found):
            return set().union(*(s for s, _ in found)), True
        return None, _any_of([_holds(s) if s is not None else q for s, q in found])
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        low, high, inner = arg
        strings, query = _sequence(inner, most)
        if (low, high) == (0, 1) and strings is not None:
            return strings | {""}, True
        if low == high == 1:
            return strings, query
        return None, (_holds(strings) if strings is not None else query) if low else True
    if op is C.AT:
        return {""}, True
    return None, True


def _sequence(nodes, most: int) -> tuple[set[str] | None, Query]:
    run: set[str] = {""}
    needs: list[Query] = []
    whole = True
    for op, arg in nodes:
        strings, query = _node(op, arg, most)
        if strings is not None and len(run) * len(strings) <= most:
            run = {a + b for a in run for b in strings}
            continue
        whole = False
        needs += [_holds(run), query]
        run = strings if strings is not None else {""}
    return (run, True) if whole else (None, _all_of([*needs, _holds(run)]))


def trigram_query(pattern: str, most: int = 64) -> Query:
    """The Boolean trigram query of a regex, over lower-cased text."""
    strings, query = _sequence(_parser.parse(pattern), most)
    return _holds(strings) if strings is not None else query


def trigrams(query: Query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*(trigrams(q) for q in query[1]))


def _satisfied(query: Query, found: Column) -> Column:
    if isinstance(query, str):
        return F.array_contains(found, query)
    parts = [_satisfied(q, found) for q in query[1]]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if query[0] == "and" else out | p
    return out


def trigram_index(docs: DataFrame, wanted: set[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The postings (trigram, doc_id) of the wanted trigrams."""
    lowered = docs.select(F.col(id_col).alias("doc_id"), F.lower(F.col(text_col)).alias("lowered"))
    has = F.array_compact(F.array(*[F.when(F.contains("lowered", F.lit(t)), F.lit(t)) for t in sorted(wanted)]))
    return lowered.select("doc_id", has.alias("has")).select(F.explode("has").alias("trigram"), "doc_id").distinct()


def candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """(doc_id, kinds): the documents whose postings satisfy a rule's query, with those rules' kinds."""
    met = index.groupBy("doc_id").agg(F.collect_set("trigram").alias("found"))
    kinds = F.array_compact(F.array(*[F.when(_satisfied(q, F.col("found")), F.lit(k)) for k, q in queries.items()]))
    return met.select("doc_id", kinds.alias("kinds")).where(F.size("kinds") > 0)


def _spans(rule: Rule, order: int, text: Column, part: int = 256) -> Column:
    """The rule's matches in order: what lies between them (split) and their own lengths give where they start.

    Matches are walked in parts of ``part``: offsets are summed within each part, then over the
    parts, and the parts' spans are moved by what stands before. So what is copied while a
    result grows stays a part's size, not that of all the text's matches.
    """
    pattern = F.lit(rule.pattern)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    counted = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else matches
    steps = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), matches.alias("match"), counted.alias("counted"))
    none = F.array().cast("array<struct<start:int,order:int,kind:string,end:int>>")

    def span(start: Column, end: Column) -> Column:
        return F.struct(start.alias("start"), F.lit(order).alias("order"), F.lit(rule.kind).alias("kind"), end.alias("end"))

    def add(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["match"]), F.lit(0))
        keep = x["match"].isNotNull() & (F.length(x["counted"]) >= rule.least)
        return F.struct(end.alias("at"), F.when(keep, F.concat(state["spans"], F.array(span(start, end)))).otherwise(state["spans"]).alias("spans"))

    def walk(steps: Column) -> Column:
        firsts = F.sequence(F.lit(0), ((F.size(steps) - 1) / part).cast("int"))
        return F.transform(firsts, lambda k: F.aggregate(F.slice(steps, k * part + 1, part), F.struct(F.lit(0).alias("at"), none.alias("spans")), add))

    def moved(parts: Column) -> Column:
        sums = F.aggregate(parts, F.array(F.lit(0)), lambda sums, p: F.concat(sums, F.array(F.element_at(sums, -1) + p["at"])))
        return F.zip_with(parts, sums, lambda p, by: F.transform(p["spans"], lambda s: span(s["start"] + by, s["end"] + by)))

    once = lambda value, then: F.element_at(F.transform(F.array(value), then), 1)  # noqa: E731  ``value`` is made once, not at each use
    spans = once(steps, lambda steps: once(walk(steps), lambda parts: F.flatten(F.filter(moved(parts), lambda s: s.isNotNull()))))
    return F.when(text.rlike(rule.pattern), spans).otherwise(none)


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): one row for each row of ``docs``; spans are structs (start, order, kind, end) by start, then rule.

    Offsets count code points, the end is exclusive. Null and empty texts have no spans.
    Repeated rows stay; rows of one (or a null) doc_id share their candidates, which costs
    time and never a span. An empty table gives none.
    """
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {k: q for k, q in queries.items() if q is not True}
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if indexed:
        index = trigram_index(plain, set().union(*map(trigrams, indexed.values())))
        # A table, so that the planner knows its size and broadcasts it only below its threshold.
        found = materialize(candidates(index, indexed), "secret-candidates").withColumnRenamed("doc_id", "found_id")
        plain = plain.join(found, F.col("doc_id").eqNullSafe(F.col("found_id")), "left")
    else:
        plain = plain.withColumn("kinds", F.array().cast("array<string>"))
    none = F.array().cast("array<struct<start:int,order:int,kind:string,end:int>>")
    parts = [
        F.when(F.array_contains("kinds", r.kind), _spans(r, i, text)).otherwise(none) if r.kind in indexed else _spans(r, i, text)
        for i, r in enumerate(rules)
    ]
    return plain.select("doc_id", F.array_sort(F.concat(*parts)).alias("spans"))

