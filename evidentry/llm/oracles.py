"""DuckDB SQL for the operators' queries that SQL can express on whole tables."""

from __future__ import annotations

from evidentry.llm.secrets import BASE_RULES, MORE_RULES

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP5 = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
  b AS (SELECT DISTINCT item_id, {_WORDS} AS w FROM benchmark),
  i AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM b WHERE len(w) > 0),
  windows AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS s FROM i),
  sizes AS (SELECT DISTINCT n FROM windows),
  u AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
  ahead AS (SELECT doc_id, p, list(word) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS ws FROM u),
  sized AS (SELECT doc_id, p, n, array_to_string(ws[1:n], ' ') AS s FROM ahead, sizes WHERE len(ws) >= n),
  occurs AS (SELECT doc_id, p, n, item_id FROM sized JOIN windows USING (n, s)),
  hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM occurs) GROUP BY 1),
  its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM occurs) GROUP BY 1)
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
  FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)"""


def _rule(order: int, rule) -> str:
    # A run of at least so many hex digits begins where the run of any length does.
    pattern = "[0-9a-f]{16,}" if rule.kind == "hex" else rule.pattern
    quoted = pattern.replace("'", "''")
    return f"""SELECT doc_id, {order} AS ord, '{rule.kind}' AS kind, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'s': list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0), 'l': length(m[i]), 'g': length(g[i])}})) AS x
    FROM (SELECT doc_id, regexp_split_to_array(text, '{quoted}') AS p, regexp_extract_all(text, '{quoted}') AS m, regexp_extract_all(text, '{quoted}', {rule.group}) AS g FROM documents WHERE text IS NOT NULL)"""


_LEAST = " ".join(f"WHEN '{r.kind}' THEN {r.least}" for r in BASE_RULES + MORE_RULES)
OP6 = f"""WITH found AS ({" UNION ALL ".join(_rule(i, r) for i, r in enumerate(BASE_RULES + MORE_RULES))}),
  spans AS (SELECT doc_id, ord, kind, x.s::BIGINT AS s, kind || ':' || x.s::BIGINT || ':' || (x.s + x.l)::BIGINT AS shown FROM found WHERE x.g >= CASE kind {_LEAST} END),
  a AS (SELECT doc_id, {", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in BASE_RULES)},
    coalesce(string_agg(shown, ',' ORDER BY s, ord) FILTER (WHERE ord < {len(BASE_RULES)}), '') AS base, string_agg(shown, ',' ORDER BY s, ord) AS spans FROM spans GROUP BY 1)
  SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE_RULES)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents LEFT JOIN a USING (doc_id)"""



def _assign(round_no: int, book: str) -> str:
    """Each part's nearest entry of ``book`` (part, entry, c): a list for each (id, part)."""
    return f"""a{round_no} AS (SELECT r, p, arg_min({{'e': e, 'd': d}}, {{'d': d, 'e': e}}) AS m FROM (
    SELECT r, x.p, e, list_sum(list_transform(list_zip(x.c, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM x JOIN {book} b USING (p)) GROUP BY r, p)"""


def _replace(round_no: int, book: str) -> str:
    """The entries of ``book`` after a round: floored means, or the entry itself where it is unused."""
    return f"""s{round_no} AS (SELECT p, e, list(floor(s / n)::BIGINT ORDER BY i) AS c FROM (
      SELECT p, m.e AS e, i, sum(c[i])::DOUBLE AS s, count(*) AS n FROM (SELECT r, p, c, m, unnest(range(1, len(c) + 1)) AS i FROM x JOIN a{round_no} USING (r, p)) GROUP BY ALL) GROUP BY p, e),
    b{round_no} AS (SELECT p, e, coalesce(s.c, b.c) AS c FROM {book} b LEFT JOIN s{round_no} s USING (p, e))"""


_ROUNDS = ",\n  ".join(f"{_assign(k, f'b{k - 1}')},\n  {_replace(k, f'b{k - 1}')}" for k in range(1, 5))
OP11 = f"""WITH k AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS r, vec_id, label, list_transform(embedding, lambda v: floor(1024 * v::DOUBLE)::BIGINT) AS v
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
  x AS (SELECT r, p, v[p * len(v) // 4 + 1:(p + 1) * len(v) // 4] AS c FROM k, unnest([0, 1, 2, 3]) AS t(p)),
  b0 AS MATERIALIZED (SELECT p, r - 1 AS e, c FROM x WHERE r <= 256),
  {_ROUNDS},
  {_assign(5, "b4")},
  codes AS (SELECT r, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM a5 GROUP BY r),
  book AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b4)
  SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM k JOIN codes USING (r), book"""

_STATES = ("n", "s", "u", "a")
_FITS = {"n": "u", "s": "u", "u": "a", "a": "u"}


def _way(state: str, cost: str, letter: str, of: str = "") -> str:
    return f"{{'c': {of}{state}.c + {cost}, 'a': {of}{state}.a || '{letter}'}}"


def _inserted(state: str, of: str = "") -> str:
    ways = [f"{of}{state}", *(_way(b, "5", "I", of) for b in _STATES if _FITS[b] == state)]
    return f"list_sort([{', '.join(ways)}])[1] AS {state}"


def _edited(state: str) -> str:
    """The least (cost, audit) of a state after the row (i: role's initial, gone, cut)."""
    kept = {"s": [("n", "s")], "u": [(b, "u") for b in "nsa"], "a": [("u", "a")]}.get(state, [])
    ways = [_way(state, "2", "D", "f.")]
    ways += [_way(b, f"CASE WHEN gone OR i <> '{i}' THEN {_NEVER} WHEN cut THEN 5 ELSE 0 END", "K", "f.") for b, i in kept]
    ways += [_way(b, f"CASE WHEN gone THEN {_NEVER} WHEN cut THEN 6 ELSE 1 END", "R", "f.") for b in _STATES if _FITS[b] == state]
    return f"list_sort([{', '.join(ways)}])[1] AS {state}"


_NEVER = 1 << 40
_CLOSE = ", ".join(_inserted(s) for s in _STATES)


def _closed(layer: str) -> str:
    return f"(SELECT * REPLACE ({_CLOSE}) FROM (SELECT * REPLACE ({_CLOSE}) FROM {layer}))"


_NONE = f"{{'c': {_NEVER}::BIGINT, 'a': ''}}"
_LAST = "(SELECT w.* FROM walk w JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.k)"
OP12 = f"""WITH RECURSIVE crc AS (SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS tab FROM range(256) AS r(n)),
  hashed AS (SELECT c.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind FROM conversations c, crc),
  damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
      CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM hashed WHERE kind <> 0),
  ordered AS (SELECT *, row_number() OVER w AS k, lag(role[1:1]) OVER w AS before FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
  faults AS (SELECT *, role[1:1] AS i, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS seen, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS open FROM ordered),
  turns AS MATERIALIZED (SELECT *, blank OR seen AS gone, open AND NOT blank AND NOT seen AS cut FROM faults),
  counts AS (SELECT conv_id, max(k) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE seen AND NOT blank) AS duplicate,
      count(*) FILTER (WHERE cut) AS truncated, count(*) FILTER (WHERE before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM turns GROUP BY conv_id),
  walk AS (
    SELECT conv_id, 0::BIGINT AS k, {{'c': 0::BIGINT, 'a': ''}} AS n, {_NONE} AS s, {_NONE} AS u, {_NONE} AS a FROM counts
    UNION ALL
    SELECT f.conv_id, t.k, {", ".join(_edited(s) for s in _STATES)} FROM {_closed("walk")} f JOIN turns t ON t.conv_id IS NOT DISTINCT FROM f.conv_id AND t.k = f.k + 1),
  best AS (SELECT conv_id, least(f.n, f.a) AS way FROM {_closed(_LAST)} f),
  letters AS (SELECT conv_id, unnest(string_split(way.a, '')) AS edit, generate_subscripts(string_split(way.a, ''), 1) AS nth FROM best WHERE way.a <> ''),
  placed AS (SELECT *, count(*) FILTER (WHERE edit <> 'I') OVER (PARTITION BY conv_id ORDER BY nth) AS k FROM letters),
  staying AS (SELECT p.conv_id, nth, edit, role, text, row_number() OVER (PARTITION BY p.conv_id ORDER BY nth) AS pos, first(coalesce(edit = 'K' AND i = 's', false)) OVER (PARTITION BY p.conv_id ORDER BY nth) AS led
    FROM placed p LEFT JOIN turns t ON t.conv_id IS NOT DISTINCT FROM p.conv_id AND t.k = p.k AND edit <> 'I' WHERE edit <> 'D'),
  repaired AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (pos + led::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY nth) AS t FROM staying GROUP BY conv_id)
  SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(way.c, 0)::BIGINT AS cost, coalesce(way.a, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
  FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM o.conv_id"""

ORACLES = {"op5_decontam": OP5, "op6_secrets": OP6, "op11_vector_codes": OP11, "op12_dialogues": OP12}
