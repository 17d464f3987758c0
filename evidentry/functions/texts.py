"""Text columns: levels, statuses, snippets, normal forms and message templates."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SPACE = " \t\n\r\f\v"

#: Level names that logs use, and the five levels that are kept.
LEVEL_NAMES = {
    "trace": "debug", "debug": "debug", "info": "info", "notice": "info", "information": "info", "warn": "warning",
    "warning": "warning", "err": "error", "error": "error", "severe": "error", "fatal": "fatal", "critical": "fatal",
    "crit": "fatal", "panic": "fatal", "emerg": "fatal", "alert": "fatal",
}

#: What a template hides, in order of precedence at one position.
MASKS = (
    ("TS", r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?"),
    ("URL", r"[a-zA-Z][a-zA-Z0-9+.\-]*://[^\s'\"<>]+"),
    ("EMAIL", r"[\w.+\-]+@[\w\-]+\.[\w.\-]+"),
    ("UUID", r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}"),
    ("HEX", r"0[xX][0-9a-fA-F]+\b|\b(?=[0-9a-fA-F]{8,}\b)[0-9a-fA-F]*[a-fA-F][0-9a-fA-F]*\b"),
    ("IP", r"\b(?:\d{1,3}\.){3}\d{1,3}(?::\d+)?\b|\[[0-9a-fA-F:]*:[0-9a-fA-F:]*\]:\d+\b"),
    ("HOSTPORT", r"\b[a-zA-Z0-9\-]+(?:\.[a-zA-Z0-9\-]+)+:\d+\b"),
    ("PATH", r"(?:/[\w.\-]+){2,}/?"),
    ("STR", r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'"),
    ("DUR", r"-?\b\d+(?:\.\d+)?(?:ms|us|µs|ns|s|m|h)\b"),
    ("SIZE", r"-?\b\d+(?:\.\d+)?(?:[KMGT]i?B)\b"),
    ("NUM", r"-?\b\d+(?:\.\d+)?\b"),
)
#: Python's word characters and white space as classes of the JVM's expressions.
_WORD = r"\p{L}\p{N}_"
_SPACE = r" \t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_EDGE = f"(?:(?<=[{_WORD}])(?![{_WORD}])|(?<![{_WORD}])(?=[{_WORD}]))"
#: What the two open-ended masks need before them, or else an earlier place would have matched; so a long run is read once.
_AFTER = {"URL": r"(?:\G|(?<![a-zA-Z]))", "EMAIL": rf"(?:\G|(?<![{_WORD}.+\-]))"}


def _for_jvm(name: str, pattern: str) -> str:
    """A pattern of ``MASKS`` with the meaning it has for Python's str; repeated groups give nothing back, which these never need to."""
    out, inside, at = [_AFTER.get(name, "")], False, 0
    while at < len(pattern):
        part = pattern[at : at + 2] if pattern[at] == "\\" else pattern[at]
        at += len(part)
        if part == r"\w":
            out.append(_WORD if inside else f"[{_WORD}]")
        elif part in (r"\d", r"\s", r"\b"):
            out.append({r"\d": r"\p{Nd}", r"\s": _SPACE, r"\b": _EDGE}[part])
        elif part == "." and not inside:
            out.append(r"[^\n]")
        else:
            inside = part == "[" or inside and part != "]"
            out.append(part)
    return re.sub(r"\)(\*|\+|\{\d+,\})", r")\1+", "".join(out))


_JVM = {name: _for_jvm(name, pattern) for name, pattern in MASKS}
_TOKEN = "|".join(_JVM.values())
#: A gap, and the token after it or nothing at the end; the earliest branch that matches at a place is taken.
_GAP_AND_TOKEN = rf"([\s\S]*?)(?:({_TOKEN})|\z)"
_PLACEHOLDER = "<(" + "|".join(name for name, _ in MASKS) + ")>"
#: Places where no token begins, many at a step: characters that begin none; words of letters and their stops before white space
#: (but for eight hex digits); of other letters the first is asked, as after a letter only a UUID may begin. Both take letters that
#: are one unit for the JVM, which looks back by units.
_NO_TOKEN = (
    rf"[^{_WORD}.+\-\[/\"']++|(?![0-9a-fA-F]{{8}})[\p{{L}}&&[\x00-\x{{ffff}}]]++[.,;:!?)]*+(?=\s|\z)"
    rf"|(?!{_TOKEN})(?:[a-zA-Z](?:(?![0-9a-fA-F]{{8}}-)[a-zA-Z])*+|[\s\S])"
)
#: Private characters: one before a token, and one after the place of each kind.
_MARKS = [chr(0xE000 + k) for k in range(len(MASKS) + 1)]
_ANY_MARK = f"[{_MARKS[0]}-{_MARKS[-1]}]"
#: A gap in group 1, the token in its kind's group.
_GAP_AND_KINDS = rf"((?:{_NO_TOKEN})*+)(?:{'|'.join(f'({p})' for p in _JVM.values())}|\z)"
_MARKED = "$1" + _MARKS[0] + "".join(f"${k + 1}{m}" for k, m in enumerate(_MARKS) if k)


def _by_parts(apart: Column) -> Column:
    """Gaps and the names of the tokens between them, each token's name asked of the token; for any characters.

    Numbers are asked for first, as no other branch fits a plain one; a host that begins with a
    hyphen needs the word before it, and is what no branch fits.
    """
    gaps, tokens = (F.regexp_extract_all(apart, F.lit(_GAP_AND_TOKEN), F.lit(k)) for k in (1, 2))

    def named(token: Column) -> Column:
        out = F.when(token == "", "")
        for name in ("NUM", *(n for n, _ in MASKS if n != "NUM")):
            out = out.when(token.rlike(rf"\A(?:{_JVM[name]})\z"), f"<{name}>")
        return out.otherwise("<HOSTPORT>")

    return F.array_join(F.zip_with(gaps, F.transform(tokens, named), lambda gap, name: F.concat(gap, name)), "")


def _by_marks(apart: Column) -> Column:
    """The same in one pass: each token is put between the marks of the branch that took it, and both give way to the name."""
    out = F.regexp_replace(apart, _GAP_AND_KINDS, _MARKED)
    for (name, _), before, after in zip(MASKS, _MARKS, _MARKS[1:]):
        out = F.regexp_replace(out, f"{before}[^{after}]++{after}", f"<{name}>")
    return F.regexp_replace(out, f"{_ANY_MARK}+", "")


#: Messages of ASCII words (no eight hex digits, a stop after them at most), whole numbers and numbers after one other letter than a
#: hex digit, one blank or newline between them: no other token than a whole number begins anywhere in these.
_SIMPLE = r"\A(?:(?:(?![a-fA-F]{8})[a-zA-Z]++[.,;:!?]?+|[g-zG-Z]?[0-9]++)(?:[ \n](?=[a-zA-Z0-9])|\z))++\z"


def _by_numbers(message: Column) -> Column:
    return F.translate(F.regexp_replace(message, r"(?<![a-zA-Z0-9])[0-9]++", "<NUM>"), "\n", " ")


def mask(message: Column | str) -> Column:
    """The template of a message: tokens give way to their names in one pass from left to right, and white space runs to one space.

    Messages of words and numbers alone need one expression. Of others, placeholders that a message has
    itself are set apart first. Messages that have the private characters of :data:`_MARKS` are put
    together from their parts.
    """
    given = F.col(message) if isinstance(message, str) else message
    return F.when(given.rlike(_SIMPLE), _by_numbers(given)).otherwise(_of_any(given))


def _of_any(message: Column) -> Column:
    apart = F.regexp_replace(message, _PLACEHOLDER, "<ESC$1>")
    joined = F.when(apart.rlike(_ANY_MARK), _by_parts(apart)).otherwise(_by_marks(apart))
    return F.btrim(F.regexp_replace(joined, rf"[{_SPACE}]{{2,}}|[{_SPACE}&&[^ ]]", " "))


def template_hash(masked: Column) -> Column:
    return F.substring(F.sha2(masked, 256), 1, 32)


#: A character from U+0300 on; no text without one differs from its normal form C.
_MAY_COMPOSE = r"[^\x00-\x{2ff}]"


@F.arrow_udf(StringType())
def _composed(text: pa.Array) -> pa.Array:
    if text.null_count == len(text):
        return text
    return pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in text.to_pylist()], text.type)


def nfc(text: Column) -> Column:
    """Unicode normal form C; Spark has no built-in, so texts that may differ from theirs go to Python."""
    return F.coalesce(F.when(~text.rlike(_MAY_COMPOSE), text), _composed(F.when(text.rlike(_MAY_COMPOSE), text)))


def normalize_raw(raw: Column) -> Column:
    """Without the one line end it may have, in normal form C."""
    return nfc(F.regexp_replace(raw, r"\r?\n\z", ""))


def status_class(code: Column) -> Column:
    return F.when(code.between(100, 599), F.concat(F.floor(code / 100).cast("string"), F.lit("xx"))).otherwise("none")


def canonical_level(level: Column, code: Column) -> Column:
    """A known name's level; info for unknown names; of the status where there is no name."""
    names = F.create_map(*[F.lit(x) for pair in LEVEL_NAMES.items() for x in pair])
    name = F.lower(F.btrim(level, F.lit(SPACE)))
    by_status = F.when(code.between(500, 599), "error").when(code.between(400, 499), "warning").otherwise("info")
    return F.when(F.length(name) > 0, F.coalesce(F.element_at(names, name), F.lit("info"))).otherwise(by_status)


def snippet(text: Column, size: int = 500) -> Column:
    """The first ``size`` characters, cut at their last space."""
    return F.when(F.length(text) <= size, text).otherwise(F.regexp_replace(F.substring(text, 1, size), r"(?s) [^ ]*\z", ""))


def truncate(text: Column, size: int) -> Column:
    return F.when(F.length(text) <= size, text).otherwise(F.concat(F.substring(text, 1, size - 1), F.lit("…")))


def component(text: Column) -> Column:
    """A service, slug or environment name in normal form C, null if it has other characters."""
    return F.when(text.rlike(r"\A[A-Za-z0-9._@-]+\z"), text)


def repository(text: Column) -> Column:
    """owner/name in lower case without .git, null if it isn't of that form."""
    plain = F.regexp_replace(F.lower(text), r"\.git\z", "")
    return F.when(plain.rlike(r"\A[a-z0-9._@-]+/[a-z0-9._@-]+\z"), plain)


def source_path(path: Column) -> Column:
    """A relative path with forward slashes; null if absolute, empty or with dot steps."""
    plain = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"/(\./)*/*", "/")
    bad = plain.rlike(r"\A(/|\z)|(\A|/)\.\.(/|\z)|\A\.(/|\z)")
    return F.when(~bad, F.regexp_replace(plain, r"/\z", ""))


def sha40(text: Column) -> Column:
    return F.when(text.rlike(r"\A[0-9a-f]{40}\z"), text)


def redact_url(url: Column) -> Column:
    """A database URL with its password hidden."""
    return F.regexp_replace(url, r"(://[^:/@]+):[^@/]*@", "$1:***@")
