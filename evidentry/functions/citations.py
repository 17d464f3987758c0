"""Citations: strings that name a piece of evidence, independent of any table's numbering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidentry.functions.times import wire_seconds

#: The grammar of the six kinds.
NAME = r"[A-Za-z0-9._@-]+"
GRAMMAR = {
    "commit": r"commit:[0-9a-f]{40}",
    "deploy": r"deploy:[0-9a-f]{32}",
    "infra": r"infra:[0-9a-f]{32}",
    "log": r"log:[0-9a-f]{32}",
    "rollup": rf"rollup:{NAME}/[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}Z/{NAME}/{NAME}/{NAME}",
    "postmortem": r"postmortem:[A-Za-z0-9._-]+@[0-9a-f]{8}#(?:0|[1-9][0-9]*)",
}


def _cite(kind: str, *parts: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), *parts)


def commit(sha: Column) -> Column:
    return _cite("commit", sha)


def deploy(uid: Column) -> Column:
    return _cite("deploy", uid)


def infra(uid: Column) -> Column:
    return _cite("infra", uid)


def log(uid: Column) -> Column:
    return _cite("log", uid)


def rollup(service: Column, bucket: Column, status: Column, level: Column, template: Column) -> Column:
    return _cite("rollup", F.concat_ws("/", service, wire_seconds(bucket), status, level, template))


def postmortem(slug: Column, content_sha: Column, ordinal: Column) -> Column:
    return _cite("postmortem", slug, F.lit("@"), F.substring(content_sha, 1, 8), F.lit("#"), ordinal.cast("string"))


def kind(cite: Column) -> Column:
    """The kind of a well-formed citation, else null. A rollup's time must be a real one."""
    found = F.lit(None).cast("string")
    for name, pattern in GRAMMAR.items():
        fits = cite.rlike(rf"\A{pattern}\z")
        if name == "rollup":
            stamp = F.regexp_extract(cite, r"\Arollup:[^/]*/([^/]*)/", 1)
            real = F.date_format(F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")), "yyyy-MM-dd'T'HH:mm:ss'Z'") == stamp
            fits = fits & F.coalesce(real, F.lit(False))
        found = F.when(fits, F.lit(name)).otherwise(found)
    return found


def components(cite: Column) -> Column:
    """The parts after the kind, in the grammar's order; null for what isn't well formed."""
    body = F.regexp_extract(cite, r"(?s)\A[^:]*:(.*)\z", 1)
    split = F.when(F.startswith(cite, F.lit("postmortem:")), F.split(body, "[@#]")).otherwise(F.split(body, "/"))
    return F.when(kind(cite).isNotNull(), split)


def well_formed(cite: Column) -> Column:
    return F.coalesce(kind(cite).isNotNull(), F.lit(False))
