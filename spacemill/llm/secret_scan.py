"""Secret scans: candidate strings by pattern, then told apart by how many owners hold them across the corpus."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from spacemill.llm.common import dropping, lookup, others, salt_of, stage
from spacemill.llm.spans import Span, digest, map_rows

BASE = ("assign", "access", "hex")
#: The base kinds, then what the corpus says of a candidate's value: held by one or few owners, or widely copied.
KINDS = (*BASE, "live", "example")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so this is the run pattern with its length test
_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")


def base_spans(text: str) -> Iterator[tuple[Span, int, int]]:
    """Each base span with the start and end of the value in it."""
    low = text.lower() if ":" in text or "=" in text else ""  # İ changes lengths, not whether an ASCII word occurs
    if low and any(w in low for w in _WORDS):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 6:
                yield ("assign", m.start(), m.end()), m.start(2), m.end(2)
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= 20:
                yield ("access", m.start(), m.end()), m.start(), m.end()
    for m in HEX.finditer(text):
        yield ("hex", m.start(), m.end()), m.start(), m.end()


SCANNED = "n_assign long, n_access long, n_hex long, base_sha256 string, spans array<struct<kind:string,start:int,end:int>>, candidates array<struct<hash:binary,start:int,end:int>>"
RESULT = ("n_assign", "n_access", "n_hex", "base_sha256", "spans")


def _scan(text: str | None) -> dict:
    text = text or ""
    found = list(base_spans(text))
    spans = [s for s, _, _ in found]
    values = {(a, b): hashlib.sha256(text[a:b].encode("utf-8", "surrogatepass")).digest()[:16] for _, a, b in found}
    count = {k: sum(s[0] == k for s in spans) for k in BASE}
    return {
        **{f"n_{k}": n for k, n in count.items()}, "base_sha256": digest(spans, BASE),
        "spans": [{"kind": k, "start": a, "end": b} for k, a, b in spans], "candidates": [{"hash": h, "start": a, "end": b} for (a, b), h in values.items()],
    }


def scan(docs: DataFrame, repository: list[str], owner: list[str], text_col: str = "text", wide_owners: int = 3) -> DataFrame:
    """The columns of docs but for the text, with n_assign, n_access, n_hex, base_sha256 and spans, an array of (kind, start, end, owners, repositories, copies).

    Besides the base spans, each distinct candidate value's span is there as ``live`` or ``example``: ``example``
    where at least wide_owners distinct owners hold the value anywhere in the corpus. Counts are over all rows; nulls in
    the repository or owner columns are values like others. A null text counts as empty; rows that repeat an id are rows of
    their own. Columns with the result's names, in any case, are replaced; others may have any name.
    """
    own = [c for c in others(docs, RESULT) if c != text_col]
    as_key = lambda cols: F.xxhash64(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0null")) for c in cols]) if cols else F.lit(0).cast("long")
    # the passed-on columns ride along in a struct, so that nothing is joined by document and no name clashes
    mine = F.struct(*[F.col(f"`{c}`") for c in own]) if own else F.struct(F.lit(None).cast("int").alias("none"))
    keyed = docs.select(mine.alias("own"), as_key(repository).alias("repository"), as_key(owner).alias("owner"), F.col(text_col).alias("text"))
    kind = StructType([*keyed.schema.fields[:3], *StructType.fromDDL(SCANNED).fields])

    def row(own_, repository_, owner_, text):
        return {"own": own_, "repository": repository_, "owner": owner_, **_scan(text)}

    kept: list[DataFrame] = []
    with dropping(docs.sparkSession, kept):
        seen = stage(map_rows(keyed, row, kind).withColumn("rid", F.monotonically_increasing_id()), "secrets-scanned")
        kept.append(seen)
    cand = seen.select("rid", "repository", "owner", F.explode("candidates").alias("c")).select("rid", "repository", "owner", "c.*")
    per_repo = cand.groupBy("hash", "owner", "repository").agg(F.count("*").alias("copies"))
    per_owner = per_repo.groupBy("hash", "owner").agg(F.count("*").alias("repositories"), F.sum("copies").alias("copies"))
    held = per_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.sum("copies").alias("copies"))
    told = lookup(cand.withColumn("salt", salt_of("rid")), held, "hash", "salt", "inner")
    named = F.when(F.col("owners") >= wide_owners, "example").otherwise("live")
    more = told.groupBy("rid").agg(F.collect_list(F.struct(named.alias("kind"), "start", "end", "owners", "repositories", "copies")).alias("more"))
    none = F.lit(None).cast("long")
    base = F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), none.alias("owners"), none.alias("repositories"), none.alias("copies")))
    plain = seen.where(F.size("candidates") == 0).withColumn("spans", base)
    marked = seen.where(F.size("candidates") > 0).join(more, "rid").withColumn("spans", F.concat(base, "more"))
    cols = [*[F.col("own")[c].alias(c) for c in own], *RESULT]
    return plain.select(*cols).unionByName(marked.select(*cols))


def spans_string(spans, kinds: tuple[str, ...] = KINDS):
    """kind:start:end by start, then kind as listed, then end, comma-joined, of an array column."""
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("a"), F.array_position(F.array(*map(F.lit, kinds)), s["kind"]).alias("k"), s["end"].alias("b"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["a"].cast("string"), s["b"].cast("string"))), ",")
