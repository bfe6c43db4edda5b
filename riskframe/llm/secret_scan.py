"""Secret scans with corpus-wide ownership frequency.

Every text is scanned once for candidates.  Each candidate's value is hashed, and the hashes are counted over the
whole corpus: in how many distinct repositories and under how many distinct owners does a value stand?  A value
that many owners share is an example copied from a manual or a licence; one that only one or two owners have and
that looks random is a credential that may be live.

Base kinds are reported whatever their count.  Further kinds (``EXTRA``) are reported only where the value is
specific to its owners.  The text itself is read once and never shuffled; per document a short row with its
candidates goes to the checkpoint folder.  Distinct owners are counted after (hash, owner, repository) is made
distinct within tasks, so a value in a third of all documents sends one row for each task and owner; counts go
back to the candidates over salted keys.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm.batches import bounded, record_batch
from riskframe.llm.registry import llm_query, table
from riskframe.session import cut_lineage

#: Base kinds in their order: pattern, group of the value, its least length (fixed values).
BASE = {
    "assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
#: Further kinds: private key blocks, tokens with a known prefix, signed web tokens, and random-looking strings.
EXTRA = {
    "pem": r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]{0,40}PRIVATE KEY-----",
    "prefixed": r"(?:gh[pousr]_|glpat-|xox[abprs]-|sk_live_|rk_live_|AIza)[A-Za-z0-9_-]{16,}",
    "jwt": r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "random": r"[A-Za-z0-9+/_=-]{20,}",
}
KINDS = [*BASE, *EXTRA]
#: Words that mark a value as made up.
PLACEHOLDER = re.compile("example|sample|dummy|placeholder|changeme|xxxx|your|12345|abcde|test", re.I)
#: Copies of a candidate's hash count when it meets its candidates, so that no task gets all of a common one.
SALTS = 16

_BASE = {k: (re.compile(p, re.A | (re.I if k == "assign" else 0)), g, n) for k, (p, g, n) in BASE.items()}
#: A maximal run of hexadecimal digits is found faster with its least length in the pattern; same matches.
_BASE["hex"] = (re.compile(r"[0-9a-f]{24,}"), 0, 24)
_EXTRA = {k: re.compile(p, re.A) for k, p in EXTRA.items()}


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """``(start, end, kind, value)`` of the base kinds, by start, then kind as listed."""
    found = [(m.start(), m.end(), kind, m.group(group))
             for kind, (pattern, group, least) in _BASE.items() for m in pattern.finditer(text)
             if len(m.group(group)) >= least]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def entropy(value: str) -> float:
    """Bits a character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def looks_live(value: str) -> bool:
    return len(value) >= 12 and any(c.isdigit() for c in value) and any(c.isalpha() for c in value) \
        and entropy(value) >= 3.0 and not PLACEHOLDER.search(value)


def extra_spans(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int, str, str]]:
    """Candidates of the further kinds that look live and touch no span found before them."""
    out, taken = [], sorted(taken)
    for kind, pattern in _EXTRA.items():
        for m in pattern.finditer(text):
            value = m.group()
            if kind == "random" and not (any(c.isdigit() for c in value) and any(c.isalpha() for c in value)
                                         and entropy(value) >= 3.5 and not PLACEHOLDER.search(value)):
                continue
            if not any(a < m.end() and m.start() < b for a, b in taken):
                out.append((m.start(), m.end(), kind, value))
                taken.append((m.start(), m.end()))
    return out


def value_hash(value: str) -> int:
    """64 bits, signed; the value itself is never written."""
    return int.from_bytes(hashlib.blake2b(value.encode(), digest_size=8).digest(), "little", signed=True)


_FOUND = "array<struct<start: int, end: int, kind: string, hash: long, live: boolean>>"


def owner_of(repository: str) -> Column:
    """What stands before the first '/' of a repository's name."""
    return F.substring_index(F.coalesce(F.col(repository).cast("string"), F.lit("")), "/", 1)


def candidates(docs: DataFrame, id: str, text: str, repository: str, owner: str | None) -> DataFrame:
    """``(row, id, repository, owner, found)``: all candidates of every row, in order."""
    repo = F.coalesce(F.col(repository).cast("string"), F.lit(""))
    own = F.coalesce(F.col(owner).cast("string"), F.lit("")) if owner else owner_of(repository)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id).alias("id"), repo.alias("repository"),
                       own.alias("owner"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    struct = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()),
                                 ("hash", pa.int64()), ("live", pa.bool_())]))

    def find(text):
        base = base_spans(text)
        extra = extra_spans(text, [(a, b) for a, b, _, _ in base])
        spans = sorted([*base, *extra], key=lambda x: (x[0], KINDS.index(x[2])))
        return [{"start": a, "end": b, "kind": k, "hash": value_hash(v), "live": looks_live(v)} for a, b, k, v in spans]

    def run(batches):
        for batch in bounded(batches, "text"):
            found = [find(t) if t else [] for t in batch.column("text").to_pylist()]
            yield record_batch(**{c: batch.column(c) for c in ("row", "id", "repository", "owner")},
                               found=pa.array(found, struct))

    return rows.mapInArrow(run, f"row long, id {kind}, repository string, owner string, found {_FOUND}")


def scan(docs: DataFrame, most_owners: int = 2, id: str = "doc_id", text: str = "text", repository: str = "source",
         owner: str | None = None) -> DataFrame:
    """``(id, spans)`` of every row: ``spans`` is an array of (start, end, kind, repositories, owners, live) by
    start, then kind; offsets count code points, ends are exclusive.

    ``live`` says that the value looks random and stands under ``most_owners`` owners at most.  Base kinds are
    always listed, further kinds only where live.  ``owner`` is by default the repository's name up to the first
    '/'.  Null and empty texts have no spans; a null repository or owner counts as the one named ''; repeated rows
    are kept and count as one owner; an empty table gives an empty table; other columns are not read.
    """
    rows = cut_lineage(candidates(docs, id, text, repository, owner))
    each = rows.select("row", "repository", "owner", F.explode("found").alias("f")).select("row", "repository", "owner", "f.*")
    counts = (each.select("hash", "owner", "repository").distinct().groupBy("hash")
              .agg(F.countDistinct("owner").alias("owners"), F.countDistinct("repository").alias("repositories"))
              .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    judged = (each.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(counts, ["hash", "salt"])
              .withColumn("live", F.col("live") & (F.col("owners") <= most_owners))
              .where(F.col("kind").isin(*BASE) | F.col("live")))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    spans = judged.groupBy("row").agg(F.sort_array(F.collect_list(F.struct(
        "start", rank.alias("rank"), "end", "kind", "repositories", "owners", "live"))).alias("spans"))
    kind = "array<struct<start: int, rank: long, end: int, kind: string, repositories: long, owners: long, live: boolean>>"
    return rows.select("row", "id").join(spans, "row", "left").select(
        F.col("id").alias(id), F.coalesce("spans", F.array().cast(kind)).alias("spans"))


def written(spans):
    """Column of spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@llm_query("op6_secret_ownership")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of all documents; ``n_live`` and ``n_copied`` count them by ownership."""
    out = scan(table(spark, folder, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))

    def number(test):
        return F.size(F.filter("spans", test)).cast("long")

    def of_kind(kind):
        return number(lambda s: s["kind"] == kind).alias(f"n_{kind}")

    return out.select(
        "doc_id", *map(of_kind, BASE),
        F.sha2(F.encode(written(base), "UTF-8"), 256).alias("base_sha256"), written("spans").alias("spans"),
        number(lambda s: s["live"]).alias("n_live"), number(lambda s: s["owners"] > 2).alias("n_copied"))
