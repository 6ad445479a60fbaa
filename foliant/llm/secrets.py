"""Secret scans: fixed patterns, and a count over the corpus that tells live secrets from copied examples.

Every text is scanned for three base kinds (assign, access, hex), and for long mixed tokens. The
values of all four (of assign what is assigned, so one value has one hash in whatever kind it is
found) are hashed wherever they occur, tokens also where a base span touches them, and counted
over the corpus by distinct repositories and owners. A value that several owners have, or more than ``MOST_REPOSITORIES`` repositories of one
owner, is a copied example; any other looks live. Spans of base kinds always stay, those of live
tokens that no base span touches are added as kind ``token``; ``verdicts`` says of each found span which it is.

Counting goes by hash, owner and repository first, so that a hash which fills a third of the
corpus is summed in every task before it meets in one; the found spans are joined to the copied
hashes only, salted where those are too many to broadcast. Null texts count as empty, a null owner as one
owner; repeated rows are each scanned. Positions are code points.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.runtime import join_dimension, materialize

KINDS = ("assign", "access", "hex", "token")
#: Kind of a token that a base span touches: counted, but no span of its own.
TOUCHED = 4
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: A token that more owners have is an example that was copied.
MOST_OWNERS = 1
#: A token that more repositories have is one, too, even if they have one owner.
MOST_REPOSITORIES = 10
LEAST_ENTROPY = 3.2

_hex_only = bytes(120 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
_token_only = bytes(120 if chr(b).isascii() and (chr(b).isalnum() or chr(b) in "+/_=-") else 32 for b in range(256))
_words = (b"password", b"passwd", b"secret", b"token", b"api")

Span = tuple[int, int, int]  # start, kind, end


def base_spans(text: str, data: bytes) -> list[Span]:
    """Matches of the base kinds, in order. Cheap tests tell which patterns can match at all."""
    out: list[Span] = []
    low = data.lower()
    if any(w in low for w in _words):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in data:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if b"x" * 24 in data.translate(_hex_only):
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(out)


def digest(value: str) -> str:
    return hashlib.sha256(value.encode()).hexdigest()[:32]


def value(text: str, span: Span) -> str:
    """The secret in a base span: of an assignment what is assigned, else all of it."""
    start, kind, end = span
    return ASSIGN.match(text, start, end)[2] if kind == 0 else text[start:end]


def candidates(text: str, data: bytes, base: list[Span]) -> list[tuple[int, int, int, str]]:
    """Start, kind, end and hash of long tokens of mixed characters."""
    if b"x" * 20 not in data.translate(_token_only):
        return []
    out = []
    for m in TOKEN.finditer(text):
        s = m[0]
        if not (any(c.isdigit() for c in s) and any(c.isalpha() for c in s)):
            continue
        if -sum(v / len(s) * math.log2(v / len(s)) for v in Counter(s).values()) >= LEAST_ENTROPY:
            touched = any(a < m.end() and b > m.start() for a, _, b in base)
            out.append((m.start(), TOUCHED if touched else 3, m.end(), digest(s)))
    return out


_SCANNED = "doc_id long, repository string, owner string, n_assign long, n_access long, n_hex long, base string, found array<struct<start:int,kind:int,end:int,hash:string>>"
_FOUND = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("hash", pa.string())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, base, found = ([], [], []), [], []
        for cell in batch.column("text"):
            text = cell.as_py() or ""
            data = text.encode()
            spans = base_spans(text, data)
            for k in range(3):
                n[k].append(sum(1 for s in spans if s[1] == k))
            base.append(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans))
            own = [{"start": s[0], "kind": s[1], "end": s[2], "hash": digest(value(text, s))} for s in spans]
            found.append(own + [{"start": a, "kind": k, "end": b, "hash": h} for a, k, b, h in candidates(text, data, spans)])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("repository"), batch.column("owner"), *(pa.array(x, pa.int64()) for x in n), pa.array(base, pa.string()), pa.array(found, _FOUND)], ["doc_id", "repository", "owner", "n_assign", "n_access", "n_hex", "base", "found"])


def ownership(found: DataFrame) -> DataFrame:
    """hash, n_repositories, n_owners of rows (hash, repository, owner)."""
    by_pair = found.groupBy("hash", "owner", "repository").agg(F.lit(1).alias("one"))
    by_owner = by_pair.groupBy("hash", "owner").agg(F.count("*").alias("repositories"))
    return by_owner.groupBy("hash").agg(F.sum("repositories").alias("n_repositories"), F.count("*").alias("n_owners"))


def scan(docs: DataFrame, repository: str = "doc_id", owner: str = "source", most_owners: int = MOST_OWNERS, most_repositories: int = MOST_REPOSITORIES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base, spans and verdicts (texts, sorted) of every row.

    ``spans`` has the base spans and the live tokens; ``verdicts`` all of them and the copied
    tokens, each followed by ``live`` or ``copied``.
    """
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col(repository).cast("string"), F.lit("")).alias("repository"), F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"))
    done = materialize(read.mapInArrow(_scan, _SCANNED).withColumn("row", F.monotonically_increasing_id()))
    found = done.where(F.size("found") > 0).select("row", "repository", "owner", F.explode("found").alias("f")).select("row", "repository", "owner", "f.*")
    copied = ownership(found).where((F.col("n_owners") > most_owners) | (F.col("n_repositories") > most_repositories))
    copied = materialize(copied.select("hash", F.lit(True).alias("copied")))
    judged = join_dimension(found.where(F.col("kind") != TOUCHED).select("row", "start", "kind", "end", "hash"), copied, ["hash"], "left")
    more = F.struct("start", "kind", "end", F.coalesce("copied", F.lit(False)).alias("copied"))
    judged = judged.groupBy("row").agg(F.array_sort(F.collect_list(more)).alias("more"))
    kinds = F.array(*map(F.lit, KINDS))
    said = lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])
    spans = F.transform(F.filter("more", lambda s: (s["kind"] < 3) | ~s["copied"]), said)
    verdicts = F.transform("more", lambda s: F.concat_ws(":", said(s), F.when(s["copied"], "copied").otherwise("live")))
    text = lambda c: F.coalesce(F.concat_ws(",", c), F.lit(""))
    return done.join(judged, "row", "left").select("doc_id", "n_assign", "n_access", "n_hex", "base", text(spans).alias("spans"), text(verdicts).alias("verdicts"))
