"""Removal of repeated byte strings: what a ``WINDOW``-byte string covers that starts earlier too.

A suffix array of the whole corpus can't be cut into tasks, so equal windows are brought
together by content first, and sorted where they meet:

1. Each text's windows fall into runs, one for each content-defined anchor (``anchors``). Equal
   windows have equal anchors. Within a batch, a run that an earlier text has as well is removed
   at once, so a passage that fills a third of the corpus is one row for each batch.
2. Runs are dealt by anchor. Of runs with one hash the first leads, and the others meet it, at most
   ``MEMBERS`` of them in one place. Anchors with several different runs are where matches begin or
   end inside of a run.
3. The bytes of those runs are sent once. Runs that follow a leader are removed if their bytes are its
   own. Those of one anchor are joined into a string for each block of anchors. Two-stage
   sorting gives its suffix array: suffixes smaller than their successors are sorted, the rest
   induced. Neighbours with a common prefix of a whole window are equal windows; all but the
   first in (doc_id, start) are removed. Anchors with more than ``HOT_RUNS`` different runs
   would make a block too large: their windows are counted by digest instead, with partial
   aggregation.
4. Each text is cut by the union of its removed windows.

Results are exact: runs are compared by their bytes (in step 1, in a batch; in step 3, beyond), and should
hashes agree where bytes don't, all runs of that anchor are sorted; windows are compared by their
bytes, under hot anchors by a 128-bit digest. Null texts are empty; texts shorter than a
window keep all. Where ids are null or repeat, texts are told apart and ordered by (id, digest of
the text), nulls first; rows that repeat both id and text count once and get equal results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.anchors import WINDOW, runs
from foliant.llm.batches import groups
from foliant.llm.keys import keyed
from foliant.llm.suffixes import common_prefixes, suffix_array
from foliant.runtime import materialize

#: Bytes that are hashed together, and the most different runs of an anchor that are sorted in a block.
PIECE, HOT_RUNS = 1_000_000, 20_000
#: Runs that are compared with their leader in one place.
MEMBERS = 4096
FREE, REMOVED, SORTED, HOT, EQUAL, LEADER, MISFIT = range(7)
_CONTEXTS = "kind byte, h long, r long, part int, doc long, lo long, n int, data binary"
_RUNS = "kind byte, doc long, h long, r long, lo long, n int, part int"
_FOUND = "kind byte, h long, doc long, lo long, n int"


def _sections(texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (text number, offset, bytes) of about PIECE bytes; long texts come in overlapping sections."""
    now, total = [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - WINDOW + 1), PIECE):
            part = t[at : at + PIECE + WINDOW - 1]
            if total + len(part) > PIECE + WINDOW and now:
                yield now
                now, total = [], 0
            now.append((i, at, part))
            total += len(part)
    if now:
        yield now


def _merged(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Joins intervals [lo, hi] of one doc, sorted by (doc, lo), that follow on each other."""
    if not len(doc):
        return doc, lo, hi
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (lo[1:] > hi[:-1] + 1)])
    first = np.flatnonzero(new)
    return doc[first], lo[first], np.maximum.reduceat(hi, first)


def _batch(kind, doc, h, r, lo, n, part=None) -> pa.RecordBatch:
    part = np.zeros(len(doc), np.int32) if part is None else part
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(kind, np.int8)), pa.array(doc, pa.int64()), pa.array(h, pa.int64()), pa.array(r, pa.int64()), pa.array(lo, pa.int64()), pa.array(n, pa.int32()), pa.array(np.asarray(part, np.int32))], ["kind", "doc", "h", "r", "lo", "n", "part"])


def _find_runs(hash_bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 1."""
    mask = np.uint64(2**hash_bits - 1)
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
        doc, h, r, lo, hi, at_text = ([] for _ in range(6))
        for parts in _sections(texts):
            data = np.frombuffer(b"".join(p for _, _, p in parts), np.uint8)
            ends = np.cumsum([len(p) for _, _, p in parts])
            a, b, at, anchor, rolling = runs(data, ends)
            which = np.searchsorted(ends, a, side="right")
            shift = np.array([o for _, o, _ in parts]) - np.concatenate([[0], ends[:-1]])
            at_text.append(np.array([i for i, _, _ in parts])[which])
            doc.append(ids[at_text[-1]])
            h.append(anchor)
            r.append((rolling.hashes(a, b + WINDOW) ^ (at - a).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & mask)
            lo.append(a + shift[which])
            hi.append(b + shift[which])
        if not doc:
            continue
        doc, h, r, lo, hi, at_text = (np.concatenate(x) for x in (doc, h, r, lo, hi, at_text))
        order = np.lexsort([lo, doc, r])
        doc, h, r, lo, hi, at_text = (x[order] for x in (doc, h, r, lo, hi, at_text))
        if not len(doc):
            continue
        first = np.concatenate([[True], r[1:] != r[:-1]])
        start = np.maximum.accumulate(np.where(first, np.arange(len(r)), 0))
        later = (doc != doc[start]) | (lo != lo[start])
        there = np.flatnonzero(later)
        span = lambda i: texts[at_text[i]][lo[i] : hi[i] + WINDOW]
        odd = [i for i, j in zip(there.tolist(), start[there].tolist(), strict=True) if h[i] != h[j] or span(i) != span(j)]
        later[odd] = False
        first[odd] = True
        yield _batch(np.zeros(first.sum(), np.int8), doc[first], h[first].view(np.int64), r[first].view(np.int64), lo[first], (hi - lo + 1)[first])
        gone = np.lexsort([lo[later], doc[later]])
        d, a, b = _merged(doc[later][gone], lo[later][gone], hi[later][gone])
        yield _batch(np.full(len(d), REMOVED, np.int8), d, (d * 2654435761 + a) ^ (a << 20), np.zeros(len(d), np.int64), a, b - a + 1)


def _match_runs(hot_runs: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 2, of rows sorted by h, r, doc, lo."""
    for table in groups(batches, ["h"]):
        kind, doc, h, r, lo, n = (table.column(c).to_numpy() for c in ("kind", "doc", "h", "r", "lo", "n"))
        free = kind == FREE
        gone = _batch(kind[~free], doc[~free], h[~free], r[~free], lo[~free], n[~free])
        if gone.num_rows:
            yield gone
        doc, h, r, lo, n = (x[free] for x in (doc, h, r, lo, n))
        if not len(h):
            continue
        new_h = np.concatenate([[True], h[1:] != h[:-1]])
        new_r = new_h | np.concatenate([[True], r[1:] != r[:-1]])
        start = np.maximum.accumulate(np.where(new_r, np.arange(len(r)), 0))
        later = (doc != doc[start]) | (lo != lo[start])
        group = np.cumsum(new_h) - 1
        different = np.bincount(group[new_r])[group]
        wanted = new_r & (different > 1)
        keep = np.flatnonzero(wanted)
        if len(keep):
            yield _batch(np.where(different > hot_runs, HOT, SORTED)[keep], doc[keep], h[keep], r[keep], lo[keep], n[keep])
        keep = np.flatnonzero(later)
        if len(keep):
            # members of a run stand in order; every MEMBERS of them meet the leader in a part of their own
            part = (np.cumsum(later) - np.cumsum(later)[start])[keep] // MEMBERS
            yield _batch(np.full(len(keep), EQUAL), doc[keep], h[keep], r[keep], lo[keep], n[keep], part)
            new_part = np.concatenate([[True], (start[keep][1:] != start[keep][:-1]) | (part[1:] != part[:-1])])
            lead = start[keep][new_part]
            yield _batch(np.full(len(lead), LEADER), doc[lead], h[lead], r[lead], lo[lead], n[lead], part[new_part])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of runs (doc, text, runs), for step 3."""
    for batch in batches:
        runs_of = batch.column("runs")
        own = runs_of.flatten()
        count = np.diff(runs_of.offsets.to_numpy())
        which = np.repeat(np.arange(batch.num_rows), count)
        lo, n = own.field("lo").to_numpy(), own.field("n").to_numpy()
        data, at, t = [], -1, b""
        for i, a, b in zip(which.tolist(), lo.tolist(), (lo + n - 1 + WINDOW).tolist(), strict=True):
            if i != at:
                at, t = i, (batch.column("text")[i].as_py() or "").encode()
            data.append(t[a:b])
        doc = batch.column("doc").take(pa.array(which))
        yield pa.RecordBatch.from_arrays([*(own.field(k) for k in ("kind", "h", "r", "part")), doc, own.field("lo"), own.field("n"), pa.array(data, pa.binary())], ["kind", "h", "r", "part", "doc", "lo", "n", "data"])


def repeated_windows(doc: np.ndarray, lo: np.ndarray, n: np.ndarray, data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """doc and start of the windows of runs that an earlier window equals, by a suffix array."""
    t = np.frombuffer(b"".join(x.translate(_NEXT) + b"\0" for x in data), np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(x) + 1 for x in data])[:-1]])
    which = np.repeat(np.arange(len(n)), n)
    offset = np.arange(len(which)) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    begins = np.full(len(t), -1, np.int64)
    begins[starts[which] + offset] = np.arange(len(which))
    order = suffix_array(t, WINDOW)
    order = order[begins[order] >= 0]
    equal = common_prefixes(t, order, WINDOW) >= WINDOW
    at = begins[order]
    d, s = doc[which[at]], lo[which[at]] + offset[at]
    group = np.cumsum(~equal)
    by = np.lexsort([s, d, group])
    d, s, group = d[by], s[by], group[by]
    first = np.concatenate([[True], group[1:] != group[:-1]])
    start = np.maximum.accumulate(np.where(first, np.arange(len(d)), 0))
    later = (d != d[start]) | (s != s[start])
    return d[later], s[later]


#: UTF-8 has no bytes above 0xF4, so 0 is free to end a run's bytes.
_NEXT = bytes(min(255, b + 1) for b in range(256))


def _removed(d: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort([s, d])
    d, a, b = _merged(d[order], s[order], s[order])
    return _found(np.full(len(d), REMOVED), np.zeros(len(d)), d, a, b - a + 1)


def _found(kind, h, doc, lo, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(kind, np.int8)), pa.array(np.asarray(h, np.int64)), pa.array(np.asarray(doc, np.int64)), pa.array(np.asarray(lo, np.int64)), pa.array(np.asarray(n, np.int32))], ["kind", "h", "doc", "lo", "n"])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 3, of rows sorted by side and place: runs of one anchor, or a leader and its members."""
    for table in groups(batches, ["side", "place"]):
        kind, h, r, doc, lo, n = (table.column(c).to_numpy() for c in ("kind", "h", "r", "doc", "lo", "n"))
        data = table.column("data").to_pylist()
        own = np.flatnonzero(kind == SORTED)
        if len(own):
            yield _removed(*repeated_windows(doc[own], lo[own], n[own], [data[i] for i in own.tolist()]))
        members = np.flatnonzero(kind == EQUAL)
        if len(members):
            leaders = {(h[i], r[i]): data[i] for i in np.flatnonzero(kind == LEADER).tolist()}
            same = np.array([leaders[h[i], r[i]] == data[i] for i in members.tolist()])
            yield _found(np.where(same, REMOVED, MISFIT), h[members], doc[members], lo[members], n[members])


def _sort_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of anchors, sorted by h, some of which may be there twice."""
    for table in groups(batches, ["h"]):
        doc, lo, n = (table.column(c).to_numpy() for c in ("doc", "lo", "n"))
        yield _removed(*repeated_windows(doc, lo, n, table.column("data").to_pylist()))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A 128-bit digest of each window of hot anchors' runs."""
    for batch in batches:
        w, doc, s = [], [], []
        for d, lo, n, data in zip(*(batch.column(c).to_pylist() for c in ("doc", "lo", "n", "data")), strict=True):
            for i in range(n):
                w.append(hashlib.blake2b(data[i : i + WINDOW], digest_size=16).digest())
                doc.append(d)
                s.append(lo + i)
        yield pa.RecordBatch.from_arrays([pa.array(w, pa.binary()), pa.array(doc, pa.int64()), pa.array(s, pa.int64())], ["w", "doc", "s"])


def removed_windows(docs: DataFrame, hot_runs: int = HOT_RUNS, hash_bits: int = 64) -> DataFrame:
    """doc, lo, n of rows (doc, text): windows that start at lo .. lo + n - 1 of that text are repeats."""
    found = docs.select("doc", "text").mapInArrow(partial(_find_runs, hash_bits), _RUNS)
    matched = materialize(found.repartition("h").sortWithinPartitions("h", "r", "doc", "lo").mapInArrow(partial(_match_runs, hot_runs), _RUNS), release=True)
    out = matched.where(F.col("kind") == REMOVED).select("doc", "lo", "n")
    # the texts are shuffled once for the runs of all kinds
    wanted = matched.where(F.col("kind") != REMOVED)
    per = wanted.groupBy("doc").agg(F.collect_set(F.struct("kind", "h", "r", "part", "lo", "n")).alias("runs"))
    # written before they are dealt, so that the shuffled texts are gone by then
    data = materialize(docs.select("doc", "text").join(per.hint("shuffle_hash"), "doc").mapInArrow(_contexts, _CONTEXTS), release=True)
    hot = not matched.where(F.col("kind") == HOT).isEmpty()
    side = (F.col("kind") == SORTED).cast("int")
    met = data.where(F.col("kind") != HOT).withColumn("side", side).withColumn("place", F.when(F.col("side") == 1, F.col("h")).otherwise(F.xxhash64("h", "r", "part")))
    met = materialize(met.repartition("side", "place").sortWithinPartitions("side", "place").mapInArrow(_meet, _FOUND), release=True)
    out = out.unionByName(met.where(F.col("kind") == REMOVED).select("doc", "lo", "n"))
    misfits = met.where(F.col("kind") == MISFIT).select("h").distinct()
    if not misfits.isEmpty():
        every = data.join(misfits, "h").repartition("h").sortWithinPartitions("h")
        out = out.unionByName(materialize(every.select("h", "doc", "lo", "n", "data").mapInArrow(_sort_blocks, _FOUND), release=True).select("doc", "lo", "n"))
    return out.unionByName(_repeated_by_digest(data.where(F.col("kind") == HOT))) if hot else out


def _repeated_by_digest(data: DataFrame) -> DataFrame:
    """doc, lo, n of the windows of hot anchors' runs that an earlier window equals."""
    windows = materialize(data.mapInArrow(_digests, "w binary, doc long, s long"), release=True)
    # the first document, then the first start in it, by sums that need no row of the others
    first_doc = materialize(windows.groupBy("w").agg(F.min("doc").alias("d"), F.count("*").alias("c")).where("c > 1").select("w", "d"), release=True)
    first = materialize(windows.join(first_doc, "w").where("doc = d").groupBy("w").agg(F.min("doc").alias("d"), F.min("s").alias("f")), release=True)
    return windows.join(first, "w").where("doc != d or s != f").select("doc", F.col("s").alias("lo"), F.lit(1).alias("n"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 4: rows (doc_id, text, gone) with gone as a list of (lo, n)."""
    for batch in batches:
        rows = []
        for d, text, gone in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("gone").to_pylist(), strict=True):
            data = (text.as_py() or "").encode()
            spans = removed_spans(len(data), [(g["lo"], g["n"]) for g in gone or ()])
            kept, at = hashlib.sha256(), 0
            for a, b in spans:
                kept.update(data[at:a])
                at = b
            kept.update(data[at:])
            rows.append({"doc_id": d, "n_bytes": len(data), "n_removed": sum(b - a for a, b in spans), "n_spans": len(spans), "kept_sha256": kept.hexdigest()})
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]))


def removed_spans(size: int, gone: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal byte ranges that the windows starting at lo .. lo + n - 1 cover."""
    out: list[tuple[int, int]] = []
    for lo, n in sorted(gone):
        a, b = lo, min(size, lo + n - 1 + WINDOW)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        elif a < b:
            out.append((a, b))
    return out


def _with_removed(docs: DataFrame, hot_runs: int, hash_bits: int = 64) -> DataFrame:
    rows, _ = keyed(docs)
    per = removed_windows(rows, hot_runs, hash_bits).groupBy("doc").agg(F.collect_list(F.struct("lo", "n")).alias("gone"))
    return rows.join(per.hint("shuffle_hash"), "doc", "left").select("doc_id", "text", "gone")


def digests(docs: DataFrame, hot_runs: int = HOT_RUNS, hash_bits: int = 64) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    return _with_removed(docs, hot_runs, hash_bits).mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def kept_bytes(docs: DataFrame, hot_runs: int = HOT_RUNS) -> DataFrame:
    """doc_id, kept (binary, what is left), spans (array of removed byte ranges)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for d, text, gone in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("gone").to_pylist(), strict=True):
                data = (text or "").encode()
                spans = removed_spans(len(data), [(g["lo"], g["n"]) for g in gone or ()])
                cuts = [0, *(x for s in spans for x in s), len(data)]
                rows.append({"doc_id": d, "kept": b"".join(data[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)), "spans": [{"start": a, "end": b} for a, b in spans]})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("doc_id", pa.int64()), ("kept", pa.binary()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]))

    return _with_removed(docs, hot_runs).mapInArrow(run, "doc_id long, kept binary, spans array<struct<start:long,end:long>>")
