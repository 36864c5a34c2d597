"""Removal of repeated byte strings by column-wise construction over many documents.

A plain collection index would insert one symbol of each document per round, for as many rounds as the longest document
has bytes. Only matches of ``LENGTH`` bytes count here, so the documents are cut into overlapping pieces of
at most 84 bytes first, each around an anchor: the smallest 16-byte string of every window of 50 bytes. Equal windows have equal
anchors at equal places, so pieces can be dealt into buckets by anchor and aligned on it. A bucket's construction then takes
84 rounds: each inserts one symbol per piece, from the right, and updates the sorted order of the suffixes and their
common prefixes. Pieces whose anchor occurs in one document only are never sent.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Scratch, hash_share, read_table, utf8

LENGTH = 50                      # bytes of a repeated string
ANCHOR = 16                      # bytes of an anchor
SPAN = LENGTH - ANCHOR + 1       # anchor places in a window, and windows in a piece, at most
COLUMNS = SPAN - 1 + LENGTH      # of aligned pieces: 34 bytes before the anchor, 50 from it on
SLICE = 1 << 21                  # bytes worked on at once
FLUSH = 1 << 20                  # anchors a task gathers before it sends them
ANCHOR_BUCKET = 9_000_000        # document bytes per bucket of anchors (about 500,000 anchors)
GROUP = 4_000_000                # document bytes per group that meets its answers
PIECE_BUCKET = 3_000_000         # document bytes per bucket of pieces (about 40,000 pieces)
LEAST = 64                       # buckets of each kind, at least
SAMPLE_BYTES = 8_000_000         # of the sample that finds frequent anchors
FREQUENT = 0.01                  # of the sampled documents
NO_ID = np.iinfo(np.int64).max   # stands for a null id: larger than all
SEVERAL = np.iinfo(np.int64).min # in place of an id: in several documents of one task
U = np.uint64


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def anchor_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the 16 bytes at every place."""
    eight = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 8)).view(np.uint64).ravel()
    return _mix(eight[:-8] * U(0x9E3779B97F4A7C15) ^ np.roll(eight, -8)[:-8] * U(0xC2B2AE3D27D4EB4F))


def pieces_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, frequent: np.ndarray):
    """Pieces of all rows ``data[start:end]``: row, first window, windows, anchor place, anchor hash.

    The anchor of a window is its smallest 16-byte string, by hash, the leftmost if it repeats. A frequent one (a set
    bit in ``frequent``) counts as larger than any other, so that a common passage becomes the anchor of few
    windows outside it. Consecutive windows with the same anchor make a piece.
    """
    if len(data) < LENGTH:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64))
    h = anchor_hashes(data)
    # top bit: frequent; then 39 bits of the hash; then the place
    rare = (h >> U(25)) << U(24) | (frequent[h & U(len(frequent) - 1)].astype(np.uint64) << U(63))
    low = rare | np.arange(len(h), dtype=np.uint64)
    width = 1
    while width * 2 <= SPAN:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < SPAN:
        low = np.minimum(low[:width - SPAN], low[SPAN - width:])
    place = (low & U((1 << 24) - 1)).astype(np.int64)
    long_rows = np.flatnonzero(ends - starts >= LENGTH)
    n = ends[long_rows] - starts[long_rows] - LENGTH + 1
    windows = np.repeat(starts[long_rows] - np.cumsum(n) + n, n) + np.arange(n.sum())
    at = place[windows]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.empty(0, np.int64)
    row = np.repeat(long_rows, n)[first]
    return row, windows[first], np.diff(np.concatenate([first, [len(at)]])), at[first], h[at[first]]


def slices(data: np.ndarray, off: np.ndarray):
    """Row ranges of about ``SLICE`` bytes as (first row, bytes, starts, ends, shift); a longer row in overlapping parts."""
    i = 0
    while i < len(off) - 1:
        j = i + 1
        while j < len(off) - 1 and off[j + 1] - off[i] <= SLICE:
            j += 1
        if off[j] - off[i] <= 2 * SLICE:
            yield i, data[off[i]:off[j]], off[i:j] - off[i], off[i + 1:j + 1] - off[i], 0
        else:
            for s in range(0, int(off[j] - off[i]), SLICE):
                e = min(int(off[j] - off[i]), s + SLICE + LENGTH - 1)
                yield i, data[off[i] + s:off[i] + e], np.array([0]), np.array([e - s]), s
        i = j


def anchor_codes(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 32 more hash bits of an anchor, as one number."""
    m = _mix(h)
    return (((m >> U(32)) * U(buckets)) >> U(32) << U(32) | (m & U(0xFFFFFFFF))).astype(np.int64)


def id_groups(ids: np.ndarray, groups: int) -> np.ndarray:
    """Spark's ``pmod(xxhash64(id), groups)``."""
    rotate = lambda x, r: (x << U(r)) | (x >> U(64 - r))
    p1, p2, p3, p4, p5 = (U(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                                         0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    h = (p5 + U(42 + 8)) ^ (rotate(ids.view(np.uint64) * p2, 31) * p1)
    h = rotate(h, 27) * p1 + p4
    h = (h ^ (h >> U(33))) * p2
    h = (h ^ (h >> U(29))) * p3
    return (h ^ (h >> U(32))).view(np.int64) % groups


def _lists(values: list[np.ndarray], kind) -> pa.Array:
    off = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(values) if values else [], kind))


def _by_key(keys: np.ndarray):
    """Order that sorts by key, the distinct keys, and where each begins and ends in that order."""
    order = np.argsort(keys, kind="stable")
    found, first = np.unique(keys[order], return_index=True)
    return order, found, first, np.append(first[1:], len(keys))


def send_anchors(buckets: int, frequent):
    """Per task: each anchor of the documents at hand, with its document or the mark that it is in several.

    These go to the anchor's bucket. Documents that share an anchor within the task know the answer already (``told``): their
    rows only travel on to their document group, through a bucket chosen by document, so that a passage in very many
    documents sends one row per task into its anchor's bucket and nothing more. ``home`` is a told anchor's own bucket.
    """
    def run(batches):
        def sent():
            code, doc = np.concatenate(codes), np.concatenate(docs)
            order = np.lexsort((doc, code))
            code, doc = code[order], doc[order]
            new = np.concatenate([[True], code[1:] != code[:-1]])
            start = np.flatnonzero(new)
            several = doc[start] != doc[np.append(start[1:], len(doc)) - 1]
            # documents that share an anchor here know the answer without asking; one mark tells the others
            known = several[np.cumsum(new) - 1] & (new | np.concatenate([[True], doc[1:] != doc[:-1]]))
            out = [(code[start], np.where(several, SEVERAL, doc[start]), 0), (code[known], doc[known], 1)]
            for c, d, told in out:
                if len(c):
                    order, found, first, last = _by_key(id_groups(d, buckets) if told else c >> 32)
                    c, d = c[order], d[order]
                    home = [(c[a:b] >> 32).astype(np.int32) if told else np.empty(0, np.int32) for a, b in zip(first, last)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(found.astype(np.int32)), pa.array([bool(told)] * len(found)), _lists(home, pa.int32()),
                         _lists([c[a:b].astype(np.uint32).view(np.int32) for a, b in zip(first, last)], pa.int32()),
                         _lists([d[a:b] for a, b in zip(first, last)], pa.int64())],
                        names=["bucket", "told", "home", "code", "doc"])

        codes, docs, held = [], [], 0
        for batch in batches:
            data, off = utf8(batch["text"])
            ids = batch["k"].to_numpy(zero_copy_only=False)
            for i, part, starts, ends, _ in slices(data, off):
                row, _, _, _, h = pieces_of(part, starts, ends, frequent.value)
                codes.append(anchor_codes(h, buckets))
                docs.append(ids[i + row])
                held += len(row)
                if held >= FLUSH:
                    yield from sent()
                    codes, docs, held = [], [], 0
        if held:
            yield from sent()
    return run


def answer_anchors(groups: int):
    """Per bucket: (document, anchor) wherever the anchor is in more than one document, by document group."""
    def run(table: pa.Table) -> pa.Table:
        told = np.repeat(table["told"].to_numpy(), pc.list_value_length(table["code"]).to_numpy())
        code = np.concatenate([np.asarray(c.flatten()) for c in table["code"].chunks]).view(np.uint32).astype(np.int64)
        doc = np.concatenate([np.asarray(c.flatten()) for c in table["doc"].chunks])
        bucket = table["bucket"][0].as_py()
        ask_code, ask_doc = code[~told], doc[~told]
        order = np.lexsort((ask_doc, ask_code))
        ask_code, ask_doc = ask_code[order], ask_doc[order]
        new = np.concatenate([[True], ask_code[1:] != ask_code[:-1]]) if len(order) else np.empty(0, bool)
        start = np.flatnonzero(new)
        if len(start):
            last = ask_doc[np.append(start[1:], len(ask_doc)) - 1]
            several = (ask_doc[start] != last) | (ask_doc[start] == SEVERAL)
            hit = several[np.cumsum(new) - 1] & (ask_doc != SEVERAL)
            ask_code, ask_doc = ask_code[hit], ask_doc[hit]
        home = np.concatenate([np.asarray(c.flatten()) for c in table["home"].chunks]).astype(np.int64)
        code = np.concatenate([ask_code | (bucket << 32), code[told] | (home << 32)])
        doc = np.concatenate([ask_doc, doc[told]])
        order, found, first, last = _by_key(id_groups(doc, groups))
        code, doc = code[order], doc[order]
        return pa.table({"kg": pa.array(found.astype(np.int32)),
                         "code": _lists([code[a:b] for a, b in zip(first, last)], pa.int64()),
                         "doc": _lists([doc[a:b] for a, b in zip(first, last)], pa.int64())})
    return run


PIECES = ("bucket int, kg int, known boolean, body binary, sizes binary, lefts binary, doc array<long>, "
          "times array<int>, text_hash array<long>, start array<int>, stop array<int>")


def send_pieces(buckets: int, piece_buckets: int, frequent):
    """Per document group: the pieces whose anchor is in several documents, each distinct piece once.

    It goes with its smallest document and the places there. A larger document of the group that has the same piece repeats
    all of it: that is known here and sent as finished intervals.
    """
    def run(key, docs: pa.Table, answers: pa.Table) -> pa.Table:
        kg = key[0].as_py()
        if not len(docs) or not len(answers):
            return _piece_table([])
        asked = np.concatenate([np.asarray(c.flatten()) for c in answers["code"].chunks])
        asked_doc = np.concatenate([np.asarray(c.flatten()) for c in answers["doc"].chunks])
        order = np.argsort(asked_doc, kind="stable")
        asked, asked_doc = asked[order], asked_doc[order]
        docs = docs.combine_chunks().sort_by("k")
        ids, hashes = docs["k"].to_numpy(), docs["th"].to_numpy()
        data, off = utf8(docs["text"].combine_chunks() if docs["text"].num_chunks != 1 else docs["text"].chunk(0))
        held: dict[bytes, list] = {}
        known: list[tuple] = []
        for i, part, starts, ends, shift in slices(data, off):
            row, window, n, place, h = pieces_of(part, starts, ends, frequent.value)
            code = anchor_codes(h, buckets)
            wanted = _wanted(ids[i + row], code, asked_doc, asked)
            bucket = (_mix(code.view(np.uint64)) >> U(11)) % U(piece_buckets)
            raw = part.tobytes()
            for r, w, m, p, c in zip(*(x[wanted].tolist() for x in (row, window, n, place, bucket))):
                body = raw[w:w + m + LENGTH - 1]
                doc, th, at = int(ids[i + r]), int(hashes[i + r]), w - int(starts[r]) + shift
                own = held.get(body)
                if own is None:
                    held[body] = [doc, p - w, c, [th], [at]]
                elif own[0] == doc:
                    own[3].append(th)
                    own[4].append(at)
                elif known and known[-1][:2] == (doc, th) and known[-1][3] >= at:
                    known[-1] = (doc, th, known[-1][2], max(known[-1][3], at + len(body)))
                else:
                    known.append((doc, th, at, at + len(body)))
        rows = []
        dealt: dict[int, list] = {}
        for body, own in held.items():
            dealt.setdefault(own[2], []).append((body, own))
        for bucket, own in dealt.items():
            rows.append((bucket, kg, False, b"".join(b for b, _ in own), bytes(len(b) for b, _ in own),
                         bytes(o[1] for _, o in own), [o[0] for _, o in own], [len(o[3]) for _, o in own],
                         [x for _, o in own for x in o[3]], [x for _, o in own for x in o[4]], []))
        if known:
            doc, th, a, b = zip(*known)
            rows.append((kg % piece_buckets, kg, True, b"", b"", b"", list(doc), [], list(th), list(a), list(b)))
        return _piece_table(rows)
    return run


def _wanted(doc: np.ndarray, code: np.ndarray, asked_doc: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Which (document, anchor) pairs are among the answers; both come grouped by document, ascending."""
    out = np.zeros(len(doc), bool)
    cut = np.concatenate([[0], np.flatnonzero(doc[1:] != doc[:-1]) + 1, [len(doc)]]) if len(doc) else [0]
    for a, b in zip(cut[:-1], cut[1:]):
        lo, hi = np.searchsorted(asked_doc, doc[a]), np.searchsorted(asked_doc, doc[a], side="right")
        if hi > lo:
            out[a:b] = np.isin(code[a:b], asked[lo:hi])
    return out


def _piece_table(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()),
             pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]
    names = [c.split()[0] for c in PIECES.split(", ")]
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)


def column_wise(symbols: np.ndarray, first: np.ndarray, windows: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each aligned piece a bit mask of its windows that also start in a piece of a smaller document.

    ``symbols`` has a row per column and a column per piece: byte + 1, or 0 outside the piece. Each round, from the last
    column to the first, inserts one symbol per piece: a stable sort by the new symbol turns the order of
    the suffixes that start one column later into that of the new ones. The common prefix of neighbours grows by one over the least
    common prefix between them in the old order, or is 0 where the new symbols differ. Neighbours with 50 common symbols have
    equal windows.
    """
    columns, n = symbols.shape
    order = np.arange(n)
    common = np.full(n + 1, LENGTH, np.int16)        # with the piece before; all empty suffixes are equal
    common[0] = 0
    mask = np.zeros(n, np.uint64)
    for c in range(columns - 1, -1, -1):
        symbol = symbols[c][order]
        move = np.argsort(symbol, kind="stable")
        order, symbol = order[move], symbol[move]
        fresh = np.zeros(n + 1, np.int16)
        same = np.flatnonzero(symbol[1:] == symbol[:-1]) + 1
        if len(same):
            between = np.stack([move[same - 1] + 1, move[same] + 1], 1).ravel()
            fresh[same] = np.minimum(np.minimum.reduceat(common, between)[::2] + 1, LENGTH)
        common = fresh
        offset = c - first[order]
        valid = (offset >= 0) & (offset < windows[order])
        if valid.any():
            start = np.flatnonzero(common[:n] < LENGTH)
            own = doc[order]
            least = np.minimum.reduceat(np.where(valid, own, NO_ID), start)
            hit = valid & (np.repeat(least, np.diff(np.append(start, n))) < own)
            mask[order[hit]] |= U(1) << offset[hit].astype(np.uint64)
    return mask


def mask_runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All runs of ones: the mask's index, and the run's first and last bit (bits 0 to 34)."""
    out = []
    index = np.flatnonzero(mask)
    left = mask[index]
    while len(index):
        low = np.log2((left & (~left + U(1))).astype(np.float64)).astype(np.int64)
        rest = left >> low.astype(np.uint64)
        size = np.log2((~rest & (rest + U(1))).astype(np.float64)).astype(np.int64)
        out.append((index, low, low + size - 1))
        left = rest >> size.astype(np.uint64) << (low + size).astype(np.uint64)
        index, left = index[left > 0], left[left > 0]
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64),) * 3


SPANS = "kg int, doc array<long>, text_hash array<long>, start array<int>, stop array<int>"


def find_repeats(table: pa.Table) -> pa.Table:
    """Per bucket of pieces: the intervals that repeat a smaller document, by document group."""
    kg, doc, th, start, stop = (np.empty(0, np.int64) for _ in range(5))
    plain = table.filter(pc.invert(table["known"]))
    flat = lambda t, c: np.concatenate([np.asarray(x.flatten()) for x in t[c].chunks]).astype(np.int64)
    known = table.filter(table["known"])
    if len(known):
        doc, th, start, stop = (flat(known, c) for c in ("doc", "text_hash", "start", "stop"))
        kg = np.repeat(known["kg"].to_numpy(), pc.list_value_length(known["doc"]).to_numpy())
    if len(plain):
        bodies, sizes, lefts = (b"".join(plain[c].to_pylist()) for c in ("body", "sizes", "lefts"))
        size, left = np.frombuffer(sizes, np.uint8).astype(np.int64), np.frombuffer(lefts, np.uint8).astype(np.int64)
        docs, times, hashes, starts = (flat(plain, c) for c in ("doc", "times", "text_hash", "start"))
        groups = np.repeat(plain["kg"].to_numpy(), pc.list_value_length(plain["doc"]).to_numpy())
        n = len(size)
        piece = np.repeat(np.arange(n), size)
        column = np.arange(len(piece)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(SPAN - 1 - left, size)
        symbols = np.zeros((COLUMNS, n), np.uint16)
        symbols[column, piece] = np.frombuffer(bodies, np.uint8).astype(np.uint16) + 1
        mask = column_wise(symbols, SPAN - 1 - left, size - LENGTH + 1, docs)
        hit, low, high = mask_runs(mask)
        # every run at every place of its piece
        at = np.repeat((np.cumsum(times) - times)[hit], times[hit])
        at += np.arange(len(at)) - np.repeat(np.cumsum(times[hit]) - times[hit], times[hit])
        piece, low, high = (np.repeat(x, times[hit]) for x in (hit, low, high))
        kg, doc = np.concatenate([kg, groups[piece]]), np.concatenate([doc, docs[piece]])
        th = np.concatenate([th, hashes[at]])
        start, stop = np.concatenate([start, starts[at] + low]), np.concatenate([stop, starts[at] + high + LENGTH])
    order, found, first, last = _by_key(np.asarray(kg, np.int64))
    doc, th, start, stop = (np.asarray(x, np.int64)[order] for x in (doc, th, start, stop))
    cut = lambda x, t: _lists([x[a:b].astype(t) for a, b in zip(first, last)], pa.int64() if t is np.int64 else pa.int32())
    return pa.table({"kg": pa.array(found.astype(np.int32)), "doc": cut(doc, np.int64), "text_hash": cut(th, np.int64),
                     "start": cut(start, np.int32), "stop": cut(stop, np.int32)})


def remove_spans(text: bool):
    """Per document group: each row's repeated bytes counted and cut out."""
    def run(docs: pa.Table, spans: pa.Table) -> pa.Table:
        found: dict[tuple, list] = {}
        for r in spans.to_pylist():
            for d, t, a, b in zip(r["doc"], r["text_hash"], r["start"], r["stop"]):
                found.setdefault((d, t), []).append((a, b))
        out = []
        for k, th, doc_id, body in zip(*(docs[c].to_pylist() for c in ("k", "th", "doc_id", "text"))):
            raw, last, removed, n, kept = (body or "").encode(), 0, 0, 0, []
            end = -1
            for a, b in sorted(found.get((k, th), ())):
                if a > end:              # touching runs are one run
                    n += 1
                    kept.append(raw[last:a])
                    removed += b - a
                    end = last = b
                elif b > end:
                    removed += b - end
                    end = last = b
            kept = b"".join([*kept, raw[last:]])
            out.append((doc_id, len(raw), removed, n, hashlib.sha256(kept).hexdigest(),
                        kept.decode("utf-8", "replace") if text else None))
        kinds = [docs.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=names)
    return run


def frequent_anchors(rows: DataFrame, total: int, bits: int = 22) -> np.ndarray:
    """A bit set (a byte each) of 16-byte strings that a hundredth of a bounded sample of documents contain.

    Any set gives right results; this one keeps frequent strings from becoming anchors.
    """
    sample = rows.where(hash_share(min(1.0, SAMPLE_BYTES / max(1, total)), 5, "k", "th")).select("text").toArrow()
    seen, n = [], 0
    for body in sample["text"].to_pylist():
        raw = np.frombuffer((body or "").encode(), np.uint8)
        if len(raw) >= ANCHOR:
            n += 1
            seen.append(np.unique(anchor_hashes(raw)))
    flags = np.zeros(1 << bits, np.uint8)
    if n:
        h, times = np.unique(np.concatenate(seen), return_counts=True)
        flags[h[times >= max(8, FREQUENT * n)] & U((1 << bits) - 1)] = 1
    return flags


def remove_repeats(docs: DataFrame, scratch: Scratch, keep_text: bool = True) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and, if asked for, ``kept`` (text) per row.

    A byte goes if it lies in a 50-byte string that also starts in a document with a smaller id. Strings are judged on the input;
    ``n_spans`` counts maximal removed runs. ``kept`` replaces what is no longer UTF-8 at the cuts; the digest is of the bytes.

    Ids are integers (their order decides which copy stays); an id that cannot be cast to a long is an error. Very long
    texts are worked on whole, in slices. A null text is empty; a text below 50 bytes is never touched. Rows that repeat an id are one document: neither
    is smaller than the other. A null id is larger than all others. Empty table: empty result. Other columns are not read.

    Three exchanges: anchors with their documents (about 12 bytes each, one per 18 bytes of text), texts by id group
    (used for the pieces and again for the result), and the distinct pieces. What a task sends is made distinct first, so a
    passage in a third of all documents arrives once per task. Bucket counts follow the input's size.
    """
    spark = docs.sparkSession
    k = F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NO_ID)))
    rows = docs.select("doc_id", "text").withColumn("k", k).withColumn("th", F.xxhash64("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets, groups, piece_buckets = (max(LEAST, int(total // x)) for x in (ANCHOR_BUCKET, GROUP, PIECE_BUCKET))
    frequent = spark.sparkContext.broadcast(frequent_anchors(rows, total))

    asked = rows.select("k", "text").mapInArrow(
        send_anchors(buckets, frequent), "bucket int, told boolean, home array<int>, code array<int>, doc array<long>")
    answers = scratch.write(asked.groupBy("bucket").applyInArrow(
        answer_anchors(groups), "kg int, code array<long>, doc array<long>"), "answers")

    kg = F.pmod(F.xxhash64("k"), F.lit(groups).cast("long")).cast("int")
    grouped = rows.withColumn("kg", kg).select("kg", "k", "th", "doc_id", "text").groupBy("kg")
    send = send_pieces(buckets, piece_buckets, frequent)
    pieces = grouped.cogroup(answers.groupBy("kg")).applyInArrow(
        lambda key, left, right: send(key, left, right), PIECES)
    spans = pieces.groupBy("bucket").applyInArrow(find_repeats, SPANS)
    kind = rows.schema["doc_id"].dataType.simpleString()
    done = grouped.cogroup(spans.groupBy("kg")).applyInArrow(
        remove_spans(keep_text), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string")
    return done if keep_text else done.drop("kept")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents"), Scratch(spark, "op5"), keep_text=False)
