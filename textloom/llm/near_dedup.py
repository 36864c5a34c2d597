"""MinHash near-dedup: bottom-k sketches of one hash function, inverted lists, exact confirmation."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import Scratch, bitset, blocks, in_bitset, read_table, small, utf8_rows
from .components import connected_components

WORDS = 5
SIMILARITY = 85                # per cent, of intersection to union
SKETCH = 64                    # smallest hash values kept for the estimate
MAX_PARTS = 40                 # hash slices of one document that become keys
SPARE_PARTS = 3
LEAST_PARTS = 10               # in a set of six values, fewer equal slices might all be empty
CACHE = 1 << 18                # distinct words whose hashes a worker remembers
BLOCK = 1 << 20                # bytes worked on at once
COUNT_SLOTS = 1 << 20
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX1
    h = (h ^ (h >> np.uint64(27))) * MIX2
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: list[bytes], known: _WordHashes, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word shingles (A-Z lower-cased, ASCII blanks split).

    A text with fewer words has its whole sequence as one shingle; one without words has none.
    """
    split = [t.lower().split() for t in texts]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    flat = np.fromiter((known[w] for own in split for w in own), np.uint64, int(counts.sum()))
    step = np.uint64(0x9E3779B97F4A7C15)
    m = max(0, len(flat) - words + 1)
    h = np.zeros(m, np.uint64)
    for k in range(words):
        h = h * step + flat[k:k + m]
    h = _mix(h)
    out, start = [], 0
    for n in counts.tolist():
        if n >= words:
            out.append(np.unique(h[start:start + n - words + 1]))
        elif n:
            short = np.uint64(n)
            for w in flat[start:start + n]:
                short = np.uint64((int(short) * int(step) + int(w)) & 0xFFFFFFFFFFFFFFFF)
            out.append(_mix(np.array([short], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
        start += n
    return out


def size_band(n: float) -> int:
    """Bands of set sizes: up to 6, 8, 12, 16, 24, 33 ... shingles, by the square root of two."""
    return max(0, int(np.ceil(2 * np.log2(n / 6) - 1e-9)))


def band_parts(band: int, similarity: int = SIMILARITY) -> int:
    """Hash slices of a band: more than two linked sets of the band can differ in elements."""
    largest = 6 * 2 ** (band / 2)
    differ = int((100 - similarity) / (100 + similarity) * 2 * largest)
    return max(differ + 1 + SPARE_PARTS, LEAST_PARTS) if differ else 0


def slice_keys(values: np.ndarray, similarity: int = SIMILARITY) -> np.ndarray:
    """Keys under which a document's retained hash values are listed.

    The hash range is cut into slices, more of them than linked sets can have differing values: at least one slice is
    the same in both, and so is its key, a hash of all its values. A value that is common by itself (a
    licence line in a third of all texts) thus opens no list. Large sets use the lowest ``MAX_PARTS`` slices
    only, their bottom values: a pair at the threshold misses all of them with a probability below 1e-6. A set is listed in its own
    size band and in that of the largest set it can be linked with.
    """
    n = len(values)
    keys = []
    for band in range(size_band(n), size_band(n * 100 / similarity) + 1) if n else ():
        parts = band_parts(band, similarity)
        if not parts:
            continue
        slot = ((values >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        used = int(np.searchsorted(slot, MAX_PARTS))
        if not used:
            continue
        slot = slot[:used]
        first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
        content = np.add.reduceat(_mix(values[:used] + np.uint64(1)), first)
        keys.append(_mix(content ^ _mix(slot[first] + np.uint64(band << 20))))
    return np.concatenate(keys).view(np.int64) if keys else np.empty(0, np.int64)


def sketch(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """``doc_id, of, n, digest, low, keys`` per row: text hash, set size, digest of the whole set, the smallest
    hash values (upper 32 bits), and the list keys."""
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("of"))

    def run(batches):
        known = _WordHashes()
        for batch in small(batches):
            texts = utf8_rows(batch["text"])
            for a, b in blocks([len(t) for t in texts], BLOCK):
                sets = shingle_sets(texts[a:b], known)
                keys = [slice_keys(s, similarity) for s in sets]
                low = [(s[:SKETCH] >> np.uint64(32)).astype(np.uint32).tobytes() for s in sets]
                digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                off = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(a, b - a), batch["of"].slice(a, b - a),
                     pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(low, pa.binary()),
                     pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(keys)))],
                    names=["doc_id", "of", "n", "digest", "low", "keys"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, of long, n long, digest binary, low binary, keys array<long>")


def estimated(pairs: DataFrame, sketches: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """Pairs whose union sketch does not speak against the threshold (five standard errors below it).

    The smallest values of both sketches together are a uniform sample of the union; the share of them found in both
    sketches estimates the similarity. Set sizes that cannot reach the threshold go as well.
    """
    a = sketches.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("low").alias("la"))
    b = sketches.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("low").alias("lb"))
    both = pairs.join(a, "a").join(b, "b")
    t = similarity / 100

    def run(batches):
        for batch in small(batches):
            keep = []
            for na, nb, la, lb in zip(*(batch[c].to_pylist() for c in ("na", "nb", "la", "lb"))):
                x, y = np.frombuffer(la, np.uint32), np.frombuffer(lb, np.uint32)
                union = np.union1d(x, y)[:SKETCH]
                both = np.isin(union, x) & np.isin(union, y)
                slack = 5 * (t * (1 - t) / len(union)) ** 0.5 if max(na, nb) > SKETCH else 0.02
                keep.append(min(na, nb) >= t * max(na, nb) - 1e-9 and both.mean() >= t - slack)
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "na", "nb", "la", "lb").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, texts: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """Pairs whose full shingle sets reach the threshold."""
    a = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    b = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))

    def run(batches):
        known = _WordHashes()
        last = {}
        for batch in small(batches):
            ta, tb = utf8_rows(batch["ta"]), utf8_rows(batch["tb"])
            keep = []
            for i, j, x, y in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), ta, tb):
                if last.get("a") != i:
                    last = {"a": i, "set": shingle_sets([x], known)[0]}
                x, y = last["set"], shingle_sets([y], known)[0]
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= similarity * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(b, "b").join(a, "a").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def value_counts(texts: DataFrame) -> np.ndarray:
    """How often hash values occur in all ``texts``, by their lowest bits: an order for ``rare_prefixes``.

    Any order gives right results; this one puts the values of large groups of copies last. A task sends one number a slot.
    """
    def run(batches):
        known, total = _WordHashes(), np.zeros(COUNT_SLOTS, np.int64)
        for batch in small(batches):
            body = utf8_rows(batch["text"])
            for a, b in blocks([len(t) for t in body], BLOCK):
                sets = np.concatenate(shingle_sets(body[a:b], known))
                total += np.bincount((sets & np.uint64(COUNT_SLOTS - 1)).astype(np.int64), minlength=COUNT_SLOTS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["slot", "n"])

    got = texts.select("text").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(COUNT_SLOTS, np.int64)
    counts[got["slot"].to_numpy()] = got["n"].to_numpy()
    return counts


def parities(values: np.ndarray) -> np.ndarray:
    """256 bits as four numbers: the parity of how many values fall into each of 256 hash ranges.

    Every value that only one of two sets has flips one bit, so the sets differ in at least as many values as
    their bits do.
    """
    odd = np.bincount((values >> np.uint64(56)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def rare_prefixes(texts: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """``node, label, n, value, place`` and parities ``p0`` to ``p3``: each set's rarest values, as many as can hold the
    first value shared with a linked set, by rising frequency."""
    counts = texts.sparkSession.sparkContext.broadcast(value_counts(texts))

    def run(batches):
        known = _WordHashes()
        for batch in small(batches):
            body = utf8_rows(batch["text"])
            for a, b in blocks([len(t) for t in body], BLOCK):
                values = []
                sets = shingle_sets(body[a:b], known)
                for s in sets:
                    order = np.lexsort((s, counts.value[(s & np.uint64(COUNT_SLOTS - 1)).astype(np.int64)]))
                    values.append(s[order][:len(s) - -(-similarity * len(s) // 100) + 1].view(np.int64))
                times = [len(v) for v in values]
                row = pa.array(np.repeat(np.arange(a, b), times))
                bits = np.repeat(np.stack([parities(s) for s in sets]), times, axis=0)
                yield pa.RecordBatch.from_arrays(
                    [batch["node"].take(row), batch["label"].take(row), pa.array(np.repeat([len(s) for s in sets], times)),
                     pa.array(np.concatenate(values)), pa.array(np.concatenate([np.arange(1, k + 1) for k in times])),
                     *(pa.array(np.ascontiguousarray(bits[:, i])) for i in range(4))],
                    names=["node", "label", "n", "value", "place", "p0", "p1", "p2", "p3"])

    return texts.select("node", "label", "text").mapInArrow(
        run, "node long, label long, n long, value long, place long, p0 long, p1 long, p2 long, p3 long")


def cross_pairs(prefixes: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """Pairs of different components whose sets may be linked: they share a value so early in the common order that
    the values from there on can still reach the overlap that their sizes ask for, and their parities differ in no more
    bits than linked sets can differ in values. Both bounds hold for every linked pair."""
    a, b = (prefixes.select("value", *[F.col(c).alias(f"{c}_{side}") for c in prefixes.columns if c != "value"])
            for side in "ab")
    both = F.col("n_a") + F.col("n_b")
    overlap = F.floor((both * similarity + (99 + similarity)) / (100 + similarity))
    apart = sum((F.bit_count(F.col(f"p{i}_a").bitwiseXOR(F.col(f"p{i}_b"))) for i in range(1, 4)),
                F.bit_count(F.col("p0_a").bitwiseXOR(F.col("p0_b"))))
    fits = ((F.col("label_a") < F.col("label_b")) & (apart <= both - 2 * overlap)
            & (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * similarity)
            & (F.col("n_a") - F.col("place_a") + 1 >= overlap) & (F.col("n_b") - F.col("place_b") + 1 >= overlap))
    return (a.join(b, (a["value"] == b["value"]) & fits)
            .select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct())


def components(docs: DataFrame, scratch: Scratch, similarity: int = SIMILARITY) -> DataFrame:
    """``row, doc_id, of, n, component``: every row of ``docs`` with the number of its component.

    Rows with equal shingle sets form a class; only one row per class goes on. Inverted lists under ``slice_keys`` give
    candidate pairs, in three rounds, each filtered by ``estimated`` and checked by ``confirmed`` on full sets:
    first every row with the smallest row of the list it shares most, then, per list, one row of each
    component found so far with the list's first. A group of copies collapses in these two, so its pairs are never made.
    What still shares a list across components meets once more under its rarest values (``cross_pairs``), which loses no
    link and spares the pairs of a group whose members are all a little below the threshold. Pairs inside one component
    could add no link to the result.
    """
    table = scratch.write(sketch(docs, similarity).withColumn("row", F.monotonically_increasing_id()), "sketches")
    some = table.where("digest IS NOT NULL")
    classes = some.groupBy("digest").agg(F.min("row").alias("node"))
    nodes = some.join(classes, F.col("row") == F.col("node"), "left_semi").withColumnRenamed("row", "node")
    listed = nodes.select("node", F.explode("keys").alias("key"))
    shared = listed.groupBy("key").agg(F.count("*").alias("c"), F.min("node").alias("first")).where("c > 1").drop("c")
    lists = scratch.write(listed.join(shared, "key"), "lists")

    members = lists.select("node").distinct()
    sketches = scratch.write(nodes.join(members, "node", "left_semi").select("node", "doc_id", "of", "n", "low"), "members")
    wanted = sketches.select("node", F.col("doc_id").alias("d"), F.col("of").alias("o"))
    source = docs.select("doc_id", "text").withColumn("of", F.xxhash64("text")).where(in_bitset(bitset(wanted, "o"), F.col("of")))
    texts = scratch.write(
        source.join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("of") == F.col("o")))
        .withColumn("copy", F.row_number().over(Window.partitionBy("node").orderBy("of"))).where("copy = 1")
        .select("node", "text"), "texts")

    def links(pairs: DataFrame, name: str) -> DataFrame:
        return scratch.write(confirmed(estimated(pairs, sketches, similarity), texts, similarity), name)

    stars = lists.where("node != first").groupBy("node", "first").count()
    best = stars.groupBy("node").agg(F.max(F.struct("count", -F.col("first"))).alias("m"))
    edges = links(best.select((-F.col("m.col2")).alias("a"), F.col("node").alias("b")), "links-1")
    labels = scratch.write(connected_components(edges, scratch, "parts-1"), "labels-1")

    for turn in (2, 3):
        named = (lists.select("key", "node").join(labels, "node", "left")
                 .withColumn("label", F.coalesce("label", "node")))
        mixed = (named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
                 .where("lo != hi"))
        left = named.join(mixed, "key")
        if turn == 2:
            one = left.groupBy("key", "label").agg(F.min("node").alias("node"), F.min("lo").alias("lo"))
            hub = one.where("label = lo").select("key", F.col("node").alias("a"))
            pairs = one.where("label != lo").select("key", F.col("node").alias("b")).join(hub, "key")
            pairs = pairs.select("a", "b").distinct()
        else:
            loose = left.select("node", "label").distinct()
            pairs = cross_pairs(rare_prefixes(scratch.write(texts.join(loose, "node"), "loose"), similarity), similarity)
        more = links(pairs, f"links-{turn}")
        edges = edges.unionByName(more)
        labels = scratch.write(connected_components(edges, scratch, f"parts-{turn}"), f"labels-{turn}")

    named = classes.join(labels, "node", "left").select("digest", F.coalesce("label", "node").alias("label"))
    return (table.select("row", "doc_id", "of", "n", "digest").join(named, "digest", "left")
            .select("row", "doc_id", "of", "n", F.coalesce("label", "row").alias("component")))


def near_duplicates(docs: DataFrame, scratch: Scratch, similarity: int = SIMILARITY) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    ``component_id`` is the smallest ``doc_id`` that links lead to, the row's own included; ``kept`` says whether it is the row's own.
    A null, empty or blank text has no shingles and is linked with nothing. A null id is a row like any other, but
    never the smallest; a component without any id has a null ``component_id`` and is kept. Rows that repeat id and text
    share a component and are kept or not together. Empty table: empty result. Other columns are not read.
    """
    found = scratch.write(components(docs, scratch, similarity), "components")
    heads = found.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return found.join(heads, "component").select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def drop_near_duplicates(docs: DataFrame, scratch: Scratch, similarity: int = SIMILARITY) -> DataFrame:
    """The columns of ``docs``, one row of each component: its smallest id, of equal rows any one."""
    found = scratch.write(components(docs, scratch, similarity), "components")
    # the order makes the smallest id win, a null id last
    head = found.groupBy("component").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "of")).alias("h"))
    head = head.select(F.col("h.doc_id").alias("__near_id"), F.col("h.of").alias("__near_of"), F.lit(1).alias("__near_in"))
    names = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select(*names, F.xxhash64("text").alias("__near_hash"))
    joined = keyed.join(head.groupBy("__near_id", "__near_of").count().withColumnRenamed("count", "__near_n"),
                        keyed["doc_id"].eqNullSafe(F.col("__near_id")) & (F.col("__near_hash") == F.col("__near_of")))
    place = F.row_number().over(Window.partitionBy("doc_id", "__near_hash").orderBy(F.lit(1)))
    return joined.withColumn("__near_place", place).where("__near_place <= __near_n").select(*names)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), Scratch(spark, "op9"))
