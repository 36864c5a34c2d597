"""Multinomial logistic regression on TF-IDF vectors, for many training sets at once, by epochs of distributed gradients.

A model is a (run, classifier): one training set, one kind of term. All models take each step together: one pass over
the vectors, one aggregation of gradients by feature, one written table of weights per epoch. The weights of an epoch are all
that the next one needs, so training goes on behind the last written epoch after a stop.

Texts are dealt into blocks by id. A block's distinct terms, with the texts they are in, meet the vocabularies by term once; what they
find goes back to the block, which writes its vectors of each model in columns. An epoch deals blocks and weights by model (a large
model's blocks in several parts, each with the weights): a row moves per feature and part, none per posting.

All sums are of whole numbers (vectors, weights and residuals in millionths), so they do not depend on the order of
tasks: a rerun, another partitioning or a lost executor gives the same weights to the last digit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.config import LABELS
from textloom.operators import metrics as M
from textloom.operators import runs
from textloom.operators import vocabulary as V
from textloom.operators.naive_bayes import counted, tally
from textloom.session import hand_off, scratch_path, ship_code
from textloom.sources.datasets import path_exists

CLASSIFIERS = {"unigram_lr": "unigram_nb", "bigram_lr": "bigram_nb"}    # classifier -> kind of term
MODEL = ["run_name", "classifier"]
UNIT = 1_000_000
RAW_UNIT = 10_000              # of a TF-IDF value before its vector is scaled to length 1
FREQUENT = 1_000               # terms per kind whose rows are broadcast: at most FREQUENT x runs rows each
BIAS = ""                      # the constant feature (no term is empty)
RIDGE = 1.0                    # weight of the squared weights in the loss
EPOCHS, PATIENCE = 4, 2        # epochs at most; a model ends after so many epochs without a better validation score


def whole(value: Column) -> Column:
    """Rounded to a whole number (half up; the same in every engine)."""
    return F.floor(value + 0.5).cast("long")


def postings(df: DataFrame, keep) -> DataFrame:
    """``keep.., classifier, term, tf``: how often each term is in each text."""
    name = F.when(F.col("classifier") == "unigram_nb", "unigram_lr").otherwise("bigram_lr")
    return (counted(df, keep).groupBy(*keep, "classifier", "term").agg(F.sum("tf").alias("tf"))
            .withColumn("classifier", name))


def vocabulary(train: DataFrame, max_features: int = V.MAX_FEATURES) -> DataFrame:
    """``run_name, classifier, term, fid, idf, head`` (written): the terms of each training set, at most ``max_features`` a model.

    ``idf`` is ln((N + 1) / (df + 1)). ``head`` marks the ``FREQUENT`` most frequent terms of each kind over all runs, and the
    constant feature, whose ``idf`` is null.
    """
    tf = postings(train.select("run_name", "doc_id", "text_clean"), ["run_name", "doc_id"])
    n = train.groupBy("run_name").agg(F.count(F.lit(1)).alias("n"))
    return most_frequent(tf.groupBy(*MODEL, "term").agg(F.count(F.lit(1)).alias("df")), n, max_features)


def most_frequent(df: DataFrame, n: DataFrame, max_features: int = V.MAX_FEATURES) -> DataFrame:
    """The ``vocabulary`` of counted terms ``run_name, classifier, term, df`` and the texts ``run_name, n`` of each training set."""
    df = hand_off(df, "linear-df")
    over_runs = hand_off(df.groupBy("classifier", "term").agg(F.sum("df").alias("df")), "linear-terms")      # read three times
    often = V.top_terms(over_runs, ["classifier"], FREQUENT)
    # a row a run, and FREQUENT rows a kind: the terms stay where they are
    kept = V.top_terms(df, MODEL, max_features).join(F.broadcast(n), "run_name").join(
        F.broadcast(often.select("classifier", "term", F.lit(True).alias("head"))), ["classifier", "term"], "left")
    kept = kept.select(*MODEL, "term", F.log((F.col("n") + 1) / (F.col("df") + 1)).alias("idf"), F.coalesce("head", F.lit(False)).alias("head"))
    names = F.explode(F.array(*[F.lit(c) for c in CLASSIFIERS]))
    bias = n.select("run_name", names.alias("classifier"), F.lit(BIAS).alias("term"), F.lit(None).cast("double").alias("idf"), F.lit(True).alias("head"))
    return hand_off(kept.unionByName(bias).withColumn("fid", F.monotonically_increasing_id()), "linear-vocabulary")


def on_terms(rows: DataFrame, table: DataFrame, keys) -> DataFrame:
    """Join on term keys without a hot key: rows of frequent terms meet their (bounded, broadcast) part of ``table`` in the map,
    only the others are dealt by their key. ``rows`` tell frequent terms by ``head``."""
    head = rows.where("head").join(F.broadcast(table.where("head").drop("head")), keys)
    tail = rows.where("not head").join(table.where("not head").drop("head"), keys)
    return head.unionByName(tail)


def vectors(texts: DataFrame, vocab: DataFrame, keep, own_run: bool) -> DataFrame:
    """``run_name, classifier, keep.., fid, head, x``: the TF-IDF vectors of ``texts`` in millionths, scaled to length 1.

    Training texts (``own_run``) have a ``run_name`` and get the vector of that run; other texts one for every run. A
    term's weight is (1 + ln tf) idf; the constant feature is added with weight 1. A row an entry: the training takes ``packed`` instead.
    """
    keys = [*MODEL, "term"] if own_run else ["classifier", "term"]
    tf = postings(texts, [*(["run_name"] if own_run else []), *keep])
    terms = vocab.where(F.col("idf").isNotNull())
    frequent = F.broadcast(terms.where("head").select("classifier", "term", F.lit(True).alias("head")).distinct())
    tf = tf.join(frequent, ["classifier", "term"], "left").withColumn("head", F.coalesce("head", F.lit(False)))
    raw = on_terms(tf, terms, keys).withColumn("raw", whole((1 + F.log("tf")) * F.col("idf") * RAW_UNIT)).where("raw > 0")
    sides = raw.groupBy(*MODEL, *keep).agg(F.sum(F.col("raw") * F.col("raw")).alias("_q"),
                                           F.collect_list(F.struct("fid", "head", "raw")).alias("_v"))
    rows = texts.select(*(["run_name"] if own_run else []), *keep)
    bias = vocab.where(F.col("idf").isNull()).select(*MODEL, "fid")
    if own_run:
        every = rows.join(F.broadcast(bias), "run_name")
    else:                                                   # one value of the query: a row a model
        models = bias.agg(F.collect_list(F.struct(*MODEL, "fid"))).scalar()
        every = rows.withColumn("_b", models).select(*keep, F.inline("_b"))
    constant = every.select(*MODEL, *keep, "fid", F.lit(True).alias("head"), F.lit(UNIT).cast("long").alias("x"))
    terms = sides.select(*MODEL, *keep, F.sqrt(F.col("_q").cast("double")).alias("_n"), F.explode("_v").alias("v")).select(
        *MODEL, *keep, "v.fid", "v.head", whole(F.col("v.raw") / F.col("_n") * UNIT).alias("x"))
    return constant.unionByName(terms.where("x > 0"))


def scores(vecs: DataFrame, weights: DataFrame, keep, n_labels: int, column: str = "w") -> DataFrame:
    """``run_name, classifier, keep.., l``: the class scores of every vector. ``weights``: ``fid, head, <column>`` (long array)."""
    parts = [F.sum(F.col("x") * F.col(column)[i]).cast("double") / (float(UNIT) * UNIT) for i in range(n_labels)]
    return on_terms(vecs, weights.select("fid", "head", column), ["fid"]).groupBy(*MODEL, *keep).agg(F.array(*parts).alias("l"))


BLOCK = 1 << 23                # characters of training texts counted together
ASKED = 1 << 21                # the same of other texts, which have a vector for every model
PART = 1 << 22                 # vector entries of a model that meet its weights in one task step
ROWS = ""                      # in place of a classifier: the row with the vectors of a block


def blocks(batches, size):
    """Tables of about ``size`` characters from batches sorted by ``doc_id``; no id is in two of them."""
    rest = None
    for batch in batches:
        batch = pa.Table.from_batches([batch])
        rest = batch if rest is None else pa.concat_tables([rest, batch])
        while rest.num_rows:
            full = np.cumsum(pc.fill_null(pc.utf8_length(rest["text_clean"]), 0).to_numpy()) >= size
            ids = rest["doc_id"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            cuts = np.flatnonzero(np.diff(ids)) + 1
            cuts = cuts[full[cuts - 1]]
            if not len(cuts):
                break
            yield rest.slice(0, int(cuts[0]))
            rest = rest.slice(int(cuts[0]))
    if rest is not None and rest.num_rows:
        yield rest


def numbered(values):
    """The place of each value among the distinct ones in order (null last), and their number."""
    distinct = pc.unique(values)
    distinct = distinct.take(pc.sort_indices(distinct))
    return pc.index_in(values, value_set=distinct).to_numpy(zero_copy_only=False).astype(np.int64), len(distinct)


def lists(edges, values, kind):
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(values, kind))


def tallies(texts: DataFrame, n_runs: int, size: int) -> DataFrame:
    """The terms of each block of ``texts (run, doc_id, label_id, text_clean)``: ``block, classifier, term, cells, n, runs, df, ids``.

    ``cells`` are the vectors that a term is in, ``n`` how often, ``runs`` and ``df`` in how many texts of which runs. A vector is a
    run, id and label; they are numbered in that order. The row of the classifier ``ROWS`` has of each vector the text (``cells``: the
    run and id, numbered), the label (``n``), the run, the number of rows (``df``) and the id. To be written: another
    evaluation may number the blocks otherwise.
    """
    ship_code(texts.sparkSession)
    kind = texts.schema["doc_id"].dataType.simpleString()
    dealt = texts.select("run", "doc_id", "label_id", "text_clean").repartition("doc_id").sortWithinPartitions("doc_id")
    names = dict(zip(CLASSIFIERS.values(), CLASSIFIERS))

    def count(block, table):
        table = table.combine_chunks()
        run, ids, labels = table["run"].to_numpy().astype(np.int64), table["doc_id"].combine_chunks(), table["label_id"].combine_chunks()
        (doc, n_docs), (label, n_labels) = numbered(ids), numbered(labels)
        key, first, place, rows = np.unique((run * n_docs + doc) * n_labels + label, return_index=True, return_inverse=True, return_counts=True)
        own = run[first]
        group = np.unique(key // n_labels, return_inverse=True)[1]
        whole_list = [0, len(key)]
        head = [pa.array([block], pa.int64()), pa.array([ROWS]), pa.array([""]), lists(whole_list, group, pa.int32()),
                pa.ListArray.from_arrays(pa.array(whole_list, pa.int32()), labels.take(pa.array(first)).cast(pa.int32())),
                lists(whole_list, own, pa.int32()), lists(whole_list, rows, pa.int32()),
                pa.ListArray.from_arrays(pa.array(whole_list, pa.int32()), ids.take(pa.array(first)))]
        columns = ["block", "classifier", "term", "cells", "n", "runs", "df", "ids"]
        yield pa.RecordBatch.from_arrays(head, names=columns)
        for name, term, cells, n in tally(table["text_clean"].combine_chunks(), place):
            if not len(term):
                continue
            of, cell = np.repeat(np.arange(len(term)), cells.value_lengths().to_numpy()), cells.flatten().to_numpy()
            fresh = (np.diff(of, prepend=-1) != 0) | (np.diff(group[cell], prepend=-1) != 0)       # a text counts once
            key = (of * n_runs + own[cell])[fresh]
            at = np.flatnonzero(np.diff(key, prepend=-1))
            edges = np.searchsorted(key[at] // n_runs, np.arange(len(term) + 1))
            none = pa.nulls(len(term), head[-1].type)
            yield from pa.Table.from_arrays(
                [pa.repeat(pa.scalar(block, pa.int64()), len(term)), pa.repeat(names[name], len(term)), term, cells, n.cast(pa.list_(pa.int32())),
                 lists(edges, key[at] % n_runs, pa.int32()), lists(edges, np.diff(np.append(at, len(key))), pa.int32()), none], names=columns).to_batches(10_000)

    def run(batches):
        base = TaskContext.get().partitionId() << 32
        for i, table in enumerate(blocks(batches, size)):
            yield from count(base + i, table)

    return dealt.mapInArrow(run, f"block bigint, classifier string, term string, cells array<int>, n array<int>, runs array<int>, df array<int>, ids array<{kind}>")


VECTORS = ("run int, classifier string, block bigint, edges array<int>, fids array<bigint>, at array<int>, x array<int>, "
           "texts array<int>, labels array<int>")


def by_term(vocab: DataFrame, run_names) -> DataFrame:
    """``classifier, term, head, v``: the runs that keep a term, with its feature and idf there."""
    own = vocab.where(F.col("idf").isNotNull()).select("classifier", "term", "head", F.struct(run_number(run_names).alias("run"), "fid", "idf").alias("v"))
    return own.groupBy("classifier", "term").agg(F.first("head").alias("head"), F.collect_list("v").alias("v"))


def run_number(run_names) -> Column:
    return (F.array_position(F.array(*[F.lit(r) for r in run_names]).cast("array<string>"), F.col("run_name")) - 1).cast("int")


def packed(tallied: DataFrame, vocab: DataFrame, terms: DataFrame, run_names, own_run: bool) -> DataFrame:
    """The ``vectors`` of tallied texts in columns, a row a block and model: ``run_name, classifier, block, edges, fids, at, x, texts, labels, ids``.

    ``terms``: the written ``by_term`` of ``vocab``. Vector i has the entries ``edges[i]`` to ``edges[i + 1]``: features ``fids[at]`` and their values ``x``. ``texts`` numbers its run and id.
    Training texts (``own_run``) without an id have no vector.
    """
    n_runs, ids = len(run_names), tallied.schema["ids"].dataType.simpleString()
    frequent = F.broadcast(terms.where("head").select("classifier", "term", "head"))
    rows = tallied.where(F.col("classifier") != ROWS).select("block", "classifier", "term", "cells", "n")
    rows = rows.join(frequent, ["classifier", "term"], "left").withColumn("head", F.coalesce("head", F.lit(False)))
    none = F.array()               # not null: Spark's Arrow writer goes over all null lists of a batch again at every row
    found = on_terms(rows, terms, ["classifier", "term"]).select(
        "block", "classifier", "cells", "n", F.col("v.run").alias("runs"), F.col("v.fid").alias("fids"), F.col("v.idf").alias("idf"),
        none.cast("array<int>").alias("df"), none.cast(ids).alias("ids"))
    own = tallied.where(F.col("classifier") == ROWS).select(
        "block", "classifier", "cells", "n", "runs", none.cast("array<bigint>").alias("fids"), none.cast("array<double>").alias("idf"), "df", "ids")
    # two rows a run
    bias = {(r.run, r.classifier): r.fid for r in vocab.where("idf is null").select(run_number(run_names).alias("run"), "classifier", "fid").collect()}

    def build(key, table):
        return pa.Table.from_batches(list(pack(key[0], table.combine_chunks())), schema=pa.schema(
            [("run", pa.int32()), ("classifier", pa.string()), ("block", pa.int64()), ("edges", pa.list_(pa.int32())), ("fids", pa.list_(pa.int64())),
             ("at", pa.list_(pa.int32())), ("x", pa.list_(pa.int32())), ("texts", pa.list_(pa.int32())), ("labels", pa.list_(pa.int32())), ("ids", table["ids"].type)]))

    def pack(block, table):
        head = table.filter(pc.equal(table["classifier"], ROWS))
        text, own, times = (head[c].combine_chunks().flatten().to_numpy().astype(np.int64) for c in ("cells", "runs", "df"))
        labels, ids = head["n"].combine_chunks().flatten(), head["ids"].combine_chunks().flatten()
        here = ids.is_valid().to_numpy(zero_copy_only=False) if own_run else np.ones(len(text), bool)
        def vectors_of(r, name, mine, row, cell, tf, n_terms, kept, fids, idf):
            feature, weight = np.full(n_terms, -1), np.zeros(n_terms)
            feature[kept], weight[kept] = fids, idf
            hit = feature[row] >= 0
            row, cell = row[hit], cell[hit]
            raw = np.floor(tf[hit] * weight[row] * RAW_UNIT + 0.5).astype(np.int64)
            row, cell, raw = row[raw > 0], cell[raw > 0], raw[raw > 0]
            start = np.flatnonzero(np.diff(cell, prepend=-1))
            square = np.add.reduceat(raw * raw, start) if len(start) else raw
            length = np.repeat(np.sqrt(square.astype(float)), np.diff(np.append(start, len(cell))))
            x = np.floor(raw / length * UNIT + 0.5).astype(np.int64)
            row, cell, x = row[x > 0], cell[x > 0], x[x > 0]
            used = np.zeros(n_terms, bool)
            used[row] = True
            place = np.cumsum(used) - 1
            constant = np.repeat(mine, times[mine])
            owner = np.append(cell, constant)
            order = np.argsort(owner, kind="stable")
            distinct = np.append(feature[used], bias[r, name])
            at = np.append(place[row], np.full(len(constant), len(distinct) - 1))[order]
            x = np.append(x, np.full(len(constant), UNIT))[order]
            edges = np.searchsorted(owner[order], np.append(mine, mine[-1] + 1))
            one = lambda v, kind: lists([0, len(v)], v, kind)
            return pa.RecordBatch.from_arrays(
                [pa.array([r], pa.int32()), pa.array([name]), pa.array([block.as_py()], pa.int64()), one(edges, pa.int32()), one(distinct, pa.int64()),
                 one(at, pa.int32()), one(x, pa.int32()), one(text[mine], pa.int32()), one(labels.take(pa.array(mine)), pa.int32()), one(ids.take(pa.array(mine)), ids.type)],
                names=["run", "classifier", "block", "edges", "fids", "at", "x", "texts", "labels", "ids"])

        for name in CLASSIFIERS:
            rows = table.filter(pc.equal(table["classifier"], name))
            cells, n, runs, fids, idf = (rows[c].combine_chunks() for c in ("cells", "n", "runs", "fids", "idf"))
            row, kept = (np.repeat(np.arange(rows.num_rows), c.value_lengths().to_numpy().astype(np.int64)) for c in (cells, runs))
            cell, tf = cells.flatten().to_numpy(), 1 + np.log(n.flatten().to_numpy())
            order = np.argsort(cell, kind="stable")
            row, cell, tf = row[order], cell[order], tf[order]
            runs, fids, idf = runs.flatten().to_numpy(), fids.flatten().to_numpy(), idf.flatten().to_numpy()
            for r in (r for r in range(n_runs) if (r, name) in bias):
                mine = np.flatnonzero(here & (own == r)) if own_run else np.arange(len(text))
                if not len(mine):
                    continue
                a, b = np.searchsorted(cell, [mine[0], mine[-1] + 1]) if own_run else (0, len(cell))
                yield vectors_of(r, name, mine, row[a:b], cell[a:b], tf[a:b], rows.num_rows, kept[runs == r], fids[runs == r], idf[runs == r])

    made = found.unionByName(own).groupBy("block").applyInArrow(build, f"{VECTORS}, ids {ids}")
    return made.withColumn("run_name", F.get(F.array(*[F.lit(r) for r in run_names]), F.col("run"))).drop("run")


def entries(row):
    """``edges, fids, at, x`` and the vector of each entry of a packed row."""
    edges, fids, at, x = (row[c].values.to_numpy().astype(np.int64) for c in ("edges", "fids", "at", "x"))
    return edges, fids, at, x, np.repeat(np.arange(len(edges) - 1), np.diff(edges))


BUCKETS = 16                   # packed rows of a model's weights: at most a 16th of its features each
BUCKETED = "run_name string, classifier string, bucket int, fids array<bigint>"


def bucketed(model, fids, values, kinds):
    """Packed rows ``*MODEL, bucket, fids, values..``: one a bucket. ``values``: arrays with a row per feature."""
    bucket = fids & (BUCKETS - 1)
    order = np.lexsort((fids, bucket))
    edges = np.searchsorted(bucket[order], np.arange(BUCKETS + 1))
    own = np.flatnonzero(np.diff(edges))
    edges = np.append(edges[own], len(fids))
    columns = [*(pa.repeat(m, len(own)) for m in model), pa.array(own, pa.int32()), lists(edges, fids[order], pa.int64())]
    for name, kind in kinds.items():
        v = values[name][order]
        columns.append(lists(edges * (v.size // max(1, len(v))), v.ravel(), kind))
    return pa.Table.from_arrays(columns, names=[*MODEL, "bucket", "fids", *kinds])


def added(table, column, width):
    """The distinct ``fids`` of packed rows in order, and their summed rows of ``column``."""
    fids, at = np.unique(table["fids"].combine_chunks().flatten().to_numpy(), return_inverse=True)
    out = np.zeros((len(fids), width), np.int64)
    np.add.at(out, at, table[column].combine_chunks().flatten().to_numpy().reshape(-1, width))
    return fids, out


STATE = f"{BUCKETED}, d array<double>, w array<bigint>, y array<bigint>"
KINDS = {"d": pa.float64(), "w": pa.int64(), "y": pa.int64()}


def start(train: DataFrame, n_labels: int) -> DataFrame:
    """``STATE`` before the first step, all weights 0. ``d``: half the sum of x times its text's sum, plus ``RIDGE``: a separable bound of the
    loss's curvature, so a step of gradient / d never overshoots and there is no rate to tune."""
    def make(key, rows):
        fids, parts = [], []
        for row in rows_of(rows.combine_chunks()):
            _, own, at, x, of = entries(row)
            text = row["texts"].values.to_numpy()[of]
            total = np.bincount(text, x).astype(np.int64)
            fids.append(own)
            parts.append(np.bincount(at, np.floor(x * total[text] / float(UNIT)), len(own)).astype(np.int64))
        fids, at = np.unique(np.concatenate(fids), return_inverse=True)
        part = np.zeros(len(fids), np.int64)
        np.add.at(part, at, np.concatenate(parts))
        return bucketed(key[:2], fids, {"g": part}, {"g": pa.int64()})

    def total(key, table):
        fids, part = added(table, "g", 1)
        zero = np.zeros((len(fids), n_labels), np.int64)
        return bucketed(key[:2], fids, {"d": 0.5 * part[:, 0] / float(UNIT) + RIDGE, "w": zero, "y": zero}, KINDS)

    parts = in_parts(train, part_sizes(train)).select(*MODEL, "_part", "edges", "fids", "at", "x", "texts").groupBy(*MODEL, "_part").applyInArrow(
        make, f"{BUCKETED}, g array<bigint>")
    return parts.groupBy(*MODEL, "bucket").applyInArrow(total, STATE)


def unpacked(state: DataFrame, n_labels: int) -> DataFrame:
    """``run_name, classifier, fid, d, w, y`` of packed weights, a row a feature."""
    rows = state.select(*MODEL, "d", "w", "y", F.posexplode("fids").alias("_i", "fid"))
    own = [F.slice(c, F.col("_i") * n_labels + 1, n_labels).alias(c) for c in ("w", "y")]
    return rows.select(*MODEL, "fid", F.get("d", F.col("_i")).alias("d"), *own)


def rows_of(table):
    """The rows of a table or batch, a dictionary of scalars each."""
    for i in range(table.num_rows):
        yield {c: table[c][i] for c in table.column_names} if isinstance(table, pa.Table) else {c: table.column(j)[i] for j, c in enumerate(table.schema.names)}


def part_sizes(vecs: DataFrame) -> DataFrame:
    """``run_name, classifier, _parts``: a row a model."""
    return F.broadcast(vecs.groupBy(*MODEL).agg(F.ceil(F.sum(F.size("x").cast("long")) / PART).cast("int").alias("_parts")))


def in_parts(vecs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Packed rows with their ``_part`` of the model, of about ``PART`` entries."""
    ship_code(vecs.sparkSession)
    return vecs.join(sizes, MODEL).withColumn("_part", F.pmod(F.xxhash64("block"), F.col("_parts")).cast("int")).drop("_parts")


def by_part(vecs: DataFrame, weights: DataFrame, column: str, make, schema: str) -> DataFrame:
    """``make(key, rows, fids, w)`` of every part of a model: its packed rows, and ``column`` of all the model's packed ``weights``, by feature."""
    sizes = part_sizes(vecs)
    right = weights.join(sizes, MODEL).select(*MODEL, F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), "fids", F.col(column).alias("w"))

    def run(key, rows, table):
        fids, w = (table[c].combine_chunks().flatten().to_numpy() for c in ("fids", "w"))
        order = np.argsort(fids)
        return make(key, rows, fids[order], w.reshape(len(fids), -1)[order] if len(fids) else np.zeros((0, 0), np.int64))

    keys = [*MODEL, "_part"]
    return in_parts(vecs, sizes).groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)


def scored(row, fids, w):
    """The class scores of the vectors of a packed row; a feature without a weight counts nothing."""
    edges, own, at, x, _ = entries(row)
    place = np.searchsorted(fids, own)
    place[place == len(fids)] = 0
    w = np.where((fids[place] == own)[:, None], w[place], 0)
    z = [np.add.reduceat(x * w[:, i][at], edges[:-1]) for i in range(w.shape[1])]
    return np.stack(z, 1) / (float(UNIT) * UNIT)


def packed_scores(vecs: DataFrame, state: DataFrame) -> DataFrame:
    """``run_name, classifier, doc_id, label_id, l``: the class scores of every packed vector under the weights ``w`` of ``state``."""
    kind = vecs.schema["ids"].dataType.elementType.simpleString()

    def make(key, rows, fids, w):
        tables = []
        for row in rows_of(rows.combine_chunks()) if len(fids) else ():
            l = scored(row, fids, w)
            n = len(l)
            tables.append(pa.Table.from_arrays(
                [pa.repeat(row["run_name"], n), pa.repeat(row["classifier"], n), row["ids"].values, row["labels"].values,
                 pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * l.shape[1], pa.int32()), pa.array(l.ravel()))], names=[*MODEL, "doc_id", "label_id", "l"]))
        return pa.concat_tables(tables) if tables else pa.table({"run_name": pa.array([], pa.string()), "classifier": pa.array([], pa.string()),
                                                                "doc_id": pa.array([], rows["ids"].type.value_type), "label_id": pa.array([], pa.int32()),
                                                                "l": pa.array([], pa.list_(pa.float64()))})

    vecs = vecs.select(*MODEL, "block", "edges", "fids", "at", "x", "labels", "ids")
    return by_part(vecs, state, "w", make, f"run_name string, classifier string, doc_id {kind}, label_id int, l array<double>")


def gradient(train: DataFrame, state: DataFrame, labels) -> DataFrame:
    """``BUCKETED, g``: the gradient of the log loss at ``y``, summed over the packed training vectors of each part of a model.

    Every vector of a text has all residuals of that text: of one unless an id repeats with another label.
    """
    k = len(labels)

    def make(key, rows, fids, w):
        g = np.zeros((len(fids), k))
        for row in rows_of(rows.combine_chunks()) if len(fids) else ():
            l = scored(row, fids, w)
            _, own, at, x, of = entries(row)
            e = np.exp(l - l.max(1, keepdims=True))
            total = np.zeros(len(e))
            for i in range(k):
                total = total + e[:, i]
            hit = np.arange(k) == pc.fill_null(row["labels"].values, -1).to_numpy(zero_copy_only=False)[:, None]
            r = np.floor((e / total[:, None] - hit) * UNIT + 0.5).astype(np.int64)
            text = row["texts"].values.to_numpy()
            first, last = np.searchsorted(text, text), np.searchsorted(text, text, "right")
            place = np.searchsorted(fids, own)
            for j in range(int((last - first).max())):
                has = slice(None) if j == 0 else (first + j < last)[of]
                sibling, value = (first + j)[of[has]], x[has]
                for i in range(k):
                    g[place, i] += np.bincount(at[has], np.floor(value * r[:, i][sibling] / float(UNIT) + 0.5), len(own))
        return bucketed(key[:2], fids, {"g": g.astype(np.int64)}, {"g": pa.int64()})

    vecs = train.select(*MODEL, "block", "edges", "fids", "at", "x", "texts", "labels")
    return by_part(vecs, state, "y", make, f"{BUCKETED}, g array<bigint>")


def step(train: DataFrame, state: DataFrame, labels, epoch: int) -> DataFrame:
    """The next weights: an accelerated gradient step from ``STATE``; ``y`` is where the gradient is taken.

    w' = y - (g + RIDGE y) / d and y' = w' + momentum (w' - w), with the momentum (epoch - 1) / (epoch + 2).
    """
    momentum, k = (epoch - 1) / (epoch + 2), len(labels)

    def move(key, own, parts):
        fids, d, w, y = (own[c].combine_chunks().flatten().to_numpy() for c in ("fids", "d", "w", "y"))
        w, y = w.reshape(-1, k), y.reshape(-1, k)
        _, g = added(parts, "g", k)                      # a part has a row for every feature of the model
        new = np.floor(y - (g + RIDGE * y) / d[:, None] + 0.5).astype(np.int64)
        ahead = np.floor(new + momentum * (new - w) + 0.5).astype(np.int64)
        return bucketed(key[:2], fids, {"d": d, "w": new, "y": ahead}, KINDS)

    keys = [*MODEL, "bucket"]
    return state.groupBy(*keys).cogroup(gradient(train, state, labels).groupBy(*keys)).applyInArrow(move, STATE)


def with_label_id(df: DataFrame, labels) -> DataFrame:
    at = F.array_position(F.array(*[F.lit(c) for c in labels]), F.col("label"))
    return df.withColumn("label_id", (at - 1).cast("int")).drop("label")


class Training:
    """The epochs of one training in a folder: ``epoch=<n>`` has the weights, ``scores=<n>`` the validation scores of epoch n.

    A new ``Training`` on the same folder goes on behind the last complete epoch.
    """

    def __init__(self, spark: SparkSession, train: DataFrame, val: DataFrame, labels=LABELS, root: str | None = None,
                 max_features: int = V.MAX_FEATURES, run_names=None):
        """``run_names``: the runs to train, by default all that ``train`` has."""
        self.spark, self.labels = spark, list(labels)
        self.root = root or scratch_path(spark, "linear")
        if run_names is None:
            run_names = sorted(r.run_name for r in train.select("run_name").distinct().collect() if r.run_name is not None)
        self.run_names = list(run_names)
        train = with_label_id(train, self.labels).withColumn("run", run_number(self.run_names)).where("run >= 0")
        counts = self._kept("tallies", lambda: tallies(train, len(self.run_names), BLOCK))
        self.vocab = self._kept("vocabulary", lambda: self._vocabulary(counts, max_features))
        self.terms = self._kept("terms", lambda: by_term(self.vocab, self.run_names))
        self.train = self._kept("train", lambda: packed(counts, self.vocab, self.terms, self.run_names, True).drop("ids"))
        self.val = self._kept("val", lambda: self._asked(val))

    def _vocabulary(self, counts: DataFrame, max_features: int) -> DataFrame:
        name = F.get(F.array(*[F.lit(r) for r in self.run_names]), F.col("_c.runs")).alias("run_name")
        rows = counts.select("classifier", "term", F.explode(F.arrays_zip("runs", "df")).alias("_c"))
        n = rows.where(F.col("classifier") == ROWS).groupBy(name).agg(F.sum("_c.df").alias("n"))
        df = rows.where(F.col("classifier") != ROWS).groupBy(F.col("_c.runs"), "classifier", "term").agg(F.sum("_c.df").alias("df"))
        df = df.select(F.get(F.array(*[F.lit(r) for r in self.run_names]), F.col("runs")).alias("run_name"), "classifier", "term", "df")
        return most_frequent(df, n, max_features)

    def _asked(self, texts: DataFrame) -> DataFrame:
        """The packed vectors of labelled texts under every model."""
        texts = with_label_id(texts, self.labels).withColumn("run", F.lit(0))
        return packed(hand_off(tallies(texts, 1, ASKED), "linear-tallies"), self.vocab, self.terms, self.run_names, False)

    def _kept(self, name: str, make) -> DataFrame:
        """The table of that name, written unless a complete one is there."""
        path = f"{self.root}/{name}"
        if not path_exists(self.spark, f"{path}/_SUCCESS"):
            make().write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.parquet(path)

    def epoch(self, n: int) -> DataFrame:
        """``run_name, classifier, fid, d, w, y``: the weights behind epoch ``n`` (0: the start); models that have ended are not in later epochs."""
        return unpacked(self.state(n), len(self.labels))

    def state(self, n: int) -> DataFrame:
        """The written weights behind epoch ``n`` as ``STATE``."""
        if n == 0:
            return self._kept("epoch=0", lambda: start(self.train, len(self.labels)))
        before = self.state(n - 1)
        if n > PATIENCE:
            before = before.join(F.broadcast(self.running(n - 1)), MODEL)
        train = self.train if n <= PATIENCE else self.train.join(F.broadcast(self.running(n - 1)), MODEL)
        return self._kept(f"epoch={n}", lambda: step(train, before, self.labels, n))

    def validation(self, n: int) -> DataFrame:
        """``run_name, classifier, epoch, macro_f1`` of epoch ``n`` on the validation texts."""
        def make():
            weights = self.state(n)
            val = self.val.join(F.broadcast(weights.select(*MODEL).distinct()), MODEL)     # one row a model
            conf = M.confusion(packed_scores(val, weights), MODEL)
            return M.macro(M.per_class(conf, MODEL), MODEL).select(*MODEL, F.lit(n).alias("epoch"), "macro_f1")
        return self._kept(f"scores={n}", make)

    def history(self, epochs: int) -> DataFrame:
        """All validation scores so far."""
        out = self.validation(1)
        for n in range(2, epochs + 1):
            if path_exists(self.spark, f"{self.root}/scores={n}/_SUCCESS"):
                out = out.unionByName(self.validation(n))
        return out

    def running(self, n: int) -> DataFrame:
        """The models whose best epoch is one of the last ``PATIENCE`` ones behind epoch ``n``."""
        best = runs.best_candidate(self.history(n), MODEL)
        return best.where(F.col("epoch") > n - PATIENCE).select(*MODEL)

    def run(self, epochs: int = EPOCHS) -> "Training":
        """Trains to the end: ``epochs`` epochs, or until no model is running."""
        for n in range(1, epochs + 1):
            if n > PATIENCE and not self.running(n - 1).limit(1).count():
                break
            self.state(n)
            self.validation(n)
        self.epochs = epochs
        return self

    def best(self) -> DataFrame:
        """``run_name, classifier, epoch, macro_f1``: the best kept epoch of each model (the earlier at a tie)."""
        return runs.best_candidate(self.history(self.epochs), MODEL)

    def best_weights(self) -> DataFrame:
        """The weights of each model's best epoch, packed."""
        best = F.broadcast(self.best().select(*MODEL, "epoch"))           # one row a model
        out = None
        for n in range(1, self.epochs + 1):
            if path_exists(self.spark, f"{self.root}/epoch={n}/_SUCCESS"):
                own = self.state(n).select(*MODEL, "fids", "w").join(best.where(F.col("epoch") == n), MODEL)
                out = own if out is None else out.unionByName(own)
        return out

    def score(self, texts: DataFrame) -> DataFrame:
        """``run_name, classifier, epoch, doc_id, label_id, l`` of labelled ``texts`` under every model's best epoch."""
        s = packed_scores(hand_off(self._asked(texts), "linear-asked"), self.best_weights())
        return s.join(F.broadcast(self.best().select(*MODEL, "epoch")), MODEL)
