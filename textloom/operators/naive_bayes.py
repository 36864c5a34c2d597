"""Multinomial naive Bayes for many training sets at once, on words and on word pairs.

A run is one training set. All runs are counted in one pass; the test rows, in blocks, meet the counts of all runs in one exchange by
(classifier, term) and are summed in one by block: no loop over runs, no text is cut and no row is skipped.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.config import ALPHAS, CLASSIFIERS, LABELS
from textloom.session import hand_off, ship_code


def grams(df: DataFrame, keep) -> DataFrame:
    """``keep.., classifier, term``: every word of ``text_clean`` and every pair of neighbouring words."""
    uni, bi = (F.lit(c).alias("classifier") for c in CLASSIFIERS)
    d = df.select(*keep, F.split("text_clean", " ").alias("_w"))
    last = F.size("_w") - 1
    pairs = F.when(last > 0, F.transform(
        F.sequence(F.lit(0), F.greatest(last - 1, F.lit(0))),
        lambda i: F.struct(bi, F.concat_ws(" ", F.get("_w", i), F.get("_w", i + 1)).alias("term"))))
    words = F.transform("_w", lambda w: F.struct(uni, w.alias("term")))
    both = F.explode(F.concat(words, F.coalesce(pairs, F.array().cast(
        "array<struct<classifier:string,term:string>>"))))
    return d.select(*keep, both.alias("_g")).select(*keep, "_g.classifier", "_g.term")


def per_label(value: Column, labels=LABELS) -> list[Column]:
    """One sum per label, in label order."""
    return [F.sum(F.when(F.col("label") == c, value).otherwise(0)) for c in labels]


def labels_of(label_map: DataFrame) -> list[str]:
    """The labels of a label map in the order of their ids. A classifier has one score per label, so they are few."""
    return [r.label for r in label_map.orderBy("label_id").collect()]


SLICE = 1 << 23            # characters of text counted at once


def counted(df: DataFrame, keep) -> DataFrame:
    """``keep.., classifier, term, tf``: the ``grams`` of ``df``, counted within slices of rows (a key may come from several slices).

    The same terms as ``grams``, but words are numbers while they are counted, and a row leaves a task per distinct term
    of a slice and not per word.
    """
    ship_code(df.sparkSession)
    keep = list(keep)
    rows = df.select(*keep, "text_clean")

    def count(batch):
        own = list(zip(*(batch[c].to_pylist() for c in keep)))
        number = {k: i for i, k in enumerate(dict.fromkeys(own))}
        first = {k: i for i, k in reversed(list(enumerate(own)))}
        at = pa.array([first[k] for k in number], pa.int64())
        words = pc.split_pattern(batch["text_clean"].cast(pa.large_string()), " ")
        row = pc.list_parent_indices(words).to_numpy()
        key = np.array([number[k] for k in own], np.int64)[row]
        coded = words.flatten().dictionary_encode()
        code, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        size = max(1, len(names))
        near = row[:-1] == row[1:]
        for name, cell in ((CLASSIFIERS[0], key * size + code),
                           (CLASSIFIERS[1], ((key[:-1] * size + code[:-1]) * size + code[1:])[near])):
            cell, n = np.unique(cell, return_counts=True)
            cell, term = np.divmod(cell, size)
            term = names.take(pa.array(term))
            if name == CLASSIFIERS[1]:
                cell, before = np.divmod(cell, size)
                term = pc.binary_join_element_wise(names.take(pa.array(before)), term, pa.scalar(" ", pa.large_string()))
            of = at.take(pa.array(cell))
            columns = [*(batch[c].take(of) for c in keep), pa.repeat(name, len(n)), term.cast(pa.string()), pa.array(n, pa.int64())]
            yield from pa.Table.from_arrays(columns, names=[*keep, "classifier", "term", "tf"]).to_batches(10_000)

    def run(batches):
        for batch in batches:
            for a, b in slices(pc.fill_null(pc.utf8_length(batch["text_clean"]), 0).to_numpy(zero_copy_only=False)):
                yield from count(batch.slice(a, b - a))

    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, ", ".join([*[f"{c} {types[c]}" for c in keep], "classifier string, term string, tf long"]))


def slices(lengths):
    """Consecutive row ranges whose texts have about ``SLICE`` characters."""
    part = np.cumsum(lengths) // SLICE
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1), len(lengths)]
    return [(int(a), int(b)) for a, b in zip(edges, edges[1:]) if b > a]


def tally(texts, place):
    """Per classifier of texts at places (numbers, a text's place may be another's): the name, the distinct terms, and a list of
    places and of counts per term."""
    words = pc.split_pattern(texts.cast(pa.large_string()), " ")
    row = pc.list_parent_indices(words).to_numpy()
    coded = words.flatten().dictionary_encode()
    code, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    size, many, at = max(1, len(names)), int(place.max(initial=0)) + 1, place[row]
    near = row[:-1] == row[1:]
    for name, key in ((CLASSIFIERS[0], code * many + at), (CLASSIFIERS[1], ((code[:-1] * size + code[1:]) * many + at[:-1])[near])):
        key, n = np.unique(key, return_counts=True)
        term, of = np.divmod(key, many)
        first = np.flatnonzero(np.diff(term, prepend=-1))
        term = term[first]
        if name == CLASSIFIERS[1]:
            before, term = np.divmod(term, size)
            term = pc.binary_join_element_wise(names.take(pa.array(before)), names.take(pa.array(term)), pa.scalar(" ", pa.large_string()))
        else:
            term = names.take(pa.array(term))
        edges = pa.array(np.append(first, len(key)), pa.int32())
        yield (name, term.cast(pa.string()), pa.ListArray.from_arrays(edges, pa.array(of, pa.int32())),
               pa.ListArray.from_arrays(edges, pa.array(n, pa.int64())))


TALLY = "classifier string, term string, block int, cells array<int>, n array<bigint>"


def tallied(texts, place, block=None):
    """``TALLY`` batches of a slice of texts."""
    for name, term, cells, n in tally(texts, place):
        columns = [pa.repeat(name, len(term)), term, pa.array([block], pa.int32()).take(pa.repeat(0, len(term))), cells, n]
        yield from pa.Table.from_arrays(columns, names=["classifier", "term", "block", "cells", "n"]).to_batches(10_000)


def merged(batches, n_cells):
    """Per batch of ``TALLY`` rows, each term's together and its null blocks (training counts) first: ``(batch, owners, cells, n,
    closed, rows, at)``.

    ``owners``: a row of each term with training counts, ``cells`` and ``n``: its summed counts; the first ``closed`` of them have no
    rows in later batches. ``rows``: the rows with a block, ``at``: their term among the owners (-1: a term without training counts).
    """
    carry = None
    for batch in batches:
        if carry is not None:
            batch = pa.Table.from_batches([carry, batch]).combine_chunks().to_batches()[0]
        if not batch.num_rows:
            continue
        codes = [batch[c].dictionary_encode().indices.to_numpy() for c in ("classifier", "term")]
        group = np.append(0, np.cumsum((codes[0][1:] != codes[0][:-1]) | (codes[1][1:] != codes[1][:-1])))
        own = batch["block"].is_null().to_numpy(zero_copy_only=False)
        train = batch.filter(pa.array(own))
        key = np.repeat(group[own], train["cells"].value_lengths().to_numpy()) * n_cells + train["cells"].flatten().to_numpy()
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        key, n = key[first], np.add.reduceat(train["n"].flatten().to_numpy()[order], first) if len(first) else np.zeros(0, np.int64)
        groups, first = np.unique(key // n_cells, return_index=True)
        edges = pa.array(np.append(first, len(key)), pa.int32())
        cells = pa.ListArray.from_arrays(edges, pa.array(key % n_cells, pa.int32()))
        n = pa.ListArray.from_arrays(edges, pa.array(n, pa.int64()))
        owners = np.searchsorted(group, groups)
        still = int(len(groups) > 0 and groups[-1] == group[-1])
        carry = None
        if still:
            row = batch.slice(int(owners[-1]), 1)
            carry = pa.RecordBatch.from_arrays([row["classifier"], row["term"], pa.array([None], pa.int32()), cells[-1:], n[-1:]], schema=batch.schema)
        rows = np.flatnonzero(~own)
        at = np.searchsorted(groups, group[rows])
        at[np.append(groups, -1)[at] != group[rows]] = -1
        yield batch, owners, cells, n, len(groups) - still, rows, at
    if carry is not None:
        yield carry, np.zeros(1, np.int64), carry["cells"], carry["n"], 1, np.zeros(0, np.int64), np.zeros(0, np.int64)


HITS = "block int, classifier string, cells array<int>, n array<bigint>, docs array<int>, tf array<bigint>"


def matched(rows: DataFrame, n_runs: int, width: int) -> DataFrame:
    """``HITS``: the rows with a block of terms with training counts, ``cells`` and ``n`` those counts, and per task and classifier one
    row without a block: all cells and their counts, all runs and their distinct terms.

    The rows are dealt once, by term. A term has a row a slice of texts at most, however frequent it is.
    """
    n_cells = n_runs * width

    def run(batches):
        sums: dict = {}
        for batch, owners, cells, n, closed, hits, at in merged(batches, n_cells):
            kind = batch["classifier"].take(pa.array(owners[:closed])).dictionary_encode()
            of = np.repeat(np.arange(closed), cells[:closed].value_lengths().to_numpy())
            cell, count = cells[:closed].flatten().to_numpy(), n[:closed].flatten().to_numpy()
            fresh = np.diff(of * n_runs + cell // width, prepend=-1) > 0
            which = kind.indices.to_numpy()[of]
            for i, name in enumerate(kind.dictionary.to_pylist()):
                total, vocab = sums.setdefault(name, (np.zeros(n_cells, np.int64), np.zeros(n_runs, np.int64)))
                np.add.at(total, cell[which == i], count[which == i])
                vocab += np.bincount(cell[fresh & (which == i)] // width, minlength=n_runs)
            hits, at = pa.array(hits[at >= 0]), pa.array(at[at >= 0])
            found = batch.take(hits)
            yield pa.RecordBatch.from_arrays([found["block"], found["classifier"], cells.take(at), n.take(at), found["cells"], found["n"]],
                                             names=["block", "classifier", "cells", "n", "docs", "tf"])
        for name, (total, vocab) in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([None], pa.int32()), pa.array([name]), pa.array([np.arange(n_cells)], pa.list_(pa.int32())), pa.array([total], pa.list_(pa.int64())),
                 pa.array([np.arange(n_runs)], pa.list_(pa.int32())), pa.array([vocab], pa.list_(pa.int64()))], names=["block", "classifier", "cells", "n", "docs", "tf"])

    return by_term(rows).mapInArrow(run, HITS)


def by_term(rows: DataFrame) -> DataFrame:
    """``rows`` dealt by term, each term's together, rows without a block first. Sorted by a hash first: numbers, not long strings, are compared."""
    return rows.repartition("classifier", "term").sortWithinPartitions(
        F.xxhash64("classifier", "term"), "classifier", "term", F.col("block").asc_nulls_first())


def totals(hits: DataFrame, run_names, k: int) -> DataFrame:
    """``run_name, run, classifier, vocab, total, n_train, rows`` from the rows without a block: one row per run and classifier."""
    width, own = k + 1, hits.where("block is null")
    cells = own.select("classifier", F.explode(F.arrays_zip("cells", "n")).alias("_c")).select(
        "classifier", F.floor(F.col("_c.cells") / width).cast("int").alias("run"), (F.col("_c.cells") % width).alias("label"), F.col("_c.n").alias("n"))
    sums = cells.groupBy("classifier", "run").agg(F.array(*per_label(F.col("n"), range(1, width))).alias("total"), F.sum("n").alias("n"))
    vocab = own.select("classifier", F.explode(F.arrays_zip("docs", "tf")).alias("_v")).groupBy(
        "classifier", F.col("_v.docs").alias("run")).agg(F.sum("_v.tf").alias("vocab")).where("vocab > 0")
    rows = sums.where(F.col("classifier") == ROWS).select("run", F.col("n").alias("n_train"), F.col("total").alias("rows"))
    name = F.get(F.array(*[F.lit(r) for r in run_names]), F.col("run"))
    return vocab.where(F.col("classifier") != ROWS).join(sums.drop("n"), ["classifier", "run"]).join(rows, "run").select(
        name.alias("run_name"), "run", "classifier", "vocab", "total", "n_train", "rows")


ROWS = ""            # in place of a classifier: the term without words, whose counts are the training rows


@dataclass
class Model:
    """Counts of many training sets, slice by slice (``TALLY``; a cell is a run and a label), summed where they meet the tested texts.

    Unpacks as ``(terms, params)``. ``terms``: counts per label of each (run, classifier, term); ``params``: per (run, classifier) the
    term total and rows per label, the number of distinct terms and of rows.
    """
    slices: DataFrame
    run_names: list
    labels: list

    @property
    def width(self) -> int:
        return len(self.labels) + 1

    def __iter__(self):
        return iter((self.terms(), self.params()))

    def terms(self) -> DataFrame:
        width, n_cells = self.width, len(self.run_names) * self.width

        def run(batches):
            for batch, owners, cells, n, closed, _, _ in merged(batches, n_cells):
                own = batch.take(pa.array(owners[:closed]))
                yield pa.RecordBatch.from_arrays([own["classifier"], own["term"], cells[:closed], n[:closed]], names=["classifier", "term", "cells", "n"])

        rows = by_term(self.slices.where(F.col("classifier") != ROWS)).mapInArrow(run, "classifier string, term string, cells array<int>, n array<bigint>")
        runs = F.array_distinct(F.transform("cells", lambda c: F.floor(c / width).cast("int")))
        rows = rows.select("classifier", "term", F.map_from_arrays("cells", "n").alias("_n"), F.explode(runs).alias("_r"))
        counts = [F.coalesce(F.try_element_at("_n", F.col("_r") * width + i), F.lit(0)) for i in range(1, width)]
        return rows.select(F.get(F.array(*[F.lit(r) for r in self.run_names]), F.col("_r")).alias("run_name"), "classifier", "term", F.array(*counts).alias("n"))

    def params(self) -> DataFrame:
        return totals(matched(self.slices, len(self.run_names), self.width), self.run_names, len(self.labels)).drop("run")


def fit(train: DataFrame, labels=LABELS, run_names=None) -> Model:
    """The counts of ``train (run_name, label, text_clean)``. ``labels``: the classes by id, such as ``labels_of`` a map;
    ``run_names``: the runs to count, by default all that ``train`` has.

    Each task counts its texts, of all runs at once, in Arrow columns: a row leaves it per distinct term of a slice of texts, with the
    cells (run and label) it was counted in. Nothing is cut.
    """
    ship_code(train.sparkSession)
    if run_names is None:
        run_names = sorted(r.run_name for r in train.select("run_name").distinct().collect() if r.run_name is not None)
    width = len(labels) + 1
    run_id = F.array_position(F.array(*[F.lit(r) for r in run_names]).cast("array<string>"), F.col("run_name")) - 1
    label_id = F.coalesce(F.array_position(F.array(*[F.lit(c) for c in labels]), F.col("label")), F.lit(0))
    rows = train.select((run_id * width + label_id).cast("int").alias("cell"), "text_clean")

    def run(batches):
        for batch in batches:
            batch = batch.filter(pc.fill_null(pc.greater_equal(batch["cell"], 0), False))
            if not batch.num_rows:
                continue
            cell = batch["cell"].to_numpy().astype(np.int64)
            at, n = np.unique(cell, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([ROWS]), pa.array([""]), pa.array([None], pa.int32()), pa.array([at], pa.list_(pa.int32())),
                                              pa.array([n], pa.list_(pa.int64()))], names=["classifier", "term", "block", "cells", "n"])
            for a, b in slices(pc.fill_null(pc.utf8_length(batch["text_clean"]), 0).to_numpy(zero_copy_only=False)):
                yield from tallied(batch["text_clean"].slice(a, b - a), cell[a:b])

    return Model(rows.mapInArrow(run, TALLY), list(run_names), list(labels))


FREQUENT = 4_000     # a term with over 1/FREQUENT of a classifier's postings is joined in the map: at most FREQUENT terms


def frequent_terms(tf: DataFrame) -> DataFrame:
    """``classifier, term, head`` of the terms whose rows of ``tf`` are over 1/``FREQUENT`` of the classifier's: so many at most."""
    many = tf.groupBy("classifier", "term").agg(F.count(F.lit(1)).alias("_m"))
    total = many.groupBy("classifier").agg(F.sum("_m").alias("_t"))
    return many.join(total, "classifier").where(F.col("_m") * FREQUENT > F.col("_t")).select("classifier", "term", F.lit(True).alias("head"))


def with_counts(tf: DataFrame, terms: DataFrame, made: Column | None = None) -> DataFrame:
    """``tf`` joined with the term counts of every run, without a hot key: frequent terms meet their rows (at most
    ``FREQUENT`` x runs a classifier, broadcast) in the map; each of the others has few rows in ``tf``.

    ``made``: a column made of the counts, instead of them; of a frequent term once a run, not once a posting.
    """
    keys = ["classifier", "term"]
    own = [c for c in terms.columns if c not in (*keys, "n")]
    value = F.col("n") if made is None else made
    often = F.broadcast(frequent_terms(tf))
    tf, terms = (d.join(often, keys, "left") for d in (tf, terms))
    head = tf.where("head").drop("head").join(F.broadcast(terms.where("head").select(*keys, *own, value)), keys)
    tail = tf.where("head is null").drop("head").join(terms.where("head is null").drop("head"), keys)
    return head.unionByName(tail.select(*[c for c in tail.columns if c != "n"], value))


BLOCK, BLOCK_ROWS = 1 << 21, 1 << 13     # characters and texts scored in one task step, about


def score(model: Model, test: DataFrame, run_names, keep=("doc_id", "label"), labels=LABELS) -> DataFrame:
    """``run_name, classifier, epoch, keep.., label_id, l``: class scores of every test row under every run.

    ``epoch`` numbers the smoothing candidates. A score is the joint log-probability divided by the number of terms (so
    that long texts do not saturate). A term that the run has not seen counts with the smoothing alone; a label
    without training rows gets the smallest prior. A run without training rows has no scores.

    The rows are dealt into blocks by id, of about ``BLOCK`` characters. A block's distinct terms, with the rows they are in, meet the
    training counts of all runs by term; what they find goes back to the block, which sums its rows' gains in one task.
    """
    k, n_runs, width = len(labels), len(model.run_names), model.width
    sizes = test.agg(F.sum(F.length("text_clean")).alias("c"), F.count(F.lit(1)).alias("r")).first()
    n_blocks = max(1, -(-(sizes.c or 0) // BLOCK), -(-sizes.r // BLOCK_ROWS))
    blocked = test.withColumn("_block", F.pmod(F.xxhash64("doc_id"), F.lit(n_blocks)).cast("int"))

    def count(key, table):
        table = table.combine_chunks()
        place = pc.index_in(table["doc_id"], value_set=sorted_ids(table["doc_id"])).to_numpy().astype(np.int64)
        batches = list(tallied(table["text_clean"].combine_chunks(), place, key[0].as_py()))
        return pa.Table.from_batches(batches)

    asked = blocked.where("doc_id is not null").select("_block", "doc_id", "text_clean").groupBy("_block").applyInArrow(count, TALLY)
    hits = hand_off(matched(model.slices.unionByName(asked), n_runs, width), "nb-hits")
    words = F.coalesce(F.size(F.split("text_clean", " ")), F.lit(0)).cast("long")
    rows = blocked.select(*dict.fromkeys(["doc_id", *keep]), "_block", words.alias("_words"), F.greatest(words - 1, F.lit(0)).alias("_pairs"))
    kept = [f for f in rows.schema.fields if f.name in keep]
    names = [f.name for f in kept]

    def gains(key, found, docs):
        ids = sorted_ids(docs["doc_id"])
        at = pc.fill_null(pc.index_in(docs["doc_id"], value_set=ids), -1).to_numpy().astype(np.int64)
        tables = []
        for name, size in zip(CLASSIFIERS, ("_words", "_pairs")):
            n = np.bincount(at[at >= 0], docs[size].to_numpy()[at >= 0], len(ids))
            gain = summed(found.filter(pc.equal(found["classifier"], name)), len(ids), n_runs, width)
            n, gain = np.append(n, 0)[at], np.concatenate([gain, np.zeros((1, gain.shape[1]))])[at]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * gain.shape[1], pa.int32()), pa.array(gain.ravel()))
            tables.append(pa.Table.from_arrays([*(docs[c] for c in names), pa.repeat(name, len(at)), pa.array(n.astype(np.int64)), lists],
                                               names=[*names, "classifier", "size", "gain"]))
        return pa.concat_tables(tables)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    summed_up = hits.where("block is not null").groupBy("block").cogroup(rows.groupBy("_block")).applyInArrow(
        gains, f"{fields}, classifier string, size bigint, gain array<double>")
    params = totals(hits, model.run_names, k).where(F.col("run_name").isin(*run_names))
    j = summed_up.join(F.broadcast(params), "classifier")        # a row a run and classifier
    tries = []
    for e, a in enumerate(ALPHAS):
        scores = []
        for i in range(k):
            seen = F.get("gain", (F.col("run") * len(ALPHAS) + e) * k + i)
            base = F.log(F.lit(a) / (F.col("total")[i] + F.lit(a) * (F.col("vocab") + 1)))
            prior = F.log((F.col("rows")[i] + 1) / (F.col("n_train") + k))
            scores.append(F.round((seen + F.col("size") * base + prior) / F.greatest("size", F.lit(1)), 9))
        tries.append(F.struct(F.lit(e + 1).alias("epoch"), F.array(*scores).alias("l")))
    label_id = F.array_position(F.array(*[F.lit(c) for c in labels]), F.col("label")) - 1
    return (j.select("run_name", "classifier", *keep, label_id.cast("int").alias("label_id"),
                     F.explode(F.array(*tries)).alias("_t"))
             .select("run_name", "classifier", "_t.epoch", *keep, "label_id", "_t.l"))


def sorted_ids(ids):
    """The distinct ids of a block in order, null left out: a row's number is its id's place here."""
    ids = pc.unique(ids.drop_null())
    return ids.take(pc.sort_indices(ids))


STEP = 1 << 21       # products of a text's and a training set's counts made at once


def summed(found, n_docs: int, n_runs: int, width: int):
    """``docs x (run, smoothing candidate, label)``: the summed gains of a block's texts from its ``HITS`` of one classifier."""
    k, n_cells = width - 1, n_runs * width
    out = np.zeros((len(ALPHAS), n_docs * n_cells))
    cells, n, docs, tf = (found[c].combine_chunks() for c in ("cells", "n", "docs", "tf"))
    c_len, d_len = cells.value_lengths().to_numpy().astype(np.int64), docs.value_lengths().to_numpy().astype(np.int64)
    part = np.cumsum(c_len * d_len) // STEP
    edges = np.unique([0, *(np.flatnonzero(np.diff(part)) + 1), len(part)])
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        cell, doc = cells[a:b].flatten().to_numpy(), docs[a:b].flatten().to_numpy().astype(np.int64)
        count, times = n[a:b].flatten().to_numpy(), tf[a:b].flatten().to_numpy().astype(float)
        row = np.repeat(np.arange(b - a), d_len[a:b])
        many, start = c_len[a:b][row], (np.cumsum(c_len[a:b]) - c_len[a:b])[row]
        of = np.repeat(np.arange(len(doc)), many)
        at = np.arange(len(of)) + np.repeat(start - (np.cumsum(many) - many), many)
        place, times = doc[of] * n_cells + cell[at], times[of]
        for e, alpha in enumerate(ALPHAS):
            out[e] += np.bincount(place, times * np.log1p(count / alpha)[at], n_docs * n_cells)
    return out.reshape(len(ALPHAS), n_docs, n_runs, width)[..., 1:].transpose(1, 2, 0, 3).reshape(n_docs, n_runs * len(ALPHAS) * k)
