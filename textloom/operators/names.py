"""Full names in texts: a sequence labeller (averaged perceptron, Viterbi decoding) over token shape and context.

A candidate is a run of two or more capitalised words; every word of a run gets a tag, outside, begin or inside, and a name is a
begin with at least one inside. Trained on a table of texts with marked names by iterative parameter mixing: in each epoch all
shards start from the same weights and go through their own texts; their changes are averaged by one aggregation.
"""

from __future__ import annotations

import itertools
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.rules import PLACEHOLDER_NAMES
from textloom.session import hand_off, ship_code

WORD = r"\p{Lu}(?:\p{Ll}+|['’]\p{Lu}\p{Ll}+)(?:-\p{Lu}\p{Ll}+)*"
RUN = regex.compile(rf"(?<![\p{{L}}\p{{N}}_]){WORD}(?: {WORD})+(?![\p{{L}}\p{{N}}_])")
CELLS = 1 << 18            # hashed features; with three tags each a fixed 6 MB, whatever the corpus
EPOCHS = 5
SHARD = 5_000              # marked texts a shard, about
UNIT = 1 << 20             # weights are averaged as whole numbers of 1 / UNIT, so that no order of sums matters
NEAR = 48                  # characters looked at to either side of a run
BATCH = 1024
O, B, I = range(3)         # noqa: E741
# tags that may follow a tag; a text ends after O or I, so a name has two words at least
NEXT = {O: (O, B), B: (I,), I: (O, B, I)}
PATHS = [(a, b) for a in NEXT for b in NEXT[a]]


@dataclass
class Model:
    """Weights per hashed feature and tag, and per pair of neighbouring tags."""
    cells: np.ndarray
    steps: np.ndarray


def _words(piece: str) -> list[str]:
    return [w.strip(".,;:!?\"'()[]").lower() for w in piece.split()]


def runs(text: str) -> list[tuple[list[tuple[int, int]], np.ndarray]]:
    """Each run of capitalised words: the words' places, and a row of hashed features per word."""
    found = []
    for m in RUN.finditer(text):
        at, places = m.start(), []
        for w in m.group().split(" "):
            places.append((at, at + len(w)))
            at += len(w) + 1
        before, after = text[max(0, m.start() - NEAR):m.start()], text[m.end():m.end() + NEAR]
        left, right = ["", "", *_words(before)][-2:], [*_words(after), "", ""][:2]
        opens = not before.strip() or before.rstrip(" ")[-1] in ".!?\n:"
        closes = not after or after[0] in ".!?,;:\n"
        words = [text[a:b] for a, b in places]
        around = [*left, *[w.lower() for w in words], *right]
        n, rows = len(words), []
        for i, w in enumerate(words):
            low, (l2, l1, _, r1, r2) = w.lower(), around[i:i + 5]
            first, last = i == 0, i == n - 1
            names = ("", f"w{low}", f"p{low[:3]}", f"s{low[-3:]}", f"l{l1}", f"k{l2} {l1}", f"r{r1}", f"q{r1} {r2}",
                     f"e{first}{last}{min(n, 4)}", f"o{opens and first}", f"c{closes and last}", f"a{left[1]} {min(i, 3)}",
                     f"b{right[0]} {min(n - 1 - i, 3)}", f"h{'-' in w}{len(w) < 4}")
            rows.append([zlib.crc32(x.encode("utf-8", "surrogatepass")) % CELLS for x in names])
        found.append((places, np.array(rows, np.int64)))
    return found


def viterbi(scores, steps) -> list[int]:
    """The best allowed tags of a run: ``scores`` per word and tag, ``steps`` per pair of tags; ties go to the lower tag."""
    worst = float("-inf")
    best, back = [scores[0][O], scores[0][B], worst], []
    for row in scores[1:]:
        now, came = [worst] * 3, [O] * 3
        for a, b in PATHS:
            value = best[a] + steps[a][b] + row[b]
            if value > now[b]:
                now[b], came[b] = value, a
        best = now
        back.append(came)
    tags = [I if best[I] > best[O] else O]
    for came in reversed(back):
        tags.append(came[tags[-1]])
    return tags[::-1]


def spans_of(places, tags) -> list[tuple[int, int]]:
    """Start and end of each name."""
    out: list = []
    for (a, b), tag in zip(places, tags):
        if tag == B:
            out.append((a, b))
        elif tag == I:
            out[-1] = (out[-1][0], b)
    return out


def tags_of(places, marked) -> list[int]:
    """Tags of a run's words by marked names; a mark that does not begin and end with words of the run, two at least, is none."""
    starts, ends = {a: i for i, (a, _) in enumerate(places)}, {b: i for i, (_, b) in enumerate(places)}
    tags = [O] * len(places)
    for a, b in marked:
        i, j = starts.get(a), ends.get(b)
        if i is not None and j is not None and j > i and not any(tags[i:j + 1]):
            tags[i:j + 1] = [B] + [I] * (j - i)
    return tags


def train_shard(rows, model: Model):
    """One pass of the averaged perceptron over ``(features, tags)`` of runs: changes of the weights, and of their average over the pass."""
    w, s = model.cells.copy(), model.steps.copy()
    late_w, late_s, t = np.zeros_like(w), np.zeros_like(s), 0
    for x, gold in rows:
        t += 1
        guess = viterbi(w[x].sum(1).tolist(), s.tolist())
        if guess == gold:
            continue
        for tags, by in ((gold, 1.0), (guess, -1.0)):
            for row, tag in zip(x, tags):
                np.add.at(w, (row, tag), by)
                np.add.at(late_w, (row, tag), by * t)
            for a, b in zip(tags, tags[1:]):
                s[a, b] += by
                late_s[a, b] += by * t
    t += 1
    return w - model.cells, s - model.steps, w - late_w / t - model.cells, s - late_s / t - model.steps


def shards(marked: DataFrame, id_col: str, n_shards: int) -> DataFrame:
    """``shard, place, features, tags`` (written): the runs of all texts, by the shard their text is in and their place there.

    The texts are read, dealt and searched once, however many epochs go through their runs.
    """
    rows = marked.select(F.col(id_col).alias("id"), F.coalesce("text", F.lit("")).alias("text"),
                         F.col("spans.start").alias("a"), F.col("spans.end").alias("b"))
    rows = rows.repartition(n_shards, "id", F.xxhash64("text")).sortWithinPartitions("id", "text", "a", "b")

    def run(batches):
        place = 0
        for shard, batch in ((batch["shard"], batch) for batch in batches):
            found: list = []
            for k, text, a, b in zip(shard.to_pylist(), *(batch[c].to_pylist() for c in ("text", "a", "b"))):
                for places, x in runs(text):
                    found.append((k, place, x.ravel(), tags_of(places, list(zip(a or (), b or ())))))
                    place += 1
            kinds = (pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=["shard", "place", "features", "tags"])

    return hand_off(rows.select(F.spark_partition_id().alias("shard"), "text", "a", "b").mapInArrow(
        run, "shard int, place long, features array<int>, tags array<int>"), "name-runs")


def fit(marked: DataFrame, id_col: str = "doc_id", epochs: int = EPOCHS, shard: int = SHARD) -> Model:
    """The model of ``marked (id, text, spans array<struct<start, end>>)``: all its rows, in about one shard per ``shard`` rows.

    Places are code points, ends exclusive. Null texts and texts without spans (null or empty) are texts without names. The
    weights are the mean of the shards' averages over all epochs; equal on any cluster, as shards are hashes of the id
    and go through their rows by id and text. Without rows all weights are 0: nothing is a name.
    """
    ship_code(marked.sparkSession)
    sc = marked.sparkSession.sparkContext
    n_shards = max(1, -(-marked.count() // shard))
    rows = shards(marked, id_col, n_shards).repartition(n_shards, "shard").sortWithinPartitions("shard", "place")
    start = Model(np.zeros((CELLS, 3)), np.zeros((3, 3)))
    mean = Model(np.zeros((CELLS, 3)), np.zeros((3, 3)))
    for _ in range(epochs):
        shared = sc.broadcast(start)

        def run(batches, shared=shared):
            def of_runs():
                for batch in batches:
                    features, tags = batch["features"], batch["tags"]
                    for k, gold, x in zip(batch["shard"].to_pylist(), tags.to_pylist(), features):
                        yield k, x.values.to_numpy().reshape(len(gold), -1), gold

            for _, own in itertools.groupby(of_runs(), lambda r: r[0]):
                w, s, mean_w, mean_s = train_shard(((x, gold) for _, x, gold in own), shared.value)
                flat = [np.rint(np.concatenate([x.ravel(), y.ravel()]) * UNIT).astype(np.int64) for x, y in ((w, s), (mean_w, mean_s))]
                at = np.flatnonzero(flat[0] | flat[1])
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[0][at]), pa.array(flat[1][at])], names=["cell", "last", "mean"])

        changes = rows.mapInArrow(run, "cell long, last long, mean long").groupBy("cell").agg(F.sum("last").alias("last"), F.sum("mean").alias("mean"))
        got = changes.toArrow()           # at most three numbers per hashed feature
        cell = got["cell"].to_numpy()

        def moved(model, column):
            flat = np.concatenate([model.cells.ravel(), model.steps.ravel()])
            flat[cell] += got[column].to_numpy() / (UNIT * n_shards)
            return Model(flat[:-9].reshape(CELLS, 3), flat[-9:].reshape(3, 3))

        average, start = moved(start, "mean"), moved(start, "last")
        mean = Model(mean.cells + average.cells / epochs, mean.steps + average.steps / epochs)
    return mean


def find(text: str, model: Model) -> list[tuple[int, int]]:
    """Names of a text, placeholders left out: start and end."""
    steps, out = model.steps.tolist(), []
    for places, x in runs(text):
        for a, b in spans_of(places, viterbi(model.cells[x].sum(1).tolist(), steps)):
            if text[a:b] not in PLACEHOLDER_NAMES:
                out.append((a, b))
    return out


def with_names(df: DataFrame, model: Model, text_col: str = "text", out: str = "names") -> DataFrame:
    """``df`` and ``out``: the names of each text in order, ``array<struct<start, end, name>>``; whole texts, null ones have none."""
    ship_code(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("name", pa.string())]))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                found = [[{"start": a, "end": b, "name": t[a:b]} for a, b in find(t, shared.value)] if t else []
                         for t in part[text_col].to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, kind)], names=[*part.schema.names, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{fields}, `{out}` array<struct<start: bigint, end: bigint, name: string>>")


def hits(marked: Column, found: Column) -> Column:
    """How many found names are marked, at exactly their place."""
    places = F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    return F.size(F.filter(marked, lambda x: F.array_contains(places, x))).cast("long")
