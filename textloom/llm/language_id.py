"""Language ID: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import blocks, code_points, held_out, read_table, segment_sum, small, strings

BITS = 16                  # n-gram buckets: 2^16
SIZES = (1, 2, 3)          # n-gram lengths
SMOOTHING = 0.5
#: The model is fitted on about this many documents per language, chosen by a hash of the id.
MAX_TRAIN_PER_LANG = 4_000
#: Languages in one matrix: more of them are scored by several matrices, one after another, so each broadcast holds at most
#: 200 x 2^16 floats whatever the number of languages.
LANGS_AT_ONCE = 200
UNKNOWN = "und"
#: The pipeline's least score: one language is likelier than all others together. Over the learnable rows of sf0.1 accuracy
#: falls nowhere above it (all 8,040 score at least 0.5, 99.9 % are right), so no learnable text is lost.
MIN_SCORE = 0.5
BLOCK = 1 << 19            # code points worked on at once
LETTER = regex.compile(r"\p{L}")


@cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    flags = np.zeros(0x110000, bool)
    for start, end in ((0, 0xD800), (0xE000, 0x110000)):
        flags[start:end] = [c.isalpha() for c in map(chr, range(start, end))]
    return flags


def _buckets(texts: list[str]):
    """For each n-gram length: bucket of the n-gram at every position, and whether it counts."""
    codes, off = code_points([t.lower() for t in texts])
    letter = _letters()[codes]
    c = np.where(letter, codes, np.uint32(32))
    inside = np.ones(len(c), bool)
    inside[off[1:] - 1] = inside[off[1:] - 2] = False
    after = np.concatenate([letter[1:], [False]])
    grams, h = [], np.zeros(len(c), np.uint32)
    for n in range(1, max(SIZES) + 1):
        h = h * np.uint32(0x01000193) + np.concatenate([c[n - 1:], np.zeros(n - 1, np.uint32)])
        if n in SIZES:
            mixed = (h ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            mixed = ((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS)
            grams.append((mixed, inside & (letter if n == 1 else letter | after)))
    return grams, off


def _count(batches):
    """Counts per (language, bucket) of one partition, and its documents per language."""
    sums: dict[str, np.ndarray] = {}
    for batch in small(batches):
        langs, texts = batch["lang"].to_pylist(), strings(batch["text"])
        order = sorted(range(len(langs)), key=lambda i: langs[i])
        for a, b in blocks([len(texts[i]) for i in order], BLOCK):
            part = order[a:b]
            for lang in sorted({langs[i] for i in part}):
                own = [texts[i] for i in part if langs[i] == lang]
                total = sums.setdefault(lang, np.zeros(1 << BITS, np.int64))
                for bucket, counts in _buckets(own)[0]:
                    total += np.bincount(bucket[counts], minlength=1 << BITS)
    for lang, total in sums.items():
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(full), pa.string()), pa.array(full.astype(np.int32)), pa.array(total[full])],
            names=["lang", "bucket", "n"])


def fit(docs: DataFrame, max_per_lang: int = MAX_TRAIN_PER_LANG) -> list[tuple]:
    """Models ``(languages, log-probability matrix [bucket, language], log priors)`` from rows with a language, each of at most
    ``LANGS_AT_ONCE`` languages, alphabetically; together they hold every learnable language.

    Priors count all rows; n-grams come from a hash sample of about ``max_per_lang`` rows per language.
    What reaches the driver at once is bounded by ``LANGS_AT_ONCE`` x 2^16 numbers.
    """
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = sorted((r["lang"], r["count"]) for r in rows.groupBy("lang").count().collect())
    all_rows = sum(n for _, n in sizes)
    models = []
    for at in range(0, len(sizes), LANGS_AT_ONCE):
        part = sizes[at:at + LANGS_AT_ONCE]
        langs = [lang for lang, _ in part]
        share = F.lit(0.0)
        for lang, n in part:
            share = F.when(F.col("lang") == lang, F.lit(min(1.0, max_per_lang / n))).otherwise(share)
        sample = rows.where(F.pmod(F.xxhash64(F.lit(6), "doc_id"), F.lit(1 << 30)) < share * float(1 << 30))
        counts = (sample.select("lang", "text").mapInArrow(_count, "lang string, bucket int, n long")
                  .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow())
        matrix = np.full((1 << BITS, len(langs)), SMOOTHING)
        place = {lang: i for i, lang in enumerate(langs)}
        column = np.array([place[x] for x in counts["lang"].to_pylist()], np.int64)
        matrix[counts["bucket"].to_numpy(), column] += counts["n"].to_numpy()
        prior = np.log([n for _, n in part]) - np.log(all_rows)
        models.append((langs, np.log(matrix / matrix.sum(0)).astype(np.float32), prior))
    return models


def advance(texts: list[str], model: tuple, state: tuple) -> tuple:
    """The state ``(language, its log posterior, its tempered one, log sum of the tempered ones)`` of each text after the
    languages of ``model``.

    The language is that of the largest multinomial posterior. Its score is tempered: the log-likelihood is divided by the square
    root of the n-gram count, since n-grams of a text are not independent, and the plain product would give 0 or 1
    for almost every text.
    """
    langs, matrix, prior = model
    best, top, soft, total_soft = (list(state[0]), *(np.array(x, np.float64) for x in state[1:]))
    for a, b in blocks([len(t) for t in texts], max(1 << 14, BLOCK // max(1, len(langs) // 8))):
        grams, off = _buckets(texts[a:b])
        total, n = np.zeros((b - a, len(langs))), np.zeros(b - a)
        for bucket, counts in grams:
            at = np.flatnonzero(counts)
            ends = np.searchsorted(at, off)
            total += segment_sum(matrix[bucket[at]], ends[:-1], ends[1:])
            n += np.diff(ends)
        plain = prior + total
        tempered = prior + total / np.sqrt(np.maximum(n, 1))[:, None]
        high = tempered.max(1)
        total_soft[a:b] = np.logaddexp(total_soft[a:b], high + np.log(np.exp(tempered - high[:, None]).sum(1)))
        pick = plain.argmax(1)
        for i, t in enumerate(texts[a:b]):
            k = int(pick[i])
            if plain[i, k] > top[a + i] and LETTER.search(t):
                best[a + i], top[a + i], soft[a + i] = langs[k], plain[i, k], tempered[i, k]
    return best, top, soft, total_soft


def score_texts(texts: list[str], langs: list[str], matrix: np.ndarray, prior: np.ndarray):
    """Predicted language and its score for each text, by one model."""
    n = len(texts)
    state = ([None] * n, np.full(n, -np.inf), np.zeros(n), np.full(n, -np.inf))
    if langs:
        state = advance(texts, (langs, matrix, prior), state)
    best, _, soft, total = state
    score = [0.0 if x is None else round(float(np.exp(s - t)), 6) for x, s, t in zip(best, soft, total)]
    return [UNKNOWN if x is None else x for x in best], np.array(score)


STATE = ("lid_best", "lid_top", "lid_soft", "lid_total")


def with_language(docs: DataFrame, models: list[tuple]) -> DataFrame:
    """``docs`` with ``lid_best`` (null: none) and ``lid_score``; one pass over the rows, through one map per model."""
    names = docs.columns
    at = names.index("text")
    start = [F.lit(None).cast("string"), *(F.lit(x).cast("double") for x in (float("-inf"), 0.0, float("-inf")))]
    rows = docs.toDF(*[f"c{i}" for i in range(len(names))]).select("*", *[c.alias(x) for c, x in zip(start, STATE)])
    for model in models:
        shared = docs.sparkSession.sparkContext.broadcast(model)

        def run(batches, shared=shared):
            for batch in small(batches):
                columns = list(batch.columns)
                state = (columns[-4].to_pylist(), *(c.to_numpy(zero_copy_only=False) for c in columns[-3:]))
                best, *numbers = advance(strings(columns[at]), shared.value, state)
                yield pa.RecordBatch.from_arrays([*columns[:-4], pa.array(best, pa.string()), *(pa.array(x) for x in numbers)],
                                                 names=batch.schema.names)

        rows = rows.mapInArrow(run, rows.schema)
    score = F.when(F.col("lid_best").isNull(), 0.0).otherwise(F.round(F.exp(F.col("lid_soft") - F.col("lid_total")), 6))
    return rows.withColumn("lid_top", score).drop("lid_soft", "lid_total").toDF(*names, "lid_best", "lid_score")


def identify(docs: DataFrame, train: DataFrame | None = None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs``.

    The model learns from text and non-null ``lang`` of the rows of ``train`` (default: ``docs``) whose id is not
    held out (``common.held_out``); prediction sees the text alone. ``lang_pred`` has the largest multinomial posterior,
    ``score`` is its tempered posterior probability (see ``advance``). ``und`` with score 0: a null text, a text without a
    letter, or nothing to learn from. Repeated rows give repeated results; ties go to the alphabetically first language; a null
    id is held out. An empty table gives an empty result. Very long texts are scored whole. Other columns are not read.
    """
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    found = with_language(rows, fit(train if train is not None else docs))
    return found.select("doc_id", "held_out", F.coalesce("lid_best", F.lit(UNKNOWN)).alias("lang_pred"), F.col("lid_score").alias("score"))


def keep_identified(docs: DataFrame, min_score: float = 0.0) -> DataFrame:
    """The rows of ``docs`` with a recognised language and at least ``min_score``; all columns stay.

    A null or letterless text is rejected. Where nothing can be learnt, all texts with a letter stay. Rows are kept or
    dropped inside one pass over the table, so repeated ids and clashing column names need no join.
    """
    models, names = fit(docs), docs.columns
    if models:
        found = with_language(docs, models).toDF(*[f"c{i}" for i in range(len(names))], "best", "score")
        return found.where(F.col("best").isNotNull() & (F.col("score") >= min_score)).drop("best", "score").toDF(*names)
    at = names.index("text")

    def judge(batches):
        for batch in small(batches):
            yield batch.filter(pa.array([LETTER.search(t) is not None for t in strings(batch.column(at))], pa.bool_()))

    rows = docs.toDF(*[f"c{i}" for i in range(len(names))])
    return rows.mapInArrow(judge, rows.schema).toDF(*names)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read_table(spark, sf_dir, "documents"))
