"""Quality rules by tokeniser fertility, next to plain counting rules."""

from __future__ import annotations

from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import blocks, read_table, strings, vocab_path

MIN_WORDS = 50
MAX_REPEAT_SHARE = 50              # per cent of words in repeated 3-word windows
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
BLOCK = 1 << 21                    # characters worked on at once
MIN_TOKENS = 50                    # a shorter text is not judged by its token statistics
WIDTH = 3.0                        # a band reaches so many interquartile spreads from the median to either side
BINS = 400

#: Unicode blocks by script (fixed values): first and last code point, script.
SCRIPTS = [
    (0x0041, 0x024F, "Latin"), (0x0370, 0x03FF, "Greek"), (0x0400, 0x052F, "Cyrillic"), (0x0530, 0x058F, "Armenian"),
    (0x0590, 0x05FF, "Hebrew"), (0x0600, 0x077F, "Arabic"), (0x0900, 0x097F, "Devanagari"), (0x0980, 0x09FF, "Bengali"),
    (0x0B80, 0x0BFF, "Tamil"), (0x0E00, 0x0E7F, "Thai"), (0x10A0, 0x10FF, "Georgian"), (0x1100, 0x11FF, "Hangul"),
    (0x1E00, 0x1EFF, "Latin"), (0x1F00, 0x1FFF, "Greek"), (0x3040, 0x30FF, "Kana"), (0x3400, 0x4DBF, "Han"),
    (0x4E00, 0x9FFF, "Han"), (0xAC00, 0xD7AF, "Hangul"),
]
NAMES = ["None", "Other", *dict.fromkeys(name for _, _, name in SCRIPTS)]

#: the least spread of a metric, where the quartiles are closer (a few emoji are no fault)
LEAST_SPREAD = {"chars_per_token": 0.05, "byte_share": 0.02, "token_entropy": 0.05}
#: metric -> (column, lowest, highest value that the histogram tells apart)
METRICS = {"chars_per_token": (0.0, 20.0), "byte_share": (0.0, 1.0), "token_entropy": (0.0, 20.0)}

SCHEMA = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, script string, "
          "n_tokens long, chars_per_token double, byte_share double, token_entropy double")


@cache
def _scripts() -> np.ndarray:
    """Script number of each code point: 0 for what is no letter, 1 for letters of other scripts."""
    kind = np.zeros(0x110000, np.uint8)
    for start, end in ((0, 0xD800), (0xE000, 0x110000)):
        kind[start:end] = [c.isalpha() for c in map(chr, range(start, end))]
    for first, last, name in SCRIPTS:
        part = kind[first:last + 1]
        part[part > 0] = NAMES.index(name)
    return kind


@cache
def _pieces(path: str):
    """The vocabulary, and which of its ids are single fallback bytes."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return sp, np.array([sp.is_byte(i) for i in range(sp.get_piece_size())])


def script_of(text: str) -> str:
    """The script of most letters; ``None`` without letters."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    counts = np.bincount(_scripts()[codes], minlength=len(NAMES))
    counts[0] = 0
    return NAMES[int(counts.argmax())] if counts.any() else NAMES[0]


def base_counts(text: str, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    chars = len(text) - sum(map(text.count, BLANKS))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    dup = len(lines) - len(set(lines))
    return len(words), chars, symbols, dup, repeat_words(words)


def repeat_words(words: list[bytes]) -> int:
    """Words covered by 3-word windows that occur at least twice in the text."""
    if len(words) < 4:
        return 0
    seen = Counter(zip(words, words[1:], words[2:]))
    if len(seen) == len(words) - 2:
        return 0
    hit = np.fromiter((seen[x] > 1 for x in zip(words, words[1:], words[2:])), bool, len(words) - 2)
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k:len(words) - 2 + k] |= hit
    return int(covered.sum())


def token_statistics(docs: list[list[bytes]], vocab: str) -> tuple[np.ndarray, ...]:
    """Tokens, share of byte-fallback tokens and token entropy (bits) of each document's words.

    Every word is encoded on its own, so a distinct word is encoded once for all documents at hand.
    """
    sp, is_byte = _pieces(vocab)
    place: dict[bytes, int] = {}
    numbers = [np.fromiter((place.setdefault(w, len(place)) for w in words), np.int64, len(words)) for words in docs]
    encoded = sp.encode([w.decode("utf-8", "replace") for w in place], num_threads=1) if place else []
    lengths = np.fromiter(map(len, encoded), np.int64, len(encoded))
    starts = np.concatenate([[0], np.cumsum(lengths)])
    ids = np.fromiter((i for e in encoded for i in e), np.int64, int(starts[-1]))
    tokens, fallback, entropy = np.zeros(len(docs), np.int64), np.zeros(len(docs)), np.zeros(len(docs))
    for k, own in enumerate(numbers):
        words, times = np.unique(own, return_counts=True)
        n = lengths[words]
        if not n.sum():
            continue
        at = np.repeat(starts[words] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        each = np.bincount(ids[at], weights=np.repeat(times, n))
        each_id = np.flatnonzero(each)
        each = each[each_id]
        total = each.sum()
        tokens[k], fallback[k] = total, each[is_byte[each_id]].sum() / total
        entropy[k] = max(0.0, np.log2(total) - (each * np.log2(each)).sum() / total)
    return tokens, fallback, entropy


def _measure(vocab: str, others: int):
    def run(batches):
        for batch in batches:
            texts = strings(batch["text"])
            for a, b in blocks([len(t) for t in texts], BLOCK):
                own = texts[a:b]
                words = [t.encode("utf-8", "replace").split() for t in own]
                counts = np.array([base_counts(t, w) for t, w in zip(own, words)], np.int64).reshape(-1, 5)
                tokens, fallback, entropy = token_statistics(words, vocab)
                per_token = np.where(tokens > 0, counts[:, 1] / np.maximum(tokens, 1), 0.0)
                rest = [batch.column(i).slice(a, b - a) for i in range(others)]
                yield pa.RecordBatch.from_arrays(
                    [*rest, *[pa.array(counts[:, i]) for i in range(5)], pa.array([script_of(t) for t in own]),
                     pa.array(tokens), *[pa.array(np.round(x, 6)) for x in (per_token, fallback, entropy)]],
                    names=[*batch.schema.names[:others], *(x.split()[0] for x in SCHEMA.split(", "))])
    return run


def measure(docs: DataFrame, vocab: str | None = None) -> DataFrame:
    """``doc_id``, the five base counts and the token statistics of every whole text."""
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_measure(vocab or vocab_path("piece_bpe_32k.model"), 1), f"doc_id {kind}, {SCHEMA}")


def bands(measured: DataFrame, width: float = WIDTH) -> dict[tuple[str, str], tuple[float, float]]:
    """(script, metric) -> lowest and highest accepted value.

    One histogram per script over all judged documents, pre-aggregated per task; its size is bounded by scripts x
    metrics x bins, whatever the corpus holds. The band is the median plus and minus ``width`` interquartile spreads
    (``LEAST_SPREAD`` at least, and one bin): it rejects what lies far outside the corpus, never a fixed share of it, and
    junk of one kind does not set it while it is well under a quarter of the script's judged documents.
    """
    stack = ", ".join(f"'{m}', cast(floor((least({m}, {hi}) - {lo}) / {hi - lo} * {BINS}) as int)"
                      for m, (lo, hi) in METRICS.items())
    hist = (measured.where((F.col("n_tokens") >= MIN_TOKENS) & ~base_failed())
            .select("script", F.expr(f"stack({len(METRICS)}, {stack}) as (metric, bin)"))
            .groupBy("script", "metric", "bin").count().collect())
    found: dict[tuple[str, str], Counter] = {}
    for r in hist:
        found.setdefault((r["script"], r["metric"]), Counter())[r["bin"]] += r["count"]
    out = {}
    for (script, metric), counts in found.items():
        lo, hi = METRICS[metric]
        step = (hi - lo) / BINS
        bins = np.array(sorted(counts))
        share = np.cumsum([counts[b] for b in bins]) / counts.total()
        low, mid, high = (lo + step * (bins[np.searchsorted(share, q)] + 0.5) for q in (0.25, 0.5, 0.75))
        spread = max(LEAST_SPREAD[metric], high - low) + step
        out[script, metric] = (mid - width * spread, mid + width * spread)
    return out


def base_failed() -> Column:
    return ((F.col("n_words") < MIN_WORDS)
            | (F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEAT_SHARE) * F.col("n_words")))


def in_bands(found: dict) -> Column:
    """Whether all metrics lie in the bands of the text's script; a short text or an unseen script passes."""
    bad = F.lit(False)
    for (script, metric), (low, high) in sorted(found.items()):
        bad = bad | ((F.col("script") == script) & ~F.col(metric).between(low, high))
    return (F.col("n_tokens") < MIN_TOKENS) | ~bad


def judge(docs: DataFrame, scratch, vocab: str | None = None, width: float = WIDTH) -> DataFrame:
    """``doc_id``, counts, token statistics, ``base_failed`` and ``kept`` for every row of ``docs``.

    Base: a word is a run of characters other than blank, tab to carriage return. ``word_chars`` counts the code
    points in words, ``n_symbols`` the characters of ``#*$%&|<>``, ``n_dup_lines`` the lines with a word that equal an
    earlier line, ``n_repeat_words`` the words in 3-word windows found twice or more.
    Method: characters per token, byte-fallback share and token entropy under a public vocabulary with byte
    fallback, each held against the band of the text's script (``bands``). ``kept``: the base rules and all bands hold.

    The measures are written once (a few numbers per document), the bands come from them, the verdict is one more
    pass over them. Null text: no words, so ``base_failed``. Empty table: empty result. Repeated rows are judged
    alike. Other columns are not read.
    """
    measured = scratch.write(measure(docs, vocab), "measures")
    found = bands(measured, width)
    return (measured.withColumn("base_failed", base_failed())
            .withColumn("kept", ~F.col("base_failed") & in_bands(found)))


def op10_fertility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import Scratch
    return judge(read_table(spark, sf_dir, "documents"), Scratch(spark, "op10"))


OP10_SQL = None
