"""Secrets: base patterns, and random strings told from ordinary identifiers by character Markov models."""

from __future__ import annotations

import base64
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .common import blocks, code_points, read_table, ship_code, small, strings, vocab_path

KINDS = ("assign", "access", "hex", "random")      # the three base kinds, then what the models add
ASSIGN = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
LETTER = re.compile(r"[A-Za-z]")                   # a span without any is a number
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SYMBOLS = DIGITS + UPPER + LOWER + "+/_.=-"        # a run is a maximal string of these
K = len(SYMBOLS) + 1                               # symbol 0: outside a run
#: Alphabets that keys are written in, narrow ones first; each has a model of random strings of its own.
ALPHABETS = {"hex": DIGITS + "abcdef", "HEX": DIGITS + "ABCDEF", "base32": UPPER + "234567", "base62": DIGITS + UPPER + LOWER}
JOINTS = "+/_-"                                    # stand in keys, paths and names alike: no evidence, and a new word behind them
NEW_WORD = 0.05                                    # probability that an ordinary string goes on with a capital as a new word
VOCABULARY = "byte_bpe_50k.tiktoken"               # public word pieces: labelled samples of ordinary identifiers
SAMPLES, SAMPLE_LENGTH = 2_000, 40                 # labelled random strings made per alphabet, by a seed
MIN_LENGTH = 16                                    # code points of an added span at least
ODDS = 1_000.0                                     # posterior odds asked of an added span (ratios overstate: characters are not independent)
BLOCK = 1 << 20                                    # code points scored at once
NEVER = -1e4                                       # ratio of a character that the alphabet lacks
SHORT, LONG = len(ALPHABETS), len(ALPHABETS) + 1   # numbers of the counts of ordinary runs

_CODE = np.zeros(129, np.int32)
_CODE[[ord(c) for c in SYMBOLS]] = np.arange(1, K)
IS_JOINT = np.array([False, *(c in JOINTS for c in SYMBOLS)])
_CONTEXT = np.where(IS_JOINT, 0, np.arange(K)).astype(np.int32)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The contract's matches by start, then kind."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end() - m.start(1) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def value_of(text: str, kind: str, start: int, end: int) -> str:
    """The secret itself: of an assignment the part behind the name."""
    return ASSIGN.match(text, start, end).group(1) if kind == "assign" else text[start:end]


def alphabet_of(value: str) -> int | None:
    """The first alphabet that has all characters of ``value``."""
    return next((i for i, a in enumerate(ALPHABETS.values()) if set(value) <= set(a)), None)


def symbols(points: np.ndarray) -> np.ndarray:
    return _CODE[np.minimum(points, 128)]


def cells(s: np.ndarray) -> np.ndarray:
    """The cell (two symbols before, symbol) of each position; a context ends where its run begins, and at a joint."""
    context = _CONTEXT[s]
    cell = s.copy()
    cell[1:] += context[:-1] * K
    cell[2:] += context[:-2] * (context[1:-1] > 0) * np.int32(K * K)
    return cell


def runs(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run."""
    inside = np.concatenate([[0], (s > 0).astype(np.int8), [0]])
    edge = np.flatnonzero(np.diff(inside))
    return edge[::2], edge[1::2]


def fold_of(run: str) -> int:
    """Equal strings are in one fold, wherever they stand."""
    return zlib.crc32(run.encode()) & 1


def count_symbols(docs: DataFrame) -> DataFrame:
    """``model, cell, n`` over all texts. Model i has the base values of alphabet i; of the runs outside base spans, model
    ``SHORT`` has those that are too short to be judged, models ``LONG`` and ``LONG + 1`` the others by their fold.

    The cells of a task are summed before they leave it; ``cell`` -1 counts the values or runs.
    """
    def run(batches):
        total: dict[int, np.ndarray] = {}
        number: dict[int, int] = {}
        for batch in small(batches):
            texts = strings(batch["text"])
            for a, b in blocks([len(t) for t in texts], BLOCK):
                points, off = code_points(texts[a:b])
                s, values = symbols(points), [[] for _ in ALPHABETS]
                for text, start in zip(texts[a:b], off):
                    for kind, x, y in base_spans(text):
                        s[start + x:start + y] = 0
                        value = value_of(text, kind, x, y)
                        if (i := alphabet_of(value)) is not None:
                            values[i].append(value)
                start, end = runs(s)
                cell, long = cells(s), [[], []]
                for x, y in zip(start[end - start >= MIN_LENGTH], end[end - start >= MIN_LENGTH]):
                    long[fold_of("".join(SYMBOLS[c - 1] for c in s[x:y]))].append(cell[x:y])
                both = [x for own in long for x in own]
                seen = [(SHORT, [cell], both, len(start) - len(both))]
                seen += [(LONG + i, own, [], len(own)) for i, own in enumerate(long)]
                for i, own in enumerate(values):
                    seen.append((i, [cells(symbols(code_points(own)[0]))] if own else [], [], len(own)))
                for i, plus, minus, many in seen:
                    if many:
                        n = np.bincount(np.concatenate(plus), minlength=K ** 3)
                        if minus:
                            n -= np.bincount(np.concatenate(minus), minlength=K ** 3)
                        n[::K] = 0                        # no symbol
                        total[i] = total[i] + n if i in total else n
                        number[i] = number.get(i, 0) + many
        for i, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at) + 1, i)), pa.array(np.append(at, -1)), pa.array(np.append(n[at], number[i]))],
                names=["model", "cell", "n"])

    return (docs.select("text").mapInArrow(run, "model long, cell long, n long")
            .groupBy("model", "cell").agg(F.sum("n").alias("n")))


def random_strings(alphabet: str, seed: int) -> list[str]:
    """Labelled samples of one alphabet: strings with no order between their characters."""
    rng = np.random.default_rng([seed, *map(ord, alphabet)])
    picked = rng.integers(0, len(alphabet), (SAMPLES, SAMPLE_LENGTH))
    return ["".join(alphabet[j] for j in row) for row in picked]


def vocabulary_cells(path: str) -> np.ndarray:
    """Cells of the pieces of a public vocabulary file, whole words from their start and inner pieces from their third
    character, and of each symbol repeated (rules, padding)."""
    n = np.zeros(K ** 3)
    with open(path, "rb") as f:
        pieces = [base64.b64decode(line.split()[0]).decode("utf-8", "replace") for line in f if line.strip()]
    s = symbols(code_points(pieces)[0])
    inner = np.zeros(len(s), bool)
    for piece, start in zip(pieces, code_points(pieces)[1]):
        inner[start:start + 2] = not piece.startswith(" ")
    np.add.at(n, cells(s)[(s > 0) & ~inner], 1)
    same = symbols(code_points([c * SAMPLE_LENGTH for c in SYMBOLS])[0])
    return n + np.bincount(cells(same)[same > 0], minlength=K ** 3)


def log_model(n: np.ndarray) -> np.ndarray:
    """Logarithms of P(symbol | two symbols before), each order mixed with the lower one by its number of successors."""
    n = n.reshape(K, K, K).astype(np.float64)
    p = np.full(K, 1.0 / (K - 1))
    lower = n.sum((0, 1))
    p = (lower + 0.5 * p) / (lower.sum() + 0.5)
    for table in (n.sum(0), n):
        kinds = np.maximum(1, (table > 0).sum(-1, keepdims=True))
        p = (table + kinds * p) / (table.sum(-1, keepdims=True) + kinds)
    p[..., 0] = 1.0
    return np.log(p)


def fit(docs: DataFrame, seed: int = 13, odds: float = ODDS, vocabulary: str | None = None) -> tuple[np.ndarray, float]:
    """``(ratios, threshold)``: per fold, alphabet and cell the log-likelihood ratio of random to ordinary; the sum asked for.

    Ordinary strings are all runs outside base spans, counted over all documents, or, with equal weight, the pieces of a public vocabulary; a run that is judged is left out of
    the model that judges it, with all its copies (two folds by a hash of the run), so that no unlabelled key vouches for itself.
    Random strings are the labelled ones: base values, by the narrowest alphabet that holds them, and ``SAMPLES`` seeded
    strings per alphabet. The counts are at most ``K`` cubed numbers per model, whatever the corpus. The threshold is the
    logarithm of ``odds`` times the ordinary runs per base value (the prior odds), times the number of alphabets to choose from.
    """
    ship_code(docs.sparkSession)
    n = np.zeros((len(ALPHABETS) + 3, K ** 3))
    number = np.zeros(len(ALPHABETS) + 3)
    got = count_symbols(docs).toArrow()
    model, cell, count = (got[c].to_numpy() for c in ("model", "cell", "n"))
    mark = cell < 0
    number[model[mark]] = count[mark]
    n[model[~mark], cell[~mark]] = count[~mark]
    ratios = np.empty((2, len(ALPHABETS), K ** 3), np.float32)
    pieces = vocabulary_cells(vocabulary or vocab_path(VOCABULARY))
    for fold in (0, 1):
        ordinary = np.logaddexp(log_model(pieces), log_model(n[SHORT] + n[LONG + 1 - fold])) - math.log(2)
        lower, upper = ([1 + SYMBOLS.index(c) for c in a] for a in (LOWER, UPPER))
        hump = np.ix_(range(K), lower, upper)
        ordinary[hump] = np.maximum(ordinary[hump], math.log(NEW_WORD) + ordinary[0, 0, upper])
        for i, alphabet in enumerate(ALPHABETS.values()):
            s = symbols(code_points(random_strings(alphabet, seed))[0])
            made = np.bincount(cells(s)[s > 0], minlength=K ** 3)
            ratios[fold, i] = (log_model(n[i] + made) - ordinary).reshape(-1)
            last = ratios[fold, i].reshape(-1, K)
            last[:, [0, *(x + 1 for x, c in enumerate(SYMBOLS) if c not in alphabet)]] = NEVER
            last[:, IS_JOINT] = 0.0
    prior = max(1.0, number[SHORT:].sum()) / max(1.0, number[:SHORT].sum())
    return ratios, math.log(odds * max(1.0, prior) * len(ALPHABETS))


def best_segments(gain: np.ndarray, least: float) -> list[tuple[int, int, float]]:
    """Disjoint segments of the largest sums, each of at least ``least``: the best one, then the best beside it, ..."""
    found, open_ = [], [(0, len(gain))]
    while open_:
        a, b = open_.pop()
        if b - a < MIN_LENGTH:
            continue
        total = np.concatenate([[0.0], np.cumsum(gain[a:b], dtype=np.float64)])
        low = np.minimum.accumulate(total)
        end = int(np.argmax(total - low))
        score = float(total[end] - low[end])
        if score < least:
            continue
        start = int(np.argmax(total[:end + 1] == low[end]))
        found.append((a + start, a + end, score))
        open_ += [(a, a + start), (a + end, b)]
    return sorted(found)


def added_spans(texts: list[str], base: list[list], model) -> list[list[tuple[str, int, int, float]]]:
    """Random strings of each text that overlap no base span: kind, start, end, log-likelihood ratio.

    In each run the segments of the largest ratio sums are taken (so a key in a path or address is found alone), widened to
    the letters and digits that adjoin them, without joints at either end.
    """
    ratios, least = model
    out: list[list] = [[] for _ in texts]
    for a, b in blocks([len(t) for t in texts], BLOCK):
        points, off = code_points(texts[a:b])
        s = symbols(points)
        start, end = runs(s)
        long = end - start >= MIN_LENGTH
        start, end = start[long], end[long]
        if not len(start):
            continue
        cell = cells(s)
        for j in range(len(start)):
            row = int(np.searchsorted(off, start[j], "right")) - 1
            text, shift = texts[a + row], int(start[j] - off[row])
            size = int(end[j] - start[j])
            gains = ratios[fold_of(text[shift:shift + size])][:, cell[start[j]:end[j]]]
            tries = [best_segments(g, least) for g in gains if np.maximum(g, 0).sum() >= least]
            if not tries:
                continue
            for x, y, score in max(tries, key=lambda t: sum(v[2] for v in t)):
                while x < y and text[shift + x] in JOINTS:
                    x += 1
                while x > 0 and text[shift + x - 1].isalnum():
                    x -= 1
                while y < size and text[shift + y].isalnum():
                    y += 1
                while y > x and text[shift + y - 1] in JOINTS:
                    y -= 1
                x, y = shift + x, shift + y
                own = out[a + row]
                if y - x >= MIN_LENGTH and LETTER.search(text, x, y) and not (own and own[-1][2] > x) and not any(
                        x < stop and first < y for _, first, stop in base[a + row]):
                    own.append(("random", x, y, score))
    return out


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                                  T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]))


def find_all(texts: list[str], model) -> list[list[tuple[str, int, int, float | None]]]:
    """All spans of each text by start, then kind: base spans without a score, added ones with theirs."""
    base = [base_spans(t) for t in texts]
    return [sorted([*((*s, None) for s in b), *x], key=lambda s: (s[1], KINDS.index(s[0])))
            for b, x in zip(base, added_spans(texts, base, model))]


def find_secrets(docs: DataFrame, odds: float = ODDS) -> DataFrame:
    """``docs`` and ``spans`` (kind, start, end in code points, score): the secrets of every whole text.

    A null text has an empty list, as an empty one. Repeated rows give repeated results, an empty table an empty one. Very
    long texts are scanned whole: time is linear in their length, but for a run of many separate keys. A column of
    ``docs`` named ``spans`` is replaced; all others pass through, whatever their names and types.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, odds=odds))
    names = [c for c in docs.columns if c != "spans"]
    at = names.index("text")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        for batch in small(batches):
            found = find_all(strings(batch.column(at)), model.value)
            spans = [[dict(zip(("kind", "start", "end", "score"), s)) for s in own] for own in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, kind)], names=[*batch.schema.names, "spans"])

    rows = numbered(docs.select(*[F.col(f"`{c}`") for c in names]))
    schema = T.StructType([*rows.schema.fields, T.StructField("spans", SPANS)])
    return rows.mapInArrow(run, schema).toDF(*names, "spans")


def numbered(df: DataFrame) -> DataFrame:
    """Columns named by their place: ``mapInArrow`` takes no name with a dot."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def redact(text: str, spans: list) -> str:
    out, last = [], 0
    for _, start, end, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= last:
            out += [text[last:start], "[SECRET]"]
        last = max(last, end)
    return "".join([*out, text[last:]])


def redact_secrets(docs: DataFrame, odds: float = ODDS) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``[SECRET]``; overlapping spans become one. A null text stays null."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, odds=odds))
    at = docs.columns.index("text")

    def run(batches):
        for batch in small(batches):
            raw = batch.column(at).to_pylist()
            found = find_all([t or "" for t in raw], model.value)
            columns = batch.columns
            columns[at] = pa.array([None if t is None else redact(t, s) for t, s in zip(raw, found)], columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    rows = numbered(docs)
    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, the digest of the base spans, and all spans of every document."""
    found = find_secrets(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select("doc_id", *(count(k) for k in KINDS[:3]), F.sha2(spans_text(base), 256).alias("base_sha256"),
                        spans_text(F.col("spans")).alias("spans"), count("random"))
