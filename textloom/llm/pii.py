"""Personal data: base patterns, overlapping candidate spans, and boosted trees that choose among them."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Scratch, read_table, small, strings

KINDS = ("email", "ip", "card", "phone")
LEAST_RATIO = 0.5              # density among hidden base spans to density among open candidates, asked of an added span
MOST_SCORE = 0.9               # ... but no more than this probability, where unlabelled candidates are few
MIN_BASE = 50                  # base spans of a kind that its model needs
MAX_CHANCE = 0.01              # of added cards, those that may fit the check digit by chance
CONTEXT = 64                   # characters kept on either side of a hidden span
TREES, DEPTH, SHRINK, CUTS = 40, 3, 0.3, 16

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# the base patterns; possessive repeats and a look-behind at the digits keep them linear and change no match
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: High-recall generators: wider than the base patterns, free to overlap them and each other.
WIDE = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]++)*"),
    "ip": re.compile(r"(?<![0-9])[0-9]{1,4}+(?:[.,:][0-9]{1,4}+){3}"),
    "card": re.compile(r"(?<![0-9])[0-9](?:[ ./-]?[0-9]){11,22}(?![0-9])"),
    "phone": re.compile(r"\+?(?:\([0-9]{1,4}\)|(?<![0-9])[0-9]{1,4})(?:[ ./-]{0,2}(?:\([0-9]{1,4}\)|[0-9]{2,6}+)){1,6}"),
}
#: Words before a span that hint at its kind (lower case).
CUES = {
    "email": ("mail", "email", "e-mail", "contact", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "adresse"),
    "card": ("card", "visa", "mastercard", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "telefono", "appel"),
}
SEPARATORS = " -.()/,:@+"
CHECK_DIGIT = 6                # its feature
N_FEATURES = 12 + len(SEPARATORS) + len(KINDS)


def luhn(digits: str) -> bool:
    """Whether the check digit fits."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str):
    """Leftmost non-overlapping e-mail matches, found from each ``@`` so that long words cost nothing."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(end, at + 1))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The contract's matches, by kind and then start."""
    found = []
    if "@" in text:
        found += [("email", a, b) for a, b in _emails(text)]
    if "." in text:
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.groups()):
                found.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(map(str.isdigit, m.group())) <= 15:
                found.append(("phone", *m.span()))
    return found


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Base matches and everything the wide patterns propose; spans may overlap."""
    found = dict.fromkeys(base_spans(text))
    for kind in KINDS:
        if kind == "email" and "@" not in text and "at" not in text:
            continue
        for m in WIDE[kind].finditer(text):
            found.setdefault((kind, *m.span()))
    return list(found)


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format of the span and its surroundings; never the base rules' verdict."""
    span = text[start:end]
    groups = re.findall(r"[0-9]+", span)
    digits = "".join(groups)
    before, after = text[max(0, start - 24):start], text[end:end + 1]
    word = re.findall(r"[^\W\d_][\w-]*", before.lower())[-1:] or [""]
    return [
        len(span), len(digits), len(groups), len(groups[0]) if groups else 0, len(groups[-1]) if groups else 0,
        max((int(g[-6:]) for g in groups), default=0), float(len(digits) > 1 and luhn(digits)),
        sum(c.isalpha() for c in span), float(before[-1:].isalnum()), float(after.isalnum()),
        float(before[-1:].isspace() or not before), float(word[0] in CUES[kind]),
        *(span.count(c) for c in SEPARATORS), *(float(kind == k) for k in KINDS)]


def plausible(kind: str, span: str) -> bool:
    """Whether a candidate can be of its kind at all: number of digits, check digit, octets, a dotted domain."""
    digits = re.sub("[^0-9]", "", span)
    if kind == "email":
        labels = re.split(r"\.|\(dot\)|\[dot\]", re.split(r"@|\(at\)|\[at\]", span)[-1])
        return len(labels) > 1 and len(labels[-1].strip()) > 1 and labels[-1].strip().isalpha()
    if kind == "ip":
        return all(int(x) <= 255 for x in re.findall("[0-9]+", span))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits) and digits[0] in "3456"
    return 7 <= len(digits) <= 15


def hidden_forms(kind: str, span: str) -> list[str]:
    """A base span without the character that decides its base rule."""
    if kind == "email":
        user, host = span.split("@", 1)
        return [f"{user} (at) {host.replace('.', ' (dot) ')}", f"{user}[at]{host}", f"{user} @ {host}"]
    if kind == "ip":
        return [span.replace(".", ","), span.replace(".", ":")]
    if kind == "phone":
        return [span[1:], re.sub(r"^\+[0-9]+[ .-]*", "", span)]
    forms, at = [], [i for i, c in enumerate(span) if c.isdigit()]
    for n in (13, 14, 15):
        cut = span[:at[n - 1]]
        digits = re.sub("[^0-9]", "", cut)
        forms.append(cut + next(c for c in "0123456789" if luhn(digits + c)))
    return [*forms, re.sub("[ -]", ".", span)]


def hidden(text: str, kind: str, start: int, end: int) -> list[tuple[str, int, int]]:
    """Each hidden form of a base span in its context, as the wide pattern finds it: text, start and end."""
    before, after = text[max(0, start - CONTEXT):start], text[end:end + CONTEXT]
    found = []
    for form in dict.fromkeys(hidden_forms(kind, text[start:end])):
        changed, stop = before + form + after, len(before) + len(form)
        over = [m.span() for m in WIDE[kind].finditer(changed) if m.start() < stop and m.end() > len(before)]
        if over:
            a, b = max(over, key=lambda s: min(s[1], stop) - max(s[0], len(before)))
            if plausible(kind, changed[a:b]) and not any(
                    k == kind and x < b and a < y for k, x, y in base_spans(changed)):
                found.append((changed, a, b))
    return found


def open_candidates(text: str, base: list) -> list[tuple[str, int, int]]:
    """Candidates that overlap no base span: that place is found already."""
    return [c for c in candidates(text) if not any(c[1] < stop and start < c[2] for _, start, stop in base)]


def quantile_cuts(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The distinct quantiles of values that occur ``weights`` times each."""
    order = np.argsort(values, kind="stable")
    values, upto = values[order], np.cumsum(weights[order])
    at = np.linspace(0, 1, CUTS + 1)[1:-1] * (upto[-1] - 1)
    low = values[np.searchsorted(upto, np.floor(at), side="right")]
    high = values[np.searchsorted(upto, np.ceil(at), side="right")]
    return np.unique(low + (high - low) * (at - np.floor(at)))


def boost(x: np.ndarray, y: np.ndarray, n: np.ndarray | None = None, cuts: list | None = None) -> list[tuple]:
    """Gradient-boosted trees for the logistic loss: histograms over quantile cuts, whole levels at a time.

    A tree is (feature and cut of each inner node, value of each leaf). ``n``: how often each row counts; ``cuts``: the cuts
    of each feature, else the quantiles of ``x``.
    """
    n = np.ones(len(y)) if n is None else n.astype(np.float64)
    cuts = cuts or [quantile_cuts(x[:, j], n) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    rate = np.clip(np.average(y, weights=n), 1e-3, 1 - 1e-3)
    score = np.full(len(y), np.log(rate / (1 - rate)))
    trees = [float(score[0])]
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        g, h = n * (y - p), n * p * (1 - p)
        node = np.zeros(len(y), np.int64)
        splits = []
        for level in range(DEPTH):
            first, width = 2 ** level - 1, 2 ** level
            gain_best = np.zeros(width)
            pick = [(0, np.inf)] * width
            pick_bin = [(0, CUTS + 1)] * width
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                at = (node - first) * (CUTS + 1) + binned[:, j]
                gs = np.bincount(at, g, width * (CUTS + 1)).reshape(width, -1).cumsum(1)
                hs = np.bincount(at, h, width * (CUTS + 1)).reshape(width, -1).cumsum(1)
                total_g, total_h = gs[:, -1:], hs[:, -1:]
                gain = gs ** 2 / (hs + 1) + (total_g - gs) ** 2 / (total_h - hs + 1) - total_g ** 2 / (total_h + 1)
                for k in range(width):
                    b = int(gain[k, :len(c)].argmax())
                    if gain[k, b] > gain_best[k] + 1e-9:
                        gain_best[k], pick[k], pick_bin[k] = gain[k, b], (j, float(c[b])), (j, b)
            splits += pick
            feature = np.array([j for j, _ in pick_bin])[node - first]
            border = np.array([b for _, b in pick_bin])[node - first]
            node = 2 * node + 1 + (binned[np.arange(len(y)), feature] > border)
        first, width = 2 ** DEPTH - 1, 2 ** DEPTH
        leaf = SHRINK * np.bincount(node - first, g, width) / (np.bincount(node - first, h, width) + 1)
        score += leaf[node - first]
        trees.append((splits, leaf))
    return trees


def predict(trees: list, x: np.ndarray) -> np.ndarray:
    """Probability of each feature row."""
    score = np.full(len(x), trees[0])
    rows = np.arange(len(x))
    for splits, leaf in trees[1:]:
        feature, cut = np.array([j for j, _ in splits]), np.array([c for _, c in splits])
        node = np.zeros(len(x), np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
        score += leaf[node - (2 ** DEPTH - 1)]
    return 1 / (1 + np.exp(-score))


def training_rows(docs: DataFrame, seed: int) -> DataFrame:
    """``half, kind, y, x, n``: how often each feature row ``x`` occurs among all candidates of all distinct texts.

    ``y``: 2 a base span (no ``x``), 1 one with its deciding character hidden, 0 an unlabelled candidate, -1 a card that fails the
    check digit, taken as if it fitted. Texts are not moved: copies are told by 128 hash bits, and only candidates leave a task.
    """
    texts = docs.where(F.col("text").isNotNull()).select(
        "text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("second"), "text").alias("h2"),
        F.pmod(F.xxhash64(F.lit(seed + 1), "text"), F.lit(2)).alias("half"))

    def packed(text, kind, start, end, checked=False):
        x = features(text, kind, start, end)
        if checked:                # as if the check digit fitted
            x[CHECK_DIGIT] = 1.0
        return np.array(x, np.float32).tobytes()

    def run(batches):
        for batch in small(batches):
            rows = []
            for text, *own in zip(strings(batch["text"]), *(batch[c].to_pylist() for c in ("h1", "h2", "half"))):
                found = []
                base = base_spans(text)
                for k, a, b in base:
                    found.append((k, 2.0, b""))
                    found += [(k, 1.0, packed(t, k, *c)) for t, *c in hidden(text, k, a, b)]
                for k, a, b in open_candidates(text, base):
                    if plausible(k, text[a:b]):
                        found.append((k, 0.0, packed(text, k, a, b)))
                    elif k == "card":
                        found.append((k, -1.0, packed(text, k, a, b, checked=True)))
                rows += [(*own, i, *r) for i, r in enumerate(found)]
            columns = list(zip(*rows)) if rows else [()] * 7
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["h1", "h2", "half", "i", "kind", "y", "x"])

    found = texts.mapInArrow(run, "h1 long, h2 long, half long, i long, kind string, y double, x binary")
    return found.dropDuplicates(["h1", "h2", "i"]).groupBy("half", "kind", "y", "x").agg(F.count(F.lit(1)).alias("n"))


def feature_cuts(rows: DataFrame) -> list[np.ndarray]:
    """The quantile cuts of each feature over all fitted rows, from the histogram of its values (a million at most)."""
    def run(batches):
        for batch in batches:
            x = np.frombuffer(b"".join(batch["x"].to_pylist()), np.float32).reshape(-1, N_FEATURES)
            n = batch["n"].to_numpy()
            for j in range(N_FEATURES):
                values, at = np.unique(x[:, j], return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(values), j, np.int64)), pa.array(values.astype(np.float64)), pa.array(np.bincount(at, n).astype(np.int64))],
                    names=["j", "value", "n"])

    hist = (rows.where("half = 0 and y in (0, 1)").select("x", "n").mapInArrow(run, "j long, value double, n long")
            .groupBy("j", "value").agg(F.sum("n").alias("n")).toArrow())
    j, value, n = (hist[c].to_numpy() for c in ("j", "value", "n"))
    return [quantile_cuts(value[j == f], n[j == f]) for f in range(N_FEATURES)] if len(j) else []


def at_least(p: np.ndarray, n: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """How many of the rows, ``n`` each, have a ``p`` of each step or more."""
    order = np.argsort(p)
    below = np.concatenate([[0], np.cumsum(n[order])])
    return below[-1] - below[np.searchsorted(p[order], steps, side="left")]


def fit(docs: DataFrame, seed: int = 7):
    """``(trees, threshold per kind)`` from all candidates of all documents, each text once, or None.

    Positives are the base spans with their deciding character hidden (``hidden_forms``), so that the trees cannot
    relearn the base rules; plausible candidates beside the base spans are unlabelled. The trees, fitted on half of the
    texts, tell the two apart; their odds, weighted by the numbers of base spans and unlabelled candidates
    of the kind, are the ratio of the two densities. A span is added where the ratio is at least ``LEAST_RATIO``: its
    format and context are about as frequent among base spans as among the unlabelled. A number fits a check digit by chance
    once in ten: on the other half, the threshold of cards rises until a ninth of the equal candidates that fail the
    check digit is at most ``MAX_CHANCE`` of those added. A kind with under ``MIN_BASE`` base spans gets no addition.

    The trees only see on which side of its cuts a feature lies, so rows that agree in this are one row that counts so often: the
    driver gets their numbers, which say all there is about the corpus, and no row of it.
    """
    spark = docs.sparkSession
    rows = Scratch(spark, "pii-fit").write(training_rows(docs, seed), "rows")
    cuts = feature_cuts(rows)
    if not cuts:
        return None
    shared = spark.sparkContext.broadcast(cuts)

    def run(batches):
        for batch in batches:
            raw = batch["x"].to_pylist()
            full = [i for i, r in enumerate(raw) if r]
            x = np.frombuffer(b"".join(raw), np.float32).reshape(-1, N_FEATURES).astype(np.float64)
            side = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(shared.value)], 1).astype(np.uint8)
            for i, s in zip(full, side):
                raw[i] = s.tobytes()
            yield pa.RecordBatch.from_arrays([batch["half"], batch["kind"], batch["y"], pa.array(raw, pa.binary()), batch["n"]],
                                             names=["half", "kind", "y", "x", "n"])

    got = (rows.select("half", "kind", "y", "x", "n").mapInArrow(run, "half long, kind string, y double, x binary, n long")
           .groupBy("half", "kind", "y", "x").agg(F.sum("n").alias("n")).toArrow()
           .sort_by([("x", "ascending"), ("y", "ascending"), ("kind", "ascending"), ("half", "ascending")]))
    half, y, n, kind = *(got[c].to_numpy() for c in ("half", "y", "n")), np.array(got["kind"].to_pylist(), object)
    n_base = {k: int(n[(y == 2) & (half == 0) & (kind == k)].sum()) for k in KINDS}
    some = y < 2
    half, y, kind, n = half[some], y[some], kind[some], n[some]
    side = np.frombuffer(b"".join(got["x"].to_pylist()), np.uint8).reshape(-1, N_FEATURES)
    # a value of each feature on that side of its cuts: the cut above it, or beyond the last
    x = np.stack([np.append(c, c[-1] + 1 if len(c) else 0.0)[side[:, f]] for f, c in enumerate(cuts)], 1)
    fitted = (half == 0) & (y >= 0)
    if not fitted.any() or y[fitted].min() == y[fitted].max():
        return None
    trees = boost(x[fitted], y[fitted], n[fitted], cuts)
    p = predict(trees, x)
    thresholds = {}
    for k in KINDS:
        n_open = int(n[fitted & (kind == k) & (y == 0)].sum())
        if n_base[k] < MIN_BASE:
            thresholds[k] = np.inf
            continue
        odds = LEAST_RATIO * n_base[k] / max(1, n_open)
        least = min(MOST_SCORE, odds / (1 + odds))
        own = (half == 1) & (kind == k) & (p >= least)
        added, failed = own & (y == 0), own & (y < 0)
        if failed.any():
            steps = np.unique(np.concatenate([[least], p[added]]))
            above, chance = at_least(p[added], n[added], steps), at_least(p[failed], n[failed], steps) / 9
            good = np.flatnonzero((chance <= MAX_CHANCE * above) & (above > 0))
            least = float(steps[good[0]]) if len(good) else np.inf
        thresholds[k] = least
    return trees, thresholds


def find_all(texts: list[str], model) -> list[tuple[list, list]]:
    """Base spans and all spans (base and chosen candidates) of each text, by kind and start.

    A candidate that overlaps a base span, or cannot be of its kind, adds nothing.
    """
    base = [base_spans(t) for t in texts]
    every = [set(b) for b in base]
    if model is not None:
        trees, thresholds = model
        usable = {k for k, least in thresholds.items() if least < np.inf}
        spans = [(i, c) for i, t in enumerate(texts) for c in open_candidates(t, base[i])
                 if c[0] in usable and plausible(c[0], t[c[1]:c[2]])]
        if spans:
            x = np.array([features(texts[i], *c) for i, c in spans], np.float32).astype(np.float64)
            for (i, c), p in zip(spans, predict(trees, x)):
                if p >= thresholds[c[0]]:
                    every[i].add(c)
    order = lambda s: (KINDS.index(s[0]), s[1], s[2])
    return [(b, sorted(e, key=order)) for b, e in zip(base, every)]


def spans_text(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Spans replaced by ``[KIND]``; overlapping spans become one, named after the first."""
    out, last = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= last:
            out += [text[last:start], f"[{kind.upper()}]"]
        last = max(last, end)
    return "".join([*out, text[last:]])


def find_pii(docs: DataFrame) -> DataFrame:
    """``doc_id``, base counts per kind, ``base_sha256`` and ``spans`` for every row of ``docs``.

    A null text counts as empty: no span, and the digest and list of nothing. Repeated rows give repeated results. An
    empty table gives an empty result. Very long texts are scanned whole, in linear time. Other columns are not read.
    """
    rows = docs.select("doc_id", "text")
    model = docs.sparkSession.sparkContext.broadcast(fit(docs))

    def run(batches):
        for batch in small(batches):
            found = find_all(strings(batch["text"]), model.value)
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
            digest = [hashlib.sha256(spans_text(base).encode()).hexdigest() for base, _ in found]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *counts, pa.array(digest, pa.string()),
                 pa.array([spans_text(s) for _, s in found], pa.string())],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, {', '.join(f'n_{k} long' for k in KINDS)}, "
                                "base_sha256 string, spans string")


def redact_pii(docs: DataFrame) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind, and ``n_chars``, if there, counted anew.

    Rows, their order and all other columns stay; a null text stays null.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs))
    names = docs.columns
    at = names.index("text")

    def run(batches):
        for batch in small(batches):
            raw = batch.column(at).to_pylist()
            found = find_all([t or "" for t in raw], model.value)
            clean = [None if t is None else redact(t, s) for t, (_, s) in zip(raw, found)]
            columns = batch.columns
            columns[at] = pa.array(clean, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    done = docs.mapInArrow(run, docs.schema)
    if "n_chars" in names:
        kind = docs.schema["n_chars"].dataType
        done = done.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars"))
                               .otherwise(F.length("text")).cast(kind))
    return done.select(*[F.col(f"`{c}`") for c in names])


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(read_table(spark, sf_dir, "documents"))
