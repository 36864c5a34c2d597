import hashlib
import random
import re

from textloom.llm import pii
from textloom.llm.common import read_table

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            s = m.group()
            digits = re.sub("[^0-9]", "", s)
            if kind == "ip" and any(int(x) > 255 for x in s.split(".")):
                continue
            if kind == "card":
                if not 16 <= len(digits) <= 19:
                    continue
                d = [int(c) for c in digits[::-1]]
                if (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10:
                    continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_base_spans_by_plain_patterns():
    rng = random.Random(1)
    bits = ["a", "b.c", "@", ".", "-", "+", "1", "22", "255", "300", "4539 1488 0343 6467", "4111111111111111", " ", "(", ")",
            "x@y.z", "é", "%", "1.2.3.4", "+1 (318) 555-2368", "\n", "@@", "..", "0007"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(25)))
        assert pii.base_spans(text) == brute(text), text


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" * 150_000, "a@" * 100_000, "1 " * 150_000, "a." * 100_000 + "@"):
        pii.base_spans(text)
        pii.candidates(text)


def test_query(spark):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in pii.find_pii(docs).collect():
        want = brute(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in want) for k in pii.KINDS]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        found = r.spans.split(",") if r.spans else []
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(found)
        keys = [(pii.KINDS.index(s.split(":")[0]), int(s.split(":")[1])) for s in found]
        assert keys == sorted(keys)


def test_boosting_learns_a_rule():
    rng = pii.np.random.default_rng(3)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    p = pii.predict(pii.boost(x[:2000], y[:2000]), x[2000:])
    assert ((p > 0.5) == y[2000:]).mean() > 0.93


def test_planted_spans_beyond_the_base_rules_are_added(make_docs):
    rng = random.Random(5)
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: rng.choice(["red", "house", "old", "river", "asks", "seven"])

    def card(k):
        d = "4" + n(k - 2)
        return d + next(c for c in "0123456789" if pii.luhn(d + c))

    def mail(at, dot):
        return f"{word()}{n(2)}{at}{word()}{n(1)}{dot}com"

    make = {"base": [lambda: ("phone", f"+1 ({n(3)}) {n(3)}-{n(4)}"), lambda: ("card", card(16)), lambda: ("email", mail("@", "."))],
            "wide": [lambda: ("phone", f"({n(3)}) {n(3)}-{n(4)}"), lambda: ("card", card(14)),
                     lambda: ("email", mail(" (at) ", " (dot) "))],
            "other": [lambda: ("", f"20{n(2)}-0{rng.randrange(1, 9)}-1{n(1)}"), lambda: ("", f"{n(2)} / {n(3)} / {n(2)}")]}
    rows, planted = [], {}
    for i in range(3000):
        group = list(make)[i % 3]
        kind, span = rng.choice(make[group])()
        before = " ".join(word() for _ in range(5)) + " "
        rows.append((i, before + span + " " + word()))
        planted[i] = (group, kind, span)
    found = {r.doc_id: r.spans for r in pii.find_pii(make_docs(rows)).collect()}
    for kind in ("phone", "card", "email"):
        own = [i for i, (group, k, _) in planted.items() if group == "wide" and k == kind]
        assert sum(kind in found[i] for i in own) > 0.9 * len(own), kind
    others = [i for i, p in planted.items() if p[0] == "other"]
    assert sum(found[i] != "" for i in others) < 0.01 * len(others)


def test_redaction_and_odd_rows(make_docs, odd_rows):
    rows = odd_rows + [(50, "write to ann.lee@mail.example.com or +1 (318) 555-2368 now"), (51, "at 10.0.0.1.")]
    docs = make_docs(rows)
    out = {r.doc_id: r for r in pii.redact_pii(docs).collect()}
    assert pii.redact_pii(docs).columns == docs.columns
    assert out[50].text == "write to [EMAIL] or [PHONE] now" and out[50].n_chars == len(out[50].text)
    assert out[51].text == "at [IP]." and out[2].text is None and out[1].text == rows[0][1]
    assert pii.redact_pii(docs).count() == len(rows)
    empty = {r.doc_id: r for r in pii.find_pii(docs).collect()}[2]
    assert empty.spans == "" and empty.base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.find_pii(docs.limit(0)).count() == 0
    assert pii.redact("abcdef", [("email", 1, 3), ("ip", 2, 4)]) == "a[EMAIL]ef"


def test_the_fit_takes_every_candidate_of_every_text(make_docs):
    """No cap per document and no sample of documents; a text counts once, however often it comes."""
    rng = random.Random(9)
    calls = lambda k: " and ".join(f"+1 (318) 555-{rng.randrange(1000, 9999)}" for _ in range(k))
    rows = [(0, calls(70)), *((i, calls(1) + f" w{i}") for i in range(1, 21_001)), (21_001, calls(60)), (21_002, None)]
    rows.append((21_003, rows[0][1]))
    got = pii.training_rows(make_docs(rows), 7).where("y = 2 and kind = 'phone'").collect()
    assert sum(r.n for r in got) == 70 + 21_000 + 60 and all(r.x == b"" for r in got)


def test_weighted_quantiles_are_those_of_the_repeated_values():
    rng = pii.np.random.default_rng(2)
    values, n = rng.normal(size=40).round(1), rng.integers(1, 9, 40)
    want = pii.np.quantile(pii.np.repeat(values, n), pii.np.linspace(0, 1, pii.CUTS + 1)[1:-1])
    assert pii.np.allclose(pii.quantile_cuts(values, n), pii.np.unique(want))
    p = rng.random(40)
    assert pii.at_least(p, n, p[:5]).tolist() == [n[p >= s].sum() for s in p[:5]]
