"""Name labeller: brute-force decoding, planted names without cue, marks, odd rows, any partitioning, held-out accuracy."""

import itertools
import random

from conftest import SF01
from textloom.operators import names as N
from textloom.plans.audit_queries import q_name_spans

SCHEMA = "doc_id long, text string, spans array<struct<start: long, end: long>>"
GIVEN = "Peter Alice Karen Thomas Ingrid Paulo Marta Henry Olga Simon Clara Viktor".split()
FAMILY = "Miller Smith Keller Brown O'Neill Santos Weber Novak Müller-Lang Fischer Jones Moreau".split()
PLACES = ["New York", "San Marino", "Los Angeles", "Green Hill", "Old Harbour", "North Bend"]
SAYS = ["{} told me to wait.", "I met {} near the river.", "We saw {}, who was late.", "My friend {} came over.", "Then {} called again."]
LIES = ["We live in {} now.", "The road to {} is long.", "They flew to {} last week.", "It rains in {} all year.", "The museum of {} is closed."]


def texts(n, seed):
    rnd, rows = random.Random(seed), []
    for i in range(n):
        text, spans = "", []
        for _ in range(rnd.randrange(1, 5)):
            person = rnd.random() < 0.5
            name = f"{rnd.choice(GIVEN)} {rnd.choice(FAMILY)}" if person else rnd.choice(PLACES)
            before, after = rnd.choice(SAYS if person else LIES).split("{}")
            at = len(text) + len(before)
            text += before + name + after + " "
            if person:
                spans.append((at, at + len(name)))
        rows.append((i, text, spans))
    return rows


def test_viterbi_equals_all_paths():
    rnd = random.Random(4)
    for n in (1, 2, 3, 4, 6, 7):
        for _ in range(60):
            scores = [[rnd.randrange(-4, 5) for _ in range(3)] for _ in range(n)]
            steps = [[rnd.randrange(-3, 4) for _ in range(3)] for _ in range(3)]

            def value(tags):
                return sum(r[t] for r, t in zip(scores, tags)) + sum(steps[a][b] for a, b in zip(tags, tags[1:]))

            allowed = [t for t in itertools.product(range(3), repeat=n) if t[0] != N.I and t[-1] != N.B
                       and all(b in N.NEXT[a] for a, b in zip(t, t[1:]))]
            got = tuple(N.viterbi(scores, steps))
            assert got in allowed and value(got) == max(map(value, allowed))


def test_planted_names_without_cue(spark):
    model = N.fit(spark.createDataFrame(texts(400, 1), SCHEMA), shard=100)
    plain = spark.createDataFrame(texts(200, 2), SCHEMA)
    hit = found = marked = 0
    for r in N.with_names(plain, model).collect():
        got, want = {(x.start, x.end) for x in r.names}, {(s.start, s.end) for s in r.spans}
        assert all(r.text[x.start:x.end] == x.name for x in r.names)
        hit, found, marked = hit + len(got & want), found + len(got), marked + len(want)
    assert hit >= 0.97 * marked and hit >= 0.97 * found
    # names and places whose words were never seen, by their context alone
    new = {"My friend Tilda Quist came over.": ["Tilda Quist"], "We live in Upper Tannack now.": [], "My friend John Doe came over.": []}
    df = spark.createDataFrame([(t,) for t in new], "text string")
    assert {r.text: [x.name for x in r.names] for r in N.with_names(df, model).collect()} == new


def test_marks_that_fit_no_words_count_as_none():
    [(places, _)] = N.runs("so Anna Maria Berg said")
    assert N.tags_of(places, [(3, 18)]) == [N.B, N.I, N.I]
    assert N.tags_of(places, [(8, 18)]) == [N.O, N.B, N.I]
    for odd in [(3, 7)], [(4, 18)], [(3, 17)], [(50, 60)], []:
        assert N.tags_of(places, odd) == [N.O] * 3
    assert N.spans_of(places, [N.B, N.I, N.O]) == [(3, 13)]


def test_odd_rows_and_any_partitioning(spark):
    rows = texts(120, 3) + [(None, None, None), (7, "", []), (7, "Alice Smith " * 3000, None), (8, "x", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    a, b = (N.fit(df.repartition(n), epochs=2, shard=40) for n in (1, 7))
    assert (a.cells == b.cells).all() and (a.steps == b.steps).all()
    clash = df.selectExpr("*", "1 as name", "2 as start")
    got = N.with_names(clash, a)
    assert got.columns == [*clash.columns, "names"] and got.count() == len(rows)
    assert [r.names for r in got.where("text is null or text = ''").collect()] == [[], []]
    empty = N.fit(df.limit(0), epochs=1)
    assert not empty.cells.any() and N.with_names(df, empty).where("size(names) > 0").count() == 0
    assert N.with_names(df.limit(0), a).count() == 0


def test_texts_are_searched_once_however_many_epochs(spark, monkeypatch):
    """The epochs read written runs, in the order of the texts of a shard: one table, with every run of every text."""
    made, hand_off = [], N.hand_off
    monkeypatch.setattr(N, "hand_off", lambda df, name: made.append(hand_off(df, name)) or made[-1])
    rows = texts(90, 5) + [(90, None, None), (91, "no names", [])]
    N.fit(spark.createDataFrame(rows, SCHEMA), epochs=3, shard=30)
    assert len(made) == 1
    got = [r for r in made[0].orderBy("shard", "place").collect()]
    assert len({r.shard for r in got}) > 1 and len({(r.shard, r.place) for r in got}) == len(got)
    want = [(x.ravel().tolist(), N.tags_of(p, m or [])) for _, t, m in rows if t for p, x in N.runs(t)]
    assert sorted((r.features, r.tags) for r in got) == sorted(want)


def test_query_on_held_out_rows(spark):
    rows = [r for r in q_name_spans(spark, SF01).collect()]
    assert len(rows) == 1000
    held = [r for r in rows if r.held_out]
    hit, found, marked = (sum(r[c] for r in held) for c in ("n_hit", "n_found", "n_marked"))
    assert marked > 50 and hit >= 0.9 * marked and hit >= 0.9 * found
