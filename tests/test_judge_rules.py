"""Judge response salvage, rule verdicts and the CSV round trip."""

from pyspark.sql import functions as F

from textloom.operators import judge, rules
from textloom.sources import csvio

OK = '[{"id":1,"is_complete":true,"reason":"x"}]'
CASES = {
    "ok": (OK, 1), "fence": ("```json\n" + OK + "\n```", 1),
    "trunc": ('[{"id":1,"is_complete":true,"reason":"x"},{"id":2,', 0),
    "none": ("sorry", 0), "empty": ("[]", 0), "null": (None, 0),
    "obj": ('{"id":1,"is_complete":true}', 1),
    "prefix": ('Here: [{"id":1,"is_complete":false}] done', 1),
    "trail": ('[{"id":1,"is_complete":true}] trailing', 1),
    "missing": ('[{"id":1}]', 1), "badtype": ('[{"id":1,"is_complete":"yes"}]', 1),
}


def test_parse_salvage_table(spark):
    df = spark.createDataFrame([(k, v[0]) for k, v in CASES.items()], "case string, raw string")
    p = judge.parsed_log(df.withColumn("attempt", F.lit(1)))
    got = {r.case: (r.ok, r.parsed) for r in p.collect()}
    for k, (_, n) in CASES.items():
        ok, parsed = got[k]
        assert ok == (n > 0 or k == "empty"), k        # an empty array is an answer: it ends the retries
        if n:
            assert len(parsed) == n, k
    assert got["missing"][1][0].is_complete is None
    assert got["badtype"][1][0].is_complete is None
    assert got["prefix"][1][0].is_complete is False


def test_first_valid_attempt_wins(spark):
    rows = [("completeness", "d", 1, 1, "sorry"), ("completeness", "d", 1, 2, OK),
            ("completeness", "d", 1, 3, '[{"id":1,"is_complete":false,"reason":"y"}]'),
            ("completeness", "d", 2, 1, "cut"), ("completeness", "d", 2, 4, OK)]
    df = spark.createDataFrame(rows, "task string, dataset string, batch_no long, attempt int, raw string")
    f = {r.batch_no: r.attempt for r in judge.first_valid(judge.parsed_log(df)).collect()}
    assert f == {1: 2}           # batch 2 only succeeds after the retry budget


def test_an_empty_array_ends_the_retries_and_fails_the_batch(spark):
    rows = [("completeness", "d", 1, 1, "[]"), ("completeness", "d", 1, 2, OK), ("pii", "d", 1, 1, '[{"id":1,"has_pii":false}]')]
    first = judge.first_valid(judge.parsed_log(spark.createDataFrame(
        rows, "task string, dataset string, batch_no long, attempt int, raw string")))
    assert {r.task: r.attempt for r in first.collect()} == {"completeness": 1, "pii": 1}
    batched = spark.createDataFrame([("d", 1, 1, "t")], "dataset string, batch_no long, id int, text string")
    row = judge.align(batched, first).first()
    assert row.is_complete is None and row.reason == judge.FAILED_REASON and row.has_pii is False


def test_a_stored_log_with_failed_attempts_is_aligned(spark, tmp_path):
    """Answers as judges give them, over several attempts, from a stored log; a batch without any valid one gets placeholders."""
    path = str(tmp_path / "log")
    good = '[{"id": 1, "is_complete": true, "reason": "ok"}, {"id": 2, "is_complete": false, "reason": "abrupt_end"}]'
    cols = "task string, dataset string, batch_no int, raw string"
    tries = ((1, [("completeness", "d", 1, good[:-1]), ("completeness", "d", 2, "sorry"), ("completeness", "d", 3, f"Here: {good} done")]),
             (2, [("completeness", "d", 1, f"```json\n{good}\n```"), ("completeness", "d", 2, good[:-1])]),
             (3, [("completeness", "d", 1, "[]"), ("completeness", "d", 2, "none")]), (4, [("completeness", "d", 2, good)]))
    for attempt, rows in tries:
        judge.write_log(spark.createDataFrame(rows, cols), path, attempt)
    first = judge.first_valid(judge.parsed_log(judge.read_log(spark, path)))
    assert {(r.batch_no, r.attempt) for r in first.collect()} == {(1, 2), (3, 1)}
    batched = spark.createDataFrame([("d", b, i, f"t{b}{i}") for b in (1, 2, 3) for i in (1, 2)], "dataset string, batch_no long, id int, text string")
    got = {(r.batch_no, r.id): (r.is_complete, r.reason) for r in judge.align(batched, first).collect()}
    assert got == {(1, 1): (True, "ok"), (1, 2): (False, "abrupt_end"), (2, 1): (None, judge.FAILED_REASON), (2, 2): (None, judge.FAILED_REASON),
                   (3, 1): (True, "ok"), (3, 2): (False, "abrupt_end")}


def test_the_judge_queries_log_has_every_answer_shape(spark):
    """Fenced, wrapped and cut-off answers, retries and a failed batch (7) go through the log of the judge queries."""
    rows = [("completeness", "d", b, OK) for b in range(1, 9)]
    log = judge.response_log(spark.createDataFrame(rows, "task string, dataset string, batch_no long, clean string"))
    tries = {}
    for r in log.collect():
        tries.setdefault(r.batch_no, {})[r.attempt] = r.raw
    assert {b: len(t) for b, t in tries.items()} == {1: 1, 2: 1, 3: 3, 4: 1, 5: 1, 6: 1, 7: 3, 8: 1}
    assert tries[1][1] == f"```json\n{OK}\n```" and tries[2][1] == f"Here: {OK} done" and tries[4][1] == OK
    assert tries[3] == {1: OK[:-1], 2: "sorry", 3: OK} and tries[7][3] == OK[:-1]
    first = judge.first_valid(judge.parsed_log(log))
    assert {r.batch_no: r.attempt for r in first.collect()} == {1: 1, 2: 1, 3: 3, 4: 1, 5: 1, 6: 1, 8: 1}


def test_the_judge_queries_write_every_attempt(spark, tmp_path, monkeypatch):
    from textloom.plans import audit_queries as A
    batched = spark.createDataFrame([("d", b, 1, "I am fine today.", "I am fine today.") for b in range(1, 9)],
                                    "dataset string, batch_no long, id int, post string, text string")
    monkeypatch.setattr(A, "audit_inputs", lambda *_: (None, batched))
    done = A.judged(spark, "none")
    assert {(r.batch_no, r.attempt) for r in done["first"].collect()} == {(b, 3 if b == 3 else 1) for b in range(1, 9) if b != 7}
    assert {r.batch_no for r in done["aligned"].where(F.col("reason") == judge.FAILED_REASON).collect()} == {7}


def test_every_pii_match_has_its_hint():
    import re
    texts = ["My name is Ann Lee", "I am called Bo Xi.", "Signed, Al Po", "contact Jo Ma", "Regards, Su Li", "Mr. Jo Bo", "Mrs. Jo Bo", "Ms. Jo Bo",
             "Dr. Jo Bo", "+1-800-123-4567", "(123) 456-7890", "555-1234", "123 456 7890", "1 Main St", "12 Old Oak Lane", "New York, NY 10001"]
    for t in texts:
        for pattern, hit in ((rules.NAME_J, any(c in t for c in rules.NAME_HINTS)), (rules.PHONE_J, bool(re.search(rules.PHONE_HINT, t))),
                             (rules.ADDRESS_J, bool(re.search(rules.ADDRESS_HINT, t)))):
            assert hit or not re.search(pattern, t), (t, pattern)


def test_completeness_rules(spark):
    cases = {"I am fine today.": "ok", "too short": "too_short", "<b> <i> <u>": "only_markup",
             "123 456 789.": "garbled", "this ends abruptly and": "abrupt_end",
             "[INST] [/INST] <x>": "only_markup", "she said ‘no’": "ok",
             "and then we left.": "fragment_start", "...was all he said.": "fragment_start", ", she went on.": "fragment_start",
             "android is my phone.": "ok", "And then we left.": "ok"}
    df = spark.createDataFrame([(k,) for k in cases], "post string")
    got = {r.post: r.reason for r in df.select("post", rules.completeness_reason(F.col("post")).alias("reason")).collect()}
    assert got == cases


def test_pii_rules(spark):
    cases = {
        "call 555-1234 now": (["phone"], "555-1234"),
        "dial +1-800-123-4567 today": (["phone"], "+1-800-123-4567"),
        "or (123) 456-7890": (["phone"], "(123) 456-7890"),
        "at 123 Main St, New York, NY 10001": (["address"], "123 Main St; New York, NY 10001"),
        "moved to Boston, MA 02134 last year": (["address"], "Boston, MA 02134"),
        "Boston, Ma 02134 or Boston, MA 0213": ([], ""),
        "Regards, Peter Miller": (["name"], "Peter Miller"),
        "see Dr. Ann Black and Mr. John Doe": (["name"], "Ann Black"),
        "My name is John Doe": ([], ""),
        "hi, my name is Alice Smith, 555-1234": (["name", "phone"], "Alice Smith; 555-1234"),
        "I live in New York": ([], ""),
        "id x555-1234": ([], ""),                       # no word boundary after a letter
        "id é555-1234": (["phone"], "555-1234"),        # ASCII boundary, as in RE2
    }
    df = spark.createDataFrame([(k,) for k in cases], "text string")
    got = {r.text: (list(r.pii_types), r.pii_details, r.has_pii) for r in rules.with_pii(df).collect()}
    for k, (types, details) in cases.items():
        assert got[k] == (types, details, bool(types)), k


def test_csv_round_trip(spark, tmp_path):
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("i", T.LongType()), T.StructField("t", T.StringType())])
    rows = [(1, "NA"), (2, "null"), (3, ""), (4, None), (5, 'he said "hi"\nnext'), (6, "  padded  "),
            (7, "na"), (8, "N/A")]
    df = spark.createDataFrame(rows, schema)
    path = str(tmp_path / "csv")
    csvio.write_csv(df, path)
    got = {r.i: r.t for r in csvio.read_csv(spark, path, schema).collect()}
    assert got == {1: None, 2: None, 3: None, 4: None, 5: 'he said "hi"\nnext', 6: "  padded  ",
                   7: "na", 8: None}
