"""Answers, citations, focus lines, amounts read again, and search, on literal rows and against brute force."""

import math
import random
from decimal import Decimal as D

import pytest


def test_cited_answers(spark):
    from paperlake.operators.chat import cited_answers

    answers = [
        (1, " **A** [3] and [1 → Page 4; 2,3 → Page 9 ] then [7] [N → Page X] [n → Page 12] [3 → Page 2]. "),
        (2, "no documents [1] [N → Page X]"), (3, None), (4, "none cited"), (5, "[99999999999999999999] [2]"), (6, "[N]"),
    ]
    docs = [(1, 1, "a.pdf", "company", 5), (1, 2, "b.pdf", "uploaded", 8), (1, 3, "a.pdf", "company", None), (4, 1, "x", "company", 1), (5, 2, "y", "company", None), (6, 4, "z", "company", None), (6, 5, "w", "company", 3)]
    frames = spark.createDataFrame(answers, "answer_id long, text string"), spark.createDataFrame(docs, "answer_id long, doc_num int, filename string, kind string, first_page int")
    got = {r.answer_id: (r.text, [tuple(s) for s in r.sources]) for r in cited_answers(*frames).collect()}
    assert got == {
        1: ("A [1] and [1 → Page 4] [2] [1 → Page 9] then [7] [2 → Page 8] [2 → Page 12] [1 → Page 2].", [(1, "📁 a.pdf", "company"), (2, "📤 b.pdf", "uploaded")]),
        2: ("no documents [1] [N → Page X]", []), 3: ("", []), 4: ("none cited", []), 5: ("[99999999999999999999] [1]", [(1, "📁 y", "company")]), 6: ("[1 → Page 1]", [(1, "📁 z", "company")]),
    }
    assert cited_answers(frames[0].limit(0), frames[1].limit(0)).count() == 0


@pytest.mark.parametrize("mode, good", [("any", {1, 2, 3, 4, 5}), ("fences", {1, 2, 3}), ("outermost", {1, 4})])
def test_parse_answers_strictly(spark, mode, good):
    from paperlake.operators.texts import parse_answers

    bodies = [
        (1, '{"vendor_name": "v", "total": 3}'), (2, '```json\n{"vendor_name": "v", "total": 3,}\n```'), (3, '{"vendor_name": "v", "total": 3, "items": [1, 2,],}'), (4, 'So: {"vendor_name": "v", "total": 3} as asked'),
        (5, 'So: {"vendor_name": "v", "total": 3, }.'), (6, '{"vendor_name": "v" "total": 3}'), (7, '{"vendor_name": "v", "total": 3'), (8, "}{"), (9, ""), (10, None), (11, "[1, 2]"), (12, '{"a": 1} {"b": 2}'),
    ]
    rows = parse_answers(spark.createDataFrame([(1, i, b) for i, b in bodies], "doc_id long, response_no long, body string"), mode=mode).collect()
    assert {r.response_no for r in rows if r.error is None} == good
    assert all((r.vendor_name, r.total) == (("v", 3) if r.response_no in good else (None, None)) for r in rows)
    assert {r.error for r in rows if r.response_no in (6, 10)} == {'{"vendor_name": "v" "total": 3}', ""}


def test_parse_answers_fields(spark):
    from paperlake.operators.texts import parse_answers

    rows = spark.createDataFrame([(1, 1, '{"total": "many", "name": null}')], "doc_id long, response_no long, body string")
    assert tuple(parse_answers(rows, {"name": "string", "total": "int", "other": "double"}).first())[2:] == (None, None, None, None)


def test_match_verified(spark):
    from paperlake.operators.selection import match_verified

    def row(b, r, amount, words=None, page=1, quality=None, conflict=False):
        return (b, r, page, 2, D(amount) if amount is not None else None, D(words) if words else None, quality, conflict)

    rows = [row(1, r, 10) for r in range(1, 7)]  # the first four may be read again; 5 would help and isn't tried
    rows += [row(2, 1, 10), row(2, 2, 20)] + [row(3, 1, 10)] + [row(4, 1, 10), row(4, 2, 10, page=9)] + [row(5, 1, None), row(5, 2, 5, words=5)] + [row(6, 1, 10, conflict=True), row(6, 2, 10, conflict=True)] + [row(7, 1, 10)]
    readings = [(1, 1, 11, 0.9, True, "both"), (1, 2, 5, 0.9, True, "both"), (1, 3, 40, 0.71, True, "both"), (1, 4, 12, 0.72, False, "both"), (1, 5, 40, 0.9, True, "both")]
    readings += [(2, 1, 15, 0.9, True, "x"), (2, 2, 25, 0.9, True, "x"), (3, 1, 20, 0.9, True, "x"), (4, 1, None, 0.9, True, "x"), (4, 2, 30, 0.9, True, "x"), (5, 1, 7, 0.8, True, "x"), (5, 2, 9, 0.8, True, "x")]
    readings += [(6, 1, 20, 0.9, True, "numeric_box"), (6, 2, 20, 0.9, True, "both"), (7, 1, 500, 0.9, True, "x")]
    controls = [(1, 6, 90), (2, 2, 35), (3, 2, 20), (4, 2, 40), (5, None, 12), (6, 2, 30), (7, None, 500)]
    got = match_verified(
        spark.createDataFrame(rows, "batch_id long, row_no long, page_number int, total_pages int, amount_numeric decimal(12,2), words_amount decimal(12,2), image_quality string, conflict boolean"),
        spark.createDataFrame([(b, r, D(a) if a else None, *x) for b, r, a, *x in readings], "batch_id long, row_no long, amount decimal(12,2), confidence double, agree boolean, source string"),
        spark.createDataFrame([(b, n, D(t)) for b, n, t in controls], "batch_id long, expected_count int, deposit_total decimal(12,2)"),
    )
    # 1: 11 is nearer, 5 isn't; 2: one reading is enough; 3: too few rows; 4: null, and off the pages; 5: 2 has its words; 6: needs both kinds; 7: too wide a gap
    assert {(r.batch_id, r.row_no, int(r.amount_numeric)) for r in got.where("replaced").collect()} == {(1, 1, 11), (2, 1, 15), (5, 1, 7), (6, 2, 20)}
    assert got.count() == len(rows)


def test_focus_context(spark):
    from paperlake.operators.texts import focus_context

    plain = "\n".join(f"line {w}" for w in "abcdefghijklmnopqrstuvwxyz") + "\n" + "\n".join(f"more {w}{w}" for w in "abcdefghijklmnopqrstuvwxyz")
    texts = [
        (1, "one\r\n  two \t words \nPAY  EXACTLY\nfour\nfive\nsix\n$ 12\nTwo words!\n-\n--\nlast"), (2, None), (3, ""), (4, plain),
        (5, "\n".join(["check no 1", "x" * 20, "y" * 30, "serial 2"])), (6, "\n".join(["serial " + "x" * 30, "serial " + "y" * 5])),
    ]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: (r.lines, r.text) for r in focus_context(frame, 1000).collect()}
    assert got[1] == (5, "two words\nPAY EXACTLY\nfour\nsix\n$ 12")  # "Two words!" repeats a line
    assert got[2] == got[3] == (0, "") and got[4][0] == 35 and got[5][0] == 4
    cut = {r.doc_id: (r.lines, len(r.text)) for r in focus_context(frame, 50).collect()}
    assert cut[5] == (2, 31) and cut[6] == (2, 50)  # 6 fits exactly, though its last line break wouldn't


def test_nearest_and_words_equal_brute_force(spark):
    from paperlake.operators.search import best_by_words, nearest

    rng = random.Random(15)
    chunks = [(i, [float(rng.randint(-3, 3)) for _ in range(4)]) for i in range(300)] + [(900, None), (901, [0.0] * 4), (902, [1.0, None, 1.0, 1.0]), (903, [float("nan")] * 4), (904, [1.0] * 3), (None, [1.0] * 4)]
    queries = [(i, [float(rng.randint(-3, 3)) for _ in range(4)]) for i in range(20)] + [(50, None), (51, [0.0] * 4)]

    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))

    fit = [(i, v) for i, v in chunks if i is not None and v and len(v) == 4 and None not in v and any(v) and not math.isnan(v[0])]
    want = {(q, r, c) for q, v in queries if v and any(v) for r, (_, c) in enumerate(sorted((-cosine(v, w), c) for c, w in fit)[:7], 1)}
    frames = spark.createDataFrame(queries, "query_id long, vector array<double>"), spark.createDataFrame(chunks, "chunk_id long, vector array<double>").repartition(5)
    assert {(r.query_id, r.rank, r.chunk_id) for r in nearest(*frames, 7).collect()} == want
    assert nearest(frames[0].limit(0), frames[1], 3).count() == 0 and nearest(frames[0], frames[1].limit(0), 3).count() == 0

    words = "ant bee cat dog eel fox gnu".split()
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(1, 9)))) for i in range(120)] + [(500, None), (501, "")]
    asked = [(i, " ".join(rng.choices(words, k=3))) for i in range(6)] + [(9, "zebra"), (10, None)]
    n, mean = len(docs), sum(len((t or "").split()) for _, t in docs) / len(docs)
    df = {w: sum(w in (t or "").split() for _, t in docs) for w in words}
    want = set()
    for q, text in asked:
        scores = []
        for i, t in docs:
            own = (t or "").split()
            s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * own.count(w) * 2.2 / (own.count(w) + 1.2 * (0.25 + 0.75 * len(own) / mean)) for w in set((text or "").split()) if w in own)
            if s:
                scores.append((-round(s, 6), i))
        want |= {(q, r, i) for r, (_, i) in enumerate(sorted(scores)[:4], 1)}
    frames = spark.createDataFrame(asked, "query_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert {(r.query_id, r.rank, r.doc_id) for r in best_by_words(*frames, 4).collect()} == want


def test_hybrid_caps_parents(spark):
    from paperlake.operators.search import hybrid_search

    chunks = [(i, "p" if i < 20 else None, "  ", "", "word " * (i % 3) + "x" * 6000, [1.0, i / 100]) for i in range(26)] + [(30, "https://h/a%20b/c%2Bd+e.pdf;x?q", None, None, "word", [1.0, 0.3]), (31, "p", None, None, "", [1.0, 0.0]), (32, "p", None, None, None, None)]
    chunks = spark.createDataFrame(chunks, "chunk_id long, parent_id string, title string, filepath string, content string, vector array<double>")
    rows = hybrid_search(spark.createDataFrame([(1, "Word", [1.0, 0.0]), (2, None, None)], "query_id long, text string, vector array<double>"), chunks).orderBy("rank").collect()
    assert [r.rank for r in rows] == list(range(1, len(rows) + 1)) and {r.query_id for r in rows} == {1}
    assert sum(r.parent == "p" for r in rows) == 7 and max(len(r.content) for r in rows) == 5000 and len(rows) == 14
    assert {r.filename for r in rows} == {"Unknown Document", "c+d+e.pdf"} and not {31, 32} & {r.chunk_id for r in rows}


def test_best_rotation(spark):
    from paperlake.operators.rollups import best_rotation

    readings = [(1, 0, 1, 10), (1, 0, 2, 20), (1, 180, 1, 900), (1, 180, 2, 900)]  # upright agrees and stands, though the other sum is larger
    readings += [(2, 0, 1, 10), (2, 90, 1, 10), (2, 90, 2, 20)]  # the expected number is elsewhere
    readings += [(3, 180, 1, 5), (3, 90, 1, 5)]  # equal scores: the first in order
    readings += [(4, 0, 1, 5), (4, 270, 1, None), (4, 45, 1, 99)]  # no controls; no such orientation
    rows = spark.createDataFrame([(p, o, r, D(a) if a is not None else None) for p, o, r, a in readings], "page_id long, orientation int, row_no int, amount decimal(12,2)")
    controls = spark.createDataFrame([(1, 2, D(30)), (2, 2, D(500)), (3, None, None)], "page_id long, expected_count int, expected_total decimal(12,2)")
    assert sorted((r.page_id, r.orientation, r["items"], int(r.total)) for r in best_rotation(rows, controls).collect()) == [(1, 0, 2, 30), (2, 90, 2, 30), (3, 180, 1, 5), (4, 0, 1, 5)]
    assert best_rotation(rows.limit(0), controls).count() == 0
