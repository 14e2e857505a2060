"""Operators of layout and rollups on literal rows: chains, ties, nulls, repeats and empty tables."""

import random

from paperlake.operators import layout, rollups

NODES, EDGES = "page_id long, id long", "page_id long, a long, b long"


def test_components_equal_brute_force(spark):
    rng = random.Random(5)
    nodes = {(p, i) for p in (1, 2) for i in range(60)}
    edges = [(p, rng.randrange(60), rng.randrange(60)) for p in (1, 2) for _ in range(35)]
    chain = list(range(100, 140))
    rng.shuffle(chain)
    nodes |= {(3, i) for i in chain}
    edges += [(3, a, b) for a, b in zip(chain, chain[1:])] + [(3, 100, 999), (3, None, 101), (1, 7, 7)]
    want = {n: n[1] for n in nodes}
    for _ in range(len(chain)):
        for p, a, b in edges:
            if (p, a) in want and (p, b) in want:
                want[p, a] = want[p, b] = min(want[p, a], want[p, b])
    rows = [*nodes, (1, 7), (None, 1), (1, None)]
    got = layout.components(spark.createDataFrame(rows, NODES), spark.createDataFrame(edges + edges, EDGES), "page_id").collect()
    assert len(got) == len(nodes) and {(r.page_id, r.id): r.component for r in got} == want
    assert layout.components(spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES), "page_id").collect() == []


def test_consensus_takes_two_of_three(spark):
    cases = {
        "agree": ([5.0, 5.01], (1, "5.00", False)), "third for first": ([5.0, 7.0, 5.0], (1, "5.00", False)), "third for second": ([5.0, 7.0, 7.0], (2, "7.00", False)),
        "none": ([5.0, 7.0, 9.0], (1, "5.00", True)), "no third": ([5.0, 7.0], (1, "5.00", True)), "first lacks": ([None, 7.0], (2, "7.00", False)),
        "second lacks": ([5.0, None, 9.0], (1, "5.00", False)), "all lack": ([None, None], (1, "None", False)),
    }
    rows = [(k, i + 1, v) for k, (values, _) in cases.items() for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "item string, reading_no int, amount double").selectExpr("item", "reading_no", "CAST(amount AS DECIMAL(12,2)) AS amount")
    got = {r["item"]: (r.reading_no, str(r.amount), r.uncertain) for r in layout.deposit_consensus(df).collect()}
    assert got == {k: w for k, (_, w) in cases.items()}


def test_near_words_and_regions(spark):
    words = [(1, 1, 0.10, 0.10, "a"), (1, 2, 0.39, 0.12, "b"), (1, 3, 0.41, 0.12, "c"), (1, 4, 0.10, 0.40, ""), (1, 5, None, 0.1, "x"), (2, 1, 0.1, 0.1, None)]
    df = spark.createDataFrame(words, "page_id long, word_no int, x double, y double, content string")
    assert sorted(tuple(r) for r in layout.nearby_words(df).collect()) == [(1, 1, 2, False), (1, 2, 3, True)]
    boxes = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.39, 0.5), (2, 0, 0.5, 0.5, 1.0, 1.0), (3, 0, 0.0, 0.0, 1.0, 1.0)], "page_id long, region_idx int, x0 double, y0 double, x1 double, y1 double")
    got = sorted((r.page_id, r.region_idx, r.words, r.text) for r in layout.words_in_regions(df, boxes).collect())
    assert got == [(1, 0, 3, "a\nb"), (2, 0, 0, ""), (3, 0, 0, "")]
    assert layout.nearby_words(df.limit(0)).collect() == [] and layout.words_in_regions(df, boxes.limit(0)).collect() == []


def test_anchor_strips(spark):
    page = lambda p, ys: [(p, y, "Pay") for y in ys] + [(p, 0.5, "total"), (p, None, "PAY"), (p, 0.5, None)]
    rows = page(1, [0.0, 0.125, 0.75, 0.75]) + page(2, [0.0, 0.125, 0.75]) + page(3, [0.0, 0.1, 0.2, 0.3]) + page(4, [0.0, 0.125, 0.5, 0.75, 0.75])
    got = layout.anchor_groups(spark.createDataFrame(rows, "page_id long, y double, content string")).collect()
    middle = (0.0625 + 0.75) / 2
    want = [(1, 0.0, middle + 0.04), (2, middle - 0.04, 1.0)]
    assert sorted((r.page_id, r.strip, r.top, r.bottom) for r in got) == [(p, *w) for p in (1, 4) for w in want]


def test_recovery_has_limits(spark):
    rows = [("a", i, "instrument", 1, 0, 5) for i in range(1, 11)] + [("b", i, "unknown", i, 0, 1) for i in (2, 3)]
    rows += [("b", 9, "back", None, 1, 20), ("b", 1, "instrument", None, None, None), ("b", 4, "batch_report", 9, 0, 9)]
    df = spark.createDataFrame(rows, "doc_id string, page_number int, kind string, front_score int, n_instruments int, n_regions int")
    got = sorted((r.doc_id, r["rank"], r.page_number, r.calls) for r in layout.recovery_pages(df).collect())
    assert got == [("a", i, i, 5) for i in range(1, 8)] + [("a", 8, 8, 1), ("b", 1, 3, 1), ("b", 2, 1, 0), ("b", 3, 9, 8)]


def test_requests_rows_and_uploads(spark):
    asks = spark.createDataFrame([(3, "x", 1), (1, "x", 1), (2, "x", None), (4, "y", 1)], "request_id long, kind string, page int")
    known = rollups.request_keys(asks.where("request_id = 4"), ("kind", "page"))
    assert sorted((r.request_id, r.asked) for r in rollups.pending_requests(asks, known, ("page", "kind")).collect()) == [(1, 2), (2, 1)]
    reads = [(1, 1, "crop", "7", None, 5.0), (1, 2, "text", "7", "A", 5.0), (1, 3, "page", "", "7", 5.0), (1, 4, "page", None, None, None), (1, 5, None, None, None, 2.0), (1, 6, "page", None, None, 2.0)]
    df = spark.createDataFrame(reads, "page_id long, row_no int, reader string, serial_number string, account_number string, amount_numeric double")
    got = sorted((r.row_key, float(r.amount), r.row_no, r.reader) for r in rollups.combined_rows(df).collect())
    assert got == [("", 2.0, 6, "page"), ("7", 5.0, 2, "text")]
    kind = "upload_id long, extracted_text string, page_texts array<struct<page_number:int,text:string>>"
    ups = spark.createDataFrame([(1, "abc", [(None, "p"), (7, None)]), (2, None, []), (3, "", None)], kind)
    assert sorted(tuple(r) for r in rollups.upload_pages(ups).collect()) == [(1, 1, "p"), (1, 7, "")]
    assert sorted(tuple(r) for r in rollups.upload_rows(ups).collect()) == [(1, 2, 3), (2, 0, 0), (3, 0, 0)]
