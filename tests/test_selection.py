"""Reconciling subsets, chosen instruments, logical deposits, fuzzy matching and boxes, against brute force or literal rows."""

import itertools
import random
from difflib import SequenceMatcher

import pytest


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def brute_subset(rows, wanted, total, least):
    """rows (row_no, cents, quality) in order: the picks by trying all subsets."""
    for n in range(wanted, least - 1, -1):
        best = None
        for picks in itertools.combinations(range(len(rows)), n):
            if n and sum(rows[i][1] for i in picks) == total:
                key = (sum(rows[i][2] for i in picks), [-i for i in reversed(picks)])
                best = max(best, (key, picks)) if best else (key, picks)
        if best:
            return [rows[i][0] for i in best[1]]
    return None


def test_reconciling_subset_equals_trying_all(spark):
    from paperlake.operators.selection import reconciling_subset

    rng = random.Random(11)
    rows, controls, want = [], [], {}
    for b in range(150):
        own = [(r, rng.choice([0, 2500, 5000, 7500, 10000]), rng.randint(0, 9)) for r in range(1, rng.randint(1, 9))]
        wanted, total = rng.randint(1, 6), rng.choice([2500, 10000, 17500, 22500])
        least = wanted if b % 2 else 1
        rows += [(b, r, r, c / 100, q) for r, c, q in own]
        controls.append((b, wanted, total / 100, least))
        want[b] = brute_subset([x for x in own if x[1] <= total], wanted, total, least)
    got = reconciling_subset(frame(spark, rows, "batch_id long, row_no long, place long, amount double, quality int"), frame(spark, controls, "batch_id long, wanted long, total double, least long"))
    got = {r.batch_id: r for r in got.collect()}
    assert {b: list(r.picks) or None for b, r in got.items()} == want
    assert {r.outcome for r in got.values()} == {"found", "no_subset", "too_few_rows"}


def test_reconciling_subset_gives_up_as_reported(spark):
    from paperlake.operators.selection import reconciling_subset

    rows = [(1, i, i, 2.0**i / 100, 1) for i in range(12)] + [(2, 1, 1, None, 1), (4, 1, 1, 5.0, 1)]
    controls = [(1, 12, 40.95), (2, 1, 5.0), (3, 1, 5.0), (4, 0, 5.0), (5, 1, None)]
    frames = frame(spark, rows, "batch_id long, row_no long, place long, amount double, quality int"), frame(spark, controls, "batch_id long, wanted long, total double")
    assert {r.batch_id: r.outcome for r in reconciling_subset(*frames, most_states=100).collect()} == {1: "too_many_states", 2: "too_few_rows", 3: "too_few_rows", 4: "no_control", 5: "no_control"}
    assert {r.batch_id: r.outcome for r in reconciling_subset(*frames).collect()}[1] == "found"
    assert reconciling_subset(frames[0].limit(0), frames[1].limit(0)).count() == 0


SEEN = """batch_id long, row_no long, source string, page_number int, item_no int, serial_number string, micr_line string, check_number string, unit string, amount_numeric decimal(12,2),
 amount_words string, payee_raw string, issue_date date, image_quality string, missing_from_scan boolean, slip_page int, report_page int"""


def test_rules_of_select_instruments(spark):
    """Batches with a coherent and an incoherent report, a surplus with and without a subset, a shortfall, no count, and nothing seen."""
    from decimal import Decimal

    from paperlake.operators.selection import select_instruments

    def seen(b, row, amount, serial=None, page=1, source="scan"):
        return (b, row, source, page, None, serial or f"1{b}00{row}", None, None, None, Decimal(amount), None, None, None, None, False, None, None)

    def listed(b, row, amount, item, serial=None, source="yottareal_batch_detail"):
        return (b, row, source, 1, item, serial, None, None, None, Decimal(amount), None, None, None, None, None, 2, None)

    rows = [seen(1, 1, 10), seen(1, 2, 20), seen(2, 1, 10), seen(2, 2, 20), seen(2, 3, 5), seen(3, 1, 10), seen(3, 2, 20), seen(3, 3, 7), seen(4, 1, 10), seen(5, 1, 10), seen(5, 2, 20), seen(5, 3, 30), seen(7, 1, 9), seen(7, 2, 8, page=5)]
    register = [listed(1, 11, 40, 2), listed(1, 12, 15, 1, "777777"), listed(4, 11, 30, 2), listed(4, 12, 20, 1, "888888"), listed(4, 13, 10, 3, "14001"), listed(6, 11, 6, 1), listed(6, 12, 7, None, "999999", "regions_deposit_report")]
    controls = [(1, 2, 2, Decimal(55)), (2, 2, 2, Decimal(25)), (3, 2, 2, Decimal(99)), (4, 2, 2, Decimal(40)), (5, 2, None, Decimal(50)), (6, 2, None, None), (7, 2, 1, Decimal(9))]
    got = select_instruments(frame(spark, rows, SEEN), frame(spark, register, SEEN), frame(spark, controls, "batch_id long, total_pages int, expected_count int, deposit_total decimal(12,2)"))
    by = {}
    for r in got.orderBy("batch_id", "item_no").collect():
        by.setdefault(r.batch_id, []).append((r.rule, r.row_no, r.missing_from_scan, r.amount_status))
    assert by == {
        1: [("report", 12, True, None), ("report", 11, True, "candidate")],
        2: [("surplus", 2, False, None), ("surplus", 3, False, None)],
        3: [("surplus_kept", 1, False, None), ("surplus_kept", 2, False, None), ("surplus_kept", 3, False, None)],
        4: [("shortfall", 1, False, None), ("shortfall", 11, True, "candidate")],
        5: [("searched", 2, False, None), ("searched", 3, False, None)],
        6: [("register", 11, True, "candidate"), ("register", 12, False, None)],
        7: [("exact", 1, False, None)],
    }
    assert {r.instrument_id for r in got.where("batch_id = 5").collect()} == {"INS-5-001", "INS-5-002"}


CANDIDATE = "doc_id long, row_no long, page_number int, source_type string, source_system string, deposit_amount decimal(14,2), item_count int, deposit_account string, deposit_date string, deposit_transaction string, confidence double"


def deposit(doc, row, kind, amount, page=1, system=None, n=None, account=None, date=None, tx=None):
    return (doc, row, page, kind, system, amount, n, account, date, tx, 0.0)


def test_logical_deposits_by_rule(spark):
    from decimal import Decimal as D

    from paperlake.operators.deposits import logical_deposits

    rows = [
        # greedy groups: row 3 is like rows 1 and 2, which aren't like each other; it joins the first, and the groups stay two
        deposit(1, 1, "regions_report", D(5000), account="1111", n=3), deposit(1, 2, "regions_report", D(5000), account="2222", n=3, date="2024-01-01", page=9), deposit(1, 3, "regions_report", D(5000), n=3, date="2024-01-01", page=4),
        # a receipt takes in a ticket of its amount; another receipt of another amount stays
        deposit(2, 1, "bank_receipt", D(10), tx="A1", page=3), deposit(2, 2, "deposit_ticket", D(10), page=30, account="9876"), deposit(2, 3, "bank_receipt", D(20), tx="B1", page=2),
        # receipts that add up to the report replace it
        deposit(3, 1, "yottareal_report", D(30), n=9), deposit(3, 2, "bank_receipt", D(10), tx="A", n=1), deposit(3, 3, "bank_receipt", D(20), tx="B", n=2),
        # one receipt that doesn't: the report stays alone, filled from it
        deposit(4, 1, "yottareal_report", D(30), n=9), deposit(4, 2, "bank_receipt", D(9000), tx="A", account="5555", page=4),
        # nothing known
        deposit(5, 1, "metadata", None), deposit(5, 2, "metadata", D(0), n=0),
        # one source system: equal counts beside a receipt, though amounts differ by reading
        deposit(6, 1, "bank_receipt", D(100), n=4, system="First-Bank"), deposit(6, 2, "summary_page", D(1000), n=4, system="first bank", page=40),
    ]
    frame_ = frame(spark, rows, CANDIDATE).withColumn("deposit_date", __import__("pyspark.sql.functions", fromlist=["x"]).col("deposit_date").cast("date"))
    got = {}
    for r in logical_deposits(frame_).orderBy("doc_id", "place").collect():
        got.setdefault(r.doc_id, []).append((r.rule, r.source_type, float(r.deposit_amount), r.deposit_account, r.deposit_transaction, r.pages, r.flags))
    both = "duplicate_deposit_candidates_collapsed"
    assert got == {
        1: [("all", "regions_report", 5000.0, "1111", None, "1,4", both), ("all", "regions_report", 5000.0, "2222", None, "9", "")],
        2: [("all", "bank_receipt", 20.0, None, "B1", "2", ""), ("all", "bank_receipt", 10.0, "9876", "A1", "3,30", both)],
        3: [("receipts", "bank_receipt", 10.0, None, "A", "1", ""), ("receipts", "bank_receipt", 20.0, None, "B", "1", "")],
        4: [("report", "yottareal_report", 30.0, "5555", "A", "1,4", "aggregate_control_superseded_component_deposits")],
        6: [("all", "bank_receipt", 100.0, None, None, "1,40", both)],
    }
    assert logical_deposits(frame_.limit(0)).count() == 0


@pytest.mark.parametrize("alphabet, longest", [("ab", 12), ("0123456789", 16), ("ABC0é", 9)])
def test_alike_pairs_lose_none(spark, alphabet, longest):
    from paperlake.operators.similar import alike_pairs

    rng = random.Random(len(alphabet))
    rows = []
    for i in range(260):
        text = "".join(rng.choices(alphabet, k=rng.randint(0, longest)))
        if rows and rng.random() < 0.6:  # a misread copy
            base = list(rng.choice(rows)[2] or "")
            for _ in range(rng.randint(0, 3)):
                at = rng.randint(0, len(base))
                base[at : at + rng.randint(0, 1)] = rng.choice(alphabet) * rng.randint(0, 1)
            text = "".join(base)
        rows.append((i % 2, i, text if i % 50 else None))
    got = {(r.page, r.a, r.b) for r in alike_pairs(frame(spark, rows, "page long, id long, t string"), "page", "id", "t").collect()}
    want = {(p, a, b) for p, a, s in rows for q, b, t in rows if p == q and a < b and s and t and SequenceMatcher(None, t, s).ratio() >= 0.82}
    assert got == want and len(want) > 100


def test_greedy_merge_is_not_components(spark):
    from paperlake.operators.boxes import greedily_merged, suppress_contained

    chain = [(1, 1, 0.0, 0.0, 0.4, 1.0, 0.9), (1, 2, 0.3, 0.0, 0.7, 1.0, 0.8), (1, 3, 0.15, 0.0, 0.55, 1.0, 0.1), (1, 4, 0.9, 0.9, 1.0, 1.0, None)]
    boxes = frame(spark, chain, "page_id long, region_idx long, x0 double, y0 double, x1 double, y1 double, confidence double")
    got = [(r.place, r.region_idx, round(r.x0, 2), round(r.x1, 2), r.members) for r in greedily_merged(boxes, 0.42).orderBy("place").collect()]
    assert got == [(1, 1, 0.0, 0.55, 2), (2, 2, 0.3, 0.7, 1), (3, 4, 0.9, 1.0, 1)]  # box 3 links 1 and 2, yet they stay apart
    nested = [(1, 1, 0.0, 0.0, 0.5, 0.5, 0.9), (1, 2, 0.1, 0.1, 0.6, 0.6, 0.8), (1, 3, 0.35, 0.35, 0.65, 0.65, 0.7), (1, 4, 0.0, 0.0, 0.5, 0.5, 0.1)]
    boxes = frame(spark, nested, "page_id long, region_idx long, x0 double, y0 double, x1 double, y1 double, confidence double")
    # box 3 lies mostly in box 2, but box 2 isn't enough in box 1 to go, so 3 goes; were 2 dropped, 3 would stay
    assert [r.region_idx for r in suppress_contained(boxes).orderBy("place").collect()] == [1, 2]
    assert [r.region_idx for r in suppress_contained(boxes, 0.6).orderBy("place").collect()] == [1, 3]


def test_evidence_groups_sweep(spark):
    """Groups by the sweep are those of all pairs, and a page of very many words is no pairing of all with all."""
    from paperlake.operators.boxes import _swept, evidence_groups

    rng = random.Random(13)
    for n, spread in ((2, 1.0), (9, 1.0), (40, 1.0), (12, 3.0), (25, 4.0)):
        for _ in range(60):
            pts = sorted((i, rng.random() * spread, rng.random() * spread) for i in range(n))
            group = {i: i for i, _, _ in pts}
            changed = True
            while changed:
                changed = False
                for i, x, y in pts:
                    for j, u, v in pts:
                        if abs(x - u) < 0.30 and abs(y - v) < 0.28 and group[i] != group[j]:
                            group[i] = group[j] = min(group[i], group[j])
                            changed = True
            assert dict(_swept((), iter(sorted(pts, key=lambda p: (p[1], p[2], p[0]))))) == group
    words = [(1, i, x := rng.random() * 0.9, y := rng.random() * 0.9, x + 0.01, y + 0.01, ["$ 5.00", "123456"][i % 2], 0.5) for i in range(100_000)]
    words += [(2, 1, 0.1, 0.1, 0.2, 0.2, "123456", None), (2, 2, 0.1, 0.1, 0.2, 1.2, "$ 5.00", 1.0), (2, 3, None, 0.1, 0.2, 0.2, "$ 5.00", 1.0)]
    got = evidence_groups(frame(spark, words, "page_id long, word_no long, x0 double, y0 double, x1 double, y1 double, content string, confidence double")).collect()
    assert [(r.page_id, r.group_no, r.words, r.kinds) for r in got] == [(1, 0, 100_000, "amount_box,micr")]


def test_distinct_hashes(spark):
    from pyspark.sql import functions as F

    from paperlake.operators.boxes import bit_hash, distinct_hashes

    rng = random.Random(14)
    rows = []
    for i in range(400):
        h = rng.getrandbits(64) if i < 3 or rng.random() < 0.2 else rows[rng.randrange(len(rows))][2] ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 7)))
        rows.append((i % 3, i, h))
    rows = [(p, i, h - (1 << 64) if h >> 63 else h) for p, i, h in rows] + [(0, 900 + i, 5) for i in range(300)] + [(0, 2000, None)]
    want, kept = set(), {}
    for p, i, h in rows:
        if h is None or all(bin((h ^ k) & (1 << 64) - 1).count("1") >= 0.08 * 64 for k in kept.get(p, [])):
            want.add((p, i))
            if h is not None:
                kept.setdefault(p, []).append(h)
    assert {(r.page_id, r.item) for r in distinct_hashes(frame(spark, rows, "page_id long, item long, hash long")).collect()} == want
    values = [(list(range(64)),), ([5] * 64,)]
    assert [r.h for r in frame(spark, values, "v array<long>").select(bit_hash(F.col("v")).alias("h")).collect()] == [(1 << 32) - 1, 0]
