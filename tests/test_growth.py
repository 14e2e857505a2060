"""Steps whose cost must grow no faster than the rows: small groups take the short way, crowded ones the same rows by another."""

import functools
import re

import pytest

from paperlake import crowds
from paperlake.views import view


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def same(a, b):
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


@pytest.mark.parametrize("name, key", [("v_candidates", "row_no"), ("v_deposits", "page_number")])
def test_deposits_of_small_documents_meet_without_copies(spark, tables, monkeypatch, name, key):
    from paperlake.operators import deposits

    rows = view(spark, tables, name).dropDuplicates(["doc_id", key]).localCheckpoint()
    short = deposits.same_deposit_rows(rows, key)
    assert "Generate" not in plan(short)
    monkeypatch.setattr(deposits, "by_crowd", functools.partial(crowds.by_crowd, most=3))
    long = deposits.same_deposit_rows(rows, key)
    assert "Generate" in plan(long)
    same(short, long)


@pytest.mark.parametrize("name", ["amount_from_words", "property_aliases", "money", "date", "labelled_amount", "serial", "serial_in", "payee", "micr", "issuer", "property_name"])
def test_a_value_is_worked_out_once(spark, name):
    """A column that is named twice is worked out twice, so expressions that name earlier ones again and again had thousands of parts."""
    from pyspark.sql import functions as F

    from paperlake.functions import normalise as N

    text = str(getattr(N, name)(F.col("text")))
    assert text.count("regexp") + text.count("RLIKE") < 120
    assert text.count("text") == 1 or name in ("property_aliases",) and text.count("text") <= 6


@pytest.mark.parametrize("name", ["score_pages", "classify_pages", "tag_reports"])
def test_page_texts_are_made_plain_once(spark, name):
    from paperlake.operators import pages

    rows = getattr(pages, name)(spark.createDataFrame([("PAY EXACTLY $5.00",)], "text string"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("translate(") == 1


def test_page_patterns_are_tried_where_their_words_are(spark):
    """Each of some sixty patterns was tried on every text; now only on those that have its words, with the same counts."""
    from pyspark.sql import functions as F

    from paperlake.operators import pages

    patterns = [*(p for *_, p in pages.SIGNALS), *pages.BACKS, *pages.BANK_REPORT, r"\bENDORSE|DEPOSITORY\s+BANK|DO\s+NOT\s+WRITE", r"\$\s*\d", r"\bMONEY\s*ORDER\b"]
    plain = lambda p: re.sub(r"\\s[+*]", " ", re.sub(r"\\b|\?", "", p))
    texts = [x for p in patterns for x in plain(p).split("|") if "\\d" not in x and "(" not in x]
    texts += ["$12.00", "$ 1234,56 $ 7", "12-1234567", "123456789", "12 34567", "COMMERCIAL DEPOSIT $1,200.00", "COMMERCIAL DEPOSIT SAVINGS 7.25", "SAVINGS DEPOSIT 1.00", "CHECKING DEPOSIT CASH OR CHECKS", "CHECK TOTAL", "PAYMENT CHECK", "BATCH#A", "CHASE x\nTRANSACTION SUMMARY"]
    texts = [*texts, *(f"X{t}" for t in texts), *(f"{t}X" for t in texts), *(t[:-1] for t in texts), " ".join(texts), ""]
    t = F.col("t")
    assert all("contains" in str(pages._times(t, p)) for p in patterns if r"\d{7,12}" not in p)
    both = F.array(*(F.struct(pages._times(t, p).alias("got"), pages._has(t, p).alias("has"), F.regexp_count(t, F.lit(p)).alias("want")) for p in patterns))
    found = [(p, r.t, x) for r in spark.createDataFrame([(x,) for x in texts], "t string").select("t", both.alias("all")).collect() for p, x in zip(patterns, r.all, strict=True)]
    assert [x for x in found if (x[2].got, x[2].has) != (x[2].want, x[2].want > 0)] == []
    assert len({(p, x.has) for p, _, x in found}) == 2 * len(set(patterns))
    odd = spark.createDataFrame([("a ‘b’  c\t d",), ("a\tb",), (" a b ",), (None,)], "t string").select(pages.N.plain(t)).collect()
    assert [r[0] for r in odd] == ["a 'b' c d", "a b", " a b ", ""]


def test_observations_of_small_pages_meet_by_one_shuffle(spark, tables, monkeypatch):
    from paperlake.operators import similar

    rows = view(spark, tables, "v_observations").localCheckpoint()
    short = similar.same_instrument_pairs(rows)
    assert "Generate" not in plan(short) and plan(short).count("Window") == 0
    monkeypatch.setattr(similar, "by_crowd", functools.partial(crowds.by_crowd, most=2))
    same(short, similar.same_instrument_pairs(rows))


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_word_kinds_name_their_text_once(spark):
    from pyspark.sql import functions as F

    from paperlake.operators import boxes

    for kind in (boxes.node_kind, boxes.anchor_kind):
        assert str(kind(F.col("content"))).count("content") == 1
    words = [(1, i, 0.1, 0.1, 0.2, 0.2, t, 0.5) for i, t in enumerate(["CHECK", "Check 7", "pay to", "12 34", "$5", "remitter", "for deposit", None])]
    rows = spark.createDataFrame(words, "page_id long, word_no long, x0 double, y0 double, x1 double, y1 double, content string, confidence double")
    got = rows.select(boxes.node_kind(F.col("content")), boxes.anchor_kind(F.col("content"))).collect()
    assert list(map(tuple, got)) == [(None, None), ("document_number", None), ("payee", "front"), ("micr", "number"), ("amount_box", "amount"), (None, "front"), (None, "back"), (None, None)]


@pytest.mark.parametrize("name", ["evidence_groups", "amount_bound_regions"])
def test_words_are_read_once_for_both_sides(spark, tables, name):
    from paperlake.operators import boxes

    rows = view(spark, tables, "v_placed_words")
    assert plan(getattr(boxes, name)(rows)).count("lineitem") == 0


def test_inferred_property_works_a_name_out_once(spark):
    from paperlake.operators.selection import inferred_property

    rows = spark.createDataFrame([(1, 1, "First Bank"), (1, 2, "oak court"), (1, 3, "Oak  Court"), (2, 1, None)], "batch_id long, row_no long, payee_raw string")
    assert optimized(inferred_property(rows)).count("APARTMENT") == 1
    assert list(map(tuple, inferred_property(rows).collect())) == [(1, "Oak Court", 2)]


def test_answers_that_cannot_be_json_are_not_parsed(spark):
    from pyspark.sql import functions as F

    from paperlake.operators import texts

    bodies = ['{"a": [1,]}', '{"a": 1, }', '{"a": "b" "c": 2}', '{"a": {"b": 1}', '{"a": ",]"}', '{"a": "{"}', '{"a": "x\\",]"}', '{"a": "", "b": ""}', '{"a": "b, }']
    broken = spark.createDataFrame([(b,) for b in bodies], "body string").select(texts._surely_broken(F.col("body"))).collect()
    assert [r[0] for r in broken] == [True, True, True, True, False, False, False, False, True]


def test_focus_lines_equal_their_patterns(spark):
    import re

    from pyspark.sql import functions as F

    from paperlake.operators import texts

    parts = "|".join(texts.FOCUS).split("|")
    examples = [re.sub(r"\\b|\?", "", p).replace(r"\s+", " ").replace(r"\s*", "").replace("[-\\s]", "-").replace("[/.-]", "/").replace(r"\d{7,12}", "1234567").replace(r"\d{9,14}", "123456789").replace(r"\d{1,2}", "1") for p in parts]
    examples = [e.replace(r"\d{2,4}", "22").replace(r"\d{2}", "12").replace(r"\d", "4").replace("\\$", "$").replace("\\*+", "*") for e in examples]
    lines = [*examples, *(e.lower() for e in examples), *(e[1:] for e in examples), "Total", "subtotals", "totality", "aptly", "Pay  exactly", "payexactly", "ſerial", "# x 4", "none of it", "", None]
    rows = spark.createDataFrame([(x,) for x in lines], "line string").select("line", texts._focused(F.col("line")).alias("got"), F.col("line").rlike("(?i)" + "|".join(texts.FOCUS)).alias("want")).collect()
    assert [r for r in rows if r.got != r.want] == [] and sum(bool(r.got) for r in rows) > len(parts)


def test_instruments_are_graded_once(spark, tables, monkeypatch):
    from paperlake.operators import selection

    class Stop(Exception):
        pass

    kept = []

    def spy(df):
        kept.append(df.columns)
        if "ids" in df.columns:
            kept.append(optimized(df).count("APARTMENT"))
            raise Stop
        return df.localCheckpoint()

    monkeypatch.setattr(selection, "written", spy)
    with pytest.raises(Stop):
        selection.select_instruments(*(view(spark, tables, v) for v in ("v_seen", "v_listed", "v_controls")))
    # the controls, then the graded rows, whose plan makes a payee once
    assert kept[0] == ["batch_id", "total_pages", "expected_count", "deposit_total"] and kept[2] == 1


def test_groups_of_small_pages_need_no_rounds(spark, tables, monkeypatch):
    """Every round of labels was two joins and a written table of all nodes, and few pages need any."""
    from paperlake.operators import layout, texts

    regions = view(spark, tables, "v_regions").localCheckpoint()
    pairs = texts.overlapping_regions(regions).localCheckpoint()
    nodes, edges = regions.selectExpr("page_id", "region_idx AS id"), pairs.selectExpr("page_id", "region_idx_a AS a", "region_idx_b AS b")
    rounds = layout.written

    def short():
        monkeypatch.setattr(layout, "written", lambda df: pytest.fail("a round was written"))
        return [layout.components(nodes, edges, "page_id").localCheckpoint(), layout.merged_regions(regions, pairs).localCheckpoint()]

    groups, boxes = short()
    monkeypatch.setattr(layout, "written", rounds)
    monkeypatch.setattr(layout, "by_crowd", functools.partial(crowds.by_crowd, most=3))
    same(groups, layout.components(nodes, edges, "page_id"))
    same(boxes, layout.merged_regions(regions, pairs))


def test_requests_meet_their_answers_without_the_long_key(spark, tmp_path):
    from paperlake.operators.increments import with_reader

    rows = spark.createDataFrame([(1, None, 5), (2, None, 5), (3, "a", None), (4, "a", 5), (5, "", 5)], "request_id long, kind string, page long")
    out = with_reader(rows, ("kind", "page"), lambda f: f.assign(text=[f"{k}/{p}" for k, p in zip(f["kind"], f["page"], strict=True)])[["text"]], "text string", f"file://{tmp_path}/answers")
    assert "sha2" not in plan(out)
    got = {r.request_id: r for r in out.collect()}
    assert len(got) == 5 and out.columns == ["request_key", "request_id", "kind", "page", "text", "error"]
    assert len({r.request_key for r in got.values()}) == 4 and got[1].request_key == got[2].request_key and got[1].text == got[2].text
    assert got[4].text.startswith("a/5") and got[5].text.startswith("/5") and not any(r.error for r in got.values())


def test_merged_observations_stay_in_their_pages_shuffle(spark, tables):
    from paperlake.operators import similar

    rows = view(spark, tables, "v_observations").localCheckpoint()
    found = re.sub(r"#\d+L?", "", plan(similar.merge_observations(rows, similar.same_instrument_pairs(rows).localCheckpoint())))
    assert "Expand" not in found and "hashpartitioning(page_id," in found
    assert "hashpartitioning(page_id, row_no" not in found and "hashpartitioning(page_id, group_no" not in found


def test_grouped_deposits_stay_in_their_documents_shuffle(spark, tables, monkeypatch):
    from paperlake.operators import deposits

    plans = []

    def spy(df):
        plans.append(re.sub(r"#\d+L?", "", plan(df)))
        return df.localCheckpoint()

    monkeypatch.setattr(deposits, "written", spy)
    deposits.logical_deposits(view(spark, tables, "v_candidates"))
    merged = plans[1]
    assert "hashpartitioning(doc_id," in merged
    assert "hashpartitioning(doc_id, row_no" not in merged and "hashpartitioning(doc_id, group_no" not in merged


def test_words_that_cannot_be_like_a_payee_are_not_rated(spark, monkeypatch):
    from paperlake.operators import similar

    seen, rate = [], similar.with_ratio

    def spy(pairs, left, right):
        seen.extend((r.p, r.t, r.word) for r in pairs.collect())
        return rate(pairs, left, right)

    monkeypatch.setattr(similar, "with_ratio", spy)
    rows = spark.createDataFrame([(1, 1, "Maplewood Gardens"), (1, 2, "Maplewod"), (1, 3, None), (2, 1, "Quite other")], "batch_id long, line_no long, payee_raw string")
    names = spark.createDataFrame([(1, "Maplewood Gardens Apartments"), (2, "12 Birch")], "batch_id long, alias string")
    got = {(r.batch_id, r.line_no): r.score for r in similar.payee_score(rows, names).collect()}
    # the shorter text has two thirds of the longer one's length at least, or the ratio can't be 0.8
    assert all(min(len(p), len(t)) * 3 >= max(len(p), len(t)) * 1.99 for p, t, word in seen if word) and ("MAPLEWOD", "MAPLEWOOD", True) in seen
    assert got == {(1, 1): 0.95, (1, 2): 0.941, (1, 3): 0.0, (2, 1): got[2, 1]} and got[2, 1] < 0.8


def test_instruments_are_dealt_by_batch_only(spark, tables, monkeypatch):
    """Rows were shuffled by the keys of every step; now once by batch, of which all that is asked of their neighbours is a part. Crowded batches meet by keys as before."""
    from paperlake.operators import selection

    plans, frames = [], [view(spark, tables, v).localCheckpoint() for v in ("v_seen", "v_listed", "v_controls")]

    def spy(df):
        plans.append(plan(df))
        return df.localCheckpoint()

    monkeypatch.setattr(selection, "written", spy)
    short = selection.select_instruments(*frames).localCheckpoint()
    dealt = [re.sub(r"#\d+L?", "", x) for x in re.findall(r"hashpartitioning\(([^)]*)\)", plans[1])]
    assert dealt and all(re.fullmatch(r"batch_id, \d+", x) for x in dealt) and len(plans) == 3
    monkeypatch.setattr(selection, "SMALL", 6)
    same(short, selection.select_instruments(*frames))
    assert len(plans) == 7


def test_lines_that_several_tables_read_are_written_once(spark, tables, monkeypatch):
    from paperlake import views

    kept = []
    monkeypatch.setattr(views, "written", lambda df: kept.append(df.columns) or df.localCheckpoint())
    seen, listed = views.views(spark, tables, ["v_seen", "v_listed"])
    assert kept == [["batch_id", "line", "part", "supp", "day"]] and "Window" not in plan(seen) + plan(listed)
    same(seen, view(spark, tables, "v_seen"))
    views.views(spark, tables, ["v_heads", "v_observations"])
    assert len(kept) == 1


def test_batches_are_summed_where_their_instruments_lie(spark, tables, monkeypatch):
    """The instruments chosen were written twice, and shuffled by batch, by serial and by unit; now a row a batch is written, and nothing is dealt by more than the batch."""
    from paperlake.operators import batches, selection

    kept, frames = {}, [view(spark, tables, v).localCheckpoint() for v in ("v_heads", "v_slips", "v_seen", "v_listed")]

    def spy(df):
        kept[tuple(df.columns)] = plan(df)
        return df.localCheckpoint()

    monkeypatch.setattr(selection, "written", spy)
    got = selection.validate_batches(*frames, as_of="1998-12-01")
    assert not any("instrument_id" in c for c in kept)
    sums = kept["batch_id", "shown", "total", "n", "soft"]
    assert sums.count("Window") >= 2 and "hashpartitioning(serial" not in sums and not re.search(r"hashpartitioning\(batch_id#\d+L?, (serial|unit)", sums)
    # as by way of the instruments themselves
    controls, chosen = selection.finalize_evidence(*frames)
    chosen = chosen.withColumn("line_no", chosen["item_no"])
    same(got, batches.batch_reconciliation(controls, chosen, batches.risk_scores(chosen, "1998-12-01")))
