"""Choosing a batch's instruments: the rows that reconcile with its controls, and placeholders for the rest."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..crowds import SMALL
from ..folds import fold
from ..functions import is_empty, let
from ..functions import normalise as N
from ..tables import written
from .batches import (
    batch_reconciliation,
    batch_soft,
    batch_sums,
    identity_keys,
    is_bare,
    match_keys,
    multiset_match,
    placeholder_facts,
    reconciled,
    risk_scores,
    with_match,
    with_risk,
)
from .deposits import logical_deposits
from .records import visible_with

#: Registers whose rows may stand in for instruments that weren't seen, and when the search for a sum is given up.
STAND_INS = ("regions_deposit_report", "transaction_detail_report", "yottareal_batch_detail")
MOST_STATES = 250_000


def instrument_quality(strong: Column, serial: Column, payee: Column, words: Column) -> Column:
    """How much of an instrument was read, given whether it is strong and its serial, payee and written amount are known."""
    points = [(strong, 50), (serial, 12), (~is_empty(F.col("micr_line")), 10), (words, 10),
              (payee, 8), (F.col("issue_date").isNotNull(), 5), (F.col("image_quality") == "unclear", -5)]
    total = F.lit(0)
    for test, value in points:
        total = total + F.when(F.coalesce(test, F.lit(False)), value).otherwise(0)
    return total


class _Sums:
    """Best ways to reach a sum with a number of rows: (rows, cents) to (quality, chain of row numbers).

    Rows come in order; of equal qualities the way found first stays. Chains share their tails, so a state is a few numbers."""

    def __init__(self, most_rows: int, target: int) -> None:
        self.most, self.target = most_rows, target
        self.best: dict[tuple[int, int], tuple[int, tuple | None]] = {(0, 0): (0, None)}

    def add(self, row: int, cents: int, quality: int) -> None:
        best = self.best
        for (n, total), (score, chain) in list(best.items()):
            if n < self.most and total + cents <= self.target:
                at = (n + 1, total + cents)
                if at not in best or score + quality > best[at][0]:
                    best[at] = (score + quality, (row, chain))

    def rows(self, n: int) -> list[int] | None:
        if (found := self.best.get((n, self.target))) is None or not n:
            return None
        out, chain = [], found[1]
        while chain is not None:
            row, chain = chain
            out.append(row)
        return out[::-1]


def _search(most_states: int):
    def step(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        """Rows are (row, cents, quality, wanted, target, least); wanted, target and least are the same in all of them."""
        sums, seen, states, over = None, 0, 0, False
        kept: list[tuple[int, int, int]] = []
        for row, cents, quality, wanted, target, least in rows:
            if sums is None:
                sums = _Sums(wanted, target)
            if cents is None or not 0 <= cents <= target:
                continue
            seen += 1
            if least < wanted:
                kept.append((row, cents, quality))  # smaller numbers of rows may have to be tried one by one
            if not over:
                sums.add(row, cents, quality)
                states = max(states, len(sums.best))
                over = states > most_states
        found = None
        for n in range(wanted, least - 1, -1):
            if over and least < wanted:
                sums, over = _Sums(n, target), False
                for one in kept:
                    sums.add(*one)
                    if over := len(sums.best) > most_states:
                        break
            found = None if over else sums.rows(n)
            if found:
                break
        outcome = "found" if found else "too_few_rows" if seen < least else "too_many_states" if over else "no_subset"
        yield outcome, states, found or []

    return step


def reconciling_subset(rows: DataFrame, controls: DataFrame, most_states: int = MOST_STATES) -> DataFrame:
    """For each batch with a count and a total: the rows, exactly so many, that add up to exactly that total with the best quality.

    rows: (batch_id, row_no, place, amount, quality), ``place`` their order; controls: (batch_id, wanted, total) and, if smaller numbers of rows do as well,
    ``least``: then the largest number that works counts. Gives (batch_id, outcome, states, picks): outcome is found, no_subset, too_few_rows (with an amount
    from 0 to the total), too_many_states (the search was given up, as reported) or no_control; states how many sums were reached; picks row numbers in order.
    Of equally good choices that whose last row comes first counts. Batches without rows have too_few_rows; null amounts take no part."""
    cents = lambda c: F.round(c.cast("decimal(18,2)") * 100).cast("long")
    asked = controls.select("batch_id", F.col("wanted").cast("long"), cents(F.col("total")).alias("target"), (F.col("least") if "least" in controls.columns else F.col("wanted")).cast("long").alias("least"))
    fit = (F.col("wanted") > 0) & (F.col("target") >= 0)
    joined = rows.select("batch_id", "row_no", "place", cents(F.col("amount")).alias("cents"), F.col("quality").cast("long").alias("quality")).join(asked.where(fit), "batch_id")
    found = fold(joined, ["batch_id"], ["place"], ["row_no", "cents", "quality", "wanted", "target", "least"], _search(most_states), "batch_id long, outcome string, states long, picks array<long>")
    none = F.when(fit, "too_few_rows").otherwise("no_control")
    return asked.join(found, "batch_id", "left").select(
        "batch_id", F.coalesce("outcome", none).alias("outcome"), F.coalesce("states", F.lit(0)).alias("states"), F.coalesce("picks", F.array().cast("array<long>")).alias("picks")
    )


def distinct_candidates(rows: DataFrame) -> DataFrame:
    """The first of each batch's rows (by row_no) that agree in source, page, serial, amount, unit and item number."""
    same = ["batch_id", F.coalesce("source", F.lit("")), "page_number", F.coalesce(N.serial(F.col("serial_number")), F.lit("")), "amount_numeric", F.coalesce("unit", F.lit("")), "item_no"]
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*same).orderBy("row_no"))).where("nth = 1").drop("nth")


_MONEY = "decimal(14,2)"


def select_instruments(seen: DataFrame, register: DataFrame, controls: DataFrame, most_states: int = MOST_STATES) -> DataFrame:
    """The instruments of each batch that are shown: those seen, held against the control count and total, and stand-ins from its register.

    seen and register: (batch_id, row_no, source, page_number, item_no, serial_number, micr_line, check_number, unit, amount_numeric, amount_words, payee_raw, issue_date,
    image_quality, missing_from_scan, slip_page, report_page), row_no unique in a batch over both, in reading order; controls: (batch_id, total_pages, expected_count,
    deposit_total). Cases, each reported as ``rule``, in this order:

    report: one report group agrees with count and total, and what was seen doesn't add up: the report's rows stand in for all;
    exact: as many seen as expected: all of them; surplus: the subset that reconciles; surplus_kept: none does, so all with a review flag;
    shortfall: all seen and stand-ins for the missing ones, those that reconcile with the rest of the total, else the first by source, page and item;
    searched: no count, and all seen don't add up: the largest subset that does; register: none seen and no count: all unmatched register rows; seen: otherwise all seen.

    Gives a row an instrument with item_no and instrument_id; batches without controls give none."""
    # a row a batch, read by two steps below
    controls = written(controls.select("batch_id", "total_pages", F.when(F.col("expected_count") > 0, F.col("expected_count")).alias("expected_count"), F.col("deposit_total").cast(_MONEY).alias("deposit_total")))
    # seen and stand-ins with all that is known of them by themselves and by their batch, for which they are dealt once
    rows = written(_judged(seen.unionByName(register), controls))
    if not (crowded := rows.where(F.col("ids").isNotNull()).drop("matched", "place")).isEmpty():
        visible = crowded.where("strong")
        judged = with_match(crowded.where("listed"), visible).unionByName(visible, allowMissingColumns=True)
        rows = written(rows.where(F.col("ids").isNull()).unionByName(_placed(judged)))
    strong, spare = F.col("strong"), F.col("listed") & ~F.col("matched")
    counts = rows.groupBy("batch_id").agg(F.count_if(strong).alias("n"), F.sum(F.when(strong, F.col("amount_numeric"))).cast(_MONEY).alias("t"), F.bool_or(F.col("agrees")).alias("agreed"))
    # batches without rows have nothing to show
    state = controls.join(counts, "batch_id")
    n, t, expected, total = F.col("n"), F.coalesce("t", F.lit(0).cast(_MONEY)), F.col("expected_count"), F.col("deposit_total")
    off = F.coalesce(F.abs(t - total) > F.lit("0.01").cast(_MONEY), F.lit(False))
    rule = (
        F.when(F.col("agreed") & off, "report").when(n == expected, "exact").when(n > expected, "surplus").when(n < expected, "shortfall")
        .when(expected.isNull() & total.isNotNull() & (n > 1), F.when(off, "searched").otherwise("seen")).when(n == 0, "register").otherwise("seen")
    )
    # the searches: among what was seen, or for the missing rest among the unmatched register rows
    wanted = F.when(F.col("rule") == "surplus", expected).when(F.col("rule") == "shortfall", expected - n).when(F.col("rule") == "searched", n - 1)
    rest = F.when(F.col("rule") == "shortfall", total - t).otherwise(total)
    state = written(state.withColumn("rule", rule).select("batch_id", "rule", wanted.alias("wanted"), rest.alias("total"), F.when(F.col("rule") == "searched", 1).otherwise(wanted).alias("least")))
    # one search a batch: its rows' order is page and quality for those seen, source, page and item for the register's
    own, other = strong & F.col("rule").isin("surplus", "searched"), spare & (F.col("rule") == "shortfall")
    asked = rows.where(strong | spare).select("batch_id", "row_no", "place", F.col("amount_numeric").alias("amount"), "quality", "strong", "listed", "matched")
    tried = asked.join(state.where("wanted IS NOT NULL").select("batch_id", "rule"), "batch_id").where(own | other).select("batch_id", "row_no", "place", "amount", "quality")
    found = reconciling_subset(tried, state.where("wanted IS NOT NULL").select("batch_id", "wanted", "total", "least"), most_states)
    state = state.join(found.select("batch_id", "outcome", "picks"), "batch_id", "left")
    hit, picked = F.col("outcome") == "found", F.array_contains("picks", F.col("row_no"))
    keep = strong & (F.col("rule") != "report") & (~F.col("rule").isin("surplus", "searched") | ~hit | picked)
    full = F.col("listed") & (F.col("rule") == "report") & F.col("agrees")
    filled = spare & F.expr("rule = 'register' OR rule = 'shortfall' AND CASE WHEN outcome = 'found' THEN array_contains(picks, row_no) ELSE place <= wanted END")
    shown = rows.where(strong | F.col("agrees") | spare).join(state, "batch_id").where(keep | ((full | filled) & F.col("row_no").isNotNull()))
    if not rows.where("copies > 1").isEmpty():
        # stand-ins of batches with several controls meet each other
        same = F.count(F.lit(1)).over(Window.partitionBy("batch_id", "row_no", "strong"))
        shown = shown.withColumn("same", same).withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), F.when(strong, 1).otherwise(F.col("same"))))).drop("same", "again")
    kept_all = strong & (F.col("rule") == "surplus") & ~hit
    facts = placeholder_facts(F.col("bare"))
    seen_or = lambda a, b: F.when(strong, a).otherwise(b)
    nth = F.when(strong, -F.col("quality")).when(F.col("rule") == "shortfall", F.col("place")).otherwise(0)
    out = shown.select(
        "batch_id", "row_no", F.when(kept_all, "surplus_kept").otherwise(F.col("rule")).alias("rule"), "source", F.when(strong, F.col("page_number")).alias("page_number"), "item_no", "serial_number", "unit", "issue_date", "amount_numeric",
        seen_or(F.coalesce("missing_from_scan", F.lit(False)), facts["missing_from_scan"]).alias("missing_from_scan"), seen_or(F.col("image_quality"), F.coalesce("image_quality", facts["image_quality"])).alias("image_quality"),
        F.when(~strong, facts["amount_status"]).alias("amount_status"), seen_or(F.when(kept_all, "visible_instruments_exceed_control_count,manual_review_required").otherwise(""), facts["review_flags"]).alias("review_flags"),
        (~strong).cast("int").alias("unseen"), nth.alias("nth"),
    )
    order = Window.partitionBy("batch_id").orderBy("unseen", "page_number", F.col("item_no").asc_nulls_last(), "nth", "row_no")
    out = out.withColumn("item_no", F.row_number().over(order)).drop("unseen", "nth")
    return out.withColumn("instrument_id", F.concat(F.lit("INS-"), F.col("batch_id").cast("string"), F.lit("-"), F.format_string("%03d", F.col("item_no"))))


def _judged(candidates: DataFrame, controls: DataFrame) -> DataFrame:
    """The distinct candidates that are strong, or register rows that may stand in, once for each of their batch's controls.

    ``strong`` and ``quality`` grade them. Register rows have ``listed``: whether they count, beside a report group that agrees with the controls (``agrees``); of several such groups that with the most rows that have an identity counts, then the one that begins first; ``matched``: whether a strong row of the
    batch has one of their keys; ``bare``: whether they have no identity. ``place`` is their order, see ``_placed``; ``copies`` the number of controls. In batches of over SMALL
    rows ``matched`` isn't known yet, and only there ``ids`` are given. All of this is by windows of a batch or parts of it, so rows are dealt once and the batches' controls come to them."""
    stand_in = F.coalesce(F.col("source").isin(*STAND_INS), F.lit(False))
    # rows of these kinds are neither strong nor stand-ins, and no other row is told from them
    of_use = F.col("amount_numeric").isNotNull() & (stand_in | (F.coalesce(F.col("source") != "vision_register_items", F.lit(True)) & (F.col("page_number") > 0)))
    group_page = F.coalesce("report_page", "slip_page").alias("group_page")
    few = candidates.where(F.col("batch_id").isNotNull() & of_use).select(
        "batch_id", "row_no", "source", "page_number", "item_no", "serial_number", "micr_line", "check_number", "unit", "amount_numeric", (~is_empty(F.col("amount_words"))).alias("worded"), "payee_raw", "issue_date", "image_quality",
        "missing_from_scan", group_page,
    )
    known = controls.where(F.col("batch_id").isNotNull()).groupBy("batch_id").agg(F.collect_list(F.struct("total_pages", "expected_count", "deposit_total")).alias("controls"))
    rows = distinct_candidates(few.repartition("batch_id")).join(known, "batch_id").withColumn("total_pages", F.explode("controls.total_pages"))
    rows = rows.where(~F.coalesce((F.col("page_number") > 0) & (F.col("page_number") > F.col("total_pages")), F.lit(False)))
    # a row is strong by its MICR line, words or date as well
    more = ~is_empty(F.col("micr_line")) | F.coalesce("worded", F.lit(False)) | F.col("issue_date").isNotNull()
    read = ~F.col("source").isin("vision_register_items", *STAND_INS) & ~F.coalesce("missing_from_scan", F.lit(False)) & F.col("page_number").between(1, F.col("total_pages"))

    def graded(known: Column) -> Column:
        strong = visible_with(known["serial"] | known["payee"]) | F.coalesce(more & read, F.lit(False))
        return let(strong, lambda s: F.struct(s.alias("strong"), instrument_quality(s, known["serial"], known["payee"], F.col("worded")).alias("quality")))

    told = F.struct(N.serial(F.col("serial_number")).isNotNull().alias("serial"), N.payee(F.col("payee_raw")).isNotNull().alias("payee"))
    batch, strong, listed = Window.partitionBy("batch_id"), F.col("strong"), F.col("listed")
    rows = rows.withColumn("graded", let(told, graded)).select("*", "graded.strong", "graded.quality").drop("graded", "payee_raw", "total_pages").withColumn("listed", ~strong & stand_in)
    # the window also keeps the grades from being worked out once more for the choice of rows
    rows = rows.withColumn("crowd", F.count_if(strong | listed).over(batch)).where(strong | listed)
    rows = rows.withColumns({"ids": identity_keys("serial_number", "micr_line", "check_number"), "bare": is_bare(F.col("source"), F.coalesce("serial_number", "micr_line", "check_number"))})
    # the one report group that has the batch's count and total
    group = Window.partitionBy("batch_id", "listed", "source", "group_page")
    rows = rows.withColumns({"of_group": F.count(F.lit(1)).over(group), "sum_group": F.sum("amount_numeric").over(group), "known": F.sum((F.size("ids") > 0).cast("int")).over(group), "first": F.min("row_no").over(group)})
    fits = F.exists("controls", lambda c: (c["expected_count"] > 0) & (c["expected_count"] == F.col("of_group")) & (F.abs(F.col("sum_group") - c["deposit_total"]) <= F.lit("0.01").cast("decimal(12,2)")))
    small = F.col("crowd") <= SMALL
    keys = rows.withColumns({"fit": F.when(listed & fits, F.struct("known", -F.col("first"), "source", "group_page")), "keys": match_keys(rows)}).withColumn("copies", F.size("controls")).drop("controls", "of_group", "sum_group", "known", "first", "micr_line", "check_number")
    rows = keys.withColumns({"best": F.max("fit").over(batch), "shown": F.flatten(F.collect_list(F.when(strong & small, F.col("keys"))).over(batch))})
    own = F.col("best.source").eqNullSafe(F.col("source")) & F.col("best.group_page").eqNullSafe(F.col("group_page"))
    rows = rows.withColumns({"listed": listed & (F.col("best").isNull() | own), "agrees": listed & F.col("best").isNotNull() & own, "matched": F.when(listed & small, F.arrays_overlap("keys", "shown")), "ids": F.when(~small, F.col("ids"))})
    return _placed(rows.where("strong OR listed").drop("fit", "best", "shown", "keys", "crowd"))


def _placed(rows: DataFrame) -> DataFrame:
    """Rows with ``place``: of those that are strong by page, quality and number, of the unmatched register rows by source, page and item."""
    strong = F.col("strong")
    by = Window.partitionBy("batch_id", "strong", "matched").orderBy(F.when(strong, F.col("page_number")), F.when(strong, -F.col("quality")), F.when(~strong, F.col("source")), F.when(~strong, F.col("group_page")).asc_nulls_last(), F.when(~strong, F.col("item_no")).asc_nulls_last(), "row_no")
    return rows.withColumn("place", F.row_number().over(by))


def with_control_candidate(candidates: DataFrame, batches: DataFrame) -> DataFrame:
    """Deposit candidates, and before them each batch's own control, if it comes from a control report or the batch has no other candidate.

    batches: (batch_id, batch_number, source_system, batch_amount, total_items); the source system's name, or else a batch number, tells the kind of report."""
    known = ~is_empty(F.col("batch_number"))
    system = F.upper(F.coalesce("source_system", F.lit("")))
    named = lambda name: system.contains(name)
    others = candidates.select(F.col("doc_id").alias("batch_id")).distinct().withColumn("others", F.lit(True))
    own = batches.join(others, "batch_id", "left").where((F.col("batch_amount").isNotNull() | F.col("total_items").isNotNull()) & (known | named("YOTTA") | named("REGIONS") | named("DEPOSIT DETAIL") | F.col("others").isNull()))
    kind = F.when(named("YOTTA") | (known & (system == "")), "yottareal_report").when(named("REGIONS"), "regions_report").when(named("DEPOSIT DETAIL"), "deposit_detail_report").otherwise("summary_page")
    empty = {"page_number": "int", "deposit_account": "string", "deposit_date": "date", "deposit_transaction": "string", "confidence": "double"}
    rows = own.select(F.col("batch_id").alias("doc_id"), F.lit(0).cast("long").alias("row_no"), kind.alias("source_type"), "source_system", F.col("batch_amount").alias("deposit_amount"), F.col("total_items").cast("int").alias("item_count"), *(F.lit(None).cast(t).alias(c) for c, t in empty.items()))
    return candidates.unionByName(rows)


def evidence_controls(deposits: DataFrame, batches: DataFrame, register: DataFrame) -> DataFrame:
    """Each batch's expected number of items and control total, from its logical deposits (doc_id = batch_id).

    The counts of all deposits add up; where only some of several have one, and where none has, the batch's own count stands, then the number of
    register rows of the report kinds. The total is that of the deposits' amounts."""
    own = F.when(F.col("item_count") > 0, F.col("item_count"))
    sums = deposits.groupBy(F.col("doc_id").alias("batch_id")).agg(F.count(F.lit(1)).alias("slips"), F.count(own).alias("counted"), F.sum(own).alias("items"), F.sum("deposit_amount").cast("decimal(14,2)").alias("deposit_total"))
    listed = register.where(F.col("source").isin(*STAND_INS)).groupBy("batch_id").agg(F.count(F.lit(1)).alias("listed"))
    rows = batches.join(sums, "batch_id", "left").join(listed, "batch_id", "left")
    some = (F.col("slips") > 1) & (F.col("counted") < F.col("slips"))
    given = F.coalesce(F.when(F.col("total_items") > 0, F.col("total_items").cast("long")), F.col("listed"))
    return rows.select("batch_id", "total_pages", F.when(some, given).otherwise(F.coalesce("items", given)).alias("expected_count"), "deposit_total")


def _shown() -> Column:
    """What of a batch's instruments is held against its receipts."""
    return F.sum(F.when(F.col("page_number").isNotNull(), F.col("amount_numeric"))).cast("decimal(14,2)").alias("shown")


def _deposited(batches: DataFrame, candidates: DataFrame, register: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The logical deposits and the controls that follow."""
    deposits = written(logical_deposits(with_control_candidate(candidates, batches)))
    return deposits, written(evidence_controls(deposits, batches, register))


def _believed(controls: DataFrame, deposits: DataFrame, sums: DataFrame, *more: str) -> DataFrame:
    """The final controls, given what each batch's instruments show: (batch_id, shown, n, and ``more``, which is passed on)."""
    receipts = deposits.where(F.col("source_type") == "bank_receipt").join(sums, F.col("doc_id") == F.col("batch_id")).where(F.abs(F.col("deposit_amount") - F.col("shown")) <= F.lit("0.01").cast("decimal(3,2)"))
    one = receipts.groupBy("batch_id").agg(F.count(F.lit(1)).alias("receipts")).where("receipts = 1")
    rows = controls.join(sums, "batch_id", "left").join(one, "batch_id", "left")
    by = F.col("receipts").isNotNull() & F.coalesce(F.abs(F.col("deposit_total") - F.col("shown")) > F.lit("0.01").cast("decimal(3,2)"), F.lit(True))
    return rows.select("batch_id", F.when(by, F.col("n")).otherwise(F.col("expected_count")).alias("total_items"), F.when(by, F.col("shown")).otherwise(F.col("deposit_total")).alias("batch_amount"), by.alias("by_receipt"), *more)


def finalize_evidence(batches: DataFrame, candidates: DataFrame, seen: DataFrame, register: DataFrame, listings: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """From all that was read of the batches to (controls, instruments): their deposits, each once, the controls that follow, and the instruments chosen by these.

    batches: (batch_id, total_pages, batch_number, source_system, batch_amount, total_items); candidates as for ``logical_deposits`` with doc_id = batch_id and row_no from 1; seen and register as for
    ``select_instruments``; listings: (batch_id, line_no, amount_numeric), amounts that a deposit slip lists, if any. If exactly one receipt has the total of what is
    seen and the control total differs, that receipt is the control, and the items are as many as were chosen. Seen instruments whose amount isn't listed, where as many
    are listed as chosen, lose it and are unclear. controls: (batch_id, total_items, batch_amount, by_receipt)."""
    deposits, controls = _deposited(batches, candidates, register)
    chosen = written(select_instruments(seen, register, controls))
    final = _believed(controls, deposits, chosen.groupBy("batch_id").agg(_shown(), F.count(F.lit(1)).alias("n")))
    if listings is not None:
        judged = multiset_match(chosen.select("batch_id", F.col("item_no").alias("line_no"), "amount_numeric"), listings).select("batch_id", F.col("line_no").alias("item_no"), "flagged")
        lost = F.col("flagged") & F.col("page_number").isNotNull()
        flags = F.concat_ws(",", F.when(F.col("review_flags") != "", F.col("review_flags")), F.when(lost, "amount_not_in_deposit_listing,manual_review_required"))
        chosen = chosen.join(judged, ["batch_id", "item_no"]).withColumns({"amount_numeric": F.when(~lost, F.col("amount_numeric")), "image_quality": F.when(lost, "unclear").otherwise(F.col("image_quality")), "review_flags": flags}).drop("flagged")
    return final, chosen


def validate_batches(batches: DataFrame, candidates: DataFrame, seen: DataFrame, register: DataFrame, as_of: str, listings: DataFrame | None = None) -> DataFrame:
    """One row a batch: its instruments against its controls, as in ``batch_reconciliation``, with the risk of what was chosen; see ``finalize_evidence``."""
    if listings is not None:
        controls, chosen = finalize_evidence(batches, candidates, seen, register, listings)
        chosen = written(chosen.withColumn("line_no", F.col("item_no")))
        return batch_reconciliation(controls, chosen, risk_scores(chosen, as_of))
    deposits, controls = _deposited(batches, candidates, register)
    # what is asked of a batch's instruments is summed up where they lie together, and only that is written
    chosen = with_risk(select_instruments(seen, register, controls).withColumn("line_no", F.col("item_no")), as_of)
    sums = written(chosen.groupBy("batch_id").agg(_shown(), *batch_sums(), batch_soft()))
    return reconciled(_believed(controls, deposits, sums, "total", "n", "soft"))


#: Re-reads that are tried of a batch, their least confidence, and the gap beyond which instruments are missing and not misread.
MOST_REREADS, SURE_REREAD, MISREAD_GAP = 4, 0.72, 150


def _closer(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
    """Re-reads (row_no, old cents, new cents, total, target) in order to (row_no, taken): each is taken if it brings the total nearer, until it agrees."""
    now = None
    for row, old, new, total, target in rows:
        now = total if now is None else now
        if abs(target - now) <= 1:
            return
        tried = now - (old or 0) + new
        if abs(target - tried) < abs(target - now):
            now = tried
            yield row, new / 100


def match_verified(rows: DataFrame, readings: DataFrame, controls: DataFrame) -> DataFrame:
    """Amounts read again replace the first reading where they bring a batch's total nearer to its control: rows with ``amount_numeric`` and ``replaced``.

    rows: (batch_id, row_no, page_number, total_pages, amount_numeric, words_amount, image_quality, conflict); readings: (batch_id, row_no, amount, confidence, agree, source), one a row at most;
    controls: (batch_id, expected_count, deposit_total). Only batches with a gap, with no fewer rows than expected and, without an expected count, a gap of MISREAD_GAP at most are judged.
    Rows on a page without written amount, with another written amount, or unclear may be misread; the first MOST_REREADS of them are read again, in order of row_no. A
    reading needs an amount, confidence and agreeing views, and where the first reading's evidence conflicts both kinds of evidence."""
    cents = lambda c: F.round(c.cast("decimal(18,2)") * 100).cast("long")
    sums = rows.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(cents(F.col("amount_numeric"))), F.lit(0)).alias("sum_cents"))
    open_ = controls.where("deposit_total IS NOT NULL").join(sums, "batch_id").withColumn("target", cents(F.col("deposit_total")))
    gap, counted = F.abs(F.col("target") - F.col("sum_cents")), F.coalesce(F.col("expected_count") > 0, F.lit(False))
    open_ = open_.where((gap > 1) & F.when(counted, F.col("n") >= F.col("expected_count")).otherwise(gap <= MISREAD_GAP * 100)).select("batch_id", "sum_cents", "target")
    doubt = F.col("words_amount").isNull() | F.coalesce(F.abs(F.col("words_amount") - F.col("amount_numeric")) > 0.01, F.lit(False)) | F.coalesce(F.col("image_quality") == "unclear", F.lit(False))
    asked = rows.where(F.col("page_number").between(1, F.col("total_pages")) & doubt).join(open_, "batch_id")
    asked = asked.withColumn("nth", F.row_number().over(Window.partitionBy("batch_id").orderBy("row_no"))).where(F.col("nth") <= MOST_REREADS)
    good = readings.where((F.col("amount").isNotNull()) & (F.col("confidence") >= SURE_REREAD) & F.col("agree"))
    tried = asked.join(good, ["batch_id", "row_no"]).where(~F.coalesce("conflict", F.lit(False)) | (F.col("source") == "both"))
    tried = tried.withColumns({"old": cents(F.col("amount_numeric")), "new": cents(F.col("amount"))})
    taken = fold(tried, ["batch_id"], ["row_no"], ["row_no", "old", "new", "sum_cents", "target"], _closer, "batch_id long, row_no long, taken double")
    out = rows.join(taken, ["batch_id", "row_no"], "left")
    kind = rows.schema["amount_numeric"].dataType
    return out.withColumns({"amount_numeric": F.coalesce(F.col("taken").cast(kind), F.col("amount_numeric")), "replaced": F.col("taken").isNotNull()}).drop("taken")


def inferred_property(instruments: DataFrame) -> DataFrame:
    """The payee that most of a batch's instruments name and that may be a property, in title case; the first seen of equally frequent ones.

    instruments: (batch_id, row_no, payee_raw). Names of banks and issuers and names that are noise don't count; batches without a name give no row."""
    banks = r"(?i)\b(BANK|CHASE|REGIONS|WESTERN\s+UNION|MONEYGRAM|INTERMEX|FIDELITY)\b"
    name = let(N.payee(F.col("payee_raw")), lambda n: F.when(~n.rlike(banks) & N.property_name(n).isNotNull(), F.initcap(n)))
    # rows without a name are counted apart and go by their count: a test of the name itself would work it out once more
    by = instruments.select("batch_id", "row_no", name.alias("property_name")).groupBy("batch_id", "property_name").agg(F.count("property_name").alias("items"), F.min("row_no").alias("first")).where("items > 0")
    return by.groupBy("batch_id").agg(F.min_by(F.struct("property_name", "items"), F.struct((-F.col("items")).alias("n"), "first")).alias("best")).select("batch_id", "best.*")
