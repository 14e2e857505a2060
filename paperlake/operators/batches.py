"""Payment batches: reconciling instruments with control totals, risk, duplicates, registers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import identity_fields, is_empty
from ..functions import normalise as N


def batch_sums() -> tuple[Column, Column]:
    """The sum of a batch's instruments and their number."""
    return F.sum("amount_numeric").cast("decimal(14,2)").alias("total"), F.count(F.lit(1)).alias("n")


def batch_soft() -> Column:
    """Whether any of a batch's instruments isn't valid."""
    return F.bool_or(F.col("status") != "VALID").alias("soft")


def batch_reconciliation(batches: DataFrame, instruments: DataFrame, scored: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Each batch's instruments against its control total and count: gap, decision, overall decision and flags.

    Sums that differ or counts that differ fail; items that risk_scores (scored) doesn't call valid make a pass one with
    review. A null expected count agrees with any; a null control total agrees with none."""
    sums = instruments.groupBy("batch_id").agg(*batch_sums())
    items = scored.groupBy("batch_id").agg(batch_soft())
    return reconciled(batches.join(sums, "batch_id", "left").join(items, "batch_id", "left"), tolerance)


def reconciled(out: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """``batch_reconciliation`` of batches with what their instruments come to: total, n and soft, null where there are none."""
    total, n = F.coalesce("total", F.lit(0).cast("decimal(14,2)")), F.coalesce("n", F.lit(0))
    gap = (total - F.col("batch_amount")).cast("decimal(14,2)")
    amounts = F.coalesce(F.abs(gap) <= F.lit(str(tolerance)).cast("decimal(14,2)"), F.lit(False))
    count = F.coalesce(n == F.col("total_items"), F.lit(True))
    soft = F.coalesce("soft", F.lit(False))
    decision = F.when(~amounts | ~count, "FAIL").when(soft, "PASS_WITH_REVIEW").otherwise("PASS")
    overall = F.when(~amounts | ~count, "REJECT").when(soft, "REVIEW").otherwise("ACCEPT")
    flags = F.concat_ws(
        ",", F.when(amounts, "amounts_reconciled").otherwise("amount_mismatch"), F.when(count, "item_count_reconciled").otherwise("item_count_mismatch"),
        F.when(amounts & count & soft, "manual_review_required_for_item_flags"),
    )
    return out.select("batch_id", "batch_amount", total.alias("instrument_total"), gap.alias("gap"), "total_items", n.alias("instrument_count"), decision.alias("decision"), overall.alias("overall"), flags.alias("flags"))


def duplicate_serials(instruments: DataFrame) -> DataFrame:
    """Rows not missing from the scan whose serial is on more than one row of their batch, missing ones counted."""
    n = F.count(F.lit(1)).over(Window.partitionBy("batch_id", "serial_number"))
    seen = instruments.where(F.col("serial_number").isNotNull()).withColumn("uses", n)
    return seen.where("uses > 1 AND NOT missing_from_scan").select("batch_id", "line_no", "serial_number", "uses")


def split_payments(instruments: DataFrame, least: int = 3) -> DataFrame:
    """Units with several instruments of one date: the items and their total."""
    by = instruments.where("unit IS NOT NULL AND issue_date IS NOT NULL").groupBy("batch_id", "unit", "issue_date")
    out = by.agg(F.count(F.lit(1)).alias("items"), F.sum("amount_numeric").cast("decimal(14,2)").alias("total"), F.array_join(F.sort_array(F.collect_list("line_no")), ",").alias("line_nos"))
    return out.where(F.col("items") >= least)


def risk_scores(instruments: DataFrame, as_of: str, max_age: int = 120, high: int = 1000) -> DataFrame:
    """Additive risk of each instrument in hundredths, at most 100, and a status; weights are fixed values."""
    return with_risk(instruments, as_of, max_age, high).select("batch_id", "line_no", "risk", "flags", "hard", "status")


def with_risk(instruments: DataFrame, as_of: str, max_age: int = 120, high: int = 1000) -> DataFrame:
    """Instruments with risk, flags, hard and status; see ``risk_scores``."""
    twice = F.count("serial_number").over(Window.partitionBy("batch_id", "serial_number")) > 1
    items = F.count(F.lit(1)).over(Window.partitionBy("batch_id", "unit", "issue_date"))
    age = F.abs(F.datediff(F.lit(as_of).cast("date"), F.col("issue_date")))
    tests = [
        ("missing", F.col("missing_from_scan"), 35), ("unclear", F.coalesce(F.col("image_quality") == "unclear", F.lit(False)), 18),
        ("serial", is_empty(F.col("serial_number")), 20), ("amount", F.col("amount_numeric").isNull(), 30),
        ("high_value", F.coalesce(F.col("amount_numeric") >= high, F.lit(False)), 10),
        ("duplicate", F.col("serial_number").isNotNull() & ~F.col("missing_from_scan") & twice, 35),
        ("stale", F.coalesce(age > max_age, F.lit(False)), 15), ("no_date", F.col("issue_date").isNull(), 12),
        ("split", F.col("unit").isNotNull() & F.col("issue_date").isNotNull() & (items >= 3), 5),
    ]
    score = F.lit(0)
    for _, test, weight in tests:
        score = score + F.when(test, weight).otherwise(0)
    flags = F.array_join(F.array_compact(F.array(*(F.when(t, F.lit(n)) for n, t, _ in tests))), ",")
    out = instruments.withColumns({"risk": F.least(score, F.lit(100)), "flags": flags})
    # all of these flags ask for a review by themselves; an unclear image does as far as no amount is verified
    out = out.withColumn("hard", F.col("flags") != "")
    status = F.when((F.col("risk") >= 60) | F.col("amount_numeric").isNull(), "INVALID").when((F.col("risk") >= 25) | F.col("hard"), "REVIEW").otherwise("VALID")
    return out.withColumn("status", status)


def risk_summary(scored: DataFrame) -> DataFrame:
    """Of each batch: mean risk, rows of each status and with flags that ask for a review, and the decision."""
    counts = [F.count_if(F.col("status") == s).alias(s.lower()) for s in ("INVALID", "REVIEW", "VALID")]
    out = scored.groupBy("batch_id").agg((F.expr("(20 * sum(risk) + count(*)) div (2 * count(*))").cast("double") / 1000).alias("average_risk"), *counts, F.count_if("hard").alias("flagged"))
    return out.withColumn("decision", F.when(F.col("invalid") > 0, "REJECT").when((F.col("review") > 0) | (F.col("flagged") > 0), "REVIEW").otherwise("ACCEPT"))


def completeness(instruments: DataFrame) -> DataFrame:
    """The percentage of the key fields that each instrument has, and whether it is unclear for want of two or of an amount."""
    n = identity_fields(F.col("serial_number"), F.col("unit"), F.col("issue_date").cast("string"))
    amount = F.col("amount_numeric").isNotNull().cast("int")
    return instruments.select("batch_id", "line_no", ((n + amount) * 25).alias("percent"), ((n < 2) | (amount == 0)).alias("is_unclear"))


def misread_controls(batches: DataFrame, instruments: DataFrame, most: int = 20) -> DataFrame:
    """Batches whose counts agree and whose amounts are all there, but whose total is off by a little."""
    sums = instruments.groupBy("batch_id").agg(F.sum("amount_numeric").alias("total"), F.count(F.lit(1)).alias("n"), F.bool_and(F.col("amount_numeric").isNotNull()).alias("trusted"))
    gap = F.abs(F.col("batch_amount") - F.col("total")).cast("decimal(14,2)")
    out = batches.join(sums, "batch_id").where("trusted AND n = total_items").select("batch_id", gap.alias("gap"))
    return out.where((F.col("gap") > 0) & (F.col("gap") <= most))


def recovery_plan(batches: DataFrame, instruments: DataFrame, least_gap: float = 50) -> DataFrame:
    """Estimated missing items of batches short by more than ``least_gap``: the gap over the mean of all rows held to 50..1500, at most 15."""
    sums = instruments.groupBy("batch_id").agg(F.sum("amount_numeric").cast("double").alias("t"), F.count(F.lit(1)).alias("rows"))
    total = F.coalesce("t", F.lit(0.0))
    gap = F.col("batch_amount").cast("double") - total
    mean = F.least(F.lit(1500.0), F.greatest(F.lit(50.0), total / F.greatest(F.coalesce("rows", F.lit(0)), F.lit(1))))
    out = batches.join(sums, "batch_id", "left").where(gap > least_gap)
    return out.select("batch_id", F.least(F.lit(15), F.ceil(gap / mean).cast("int")).alias("missing_items"))


def number_instruments(instruments: DataFrame) -> DataFrame:
    """Item numbers by line, and ids made of batch and number."""
    n = F.row_number().over(Window.partitionBy("batch_id").orderBy("line_no"))
    return instruments.withColumn("item_no", n).select("batch_id", "line_no", "item_no", F.concat(F.lit("INS-"), F.col("batch_id").cast("string"), F.lit("-"), F.lpad(F.col("item_no").cast("string"), 3, "0")).alias("instrument_id"))


def keep_best(instruments: DataFrame) -> DataFrame:
    """One row for each batch and serial: the one with most fields, then the first line."""
    n = identity_fields(F.col("unit"), F.col("issue_date").cast("string"), F.col("amount_numeric").cast("string"))
    order = Window.partitionBy("batch_id", "serial_number").orderBy(F.col("fields").desc(), "line_no")
    rows = instruments.where("serial_number IS NOT NULL").withColumn("fields", n).withColumn("r", F.row_number().over(order))
    return rows.where("r = 1").select("batch_id", "serial_number", "line_no", "fields")


def identity_keys(*columns: str) -> Column:
    """The digits of serials, MICR lines and check numbers without leading zeros, and the last ten of more than four, each once."""
    digits = F.transform(F.array(*columns), lambda c: F.ltrim(N.digits(N.serial(c)), F.lit("0")))
    both = F.transform(digits, lambda d: F.array(F.when(d != "", d), F.when(F.length(d) > 4, F.right(d, F.lit(10)))))
    return F.array_distinct(F.array_compact(F.flatten(both)))


def match_keys(df: DataFrame) -> Column:
    """Identity keys (``ids`` where they are known already), and one of unit and amount."""
    fields = [c for c in ("serial_number", "micr_line", "check_number") if c in df.columns]
    ids = F.col("ids") if "ids" in df.columns else identity_keys(*fields)
    by_unit = F.concat(F.lit("u"), "unit", F.lit("|"), F.col("amount_numeric").cast("decimal(14,2)").cast("string"))
    return F.array_compact(F.concat(ids, F.array(by_unit)))


def with_match(register: DataFrame, visible: DataFrame) -> DataFrame:
    """Register rows with ``matched``: whether they share an identity key or (unit, amount) with a visible row of their batch.

    Whether a row matches depends on its batch and keys only, so keys are exploded and joined once, and what matched is
    told by batch and keys; repeated rows share their fate."""
    rows = register.withColumn("keys", match_keys(register))
    known = visible.select("batch_id", F.explode(match_keys(visible)).alias("key")).distinct()
    listed = rows.select("batch_id", "keys").distinct().withColumn("key", F.explode("keys"))
    matched = listed.join(known, ["batch_id", "key"], "left_semi").select("batch_id", "keys", F.lit(True).alias("matched")).distinct()
    return rows.join(matched, ["batch_id", "keys"], "left").withColumn("matched", F.coalesce("matched", F.lit(False))).drop("keys")


def without_match(register: DataFrame, visible: DataFrame) -> DataFrame:
    """The register rows that aren't matched; see ``with_match``."""
    return with_match(register, visible).where(~F.col("matched")).drop("matched")


def unmatched_register(register: DataFrame, visible: DataFrame) -> DataFrame:
    """Register rows that share neither an identity key nor (unit, amount) with a visible row of their batch: equi joins only.

    Identity keys are the digits of serials, and of micr_line and check_number where the tables have them."""
    return without_match(register, visible).select("batch_id", "line_no", "serial_number", "unit", "amount_numeric", "source")


def is_bare(source: Column, identity: Column) -> Column:
    """Whether a register row that is no report's has no digits but zeros to be known by."""
    return ~source.isin("transaction_detail_report", "regions_deposit_report") & (F.ltrim(N.digits(identity), F.lit("0")) == "")


def placeholder_facts(bare: Column) -> dict[str, Column]:
    """What an instrument is that a register row (``source``) stands in for: report rows count as seen, others as missing, and without an identity as candidates."""
    report = F.col("source").isin("transaction_detail_report", "regions_deposit_report")
    weak = F.when(bare, "unverified_register_amount,missing_document_identity,manual_review_required")
    return {
        "missing_from_scan": ~report, "image_quality": F.when(report, "thumbnail_report_image").otherwise("not_extracted_from_scan"), "amount_status": F.when(bare, "candidate"),
        "review_flags": F.concat_ws(",", weak, F.when(report, "report_row_instrument").otherwise("register_item_not_matched_to_clear_instrument")),
    }


def placeholders(unmatched: DataFrame) -> DataFrame:
    """Unmatched register rows as instruments; see ``placeholder_facts``."""
    facts = placeholder_facts(is_bare(F.col("source"), F.col("serial_number")))
    return unmatched.select("batch_id", "line_no", "serial_number", "amount_numeric", *(c.alias(name) for name, c in facts.items()))


def multiset_match(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """The k-th row of an amount meets the k-th listing of it; rows without one lose their amount and are flagged.

    Only batches that list as many amounts as they have rows are judged."""
    kth = Window.partitionBy("batch_id", "amount_numeric").orderBy("line_no")
    a = rows.withColumns({"k": F.row_number().over(kth), "shown": F.count(F.lit(1)).over(Window.partitionBy("batch_id"))}).select("batch_id", "line_no", "amount_numeric", "k", "shown")
    b = listed.withColumn("k", F.row_number().over(kth)).select("batch_id", "amount_numeric", "k", F.lit(True).alias("hit"))
    sizes = listed.groupBy("batch_id").agg(F.count("amount_numeric").alias("listed"))
    out = a.join(b, ["batch_id", "amount_numeric", "k"], "left").join(sizes, "batch_id", "left")
    lost = F.coalesce(F.col("listed") == F.col("shown"), F.lit(False)) & F.col("hit").isNull()
    return out.select("batch_id", "line_no", F.when(~lost, F.col("amount_numeric")).alias("amount_numeric"), lost.alias("flagged"))


def new_identities(recovered: DataFrame, known: DataFrame) -> DataFrame:
    """Recovered rows whose serial no known row of the batch has."""
    ids = known.where("serial_number IS NOT NULL").select("batch_id", "serial_number").distinct()
    return recovered.join(ids, ["batch_id", "serial_number"], "left_anti").select("batch_id", "line_no", "serial_number")
