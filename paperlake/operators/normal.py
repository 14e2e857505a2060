"""Normalisers as table jobs: each keeps its rows and adds a value and a status; rejects can be profiled."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalise as N


def normalised(df: DataFrame, column: str, how: Callable[[Column], Column], value: str = "value", status: str = "status") -> DataFrame:
    """df with ``value``, how of the column, and ``status``: empty, rejected or ok. Null and empty cells give null."""
    out = df.withColumn(value, F.when(F.col(column).isNotNull(), how(F.col(column))))
    empty = F.col(column).isNull() | (F.trim(F.col(column).cast("string")) == "")
    return out.withColumn(status, F.when(empty, "empty").when(F.col(value).isNull(), "rejected").otherwise("ok"))


def reject_profile(df: DataFrame, by: str, status: str = "status") -> DataFrame:
    """Rows of each status by a column."""
    return df.groupBy(by).agg(*(F.count_if(F.col(status) == s).alias(s) for s in ("ok", "empty", "rejected")))


def restored_cents(df: DataFrame) -> DataFrame:
    """A whole-dollar ``amount`` becomes the ``labelled`` one of the same dollars with cents; corrections say so."""
    a, b = F.col("amount"), F.col("labelled")
    fits = (F.floor(a) == F.floor(b)) & (a == F.floor(a)) & (b != F.floor(b))
    value = F.when(a.isNull(), b).when(fits, b).otherwise(a)
    return df.withColumn("value", value).withColumn("correction", F.when(fits, F.concat(a.cast("string"), F.lit(" to "), b.cast("string"))))


def amount_conflicts(df: DataFrame) -> DataFrame:
    """``amount`` against ``words``: dollars that differ, or cents that the words name, null the amount and keep it as candidate."""
    a, said = F.col("amount"), F.col("said_")
    names_cents = F.upper(F.coalesce("words", F.lit(""))).rlike(r"\b\d{1,2}\s*/\s*100\b|\b\d{1,2}\s+CENTS?\b|\bNO\s+CENTS?\b")
    apart = F.coalesce((F.floor(a) != F.floor(said)) | (names_cents & (F.abs(a - said) >= 0.01)), F.lit(False))
    status = F.when(apart, "conflict").when(a.isNotNull() | said.isNotNull(), "verified")
    rows = df.withColumn("said_", N.amount_from_words(F.col("words")))
    return rows.withColumns({"value": F.when(~apart, F.coalesce(a, said)), "candidate": F.when(apart, a), "amount_status": status}).drop("said_")


def rejected_serials(df: DataFrame) -> DataFrame:
    """Serials that are routing numbers, unlabelled nine digits of a check, or a MICR line's account or routing group become null."""
    s, m, d = F.col("serial"), F.col("micr_"), F.col("digits_")
    weak = F.col("kind").isin("Check", "CashiersCheck") & (F.length(d) == 9) & ~F.coalesce(F.lower("evidence"), F.lit("")).isin("labeled_number", "both")
    bare = lambda x: F.ltrim(x, F.lit("0"))
    groups = F.array_compact(F.concat(F.array(m["routing_number"]), F.split(F.coalesce(m["accounts"], F.lit("")), ",")))
    no_identity = m["check_number"].isNotNull() & (d != "") & F.exists(groups, lambda x: (x != "") & (bare(x) == bare(d)))
    reason = F.when(N.routing_number(s) | F.coalesce(weak, F.lit(False)), "routing_or_weak").when(no_identity, "micr_account_or_routing")
    rows = df.withColumns({"micr_": N.micr(F.col("micr_line")), "digits_": N.digits(s)})
    return rows.withColumn("reason", F.when(s.isNotNull(), reason)).withColumn("value", F.when(F.col("reason").isNull(), s)).drop("micr_", "digits_")


def serials_against_micr(df: DataFrame) -> DataFrame:
    """Of checks: an existing conflict nulls the serial, a labelled one that differs from the MICR check number is a conflict, else that number is taken."""
    s, check, current = F.col("serial"), F.col("check_"), F.col("current_")
    mine = F.col("kind").isin("Check", "CashiersCheck") & F.col("micr_line").isNotNull()
    old = mine & F.coalesce(F.col("match_status") == "conflicting", F.lit(False))
    labelled = F.lower(F.coalesce("evidence", F.lit(""))).isin("labeled_number", "both")
    differs = mine & check.isNotNull() & (current != check)
    clash = differs & (current != "") & labelled
    value = F.when(old | clash, F.lit(None)).when(F.coalesce(differs, F.lit(False)), check).otherwise(s)
    rows = df.withColumns({"check_": N.micr(F.col("micr_line"))["check_number"], "current_": F.ltrim(N.digits(s), F.lit("0"))})
    return rows.withColumn("value", value).withColumn("status", F.when(F.coalesce(old | clash, F.lit(False)), "conflicting").otherwise(F.col("match_status"))).drop("check_", "current_")


def sanitised_instruments(df: DataFrame) -> DataFrame:
    """Raw rows (kind, issuer, serial, amount, words, issued, payee, unit, micr_line, evidence, match_status, ocr_text) made fit: one projection."""
    text = F.coalesce("ocr_text", F.lit(""))
    seen = N.issuer(F.concat_ws("\n", F.coalesce("issuer", F.lit("")), text))
    line = F.coalesce(N.empty_to_null(N.stripped(F.regexp_replace("micr_line", r"\s+", " "))), N.micr_line(text))
    out = df.withColumns({
        "issuer": F.coalesce(seen["issuer"], "issuer"), "agent": seen["agent"], "kind": N.instrument_type(F.col("kind"), F.concat_ws("\n", text, F.coalesce("issuer", F.lit("")))),
        "serial": F.coalesce(N.serial(F.col("serial")), N.serial_in(text)), "issue_date": F.coalesce(N.date(F.col("issued")), N.date(text)),
        "amount": N.money(F.col("amount")), "labelled": N.labelled_amount(text), "payee": N.payee(F.col("payee")), "unit": N.unit_in(F.col("unit"), N.payee(F.col("payee")), text), "micr_line": line,
        "mobile_deposit_prohibited": text.rlike(r"(?i)MOBILE\s+DEPOSIT\s+PROHIBITED|NOT\s+FOR\s+MOBILE\s+DEPOSIT"),
    })
    out = restored_cents(out).drop("amount", "labelled", "correction").withColumnRenamed("value", "amount")
    out = amount_conflicts(out).drop("amount").withColumnRenamed("value", "amount")
    out = rejected_serials(out).drop("serial").withColumnRenamed("value", "serial")
    out = serials_against_micr(out).drop("serial", "match_status").withColumnRenamed("value", "serial").withColumnRenamed("status", "match_status")
    flags = F.array_compact(F.array(F.when(F.col("reason").isNotNull(), "missing_document_identity"), F.when(F.col("amount_status") == "conflict", "amount_evidence_conflict"), F.when(F.col("match_status") == "conflicting", "serial_micr_conflict")))
    return out.withColumn("review_flags", F.array_join(flags, ","))


def provenance(df: DataFrame) -> DataFrame:
    """Where a serial comes from (serial, evidence, correction, flags, match_status): distinct sources, and one of four match states."""
    own = F.array_compact(F.array(N.empty_to_null(F.lower("evidence")), F.col("correction")))
    sources = F.array_distinct(F.when((F.size(own) == 0) & F.col("serial").isNotNull(), F.array(F.lit("extracted_serial"))).otherwise(own))
    flags = F.split(F.coalesce("flags", F.lit("")), ",")
    conflict = F.coalesce(F.col("match_status") == "conflicting", F.lit(False)) | F.array_contains(flags, "serial_micr_conflict")
    missing = F.array_contains(flags, "missing_document_identity") | F.col("serial").isNull()
    sure = F.arrays_overlap(sources, F.array(*map(F.lit, ("both", "labeled_number", "check_micr_structure"))))
    other = F.exists(flags, lambda f: f.contains("serial") & f.contains("conflict"))
    status = F.when(conflict, "conflicting").when(missing, "unclear").when(other, "conflicting").when(sure, "confirmed").otherwise("unmatched")
    return df.withColumn("sources", F.array_join(sources, ",")).withColumn("identity", status)


def unpacked_pairs(df: DataFrame, column: str) -> DataFrame:
    """"name=$amount, name=text" opened up: one row a pair with its limit as text and, where it is one, as number."""
    parts = F.split(F.col(column), r",\s+(?=[^,=]+=)")
    rows = df.select("*", F.posexplode(F.filter(parts, lambda x: x.contains("="))).alias("pos", "pair"))
    limit = N.stripped(F.regexp_extract("pair", r"=(.*)$", 1))
    numeric = F.when(limit.rlike(r"^\$?\s*[0-9][0-9,]*(\.[0-9]+)?$"), N.money(limit))
    return rows.select(*df.columns, (F.col("pos") + 1).alias("pair_no"), N.stripped(F.regexp_extract("pair", "^([^=]*)=", 1)).alias("name"), limit.alias("limit_text"), numeric.alias("limit_value")).drop(column)
