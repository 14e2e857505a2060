"""Pages of reports and instruments: scores, kinds, register rows, report tags. Texts in, rows out; all in the JVM."""

from __future__ import annotations

import functools
import operator
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import let
from ..functions import normalise as N

#: Fixed value: a deposit and its amount.
SLIP_AMOUNT = r"\b(?:COMMERCIAL\s+DEPOSIT(?:\s+(?:CHECKING|SAVINGS))?|(?:CHECKING|SAVINGS)\s+DEPOSIT)\s+\$?\s*[\d,]+\.\d{2}\b"
#: Signals of a page, as axis, weight and pattern.
SIGNALS = (
    ("front", 5, r"\bPAY\s+EXACTLY\b"),
    ("front", 4, r"\bPAY\s+TO\s+THE\s+ORDER\b"),
    ("front", 3, r"\bCASHIER'?S\s+CHECK\b|\bOFFICIAL\s+CHECK\b"),
    ("front", 3, r"\bREMITTER\b"),
    ("front", 3, r"\bWESTERN\s+UNION\b|\bMONEYGRAM\b|\bINTERMEX\b|\bFIDELITY\s+EXPRESS\b|\bBARRI\b|\bDOLEX\b|\bPLS\b"),
    ("front", 1, r"\$\s*\d{2,5}[,.]\d{2}\b"),
    ("front", 1, r"\b\d{2}[-\s]?\d{7,12}\b"),
    ("front", 1, r"\bMICR\b|\bMEMO\b|\bPURCHASER\b"),
    ("back", 5, r"\bSERVICE\s+CHARGE\b"),
    ("back", 4, r"\bLOAD\s+THIS\s+DIRECTION\b"),
    ("back", 4, r"\bENDORSE\s+ABOVE\s+THIS\s+LINE\b|\bPAYEE\s+ENDORSEMENT\b"),
    ("back", 3, r"\bPURCHASER'?S\s+AGREEMENT\b|\bLIMITED\s+RECOURSE\b"),
    ("back", 2, r"\bFOR\s+DEPOSIT\s+ONLY\b|\bDEPOSITORY\s+BANK\s+ENDORSEMENT\b"),
    ("back", 1, r"\bSECURITY\s+FEATURES\b|\bVOID\s+IF\b|\bTERMS\s+AND\s+CONDITIONS\b"),
    ("batch", 5, r"\bBATCH\s+DETAILS\b|\bDEPOSIT\s+BATCH\s+DETAIL\s+REPORT\b"),
    ("batch", 4, r"\bBATCH\s*#\b|\bBATCH\s+AMOUNT\b|\bACTUAL\s+ITEMS\b|\bLINE\s+ITEMS\b"),
    ("batch", 2, r"\bG/L\s+ACCOUNT\b|\bGENERAL\s+LEDGER\b|\bPOSTED\s+BY\b"),
    ("batch", 1, r"PAYMENT[-\s]?MONEYORDER|PAYMENT[-\s]?CHECK"),
    ("deposit", 5, r"\bTRANSACTION\s+DETAIL\s+FOR\s+TRANSACTION\b|\bDEPOSIT\s+CONTROL\s+INFORMATION\b"),
    ("deposit", 5, r"\bDETAILS\s+OF\s+DEPOSITS\s+BY\s+ACCOUNT\b|\bTOTAL\s+OF\s+DEPOSITS\s+SUBMITTED\b"),
    ("deposit", 4, r"\bDEPOSIT\s+ACCOUNT\b|\bDEPOSIT\s+TOTAL\b|\bCHECKS?\s+TOTAL\b"),
    ("deposit", 4, r"\bTOTAL\s+NUMBER\s+OF\s+ITEMS\b|\bACCOUNT\s+NAME/NUMBER\b"),
    ("deposit", 3, r"\bCAPTURE\s+SEQ\b|\bPOST\s+AMOUNT\b|\bCREDIT\s+AMOUNT\b|\bDEPOSIT\s+NUMBER\b"),
    ("deposit", 2, r"\bCREDIT\s+TOTAL\b|\bDEBIT\s+TOTAL\b|\bITEM\s+COUNT\b"),
    ("deposit", 2, r"\bDEPOSIT\s+SLIP\b|\bDEPOSIT\s+TICKET\b"),
    ("receipt", 4, r"\bCHASE\b.*\bTRANSACTION\s+SUMMARY\b|\bMY\s+TRANSACTION\s+SUMMARY\b"),
    ("receipt", 5, r"\bTRANSACTION\s+RECEIPT\b"),
    ("receipt", 4, r"\bTOTAL\s+CHECKS\s+AMOUNT\b|\bTOTAL\s+DEPOSIT\b"),
    ("receipt", 3, r"\bNUMBER\s+OF\s+CHECKS\b|\bCHECK\s+LISTING\b"),
    ("receipt", 3, r"\bDEPOSIT\s+CASH\s+OR\s+CHECKS\b|\bCHECKING\s+DEPOSIT\b"),
    ("receipt", 1, r"\bCASHBOX\b|\bBUSINESS\s+DATE\b"),
    ("receipt", 5, SLIP_AMOUNT),
)
#: What only backs of instruments say.
BACKS = (
    r"\bLOAD\s+THIS\s+DIRECTION\b",
    r"\bPURCHASER'?S\s+AGREEMENT\b",
    r"\bSERVICE\s+CHARGE\b",
    r"\bTERMS\s+AND\s+CONDITIONS\b",
    r"\bPAYEE\s+ENDORSEMENT\b",
    r"\bENDORSE\s+ABOVE\s+THIS\s+LINE\b",
    r"\bDEPOSITORY\s+BANK\s+ENDORSEMENT\b",
    r"\bDO\s+NOT\s+WRITE\s*/?\s*SIGN\s*/?\s*STAMP\s+BELOW\b",
    r"\bFOR\s+DEPOSIT\s+ONLY\b",
)
#: Signs of a bank's deposit report, two of which make one.
BANK_REPORT = (
    r"\bDETAILS\s+OF\s+DEPOSITS\s+BY\s+ACCOUNT\b",
    r"\bTOTAL\s+OF\s+DEPOSITS\s+SUBMITTED\b",
    r"\bTOTAL\s+NUMBER\s+OF\s+ITEMS\b",
    r"\bACCOUNT\s+NAME/NUMBER\b",
    r"\bCAPTURE\s+SEQ\b",
    r"\bPOST\s+AMOUNT\b",
    r"\bCREDIT\s+AMOUNT\b",
    r"\bDEPOSIT\s+NUMBER\b",
)
AXES = ("front", "back", "batch", "deposit", "receipt")


def _text(c: str) -> Column:
    return F.upper(N.plain(F.col(c)))


def _needed(pattern: str) -> list[list[str]]:
    """For each alternative of a pattern the texts that it can't do without, longest first: what is in groups and sets and what is optional doesn't count."""
    bare = pattern.replace(r"\$", "$")
    while "(" in bare:
        bare = re.sub(r"\([^()]*\)[?*]?", " ", bare)
    bare = re.sub(r"\\.|\[[^]]*\]|\{[^}]*\}", " ", bare)
    return [sorted(dict.fromkeys(re.findall(r"[A-Z$]+", re.sub(r".[?*]", " ", x))), key=len, reverse=True) for x in bare.split("|")]


def _may_have(t: Column, pattern: str) -> Column:
    """Whether a text has what one of the pattern's alternatives needs: plain searches, so that patterns are tried on few texts only."""
    needs = [functools.reduce(operator.and_, (t.contains(w) for w in words)) for words in _needed(pattern) if words]
    if len(needs) == len(_needed(pattern)):
        return functools.reduce(operator.or_, needs)
    return t.contains(".") & t.contains("DEPOSIT") if pattern == SLIP_AMOUNT else t.rlike(r"\d{7}") if r"\d{7,12}" in pattern else F.lit(True)


def _led(pattern: str) -> str:
    """The pattern, tried only where one of its first characters is: the bounds of words are slow to look for."""
    firsts = [re.match(r"(?:\\b)?(?:\\)?([A-Z$])", x) for x in pattern.split("|")]
    return f"(?=[{''.join(dict.fromkeys(m[1] for m in firsts))}])(?:{pattern})" if all(firsts) and "(" not in pattern else pattern


def _has(t: Column, pattern: str) -> Column:
    return _may_have(t, pattern) & t.rlike(_led(pattern))


def _times(t: Column, pattern: str) -> Column:
    return F.when(_may_have(t, pattern), F.regexp_count(t, F.lit(_led(pattern)))).otherwise(0)


def score_pages(pages: DataFrame, text: str = "text") -> DataFrame:
    """pages with weighted counts of signals on five axes, and the number of words; null texts have none."""
    return _scored(pages, text).drop("plain_")


def _scored(pages: DataFrame, text: str) -> DataFrame:
    """score_pages with the text as it is searched, made once, in ``plain_``."""
    made = pages.withColumn("plain_", _text(text)).withColumn("scores_", let(F.col("plain_"), _scores))
    return made.withColumns({a: F.col(f"scores_.{a}") for a in AXES} | {"words": F.regexp_count("plain_", F.lit("[A-Z0-9$#:/.-]{2,}"))}).drop("scores_")


def _scores(t: Column) -> Column:
    """The five sums of a text, as a struct."""
    sums = {a: F.lit(0) for a in AXES}
    for axis, weight, pattern in SIGNALS:
        sums[axis] = sums[axis] + weight * _times(t, pattern)
    # the wording of a money order counts unless a register's description column opens the page
    order = _has(t, r"\bMONEY\s*ORDER\b") & ~F.substring(t, 1, 600).contains("PAYMENT-MONEYORDER")
    sums["front"] = sums["front"] + F.when(order, 2).otherwise(0)
    return F.struct(*(c.cast("int").alias(a) for a, c in sums.items()))


def classify_pages(pages: DataFrame, text: str = "text") -> DataFrame:
    """score_pages with the kind of each page, by an ordered list of rules."""
    return _scored(pages, text).withColumn("kind", let(F.col("plain_"), _kind)).drop("plain_")


def _kind(t: Column) -> Column:
    """The kind of a page, given its text and, as columns, its scores."""
    front, back, batch, deposit, receipt = map(F.col, AXES)
    face = _has(t, r"\bPAY\s+EXACTLY\b|\bPAY\s+ONLY\b") & _has(t, r"\bPAY\s+TO\b") & _has(t, r"\$\s*\d{2,5}[,.]\d{2}\b")
    hard = sum((_has(t, p).cast("int") for p in BACKS), F.lit(0))
    back_only = _has(t, r"\bFOR\s+DEPOSIT\s+ONLY\b") & _has(t, r"\bENDORSE|DEPOSITORY\s+BANK|DO\s+NOT\s+WRITE")
    return (
        F.when(F.col("words") < 6, "blank")
        .when(~face & ((hard >= 2) | back_only), "back_page")
        .when((back >= 12) & (back >= 2 * front), "back_page")
        .when((receipt >= 8) & ~face, "receipt")
        .when((front >= 6) & ((deposit >= 5) | (batch >= 5)), "report_with_instruments")
        .when(front >= 6, "instrument_front")
        .when((receipt >= 4) & (front < 4), "receipt")
        .when(deposit >= 8, "deposit_slip")
        .when(back >= 5, "back_page")
        .when(deposit >= 5, "deposit_report")
        .when(batch >= 5, "batch_header")
        .when(_has(t, r"\bTOTAL\s+ITEMS\b|\bITEMS\s+TOTAL\b|\bTOTAL\s+DEPOSIT\b") & _has(t, r"\$\s*\d"), "deposit_slip")
        .otherwise("unknown")
    )


def tag_reports(pages: DataFrame, text: str = "text") -> DataFrame:
    """Flags of a detail report (one of three phrase pairs) and of a bank's deposit report (two of eight signs)."""
    t = F.col("plain_")
    both = lambda a, b: _has(t, a) & _has(t, b)
    detail = (
        _has(t, r"\bDEPOSIT\s+DETAIL\s+REPORT\b")
        | both(r"\bDEPOSIT\s+DETAIL\s+FOR\s+DEPOSIT\s+ID\b", r"\bTRANSACTION\s+DETAIL\s+FOR\s+TRANSACTION\s+ID\b")
        | both(r"\bDEPOSIT\s+CONTROL\s+INFORMATION\b", r"\bTRANSACTION\s+CONTROL\s+INFORMATION\b")
    )
    signs = sum((_has(t, p).cast("int") for p in BANK_REPORT), F.lit(0))
    return pages.withColumn("plain_", _text(text)).withColumns({"detail_report": detail, "bank_report": signs >= 2}).drop("plain_")


def bank_register(pages: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """Rows of bank deposit reports: sequence, routing, account, check, post and credit amount, adjustment."""
    line = r"^\s*(\d{6})\s+(\d{9})\s+(\d{4,20})\s+(\d{1,12})\s+([\d,]+\.\d{2})\s+([\d,]+\.\d{2})(?:\s+([\d,]+\.\d{2}))?\s*$"
    rows = tag_reports(pages, text).where("bank_report").select(*key, F.explode(F.split(text, r"\R")).alias("line")).where(F.col("line").rlike(line))
    g = lambda i: F.regexp_extract("line", line, i)
    zeros = F.coalesce(N.empty_to_null(F.ltrim(g(4), F.lit("0"))), g(4))
    serial = F.when(F.length(g(4)) <= 5, g(4)).otherwise(zeros)
    out = rows.select(
        *key, g(1).cast("int").alias("item_no"), serial.alias("serial_number"), g(4).alias("check_number"), g(2).alias("routing_number"), g(3).alias("account_number"),
        N.money(g(5)).alias("amount_numeric"), N.money(g(6)).alias("credit_amount"), F.coalesce(N.money(N.empty_to_null(g(7))), F.lit(0).cast(N.MONEY)).alias("adjustment"),
    )
    return out.withColumn("payment_description", F.when(F.length("serial_number") >= 6, "Payment-MoneyOrder").otherwise("Payment-Check"))


def transaction_detail(pages: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """Rows of transaction details: no credits, amounts over 0 and up to 5000; serials from aux, check or account."""
    line = r"(?i)^\s*(?:([A-Z0-9-]{4,14})\s+)?(\d{9})\s+(\d{4,20})(?:\s+(\d{1,12}))?\s+\$?\s*([\d,]+\.\d{2})\s+(\d{3,4}|Credit|Debit)?\b"
    is_report = F.col(text).rlike(r"(?i)Transaction\s+Detail\s+for\s+Transaction|Deposit\s+Control\s+Information")
    of = lambda x, i: N.empty_to_null(F.regexp_extract(x, line, i))
    fit = lambda x: x.rlike(line) & (F.coalesce(F.upper(of(x, 6)), F.lit("")) != "CREDIT") & let(N.money(of(x, 5)), lambda v: (v > 0) & (v <= 5000))
    rows = pages.where(is_report).select(*key, F.posexplode(F.filter(F.split(N.plain(F.col(text)), r"\R"), fit)).alias("pos", "line"))
    g = lambda i: of(F.col("line"), i)
    kind, given = N.serial(g(6)), N.serial(F.coalesce(g(1), g(4)))
    wrong = lambda s: s.eqNullSafe(kind) | s.isin("0003", "0004", "003", "004")
    serial = F.coalesce(let(given, lambda s: F.when(~F.coalesce(wrong(s), F.lit(False)), s)), N.serial(N.serial_from_account(g(3))))
    return rows.select(*key, (F.col("pos") + 1).alias("item_no"), g(2).alias("routing_number"), g(3).alias("account_number"), serial.alias("serial_number"), N.money(g(5)).alias("amount_numeric"))


def basic_instruments(pages: DataFrame, text: str = "text") -> DataFrame:
    """Pages on which an issuer, a serial, an amount or a date is found, with these."""
    t = F.col(text)
    rows = pages.withColumns({"issuer": N.issuer(t)["issuer"], "serial_number": N.serial_in(t), "amount_numeric": N.labelled_amount(t), "issue_date": N.date(t)})
    kind = F.when(F.col("issuer").isNotNull() | t.rlike(r"(?i)MONEY\s*ORDER"), "MoneyOrder").otherwise("Check")
    return rows.withColumn("instrument_type", kind).where("issuer IS NOT NULL OR serial_number IS NOT NULL OR amount_numeric IS NOT NULL OR issue_date IS NOT NULL")


def deposit_sources(rows: DataFrame) -> DataFrame:
    """(page_kind, text, source_type, source_system, transaction, amount, items) with one of eight kinds of source, by ordered rules."""
    t, source = F.upper(F.coalesce("text", F.lit(""))), F.upper(F.coalesce("source_system", F.lit("")))
    given = F.lower(N.stripped(F.coalesce("source_type", F.lit(""))))
    receipt = t.rlike(r"\b(?:COMMERCIAL\s+DEPOSIT(?:\s+(?:CHECKING|SAVINGS))?|(?:CHECKING|SAVINGS)\s+DEPOSIT)\s*:?\s*\$?\s*[\d,]+\.\d{2}\b")
    receipt = receipt | t.rlike(r"MY\s+TRANSACTION\s+SUMMARY|QUICKDEPOSIT\s+RECEIPT|TRANSACTION\s+RECEIPT|TOTAL\s+CHECKS\s+AMOUNT")
    kind = F.coalesce("page_kind", F.lit(""))
    from .deposits import RANKS

    out = (
        F.when(given.isin(*RANKS), given)
        .when(source.contains("YOTTA") | t.rlike(r"\bBATCH\s+DETAILS\b|\bDEPOSIT\s+BATCH\s+DETAIL\s+REPORT\b"), "yottareal_report")
        .when(source.contains("DEPOSIT DETAIL REPORT") | t.contains("DEPOSIT DETAIL REPORT"), "deposit_detail_report")
        .when((kind == "receipt") | receipt, "bank_receipt")
        .when(source.contains("REGIONS") | t.contains("DETAILS OF DEPOSITS BY ACCOUNT"), "regions_report")
        .when(kind.isin("batch_header", "deposit_report"), "summary_page")
        .when(t.rlike(r"DEPOSIT\s+TICKET|TOTAL\s+ITEMS|ADDITIONAL\s+CHECK\s+LISTING"), "handwritten_ocr")
        .when(F.coalesce("transaction", F.lit("")) != "", "bank_receipt")
        .when(F.col("amount").isNotNull() | (F.col("items") > 0), "deposit_ticket")
        .otherwise("metadata")
    )
    return rows.withColumn("source", out)


def page_word_signals(words: DataFrame, key: list[str]) -> DataFrame:
    """Of each page's words (content, confidence, y): anchors of four classes, sure and unsure words, occupied eighths of the height."""
    has = lambda p: F.count_if(F.col("content").rlike(p))
    sure, unsure = F.count_if(F.col("confidence") >= 0.8), F.count_if(F.coalesce("confidence", F.lit(0.0)) < 0.5)
    out = words.groupBy(*key).agg(
        has("(?i)PAY|EXACTLY|ORDER|MONEY|CASHIER|REMITTER|PURCHASER").alias("front_anchors"), has("(?i)ENDORSE|DEPOSITORY|AGREEMENT|SERVICE|DIRECTION|TERMS").alias("back_anchors"),
        has("(?i)DEPOSIT|TOTAL|BATCH|TRANSACTION|ACCOUNT|ITEMS").alias("control_anchors"), has(r"^\$?[\d,]+\.\d{2}$").alias("amount_anchors"), sure.alias("sure"), unsure.alias("unsure"),
        F.count_distinct(F.when(F.col("y").between(0, 1), F.least(F.floor(F.col("y") * 8), F.lit(7)))).alias("occupied_eighths"),
    )
    ratio = F.when(F.col("sure") + F.col("unsure") > 0, F.round(F.col("sure") / (F.col("sure") + F.col("unsure")), 3)).otherwise(0.0)
    return out.withColumn("confidence_ratio", ratio)
