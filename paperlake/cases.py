"""Queries of text rules: every row of lineitem gets one of some literal cases, and the expected values are written out.

A case is the operator's input columns and the rows it must give. The SQL holds the expected values as literals and
no rule, so that it can't repeat an operator's mistake; the work grows with the table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import normalise as N
from .operators import normal, pages, records, rollups

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
KEY = ["doc_id", "line_no"]


def _literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    return str(x) if isinstance(x, (int, float)) else "'" + str(x).replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _add(name: str, operator: Callable[[DataFrame], DataFrame], inputs: str, outputs: str, cases: list[tuple]) -> None:
    """cases: (input values, expected rows or one expected row). outputs: DuckDB's types."""
    schema = [x.split() for x in inputs.split(", ")]
    wanted = [x.split() for x in outputs.split(", ")]
    n = len(cases)

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = [F.struct(*(F.lit(v).cast(kind).alias(c) for v, (c, kind) in zip(c[0] if isinstance(c[0], tuple) else (c[0],), schema, strict=True))) for c in cases]
        case = F.element_at(F.array(*rows), (F.pmod(F.col("l_partkey") + F.col("l_suppkey"), F.lit(n)) + 1).cast("int"))
        lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("line_no"), case.alias("case"))
        return operator(lines.select(*KEY, "case.*")).select(*KEY, *(w[0] for w in wanted))

    values = [(i, *r) for i, c in enumerate(cases) for r in (c[1] if isinstance(c[1], list) else [c[1] if isinstance(c[1], tuple) else (c[1],)])]
    table = ",\n".join("(" + ", ".join(map(_literal, v)) + ")" for v in values)
    columns = ", ".join(f"CAST({c} AS {t}) AS {c}" for c, t in wanted)
    QUERIES[name] = query
    ORACLE_SQL[name] = (
        f"SELECT l_orderkey AS doc_id, l_linenumber AS line_no, {columns} FROM lineitem\n"
        f"JOIN (VALUES {table}) AS wanted(case_no, {', '.join(w[0] for w in wanted)}) ON case_no = (l_partkey + l_suppkey) % {n}"
    )


def _value(name: str, how, kind: str, cases: list[tuple]) -> None:
    """A normaliser of one text column; expected: value and status."""
    full = [(c[0], (c[1], c[2] if len(c) > 2 else "rejected" if c[1] is None else "ok")) for c in cases]
    _add(name, lambda df: normal.normalised(df, "text", how), "text string", f"value {kind}, status VARCHAR", full)


_value("normalise_money", N.money, "DECIMAL(14,2)", [
    ("$356 56", 356.56), ("$356,56", 356.56), ("1,234", 1234), ("1,234.5", 1234.50), ("PAY EXACTLY 442 17", 442.17), ("NOT VALID OVER $1000.00", None), ("NOT VALID OVER $500 $ 75.25", 75.25),
    ("12 34", 12.34), ("lot 12 34 x", 12), ("-7.10", 7.10), ("2000000", None), ("abc", None), ("", None, "empty"), (None, None, "empty"),
])
_value("normalise_currency_last", lambda c: F.try_element_at(N.every(c, r"([0-9][0-9,]*[.]?[0-9]*)"), F.lit(-1)).try_cast(N.MONEY), "DECIMAL(14,2)", [("11-02-25: 500", 500), ("x 12.50", 12.50), ("none", None), ("", None, "empty")])
_value("normalise_numeric_strip", N.numeric_strip, "DECIMAL(18,4)", [("$1,250.75", 1250.75), ("7 pcs", 7), ("1.2.3", None), ("none", None), (None, None, "empty")])
_value("normalise_date", N.date, "DATE", [
    ("2024-02-29", "2024-02-29"), ("2023-02-29", None), ("3/4/24", "2024-03-04"), ("13/1/24", "2024-01-13"), ("0l/15/2O24", "2024-01-15"), ("D 050926", "2026-05-09"),
    ("July 4, 2025", "2025-07-04"), ("Oct. 9 2024", "2024-10-09"), ("paid 2024/1/2 ok", "2024-01-02"), ("no date", None), ("", None, "empty"),
])
_value("amount_from_words", N.amount_from_words, "DECIMAL(14,2)", [
    ("FOURTEEN HUNDRED NINETY NINE 74", 1499.74), ("TWO HUNDRED SIX AND 17 DOLLARS", 206.17), ("THIRTEEN HUNDRED TWENTY THREE DOLLARS 74/XX", 1323.74),
    ("One Hundred Thirty Two and 63/100ths dollars", 132.63), ("PAY EXACTLY FIVE HUNDRED DOLLARS AND NO CENTS", 500), ("ONE THOUSAND TWO HUNDRED DOLLARS AND FIFTY CENTS", 1200.50),
    ("REF 0412 SEVEN HUNDRED AND NO/100", 700), ("ninety-nine dollars", 99), ("illegible", None), ("", None, "empty"),
])
_value("extract_labelled_amount", N.labelled_amount, "DECIMAL(14,2)", [
    ("PAY EXACTLY ***FOUR*** $ 442.17", 442.17), ("PAY ONLY $356 56", 356.56), ("NOT VALID OVER $1000.00\n$ 75.25", 75.25), ("*** 12.50 ***", 12.50), ("$ 1,234.56 due", 1234.56), ("total 5", None), ("", None, "empty"),
])
_value("extract_serial", N.serial_in, "VARCHAR", [
    ("Money Order No. 12345678901", "12345678901"), ("SERIAL: 98765", "98765"), ("20-1234567890", "201234567890"), ("ref 021000021 then 7654321", "7654321"), ("ref 111000025", "111000025"), ("0000000 x", None), ("none", None), (None, None, "empty"),
])
_value("normalise_serial", N.serial, "VARCHAR", [("12-3456789", "123456789"), ("o1l-9", "011-9"), ("12-XXXX", None), ("n/a", None), ("ab 12#", "AB12"), (" 20 1234567 ", "201234567"), ("", None, "empty")])
_value("extract_unit", lambda c: N.unit_in(c), "VARCHAR", [("rent APT # 12b4", None), ("Apt. b204", "B204"), ("memo: may 1203", "1203"), ("oak house 77", None), ("oak house 118", "118"), ("Unit #3045 A", "3045"), ("", None, "empty")])
_value("serial_from_account", N.serial_from_account, "VARCHAR", [("40197995806964", "19799580696"), ("4012345678901", "12345678901"), ("123456789", "123456789"), ("9912345678901", "12345678901"), ("1234", None), ("", None, "empty")])
_value("normalise_payee", N.payee, "VARCHAR", [("Oak  Park Apts. APT 1204", "Oak Park Apts"), ("# A101 Elm Court", "Elm Court"), ("Pay to the order of", None), (" -Lake View, ", "Lake View"), ("", None, "empty")])
_value("clean_property_name", N.property_name, "VARCHAR", [
    ("Oak Park Apartments / 0293323581", "Oak Park Apartments"), ("Lake View Account Currency USD", "Lake View"), ("REGIONS", None), ("of the a bc", None), ("oaK parK House", None), ("AB12 (COPY)", None), ("", None, "empty"),
])
_value("property_aliases", lambda c: F.array_join(N.property_aliases(c), "|"), "VARCHAR", [
    ("Holding Five LP dba Oak Park Apartments", "Holding Five LP dba Oak Park Apartments|Oak Park Apartments|Oak Park"), ("Lake House at Elm Street", "Lake House at Elm Street|Lake House"),
    ("Maple Court Village", "Maple Court Village|Maple Court"), ("", None, "empty"),
])
_value("normalise_bank_name", N.valid_bank_name, "VARCHAR", [("jp morgan na", "JPMorgan Chase Bank"), ("First Oak Bank", "First Oak Bank"), ("Account Bank", None), ("regions", "Regions Bank"), ("X Bank", None), ("", None, "empty")])
_value("canonical_angle", lambda c: N.canonical_angle(c.try_cast("double")), "DOUBLE", [("83.2", 90.0), ("-91", 270.0), ("45", 45.0), ("359", 0.0), ("171", 180.0), ("101", 101.0), ("x", None)])
_value("check_routing_number", lambda c: F.when(N.routing_number(c), N.digits(c)), "VARCHAR", [("111000025", "111000025"), ("0210-0002-1", "021000021"), ("111000026", None), ("12345", None), ("", None, "empty")])
_add("parse_micr", lambda df: df.select(*KEY, N.micr(F.col("text")).alias("m")).select(*KEY, "m.*"), "text string", "routing_number VARCHAR, check_number VARCHAR, accounts VARCHAR", [
    ("⑆111000025⑆ 0012345678 ⑈001204", ("111000025", "1204", "0012345678")), ("021000021 445566778 0099", ("021000021", "99", "445566778")), ("nothing", (None, None, "")), ("7654321987 55", (None, "55", "7654321987")),
])
_value("micr_line", N.micr_line, "VARCHAR", [("pay\n111000025 0012345678 1204\n4444 5555", "111000025 0012345678 1204"), ("1234 5678", None), ("a1234567b7654321\nx", "1234567 7654321"), ("", None, "empty")])
_add("detect_issuer", lambda df: df.select(*KEY, N.issuer(F.col("text")).alias("i")).select(*KEY, "i.*"), "text string", "issuer VARCHAR, agent VARCHAR", [
    ("sold at Kroger 12", ("Western Union", None)), ("MONEY GRAM", ("MoneyGram", None)), ("barri store", ("DolEx", "Bank of Texas")), ("Chase and PLS", ("PLS", "BancFirst")), ("none", (None, None)), (None, (None, None)),
])
_value("detect_bank", N.bank_name, "VARCHAR", [("J P Morgan", "JPMorgan Chase Bank"), (" wells  fargo ", "Wells Fargo Bank"), (" Oak Bank ", "Oak Bank"), ("bank of texas", "Bank of Texas"), ("", "", "empty")])
_add("default_instrument_type", lambda df: df.withColumn("type", N.instrument_type(F.col("kind"), F.col("text"))).withColumn("description", N.payment_description(F.col("given"), F.col("type"))), "kind string, text string, given string", "type VARCHAR, description VARCHAR", [
    ((None, "OFFICIAL CHECK 5", None), ("CashiersCheck", "Payment-Check")), (("", "a check", None), ("Check", "Payment-Check")), ((None, "check or money order", ""), ("MoneyOrder", "Payment-MoneyOrder")),
    (("Escrow", "x", None), ("Escrow", "Escrow Deposit Paid In")), (("Draft", "x", "own"), ("MoneyOrder", "own")),
])
_add("restore_cents", normal.restored_cents, "amount decimal(14,2), labelled decimal(14,2)", "value DECIMAL(14,2), correction VARCHAR", [
    ((356.0, 356.56), (356.56, "356.00 to 356.56")), ((356.0, 357.56), (356, None)), ((356.1, 356.56), (356.10, None)), ((None, 12.5), (12.50, None)), ((7.0, None), (7, None)),
])
_add("amount_conflict", normal.amount_conflicts, "amount decimal(14,2), words string", "value DECIMAL(14,2), candidate DECIMAL(14,2), amount_status VARCHAR", [
    ((400.0, "FOUR HUNDRED FORTY TWO DOLLARS"), (None, 400, "conflict")), ((442.0, "FOUR HUNDRED FORTY TWO DOLLARS"), (442, None, "verified")), ((442.5, "FOUR HUNDRED FORTY TWO AND 17/100"), (None, 442.5, "conflict")),
    ((442.5, "FOUR HUNDRED FORTY TWO DOLLARS"), (442.5, None, "verified")), ((None, "NINETY DOLLARS"), (90, None, "verified")), ((None, None), (None, None, None)),
])
_add("reject_false_serials", normal.rejected_serials, "serial string, kind string, evidence string, micr_line string", "value VARCHAR, reason VARCHAR", [
    (("111000025", "MoneyOrder", None, None), (None, "routing_or_weak")), (("123456789", "Check", None, None), (None, "routing_or_weak")), (("123456789", "Check", "both", None), ("123456789", None)),
    (("12345678", "MoneyOrder", None, "111000025 0012345678 1204"), (None, "micr_account_or_routing")), (("1204", "Check", None, "111000025 0012345678 1204"), ("1204", None)), ((None, "Check", None, None), (None, None)),
])
_add("check_serial_vs_micr", normal.serials_against_micr, "serial string, kind string, evidence string, micr_line string, match_status string", "value VARCHAR, status VARCHAR", [
    (("55", "Check", "labeled_number", "111000025 0012345678 1204", None), (None, "conflicting")), (("55", "Check", None, "111000025 0012345678 1204", None), ("1204", None)), ((None, "Check", None, "111000025 0012345678 1204", None), ("1204", None)),
    (("1204", "Check", None, "111000025 0012345678 1204", "conflicting"), (None, "conflicting")), (("55", "MoneyOrder", "both", "111000025 0012345678 1204", None), ("55", None)), (("77", "Check", None, None, None), ("77", None)),
])
_RAW = "kind string, issuer string, serial string, amount string, words string, issued string, payee string, unit string, micr_line string, evidence string, match_status string, ocr_text string"
_add("sanitize_instruments", normal.sanitised_instruments, _RAW, "kind VARCHAR, issuer VARCHAR, serial VARCHAR, amount DECIMAL(14,2), amount_status VARCHAR, issue_date DATE, payee VARCHAR, unit VARCHAR, mobile_deposit_prohibited BOOLEAN, review_flags VARCHAR", [
    ((None, "western union", "20-1234567", "356", None, "3/4/24", "Oak Park APT 1204", None, None, None, None, "PAY EXACTLY $356.56"), ("MoneyOrder", "Western Union", "201234567", 356.56, "verified", "2024-03-04", "Oak Park", None, False, "")),
    (("Check", None, "55", "400", "FOUR HUNDRED FORTY TWO", None, None, "B204", "111000025 0012345678 1204", "both", None, "Not for mobile deposit"), ("Check", None, None, None, "conflict", None, None, "B204", True, "amount_evidence_conflict,serial_micr_conflict")),
    ((None, None, None, None, None, None, None, None, None, None, None, None), ("MoneyOrder", None, None, None, None, None, None, None, False, "")),
])
_add("provenance", normal.provenance, "serial string, evidence string, correction string, flags string, match_status string", "sources VARCHAR, identity VARCHAR", [
    (("1", "Both", None, None, None), ("both", "confirmed")), (("1", None, "check_micr_structure", "", None), ("check_micr_structure", "confirmed")), (("1", None, None, None, None), ("extracted_serial", "unmatched")),
    ((None, None, None, None, None), ("", "unclear")), (("1", "labeled_number", None, "x_serial_conflict", None), ("labeled_number", "conflicting")), (("1", "both", None, None, "conflicting"), ("both", "conflicting")),
])
_add("unpack_pairs", lambda df: normal.unpacked_pairs(df, "text"), "text string", "pair_no INTEGER, name VARCHAR, limit_text VARCHAR, limit_value DECIMAL(14,2)", [
    ("Each Occurrence=$1,000,000, Damage to Rented=$100,000", [(1, "Each Occurrence", "$1,000,000", 1000000), (2, "Damage to Rented", "$100,000", 100000)]), ("Wind/hail=2% of Coverage A", [(1, "Wind/hail", "2% of Coverage A", None)]),
    ("none", []), (None, []),
])
_FRONT = "WESTERN UNION MONEY ORDER PAY TO THE ORDER OF OAK PARK PAY EXACTLY $442.17 PURCHASER"
_BACK = "PURCHASER'S AGREEMENT SERVICE CHARGE applies LOAD THIS DIRECTION always as printed here"
_BATCH = "BATCH DETAILS of the week\nBATCH AMOUNT 12 ACTUAL ITEMS 4 POSTED BY ANN"
_SLIP = "DEPOSIT SLIP with DEPOSIT TOTAL and ITEM COUNT plus CREDIT TOTAL today again"
_RECEIPT = "TRANSACTION RECEIPT for you TOTAL DEPOSIT in CASHBOX four"
_SCORES = ", ".join(f"{a} INTEGER" for a in pages.AXES)
_TEXTS = [
    (_FRONT, (16, 0, 0, 0, 0, "instrument_front")), (_BACK, (1, 12, 0, 0, 0, "back_page")), (_BATCH, (0, 0, 15, 0, 0, "batch_header")), (_SLIP, (0, 0, 0, 10, 0, "deposit_slip")), (_RECEIPT, (0, 0, 0, 0, 10, "receipt")),
    (_FRONT + " " + _BATCH, (16, 0, 15, 0, 0, "report_with_instruments")), ("one two", (0, 0, 0, 0, 0, "blank")), (None, (0, 0, 0, 0, 0, "blank")), ("seven words that say nothing at all", (0, 0, 0, 0, 0, "unknown")),
    ("hand written note says TOTAL ITEMS and $ 12", (0, 0, 0, 0, 0, "deposit_slip")),
]
_add("score_pages", pages.score_pages, "text string", _SCORES, [(t, x[:5]) for t, x in _TEXTS])
_add("classify_pages", pages.classify_pages, "text string", "kind VARCHAR", [(t, x[5]) for t, x in _TEXTS])
_add("tag_reports", pages.tag_reports, "text string", "detail_report BOOLEAN, bank_report BOOLEAN", [
    ("Deposit Detail  Report", (True, False)), ("deposit detail for deposit id 4 transaction detail for transaction id 5", (True, False)), ("CAPTURE SEQ and POST AMOUNT", (False, True)), ("POST AMOUNT", (False, False)), (None, (False, False)),
])
_REGISTER = "Capture Seq  Post Amount\n000101 111000025 1234567 0000204 450.00 450.00\n 000102 021000021 7654321 123456789 1,275.50 1,275.50 0.25\nTotal 2"
_add("parse_bank_register", lambda df: pages.bank_register(df, KEY), "text string", "item_no INTEGER, serial_number VARCHAR, check_number VARCHAR, routing_number VARCHAR, amount_numeric DECIMAL(14,2), adjustment DECIMAL(14,2), payment_description VARCHAR", [
    (_REGISTER, [(101, "204", "0000204", "111000025", 450, 0, "Payment-Check"), (102, "123456789", "123456789", "021000021", 1275.50, 0.25, "Payment-MoneyOrder")]), ("000101 111000025 1234567 204 450.00 450.00", []), (None, []),
])
_DETAIL = "Transaction Detail for Transaction ID 77\n111000025 40197995806964 $450.00 003\n20-12345678 021000021 7654321 99.00 Debit\n111000025 1234567 88 10.00 Credit\n111000025 1234567 88 9,999.00 003"
_add("parse_transaction_detail", lambda df: pages.transaction_detail(df, KEY), "text string", "item_no INTEGER, routing_number VARCHAR, account_number VARCHAR, serial_number VARCHAR, amount_numeric DECIMAL(14,2)", [
    (_DETAIL, [(1, "111000025", "40197995806964", "19799580696", 450), (2, "021000021", "7654321", "2012345678", 99)]), ("no report\n111000025 1234567 9.00 003", []),
])
_add("basic_instrument_from_page", pages.basic_instruments, "text string", "instrument_type VARCHAR, issuer VARCHAR, serial_number VARCHAR, amount_numeric DECIMAL(14,2), issue_date DATE", [
    ("MoneyGram serial: 98765432 PAY EXACTLY $12.50 on 3/4/24", [("MoneyOrder", "MoneyGram", "98765432", 12.50, "2024-03-04")]), ("check no 1234567", [("Check", None, "1234567", None, None)]), ("nothing here", []), (None, []),
])
_add("classify_deposit_source", pages.deposit_sources, "page_kind string, text string, source_type string, source_system string, transaction string, amount decimal(14,2), items int", "source VARCHAR", [
    ((None, None, " Bank_Receipt", None, None, None, None), "bank_receipt"), ((None, "BATCH  DETAILS", None, None, None, None, None), "yottareal_report"), ((None, "x", None, "Deposit Detail Report", None, None, None), "deposit_detail_report"),
    ((None, "Checking Deposit $1,200.00", "other", None, None, None, None), "bank_receipt"), ((None, None, None, "Regions", None, None, None), "regions_report"), (("batch_header", "x", None, None, None, None, None), "summary_page"),
    ((None, "deposit ticket", None, None, None, None, None), "handwritten_ocr"), ((None, None, None, None, "T1", None, None), "bank_receipt"), ((None, None, None, None, None, 5.0, None), "deposit_ticket"), ((None, None, None, None, None, None, 0), "metadata"),
])
_add("classify_query", records.casual_queries, "message string", "is_casual BOOLEAN", [
    ("Hello ", True), ("this policy", True), ("how are things going now", True), ("what is the premium due", False), ("thank you", True), ("rent roll", False), (None, False), ("", False),
])
_add("review_decision_invoice", records.invoice_reviews, "invoice_id string, vendor_name string, n_lines int", "needs_review BOOLEAN, reason VARCHAR", [
    (("1", "v", 2), (False, "")), ((None, "v", 0), (True, "missing vital field(s): invoice_id, line_items")), (("1", "", 2), (True, "missing vital field(s): vendor_name")),
])
_add("review_decision_id", records.id_reviews, "document_type string, id_number string, full_name string, date_of_birth string, n_fields int", "needs_review BOOLEAN, reason VARCHAR", [
    (("social_security", "1", "a b", None, 3), (False, "")), (("passport", "1", "a b", None, 9), (True, "missing vital field(s): date_of_birth")), (("passport", "1", "a b", "2000-01-01", 5), (True, "insufficient data extracted (5/6 required fields)")),
    (("passport", None, None, "2000-01-01", 5), (True, "No valid ID data found")), (("passport", "1", "a b", "2000-01-01", 6), (False, "")),
])
_add("review_decision_insurance", records.insurance_reviews, "policy_number string, insured_name string, insurance_company string, n_fields int", "needs_review BOOLEAN, reason VARCHAR", [
    (("1", "a", "c", 6), (False, "")), (("1", None, "", 6), (True, "Missing vital field(s): insured_name, insurance_company")), (("1", "a", "c", 4), (True, "Insufficient data extracted (4/6 required fields)")),
])
_add("valid_ids", records.valid_ids, "full_name string, id_number string", "full_name VARCHAR, id_number VARCHAR", [(("a", None), [("a", None)]), (("", "7"), [("", "7")]), (("", None), []), ((None, None), [])])
_add("strong_visible", records.strong_visible, "source string, missing_from_scan boolean, page_number int, total_pages int, amount_numeric decimal(14,2), serial_number string, payee_raw string", "strong BOOLEAN", [
    (("vision", False, 1, 3, 5.0, "12-3456789", None), True), (("regions_deposit_report", False, 1, 3, 5.0, "1", None), False), (("vision", True, 1, 3, 5.0, "1", None), False), (("vision", False, 4, 3, 5.0, "1", None), False),
    (("vision", False, 1, 3, None, "1", None), False), ((None, None, 1, 3, 5.0, None, "Oak Park"), True), ((None, None, 1, 3, 5.0, None, "ADDRESS"), False), ((None, None, None, 3, 5.0, "1", None), False),
])
_add("flag_low_quality", records.low_quality, "blur double, contrast double, dark double", "needs_enhancement BOOLEAN", [((89.9, 40.0, 0.1), True), ((90.0, 32.0, 0.35), False), ((200.0, 31.0, 0.1), True), ((200.0, 50.0, 0.36), True), ((None, 50.0, 0.1), False)])
_add("amount_evidence_gate", records.amount_evidence, "amount decimal(14,2), words string, evidence string", "amount_status VARCHAR", [((5.0, None, None), "candidate"), ((5.0, "FIVE DOLLARS", None), "verified"), ((5.0, None, "Both"), "verified"), ((None, None, None), None)])
_add("local_evidence_check", records.local_evidence, "serial string, region_text string, amount decimal(14,2), words string", "value VARCHAR, amount_kept DECIMAL(14,2), flags VARCHAR", [
    (("123456", "no 00123456 here", 5.0, None), ("123456", 5, "")), (("999", "no 00123456", 5.0, "SIX DOLLARS"), (None, None, "serial_outside_local_graph,graph_local_amount_conflict")), (("999", "", 5.0, "SIX DOLLARS"), ("999", 5, "")), ((None, "1", 5.0, "FIVE DOLLARS"), (None, 5, "")),
])
_add("accept_detections", records.accepted_detections, "probability double, x double, y double, w double, h double", "x1 DOUBLE, y1 DOUBLE, orientation INTEGER", [
    ((0.55, 0.5, 0.5, 0.75, 0.25), [(1.0, 0.75, 0)]), ((0.54, 0.0, 0.0, 0.5, 0.5), []), ((0.9, 0.25, 0.25, 0.25, 0.5), [(0.5, 0.75, 90)]), ((0.9, 0.25, 0.25, 0.0, 0.5), []),
])
_add("count_fronts_by_text", records.fronts_by_text, "text string", "fronts INTEGER", [("PAY TO THE ORDER OF x", 1), ("western union pay exactly pay exactly pay exactly", 2), ("Pay  exactly, pay exactly", 1), ("none", 0), (None, 0)])
_add("sniff_content", lambda df: records.sniffed(df.withColumn("content", F.unhex("bytes"))), "bytes string, content_type string", "accepted BOOLEAN", [
    (("255044462D312E37", "application/pdf"), True), (("FFD8FFE0", None), True), (("89504E470D0A1A0A00", None), True), (("89504E470D0A1A", None), False), (("49492A00", None), True), (("4D4D002A", None), True),
    (("424D", None), True), (("504B0304", None), True), (("68C3A9", "text/plain"), True), (("68C3", "text/plain"), False), (("68C3A9", "text/html"), False), (("", "text/plain"), True), ((None, None), False),
    (("61" * 1023 + "C3A9", "text/plain"), False), (("61" * 1024 + "FF", "text/plain"), True),
])
_add("clean_person_name", records.person_names, "first_name string, last_name string", "first_name VARCHAR, last_name VARCHAR, full_name VARCHAR", [
    (("OLIVIA 178-82-6396", "Stone"), ("OLIVIA", "Stone", "OLIVIA Stone")), (("Ann\nDOB 1980", None), ("Ann", None, "Ann")), ((" Ann \n Mary ", ""), ("Ann Mary", "", "Ann Mary")), (("4", "Li"), (None, "Li", "Li")), ((None, None), (None, None, None)),
])
_add("clean_field", lambda df: df.withColumn("field", records.clean_field(F.col("field"))), "field string", "field VARCHAR", [
    ("1. Main St,; ", "Main St"), (" 12.x ,", "x"), ("a, b", "a, b"), ("", None), (None, None), (";", ""), ("7 Elm;", "7 Elm"),
])
_add("format_address", records.addresses, "street string, city string, state string, postal_code string", "address VARCHAR", [
    (("8. 123 Main St", "Reno", "NV", "89501"), "123 Main St, Reno, NV, 89501"), (("123 Main St", None, "NV", ""), "123 Main St, NV"), ((None, "", None, None), None), (("", "Reno", None, None), "Reno"),
])
_JOBS = "array<struct<document_type:string,employer:string>>"
_APPLICANTS = [
    (("Ann", '[{"document_type":"paystub","employer":"x"},{"document_type":"employment verification application","employer":"y"},{"employer":"z"}]'), [(1, "paystub", "x"), (2, "employment verification application", "y"), (3, None, "z")]),
    (("Bo", '[{"document_type":"employment verification application","employer":"y"}]'), [(1, "employment verification application", "y")]), (("Cy", "[]"), []), (("Di", None), []),
]
_add("explode_jobs", lambda df: records.exploded_jobs(df.withColumn("jobs", F.from_json("jobs", _JOBS))), "applicant string, jobs string", "applicant VARCHAR, job_no INTEGER, document_type VARCHAR, employer VARCHAR", [
    (c, [(c[0], *r) for r in rows]) for c, rows in _APPLICANTS
])
_add("drop_verification_jobs", lambda df: records.exploded_jobs(records.income_jobs(df.withColumn("jobs", F.from_json("jobs", _JOBS)))), "applicant string, jobs string", "applicant VARCHAR, job_no INTEGER, employer VARCHAR", [
    (_APPLICANTS[0][0], [("Ann", 1, "x"), ("Ann", 2, "z")]), (_APPLICANTS[1][0], []), (_APPLICANTS[2][0], []), (_APPLICANTS[3][0], []),
])
_add("limit_pages", rollups.limited_pages, "document_type string, is_pdf boolean, page_number int", "document_type VARCHAR, is_pdf BOOLEAN, page_number INTEGER", [
    (("income", True, 8), [("income", True, 8)]), (("income", False, 9), []), (("insurance", True, 10), [("insurance", True, 10)]), (("insurance", True, 11), []), (("vendor", True, 4), []),
    (("id", True, 2), [("id", True, 2)]), (("id", True, 3), []), (("id", False, 9), [("id", False, 9)]), (("other", True, 99), [("other", True, 99)]),
])
_add("map_id_type", records.id_types, "doc_type string, type_field string, number string", "id_type VARCHAR", [
    (("idDocument.passport", "driver", None), "passport"), (("idDocument.socialSecurityCard", None, None), "social_security"), (("idDocument.driverLicense", None, None), "driver_license"),
    ((None, " p ", None), "passport"), ((None, "Pasaporté", None), "passport"), ((None, "ПАСПОРТ", None), "passport"), ((None, "Green Card", None), "residence_permit"),
    (("idDocument", "Seguro Social", None), "social_security"), ((None, "Alien Registration", None), "foreign_id"), ((None, "Identity card", None), "state_id"), ((None, "National Identification", None), "national_id"),
    ((None, None, " 123-45-6789 "), "social_security"), ((None, "", "123456789"), "id"), ((None, None, None), "id"), (("idDocument.residence_permit", None, None), "residence_permit"), ((None, "Work visa", None), "visa"),
])
_add("should_extract_unknown", records.maybe_instruments, "text string, front_score int", "may_be BOOLEAN", [
    (("", 0), True), ((None, None), True), ((" \n", 0), True), (("Deposit  Detail Report $ 5", 9), False), (("short", 1), True), (("short", 0), False), (("x" * 500, 1), False), (("x" * 500, 2), True),
    (("x" * 500 + " money order", None), True), (("costs $ 7", 0), True), (("cashiers", 0), False), (("pls", 0), True),
])
_INVOICE = "vendor_name string, customer_name string, vendor_phone_number string, invoice_id string, unit_list string, source_text string"
_BILL = "ACME Roofing Company of Reno\nPhone (775) 555-0101\nInvoice INV 2024-77\nApt 12B, #4"
_add("ground_fields", lambda df: records.grounded(df.withColumn("units", F.split("unit_list", ","))).withColumn("kept_units", F.array_join("units", ",")), _INVOICE,
     "vendor_name VARCHAR, customer_name VARCHAR, vendor_phone_number VARCHAR, invoice_id VARCHAR, kept_units VARCHAR", [
    (("Acme Roofing", "Bob Stone", "775-555-0101", "INV2024-77", "12b,4,9,99Z", _BILL), ("Acme Roofing", None, "775-555-0101", "INV2024-77", "12b,4")),
    (("Acme Roofing Company Inc", "X Y", "775-555-0102", "2024/88", "C", _BILL), ("Acme Roofing Company Inc", "X Y", None, "2024/88", "C")),
    (("Acme Paving Company", "", "none", "ZZ-9", None, _BILL), (None, "", "none", None, None)),
    (("Acme", None, None, None, "7", None), (None, None, None, None, "")), ((None, None, "", "", "12", _BILL), (None, None, "", "", "12")),
])
_RECORD = "a string, b struct<c:int,d:array<string>>, e array<struct<f:string,g:double>>, h map<string,string>"
_add("field_count", lambda df: records.counted_fields(df.withColumn("record", F.from_json("body", _RECORD)), "record"), "body string", "n_fields INTEGER", [
    ('{"a":"x","b":{"c":0,"d":["p","",null,"q"]},"e":[{"f":"y","g":1.5},{"f":""}],"h":{"k":"v","l":""}}', 7), ("{}", 0), (None, 0), ('{"a":"","b":{"c":null,"d":[]}}', 0), ('{"a":"z","e":[null]}', 1),
])
_add("should_extract", records.extracted_pages, "kind string, front_score int, text string, multi_front boolean", "should_extract BOOLEAN, skip_reason VARCHAR", [
    (("instrument", 0, "x", None), (True, None)), (("back", 9, "x", False), (False, "page_kind_excluded")), (("back", 0, "x", True), (True, None)), (("blank", 0, "", True), (False, "page_kind_excluded")),
    (("deposit_ticket", 3, "x", None), (True, None)), (("deposit_ticket", 2, "x", None), (False, "page_kind_excluded")), (("unknown", 0, "text", None), (False, "unknown_keyword_miss")), (("unknown", 0, "text", True), (True, None)),
    ((None, None, None, None), (True, None)), (("batch_header", None, "x", None), (False, "page_kind_excluded")), (("report_with_instruments", None, None, None), (True, None)),
])
_ITEMS = "array<struct<description:string,n:int>>"
_add("clean_whitespace", lambda df: records.clean_whitespace(df.withColumn("items", F.from_json("body", _ITEMS)), ("vendor_name",), "items").withColumn("line_items", F.to_json("items")),
     "vendor_name string, body string", "vendor_name VARCHAR, line_items VARCHAR", [
    ((" A\n\t B ", '[{"description":"x \\n y","n":1},{"n":2}]'), ("A B", '[{"description":"x y","n":1},{"n":2}]')), ((None, None), (None, "[]")), (("", "[]"), ("", "[]")),
])
