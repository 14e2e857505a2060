"""Extracted records: gates, review decisions and evidence checks. Rows in, rows with a decision out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import is_empty
from ..functions import normalise as N

#: What people say who ask for nothing, and beginnings of such questions.
CASUAL = (
    "hi", "hello", "hey", "how are you", "thanks", "thank you", "bye", "goodbye", "good morning", "good evening",
    "sup", "what's up", "wassup", "yo", "howdy", "good night",
)
CASUAL_QUESTIONS = ("how are", "how r u", "how r you", "hows it going", "how do you do")
#: Sources of rows that were read from registers.
REGISTER_SOURCES = ("regions_deposit_report", "transaction_detail_report", "vision_register_items", "yottareal_batch_detail")


def casual_queries(messages: DataFrame, word_match: bool = False) -> DataFrame:
    """Whether a message asks for nothing: it is such a phrase, has up to two words and holds one, or holds such a question.

    Phrases count inside words ("this" holds "hi") unless word_match; null messages aren't casual."""
    text = N.stripped(F.lower(F.coalesce("message", F.lit(""))))
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    if word_match:
        holds = lambda p: text.rlike(rf"(^|\W)\Q{p}\E($|\W)")
    else:
        holds = text.contains
    any_of = lambda ps: F.greatest(*(holds(p) for p in ps))
    casual = F.when(text.isin(*CASUAL), True).when(words <= 2, any_of(CASUAL)).otherwise(any_of(CASUAL_QUESTIONS))
    return messages.withColumn("is_casual", casual)


def _missing(*fields: str) -> tuple[Column, Column]:
    lacking = F.array_compact(F.array(*(F.when(is_empty(F.col(f)), F.lit(f)) for f in fields)))
    return F.size(lacking) > 0, F.array_join(lacking, ", ")


def _decided(df: DataFrame, reason: Column) -> DataFrame:
    return df.withColumn("reason", F.coalesce(reason, F.lit(""))).withColumn("needs_review", F.col("reason") != "")


def invoice_reviews(df: DataFrame) -> DataFrame:
    """Invoices (invoice_id, vendor_name, n_lines) that lack a vital field."""
    rows = df.withColumn("line_items", F.when(F.col("n_lines") > 0, "some"))
    lacks, names = _missing("invoice_id", "vendor_name", "line_items")
    return _decided(rows, F.when(lacks, F.concat(F.lit("missing vital field(s): "), names))).drop("line_items")


def id_reviews(df: DataFrame) -> DataFrame:
    """IDs (document_type, id_number, full_name, date_of_birth, n_fields) that lack a vital field or have too few fields; social security cards need less."""
    social = F.lower(F.coalesce("document_type", F.lit(""))) == "social_security"
    lacks_two, two = _missing("id_number", "full_name")
    lacks_three, three = _missing("id_number", "full_name", "date_of_birth")
    least = F.when(social, 2).otherwise(6)
    few = F.format_string("insufficient data extracted (%d/%d required fields)", F.col("n_fields"), least)
    reason = (
        F.when(is_empty(F.col("id_number")) & is_empty(F.col("full_name")), "No valid ID data found")
        .when(social & lacks_two, F.concat(F.lit("missing vital field(s): "), two))
        .when(~social & lacks_three, F.concat(F.lit("missing vital field(s): "), three))
        .when(F.col("n_fields") < least, few)
    )
    return _decided(df, reason)


def insurance_reviews(df: DataFrame, least: int = 6) -> DataFrame:
    """Policies (policy_number, insured_name, insurance_company, n_fields) that lack a vital field or have too few fields."""
    lacks, names = _missing("policy_number", "insured_name", "insurance_company")
    few = F.format_string(f"Insufficient data extracted (%d/{least} required fields)", F.col("n_fields"))
    return _decided(df, F.when(lacks, F.concat(F.lit("Missing vital field(s): "), names)).when(F.col("n_fields") < least, few))


def valid_ids(df: DataFrame) -> DataFrame:
    """IDs with a name or a number."""
    return df.where(~is_empty(F.col("full_name")) | ~is_empty(F.col("id_number")))


def strong_visible(df: DataFrame) -> DataFrame:
    """Whether an instrument was seen: not from a register, not missing, on a page of the scan, with an amount and an identity field."""
    return df.withColumn("strong", visible_with(N.serial(F.col("serial_number")).isNotNull() | N.payee(F.col("payee_raw")).isNotNull()))


def visible_with(known: Column) -> Column:
    """The test of ``strong_visible``, given whether an identity field is known."""
    from_register = F.coalesce(F.col("source").isin(*REGISTER_SOURCES) | F.col("missing_from_scan"), F.lit(False))
    page = F.coalesce((F.col("page_number") > 0) & (F.col("page_number") <= F.col("total_pages")), F.lit(False))
    return ~from_register & page & F.col("amount_numeric").isNotNull() & F.coalesce(known, F.lit(False))


def low_quality(df: DataFrame, blur: float = 90, contrast: float = 32, dark: float = 0.35) -> DataFrame:
    """Images to be enhanced, by measured blur, contrast and share of dark pixels; unknown measures don't count."""
    tests = (F.col("blur") < blur, F.col("contrast") < contrast, F.col("dark") > dark)
    return df.withColumn("needs_enhancement", F.greatest(*(F.coalesce(t, F.lit(False)) for t in tests)))


def amount_evidence(df: DataFrame) -> DataFrame:
    """An amount without words and without strong evidence is a candidate only."""
    strong = ~is_empty(F.col("words")) | F.lower(F.coalesce("evidence", F.lit(""))).isin("numeric_box", "both")
    return df.withColumn("amount_status", F.when(F.col("amount").isNotNull(), F.when(strong, "verified").otherwise("candidate")))


def local_evidence(df: DataFrame) -> DataFrame:
    """Serials whose digits the text of their own region doesn't hold, and amounts that differ from the written one, become null with a flag."""
    has_text = F.trim(F.coalesce("region_text", F.lit(""))) != ""
    d = N.digits(F.col("serial"))
    here = F.filter(F.transform(N.every(F.col("region_text"), r"(\d[\d,.$/-]*)"), N.digits), lambda x: x != "")
    outside = has_text & (d != "") & ~F.exists(here, lambda x: x.contains(d) | d.contains(x))
    said = N.amount_from_words(F.col("words"))
    clash = has_text & F.coalesce(F.abs(F.col("amount") - said) > 0.01, F.lit(False))
    flags = F.array_compact(F.array(F.when(outside, "serial_outside_local_graph"), F.when(clash, "graph_local_amount_conflict")))
    return df.withColumns({"value": F.when(~outside, F.col("serial")), "amount_kept": F.when(~clash, F.col("amount")), "flags": F.array_join(flags, ",")})


def accepted_detections(df: DataFrame, least: float = 0.55) -> DataFrame:
    """Detected boxes (probability, x, y, w, h) that are probable enough and not empty: far corners clipped at 1, and the orientation."""
    rows = df.where(F.col("probability") >= least)
    rows = rows.withColumns({"x1": F.least(F.lit(1.0), F.col("x") + F.col("w")), "y1": F.least(F.lit(1.0), F.col("y") + F.col("h"))})
    return rows.where("x1 > x AND y1 > y").withColumn("orientation", F.when(F.col("y1") - F.col("y") > F.col("x1") - F.col("x"), 90).otherwise(0))


def fronts_by_text(df: DataFrame, text: str = "text") -> DataFrame:
    """Faces of a page by the counts of their phrases; one issuer prints its phrase twice, so half of these count, rounded up."""
    t = F.upper(F.coalesce(text, F.lit("")))
    n = lambda p: F.regexp_count(t, F.lit(p))
    exact = F.when(t.contains("WESTERN UNION"), F.ceil(n("PAY EXACTLY") / 2)).otherwise(n("PAY EXACTLY"))
    return df.withColumn("fronts", F.greatest(exact, n("PAY TO THE ORDER"), n("CASHIER'S CHECK")).cast("int"))


#: How files begin that are taken (PDF, JPEG, PNG, TIFF in two orders, BMP, ZIP), in hexadecimal.
SIGNATURES = ("25504446", "FFD8FF", "89504E470D0A1A0A", "49492A00", "4D4D002A", "424D", "504B0304")
#: Fixed value: jobs of this type say nothing about an income.
VERIFICATION = "employment verification application"
_LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"


def sniffed(files: DataFrame) -> DataFrame:
    """Whether a file's first bytes are those of a kind that is taken; plain text must begin with 1024 bytes of UTF-8.

    files: (content binary, content_type). Null contents count as empty ones, which only plain text may be."""
    content = F.coalesce("content", F.lit(b""))
    start = F.hex(F.substring(content, 1, 8))
    signed = F.greatest(*(start.startswith(s) for s in SIGNATURES))
    plain = F.coalesce(F.col("content_type") == "text/plain", F.lit(False))
    return files.withColumn("accepted", signed | (plain & F.is_valid_utf8(F.substring(content, 1, 1024).cast("string"))))


def clean_name(c: Column) -> Column:
    """A name without social security numbers and without lines that hold digits; null if nothing is left. Empty names stay."""
    lines = F.split(F.regexp_replace(c, r"\b\d{3}-\d{2}-\d{4}\b", ""), _LINE_END)
    kept = F.filter(F.transform(F.filter(lines, lambda x: ~x.rlike(r"\p{Nd}")), lambda x: N.stripped(x)), lambda x: x != "")
    return F.when(c == "", c).otherwise(F.nullif(F.array_join(kept, " "), F.lit("")))


def person_names(rows: DataFrame) -> DataFrame:
    """Clean first and last names, and the full name of those that there are."""
    first, last = clean_name(F.col("first_name")), clean_name(F.col("last_name"))
    full = F.nullif(F.concat_ws(" ", F.nullif(first, F.lit("")), F.nullif(last, F.lit(""))), F.lit(""))
    return rows.withColumns({"first_name": first, "last_name": last, "full_name": full})


def clean_field(c: Column) -> Column:
    """A field without its number ("1. ") and without commas, semicolons and blanks at its end; empty fields are null."""
    bare = F.regexp_replace(N.stripped(c), r"^\d+\.\s*", "")
    return F.when(c != "", N.stripped(F.regexp_replace(bare, r"[,; ]+$", "")))


def addresses(rows: DataFrame) -> DataFrame:
    """One line of street (without its number in the form), city, state and postal code, as far as there are any."""
    parts = [F.when(F.col("street") != "", F.regexp_replace("street", r"^\d+\.\s*", "")), *(F.nullif(F.col(c), F.lit("")) for c in ("city", "state", "postal_code"))]
    return rows.withColumn("address", F.nullif(F.concat_ws(", ", *parts), F.lit("")))


def income_jobs(applicants: DataFrame) -> DataFrame:
    """Applicants with their jobs, but for those that are only applied for; who has no other jobs is left out. jobs: array of structs."""
    kept = F.filter("jobs", lambda j: F.coalesce(j["document_type"], F.lit("")) != VERIFICATION)
    return applicants.withColumn("jobs", kept).where(F.size("jobs") > 0)


def exploded_jobs(applicants: DataFrame) -> DataFrame:
    """One row for each job of an applicant, numbered from 1; missing lists of jobs give none."""
    rows = applicants.select(*(c for c in applicants.columns if c != "jobs"), F.posexplode("jobs").alias("pos", "job"))
    return rows.select("*", (F.col("pos") + 1).alias("job_no"), "job.*").drop("pos", "job")


#: Kinds of identity documents, as marks of the model's type and as words of the type field, in order.
ID_TYPES = (
    ("social_security", ("socialsecurity", "social_security", "ssn")), ("passport", ("passport",)), ("driver_license", ("driverlicense", "driver_license")),
    ("national_id", ("nationalidentitycard", "national_identity_card")), ("residence_permit", ("residencepermit", "residence_permit")), ("visa", ("visa",)),
)
ID_WORDS = (
    ("social_security", ("social security", "seguro social", "ssn")), ("driver_license", ("driver", "licence", "license", "dl")),
    ("passport", ("passport", "pasaporte", "passaporte", "pasaport", "passaporto", "reisepass", "паспорт")),
    ("residence_permit", ("residence", "residency", "permit", "green card", "permanent resident")), ("visa", ("visa",)),
    ("national_id", ("national id", "national identification", "citizen id", "citizenship card")),
    ("foreign_id", ("foreign id", "alien id", "immigration id", "alien registration")), ("state_id", ("id", "identity", "identification")),
)
#: Reports that hold no instrument, and words of instruments.
REPORT_TEXT = r"(?i)DETAILS\s+OF\s+DEPOSITS\s+BY\s+ACCOUNT|DEPOSIT\s+DETAIL\s+REPORT|CAPTURE\s+SEQ|TOTAL\s+OF\s+DEPOSITS\s+SUBMITTED"
INSTRUMENT_TEXT = r"(?i)\b(PAY\s+EXACTLY|PAY\s+TO\s+THE\s+ORDER|MONEY\s*ORDER|CASHIER|WESTERN\s+UNION|MONEYGRAM|INTERMEX|BARRI|FIDELITY|PLS)\b|\$\s*\d"
SPARSE = 500


def id_types(df: DataFrame) -> DataFrame:
    """``id_type`` of identity documents (doc_type, type_field, number): by the model's type, then by words of the type
    field, then by the shape of the number, else ``id``. Case and accents don't count; nulls say nothing.
    Texts with other letters than ASCII's are compared by a collation, which is slower."""

    def holds(c: str, words: tuple[str, ...]) -> Column:
        text = F.coalesce(F.col(c), F.lit(""))
        any_of = lambda t: F.greatest(F.lit(False), *(t.contains(w) for w in words))
        return F.when(text.rlike(r"^\p{ASCII}*$"), any_of(F.lower(text))).otherwise(any_of(F.collate(text, "UNICODE_CI_AI")))

    first = lambda c, rules: F.coalesce(*(F.when(holds(c, words), F.lit(kind)) for kind, words in rules))
    letter = F.when(F.upper(N.stripped(F.col("type_field"))) == "P", F.lit("passport"))
    social = F.when(N.stripped(F.col("number")).rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), F.lit("social_security"))
    return df.withColumn("id_type", F.coalesce(first("doc_type", ID_TYPES), letter, first("type_field", ID_WORDS), social, F.lit("id")))


def maybe_instruments(pages: DataFrame) -> DataFrame:
    """``may_be``: whether an unknown page (text, front_score) is worth the costly reader: it has no text, or it is no
    report and has little text and some front score, a front score of two, or words of an instrument. Nulls are empty and 0."""
    text, score = N.stripped(F.coalesce("text", F.lit(""))), F.coalesce("front_score", F.lit(0))
    fits = ((F.length(text) < SPARSE) & (score >= 1)) | (score >= 2) | text.rlike(INSTRUMENT_TEXT)
    return pages.withColumn("may_be", F.when(text == "", True).when(text.rlike(REPORT_TEXT), False).otherwise(fits))


def grounded(df: DataFrame) -> DataFrame:
    """Invoice fields (vendor_name, customer_name, vendor_phone_number, invoice_id, units) that source_text supports; others become null.

    A name needs 70 % of its words of three letters or more in the text, a phone number its digits among the text's
    digits, an id its letters without blanks or one long part. Units stay that the text holds as written or by their
    digits, so units without digits always stay. Null texts are empty; null and empty fields stay."""
    text = F.lower(F.coalesce("source_text", F.lit("")))
    compact = lambda c: F.regexp_replace(c, r"\s+", "")
    digits = lambda c: F.regexp_replace(c, r"[^0-9]", "")

    def name(c: str) -> Column:
        words = F.filter(F.split(F.lower(F.col(c)), r"\s+"), lambda w: F.length(w) > 2)
        return F.when(10 * F.size(F.filter(words, text.contains)) < 7 * F.size(words), None).otherwise(F.col(c))

    parts = F.filter(F.regexp_extract_all("invoice_id", F.lit(r"(?U)\w+"), 0), lambda w: F.length(w) > 2)
    known = compact(text).contains(F.lower(compact(F.col("invoice_id")))) | F.exists(parts, lambda w: text.contains(F.lower(w)))
    unit = lambda u: F.coalesce(text.contains(F.lower(N.stripped(u))) | text.contains(digits(u)), F.lit(True))
    phone = digits(text).contains(digits(F.col("vendor_phone_number")))
    return df.withColumns({
        "vendor_name": name("vendor_name"), "customer_name": name("customer_name"), "units": F.filter("units", unit),
        "vendor_phone_number": F.when(phone, F.col("vendor_phone_number")), "invoice_id": F.when(known, F.col("invoice_id")),
    })


def field_count(c: Column, kind: T.DataType) -> Column:
    """How many leaves of a nested value aren't null or empty; the expression follows the type, so no row is interpreted."""
    total = lambda values, of: F.coalesce(F.aggregate(values, F.lit(0), lambda n, x: n + field_count(x, of)), F.lit(0))
    if isinstance(kind, T.StructType):
        return sum((field_count(c[f.name], f.dataType) for f in kind.fields), F.lit(0))
    if isinstance(kind, T.ArrayType):
        return total(c, kind.elementType)
    if isinstance(kind, T.MapType):
        return total(F.map_values(c), kind.valueType)
    empty = is_empty(c) if isinstance(kind, T.StringType) else c.isNull()
    return F.when(empty, 0).otherwise(1)


def counted_fields(df: DataFrame, record: str) -> DataFrame:
    """The rows with ``n_fields``, the filled leaves of one nested column; 0 where it is null."""
    return df.withColumn("n_fields", field_count(F.col(record), df.schema[record].dataType))


def extracted_pages(pages: DataFrame) -> DataFrame:
    """``should_extract`` and ``skip_reason`` of pages (kind, front_score, text, multi_front).

    Instruments always; unknown pages by maybe_instruments; blanks, backs and headers never, other kinds by a front
    score of three; a page known to hold several fronts in any case unless it is blank. A null kind is like unknown."""
    kind = F.coalesce("kind", F.lit("unknown"))
    rows = maybe_instruments(pages)
    plain = (
        F.when(kind == "unknown", F.col("may_be"))
        .when(kind.isin("blank", "back", "batch_header"), False)
        .when(kind.isin("instrument", "report_with_instruments"), True)
        .otherwise(F.coalesce("front_score", F.lit(0)) >= 3)
    )
    takes = plain | (F.coalesce("multi_front", F.lit(False)) & (kind != "blank"))
    why = F.when(kind == "unknown", "unknown_keyword_miss").otherwise("page_kind_excluded")
    return rows.withColumn("should_extract", takes).withColumn("skip_reason", F.when(~takes, why)).drop("may_be")


def clean_whitespace(df: DataFrame, fields: tuple[str, ...], items: str | None = None) -> DataFrame:
    """The named texts with each run of blanks and line ends as one blank, none at the ends; also the description of each
    struct of the array ``items``. Nulls stay, and a null array becomes an empty one."""
    tidy = lambda c: F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    out = df.withColumns({f: tidy(F.col(f)) for f in fields})
    if items is None:
        return out
    cleaned = F.transform(items, lambda i: i.withField("description", tidy(i["description"])))
    return out.withColumn(items, F.coalesce(cleaned, F.array().cast(df.schema[items].dataType)))
