"""Texts, files, answers, invoices, incomes and page regions."""

from __future__ import annotations

import functools
import operator
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import last_number, let
from .search import best_by_words, derived_filename

#: Extensions that are taken, and pay periods a year.
EXTENSIONS = ("pdf", "jpg", "jpeg", "png", "heic", "heif")
PERIODS = {"weekly": 52, "bi-weekly": 26, "semi-monthly": 24, "monthly": 12}


def paginate_text(docs: DataFrame, size: int = 2000, most: int | None = None) -> DataFrame:
    """Numbered pages of ``size`` characters of the trimmed text, up to ``most`` if given: lengths and digests."""
    text = F.trim("text")
    n = F.ceil(F.length(text) / size).cast("int")
    n = n if most is None else F.least(F.lit(most), n)
    pages = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(text, (i - 1) * size + 1, F.lit(size))))
    rows = docs.where(F.length(text) > 0).select("doc_id", F.posexplode(pages).alias("pos", "page"))
    return rows.select("doc_id", (F.col("pos") + 1).alias("page_number"), F.length("page").alias("chars"), F.md5("page").alias("page_md5"))


def chunk_text(docs: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """Overlapping chunks with their numbers."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("text")), F.lit(size - overlap))
    rows = docs.where("length(text) > 0").select("doc_id", "text", F.posexplode(starts).alias("pos", "start"))
    return rows.select("doc_id", (F.col("pos") + 1).alias("chunk_number"), F.md5(F.substring(F.col("text"), F.col("start"), F.lit(size))).alias("chunk_md5"))


def insufficient_text(docs: DataFrame, least: int = 50) -> DataFrame:
    return docs.where(F.length(F.trim(F.coalesce("text", F.lit("")))) < least).select("doc_id", F.length(F.trim(F.coalesce("text", F.lit("")))).alias("chars"))


def ingest_files(files: DataFrame, most: int = 15 * 1024 * 1024) -> DataFrame:
    """A status for each file: ok, or why it is rejected."""
    extension = F.lower(F.regexp_extract(F.coalesce("filename", F.lit("")), r"\.([A-Za-z0-9]+)$", 1))
    status = F.when(F.trim(F.coalesce("filename", F.lit(""))) == "", "no_name").when(~extension.isin(*EXTENSIONS), "extension").when(F.coalesce("size_bytes", F.lit(0)) == 0, "empty").when(F.col("size_bytes") > most, "too_large").otherwise("ok")
    return files.select("doc_id", "filename", status.alias("status"))


def _surely_broken(c: Column) -> Column:
    """Whether a text without escapes can't be JSON: outside of its strings a comma before a closing bracket, strings side by side, or brackets that don't pair up.

    The parser finds that too, but by an error that costs more than all the rest."""
    count = lambda rest, signs: F.length(F.translate(rest, signs, ""))
    broken = lambda rest: rest.rlike(r',\s*[}\]]|"\s*"') | (count(rest, "{[") != count(rest, "}]"))
    return ~c.contains("\\") & let(F.regexp_replace(c, '"[^"]*"', '"'), broken)


def parse_answers(responses: DataFrame, fields: dict[str, str] | None = None, mode: str = "any") -> DataFrame:
    """JSON answers out of code fences, strictly: one field a column, or ``error`` with the answer's first 500 characters and null fields.

    Tried in order: the answer as it stands; without commas before a closing bracket; and the outermost {...} of it, as it stands and without such commas. mode "fences" leaves the
    outermost brackets out, mode "outermost" the commas, "any" tries all. Fields that are absent or of another type are null without error; null answers are errors with a null text."""
    fields = fields or {"vendor_name": "string", "total": "int"}
    bare = F.trim(F.regexp_replace("body", r"```(json)?", ""))
    outer = lambda c: F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    commas = lambda c: F.regexp_replace(c, r",\s*([}\]])", "$1")
    mended, outermost = mode in ("fences", "any"), mode in ("outermost", "any")

    def strict(c: Column) -> Column:
        """The one object that c holds. What follows an object is only read inside of a list, so it is parsed as one."""
        v = F.try_parse_json(F.when(c.rlike(r"(?s)^\s*\{.*\}\s*$") & ~_surely_broken(c), F.concat(F.lit("["), c, F.lit("]"))))
        return let(v, lambda v: F.when(F.try_variant_get(v, "$[1]", "variant").isNull(), v))

    def without_commas(c: Column) -> list[Column]:
        # a text that has none was tried as it stands
        return [let(commas(c), lambda x: F.when(x != c, strict(x)))] if mended else []

    def tried(c: Column) -> Column:
        inner = [let(outer(c), lambda o: F.when(o != c, F.coalesce(strict(o), *without_commas(o))))] if outermost else []
        return F.coalesce(strict(c), *without_commas(c), *inner)

    rows = responses.withColumn("parsed", let(bare, tried))
    found = [F.try_variant_get("parsed", f"$[0].{name}", kind).alias(name) for name, kind in fields.items()]
    return rows.select("doc_id", "response_no", *found, F.when(F.col("parsed").isNull(), F.coalesce(F.substring("body", 1, 500), F.lit(""))).alias("error"))


def group_invoices(lines: DataFrame) -> DataFrame:
    """Flat items by invoice and property, null ones together: first position, items in order and total."""
    items = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "description"))), lambda x: x["description"]), "|")
    return lines.groupBy("invoice_no", "property_name").agg(F.min("position").alias("first_position"), F.count(F.lit(1)).alias("items"), items.alias("descriptions"), F.sum("total_price").cast("decimal(14,2)").alias("total"))


def item_ids(lines: DataFrame) -> DataFrame:
    """Company, invoice and item numbers that run through all files in order of company, invoice and position.

    Rows are sorted by range; each partition's numbers begin where those of the ones before end, so no task sees all rows."""
    order = ("company_name", "invoice_no", "position")
    rows = lines.select(*order).repartitionByRange(*order[:2]).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    own = Window.partitionBy("part").orderBy(*order)
    first = lambda *keys: (F.row_number().over(Window.partitionBy("part", *keys).orderBy(*order)) == 1).cast("long")
    rows = rows.withColumns({"item": F.row_number().over(own), "invoice": F.dense_rank().over(Window.partitionBy("part").orderBy(*order[:2])), "company": F.dense_rank().over(Window.partitionBy("part").orderBy("company_name"))})
    # one row a partition: how many numbers it uses; a company may go on in the next one
    sizes = rows.groupBy("part").agg(F.count(F.lit(1)).alias("items"), F.max("invoice").alias("invoices"), F.max("company").alias("companies"), F.min("company_name").alias("low"), F.max("company_name").alias("high"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    goes_on = F.coalesce((F.lag("high").over(Window.orderBy("part")) == F.col("low")).cast("long"), F.lit(0))
    sizes = sizes.withColumn("goes_on", goes_on).withColumn("fresh", F.col("companies") - F.col("goes_on"))
    base = sizes.select(
        "part", F.coalesce(F.sum("items").over(before), F.lit(0)).alias("item0"), F.coalesce(F.sum("invoices").over(before), F.lit(0)).alias("invoice0"),
        (F.coalesce(F.sum("fresh").over(before), F.lit(0)) - F.col("goes_on")).alias("company0"),
    )
    out = rows.join(F.broadcast(base), "part")  # a row for each partition
    return out.select(*order, *((F.col(n) + F.col(f"{n}0")).alias(f"{n}_id") for n in ("company", "invoice", "item")))


def monthly_income(checks: DataFrame, n: int = 3) -> DataFrame:
    """From each user's latest checks, amounts read out of their text: the mean times the periods of a year over twelve."""
    order = Window.partitionBy("user_id").orderBy(F.col("pay_date").desc(), F.col("event_id").desc())
    last = checks.withColumn("r", F.row_number().over(order)).where(F.col("r") <= n).withColumn("paid", last_number(F.col("check_text")))
    periods = F.lit(0)
    for name, value in PERIODS.items():
        periods = F.when(F.col("pay_frequency") == name, value).otherwise(periods)
    by = last.groupBy("user_id", "pay_frequency").agg(F.sum("paid").alias("paid"), F.count("paid").alias("checks"))
    cents = F.floor(F.col("paid").cast("double") * 100 * periods / (12 * F.col("checks")) + 0.5).cast("long")
    return by.select("user_id", "checks", F.col("paid").cast("decimal(14,2)").alias("paid"), cents.alias("monthly_cents"))


def pay_gaps(checks: DataFrame) -> DataFrame:
    """Daily totals of each user and the days since the pay day before."""
    days = checks.groupBy("user_id", "pay_date").agg(F.sum("amount").cast("decimal(14,2)").alias("day_total"))
    before = F.lag("pay_date").over(Window.partitionBy("user_id").orderBy("pay_date"))
    return days.withColumn("gap_days", F.datediff("pay_date", before))


def overlapping_regions(regions: DataFrame, share: float = 0.42) -> DataFrame:
    """Pairs of a page's regions whose common area is at least a share of their union."""
    names = ("region_idx", "x0", "y0", "x1", "y1")
    a, b = (regions.select("page_id", *(F.col(n).alias(f"{n}_{s}") for n in names)) for s in "ab")
    pairs = a.join(b, "page_id").where("region_idx_a < region_idx_b AND x0_a < x1_b AND x0_b < x1_a AND y0_a < y1_b AND y0_b < y1_a")
    common = (F.least("x1_a", "x1_b") - F.greatest("x0_a", "x0_b")) * (F.least("y1_a", "y1_b") - F.greatest("y0_a", "y0_b"))
    area = lambda s: (F.col(f"x1_{s}") - F.col(f"x0_{s}")) * (F.col(f"y1_{s}") - F.col(f"y0_{s}"))
    pairs = pairs.withColumn("common", common).withColumn("whole", area("a") + area("b") - common)
    return pairs.where(F.col("common") >= share * F.col("whole")).select("page_id", "region_idx_a", "region_idx_b", "common", "whole")


def region_ids(regions: DataFrame) -> DataFrame:
    """Ids that depend on page and box only."""
    box = F.concat_ws(",", *(F.col(c).cast("string") for c in ("page_id", "x0", "y0", "x1", "y1")))
    return regions.select("page_id", "region_idx", F.concat(F.lit("REG-"), F.col("page_id").cast("string"), F.lit("-"), F.substring(F.md5(box), 1, 10)).alias("region_id"))


def derived_filenames(hits: DataFrame) -> DataFrame:
    """The name of each hit (page_id, title, filepath, parent_id); see ``derived_filename``."""
    return hits.select("page_id", derived_filename(F.col("title"), F.col("filepath"), F.col("parent_id")).alias("filename"))


def keyword_rank(queries: DataFrame, docs: DataFrame, k: int = 5) -> DataFrame:
    """BM25 over whole texts for each query's distinct words. queries: (item_id, text); docs: (doc_id, text); see ``best_by_words``."""
    found = best_by_words(queries.select(F.col("item_id").alias("query_id"), "text"), docs, k)
    return found.select(F.col("query_id").alias("item_id"), "rank", "doc_id", "score")


#: What makes a line of a scan worth keeping, without regard to case; the lines that stand in for none, and the budget.
FOCUS = (
    r"PAY\s+EXACTLY", r"PAY\s+TO\s+THE\s+ORDER", r"PAYABLE\s+TO", r"PURCHASER|REMITTER|DRAWER|SENDER", r"MONEY\s*ORDER|CASHIER|CHECK\s+NO|SERIAL",
    r"WESTERN\s+UNION|MONEYGRAM|INTERMEX|FIDELITY|BARRI|DOLEX|PLS|CHASE|JPMORGAN|WELLS\s+FARGO|PROSPERITY", r"\$\s*\d|\*+\s*\$?\d", r"\b\d{2}[-\s]?\d{7,12}\b|\b\d{9,14}\b",
    r"\b\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}\b|\b20\d{2}-\d{2}-\d{2}\b", r"APT|APARTMENT|UNIT|SUITE|#\s*\d", r"BATCH\s*#|BATCH\s+AMOUNT|ACTUAL\s+ITEMS|TOTALS?\b|DEPOSIT\s+ACCOUNT|TRANSACTION\s+ID", r"MICR|ROUTING|ACCOUNT",
)
STAND_IN_LINES, FOCUS_CHARS = 35, 2600


def _focused(line: Column) -> Column:
    """Whether a line has one of FOCUS. Plain words are looked for as such, and other patterns are tried where their longest word or a digit is there."""
    upper = F.translate(line, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    parts = "|".join(FOCUS).split("|")
    # the letters that a pattern can't do without: no escapes, sets and optional characters
    words = {p: max(re.findall("[A-Z]+", re.sub(r"\\.|\[[^]]*\]|.[?*]", " ", p)), key=len, default="") for p in parts}

    def told(u: Column) -> Column:
        plain = [u.contains(p) for p in parts if words[p] == p]
        worded = [u.contains(w) & u.rlike(p) for p, w in words.items() if w and w != p]
        return functools.reduce(operator.or_, [*plain, *worded, u.rlike("[0-9]") & u.rlike("|".join(p for p in parts if not words[p]))])

    return let(upper, told)


def focus_context(pages: DataFrame, most: int = FOCUS_CHARS) -> DataFrame:
    """The lines of each page that say something of a payment, each with its neighbours, up to ``most`` characters: (doc_id, lines, text).

    pages: (doc_id, text). Lines are cleaned of outer white space and runs of blanks; those of one character don't count. A page without such a line gives its first
    STAND_IN_LINES. Of lines that are equal in their letters and digits the first stays; lines without any go. A line that would pass the budget ends the text, unless all fit.
    Null and empty texts give an empty text; repeated rows of a page are one page, and of different texts with one id the lines come together."""
    cut = F.split(F.coalesce("text", F.lit("")), "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]")
    lines = F.filter(F.transform(cut, lambda x: F.regexp_replace(F.regexp_replace(x, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""), "[ \t]{2,}|\t", " ")), lambda x: F.length(x) >= 2)
    # outer, as otherwise lines would also be made before, to see whether there are any
    rows = pages.select("doc_id", "text").distinct().select("doc_id", F.posexplode_outer(lines).alias("pos", "line")).where("line IS NOT NULL")
    by = Window.partitionBy("doc_id").orderBy("pos")
    page = Window.partitionBy("doc_id")
    rows = rows.withColumn("hit", _focused(F.col("line")))
    near = F.col("hit") | F.lag("hit", 1, False).over(by) | F.lead("hit", 1, False).over(by)
    rows = rows.withColumns({"near": near, "any_hit": F.max("hit").over(page), "nth": F.row_number().over(by)})
    kept = rows.where("near OR (NOT any_hit AND nth <= " + str(STAND_IN_LINES) + ")").withColumn("same", F.upper(F.regexp_replace("line", r"[^\p{L}\p{N}_]+", ""))).where("same <> ''")
    once = kept.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id", "same").orderBy("pos"))).where("copy = 1")
    size = F.length("line") + 1
    once = once.withColumns({"upto": F.sum(size).over(by.rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum(size).over(page)})
    fit = once.where((F.col("upto") <= most) | (F.col("all") - 1 <= most))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"])
    texts = fit.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.array_join(listed, "\n").alias("text"))
    return pages.select("doc_id").distinct().join(texts, "doc_id", "left").select("doc_id", F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce("text", F.lit("")).alias("text"))
