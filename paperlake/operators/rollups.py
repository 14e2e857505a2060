"""Aggregates and joins of documents, readings, usage, contexts and sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import is_empty

#: Pages that are read of each type of document, and budgets of tokens and characters.
PAGE_LIMITS = {"income": 8, "insurance": 10, "vendor": 3, "id": 2}
TOKEN_BUDGET, RECOVERY_SHARE, COMPANY_CHARS = 120_000, 0.40, 10_000


def vital_status(records: DataFrame, key: str, vitals: tuple[str, ...]) -> DataFrame:
    """For each document and vital field: whether all, and whether any, of its records have it; and whether none has any at all."""
    has = {v: ~is_empty(F.col(v)) for v in vitals}
    aggs = [f(has[v]).alias(f"{v}_{n}") for v in vitals for f, n in ((F.bool_and, "all"), (F.bool_or, "any"))]
    none: Column = F.lit(True)
    for v in vitals:
        none = none & ~has[v]
    return records.groupBy(key).agg(*aggs, F.bool_and(none).alias("not_a_document"))


def majority_amounts(readings: DataFrame, least: float = 0.72, slack: int = 1) -> DataFrame:
    """The amount on which a strict majority of an item's readings agree, to the cent; the earliest such reading's,
    of equally early ones the smaller.

    readings: (item, reading_no, amount, confidence). Unsure readings and those without an amount count among all
    but don't agree with any. Null where no amount has a majority. Counted by a range of cents, not by pairs."""
    cents = F.when(F.col("confidence") >= least, F.round(F.col("amount") * 100).cast("long"))
    rows = readings.select("item", "reading_no", "amount", cents.alias("cents"))
    near = Window.partitionBy("item").orderBy("cents").rangeBetween(-slack, slack)
    rows = rows.withColumn("agree", F.when(F.col("cents").isNotNull(), F.count("cents").over(near)))
    rows = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("item")))
    first = F.min_by("amount", F.when(F.col("agree") * 2 > F.col("n"), F.struct("reading_no", "amount")))
    return rows.groupBy("item").agg(F.count(F.lit(1)).alias("readings"), first.alias("amount"))


def usage_rollup(calls: DataFrame, budget: int = TOKEN_BUDGET, share: float = RECOVERY_SHARE) -> DataFrame:
    """Calls and tokens of each document, in all and by phase; whether it is over budget, and recovery over its share.

    calls: (doc_id, phase, prompt_tokens, completion_tokens). Aggregated by phase first, so a document's phases are few."""
    tokens = F.col("prompt_tokens") + F.col("completion_tokens")
    by = calls.groupBy("doc_id", "phase").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("prompt_tokens").alias("prompt"), F.sum("completion_tokens").alias("completion"), F.sum(tokens).alias("tokens")
    )
    phases = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("phase", "tokens"))), lambda x: F.concat_ws(":", x["phase"], x["tokens"].cast("string"))), ",")
    recovery = F.sum(F.when(F.col("phase").contains("recovery"), F.col("tokens")).otherwise(0))
    return by.groupBy("doc_id").agg(
        F.sum("calls").alias("calls"), F.sum("prompt").alias("prompt_tokens"), F.sum("completion").alias("completion_tokens"), F.sum("tokens").alias("total_tokens"),
        phases.alias("by_phase"), (F.sum("tokens") > budget).alias("over_budget"), (recovery > budget * share).alias("recovery_over_share"),
    )


def prompt_stats(contexts: DataFrame, most: int = COMPANY_CHARS) -> DataFrame:
    """Characters of each session's context by type of source, each company text up to ``most``, and some four characters a token.

    contexts: (session_id, source_type, content). Null texts have no characters."""
    chars = F.coalesce(F.length("content"), F.lit(0))
    of = lambda kind, n: F.sum(F.when(F.col("source_type") == kind, n).otherwise(0))
    sums = contexts.groupBy("session_id").agg(F.sum(chars).alias("total_chars"), of("uploaded", chars).alias("uploaded_chars"), of("company", F.least(chars, F.lit(most))).alias("company_chars"))
    return sums.withColumn("est_tokens", F.floor(F.col("total_chars") / 4))


def first_sources(sources: DataFrame) -> DataFrame:
    """Of each answer the first source of every file, of equal positions the smaller kind; sources without a name are one file. sources: (answer_id, position, filename, kind)."""
    name = F.coalesce("filename", F.lit("Unknown"))
    return sources.groupBy("answer_id", name.alias("filename")).agg(F.min("position").alias("position"), F.min_by("kind", F.struct("position", "kind")).alias("kind"))


def source_stats(sources: DataFrame) -> DataFrame:
    """How often each file is cited, by type, and in how many answers."""
    # answers are counted after a first step by answer, so that a file cited everywhere isn't one group of rows
    by = sources.groupBy("filename", "kind", "answer_id").agg(F.count(F.lit(1)).alias("n"))
    return by.groupBy("filename", "kind").agg(F.sum("n").alias("citations"), F.count(F.lit(1)).alias("answers"))


def resolved_citations(citations: DataFrame, documents: DataFrame) -> DataFrame:
    """Cited numbers of an answer with their file and new number: files count from 1 in order of their first number.

    citations: (answer_id, doc_num); documents: (answer_id, doc_num, filename). Unknown numbers keep null, as they stay as written."""
    known = citations.join(documents, ["answer_id", "doc_num"], "left")
    first = F.min(F.when(F.col("filename").isNotNull(), F.col("doc_num"))).over(Window.partitionBy("answer_id", "filename"))
    known = known.withColumn("first", first)
    rank = F.dense_rank().over(Window.partitionBy("answer_id").orderBy(F.col("first").asc_nulls_last()))
    return known.select("answer_id", "doc_num", "filename", F.when(F.col("filename").isNotNull(), rank).alias("new_num"))


def reassembled_tables(cells: DataFrame) -> DataFrame:
    """Each table as text: a heading, then rows in order with their cells in order; of cells at one place the last counts,
    of equally late ones the greater text.

    cells: (doc_id, table_idx, row_index, column_index, cell_no, content). Two steps of grouping, by row and by table."""
    place = ["doc_id", "table_idx", "row_index", "column_index"]
    once = cells.groupBy(*place).agg(F.trim(F.coalesce(F.max_by("content", F.struct("cell_no", "content")), F.lit(""))).alias("content"))
    in_order = lambda key, text: F.transform(F.array_sort(F.collect_list(F.struct(key, text))), lambda x: x[text])
    lines = once.groupBy(*place[:3]).agg(F.array_join(in_order("column_index", "content"), " | ").alias("line"))
    tables = lines.groupBy(*place[:2]).agg(in_order("row_index", "line").alias("lines"))
    heading = F.concat(F.lit("\n--- TABLE "), (F.col("table_idx") + 1).cast("string"), F.lit(" ---\n"))
    return tables.select("doc_id", "table_idx", F.concat(heading, F.array_join("lines", "\n"), F.lit("\n")).alias("text"))


def limited_pages(pages: DataFrame, limits: dict[str, int] = PAGE_LIMITS) -> DataFrame:
    """The pages that are read of each document: up to its type's limit; images and other types have none.

    pages: (document_type, is_pdf, page_number). Only ids differ by file: their images aren't cut."""
    most = F.lit(None).cast("int")
    for kind, n in limits.items():
        most = F.when(F.col("document_type") == kind, F.when(F.col("is_pdf") | F.lit(kind != "id"), n)).otherwise(most)
    return pages.where(most.isNull() | (F.col("page_number") <= most))


def document_texts(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """The whole text where there is one, else the pages' texts with a blank line between; an error where there is neither.

    docs: (doc_id, content); pages: (doc_id, page_number, text). Only pages that are needed are gathered."""
    whole = F.when(F.col("content") != "", F.col("content"))
    bare = docs.where(whole.isNull()).select("doc_id")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("page_number", "text"))), lambda x: x["text"])
    joined = pages.where("text <> ''").join(bare, "doc_id", "left_semi").groupBy("doc_id").agg(F.array_join(texts, "\n\n").alias("joined"))
    rows = docs.join(joined, "doc_id", "left").withColumn("text", F.coalesce(whole, "joined"))
    return rows.select("doc_id", "text", F.when(F.col("text").isNull(), "no text").alias("error"))


def request_keys(requests: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """The requests with ``request_key``, the SHA-256 of their fields as JSON with sorted names; nulls are part of it."""
    body = F.to_json(F.struct(*(F.col(f) for f in sorted(fields))), {"ignoreNullFields": "false"})
    return requests.withColumn("request_key", F.sha2(body, 256))


def pending_requests(requests: DataFrame, cache: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Each distinct request that the cache (request_key) doesn't answer, with the smallest id that asks and how many do.

    requests: (request_id, *fields). Equal requests are counted before the join, so a hot one is one row there."""
    asked = request_keys(requests, fields).groupBy("request_key").agg(F.min("request_id").alias("request_id"), F.count(F.lit(1)).alias("asked"))
    return asked.join(cache.select("request_key").distinct(), "request_key", "left_anti")


def combined_rows(reads: DataFrame, readers: tuple[str, ...] = ("text", "page", "crop")) -> DataFrame:
    """Rows of a page that several readers found, each once by serial (else account) and amount; the first reader's stays.

    reads: (page_id, row_no, reader, serial_number, account_number, amount_numeric). Rows with neither a number nor an
    amount are dropped; other readers come last. Equal rows of a reader: the smallest row_no stays."""
    full = lambda c: F.when(F.col(c) != "", F.col(c))
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, readers)), F.col("reader")), F.lit(0)), F.lit(len(readers) + 1))
    rows = reads.withColumn("row_key", F.coalesce(full("serial_number"), full("account_number"), F.lit("")))
    rows = rows.withColumn("amount", F.round(F.coalesce("amount_numeric", F.lit(0)), 2).cast(reads.schema["amount_numeric"].dataType)).where("row_key <> '' OR amount <> 0")
    first = F.min_by(F.struct("row_no", "reader"), F.struct(rank, F.col("row_no"))).alias("first")
    return rows.groupBy("page_id", "row_key", "amount").agg(first).select("page_id", "row_key", "amount", "first.*")


def upload_pages(uploads: DataFrame) -> DataFrame:
    """One row for each page of an upload (upload_id, page_texts); pages without a number get their position, without a text an empty one.

    Uploads whose page_texts is null or empty have no rows."""
    pages = uploads.select("upload_id", F.posexplode("page_texts").alias("position", "page"))
    number = F.coalesce(F.col("page.page_number"), F.col("position") + 1).cast("int")
    return pages.select("upload_id", number.alias("page_number"), F.coalesce("page.text", F.lit("")).alias("page_text"))


def upload_rows(uploads: DataFrame) -> DataFrame:
    """One row for each upload (upload_id, extracted_text, page_texts): its pages and the length of its text, 0 for null."""
    count = F.when(F.col("page_texts").isNull(), 0).otherwise(F.size("page_texts"))
    return uploads.select("upload_id", count.alias("page_count"), F.coalesce(F.length("extracted_text"), F.lit(0)).alias("text_length"))


#: The orientations in which a listing is read, in order, and the weights of what speaks for one.
ORIENTATIONS = (0, 180, 90, 270)
EACH_ROW, MISSED_ROW, ALL_ROWS, TOTAL_AGREES, TOTAL_NEAR = 100.0, 500.0, 1000.0, 400.0, 75.0


def best_rotation(readings: DataFrame, controls: DataFrame) -> DataFrame:
    """The orientation in which a page's listing was read best: (page_id, orientation, items, total).

    readings: (page_id, orientation, row_no, amount), a row for each listed item read in one of ORIENTATIONS; controls: (page_id, expected_count, expected_total), either may be null. The upright reading stands
    if it has the expected number of items and, if one is expected, the total to 1.00. Else the reading with the highest score counts, the first in order of equal ones: items count, those missed or too many count against it, the
    expected number counts for it, so does a total that agrees or is within 250, a further one counts against it, and larger sums count a little. Null amounts are 0; pages without readings give no row."""
    turn = F.array_position(F.array(*map(F.lit, ORIENTATIONS)), F.col("orientation"))
    by = readings.groupBy("page_id", "orientation").agg(F.count(F.lit(1)).alias("items"), F.coalesce(F.sum("amount"), F.lit(0)).cast("decimal(14,2)").alias("total")).withColumn("turn", turn).where("turn > 0")
    rows = by.join(controls, "page_id", "left")
    counted, summed = F.coalesce(F.col("expected_count") > 0, F.lit(False)), F.coalesce(F.col("expected_total") != 0, F.lit(False))
    exact = counted & (F.col("items") == F.col("expected_count"))
    off = F.abs(F.col("total") - F.col("expected_total")).cast("double")
    near = F.when(off <= 1, TOTAL_AGREES).when(off <= 250, TOTAL_NEAR).otherwise(-F.least(off, F.lit(1000.0)) / 25)
    score = F.col("items") * EACH_ROW + F.when(counted, F.abs(F.col("items") - F.col("expected_count")) * -MISSED_ROW).otherwise(0.0) + F.when(exact, ALL_ROWS).otherwise(0.0)
    score = score + F.when(summed, near).otherwise(0.0) + F.col("total").cast("double") / 1000
    stands = (F.col("turn") == 1) & exact & (~summed | (off <= 1))
    order = F.struct((~stands).alias("a"), (-score).alias("b"), F.col("turn").alias("c"))
    return rows.groupBy("page_id").agg(F.min_by(F.struct("orientation", "items", "total"), order).alias("best")).select("page_id", "best.*")
