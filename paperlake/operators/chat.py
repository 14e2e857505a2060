"""Search results, conversations, citations and session events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import MARKER, strip_citations


def cap_per_parent(hits: DataFrame, per_parent: int = 7, top: int = 15) -> DataFrame:
    """Ranked hits with text: at most so many of a parent, then the first of all. hits: (chunk_id, parent_id, content, points)."""
    order = (F.col("points").desc(), F.col("chunk_id"))
    rows = hits.where("content IS NOT NULL AND content <> ''")
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("parent_id").orderBy(*order))).where(F.col("r") <= per_parent)
    best = rows.orderBy(*order).limit(top)  # the operator's own limit: a bounded report
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select("rank", "chunk_id", "parent_id", "points")


def recent_history(turns: DataFrame, most: int = 10, chars: int = 3000, per: int = 600) -> DataFrame:
    """The last turns of each session, responses cut, newest first until the budget overflows."""
    newest = Window.partitionBy("session_id").orderBy(F.col("turn").desc())
    rows = turns.withColumn("r", F.row_number().over(newest)).where(F.col("r") <= most)
    rows = rows.withColumn("response", F.substring("response", 1, per))
    rows = rows.withColumn("used", F.sum(F.length("query") + F.length("response")).over(newest.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where(F.col("used") <= chars).select("session_id", "turn", "used", F.length("response").alias("kept_chars"))


def cited_numbers(answers: DataFrame) -> DataFrame:
    """One row for each number an answer cites, grouped markers opened up."""
    marks = F.explode(F.regexp_extract_all("text", F.lit(MARKER), F.lit(1)))
    rows = answers.select("answer_id", marks.alias("mark"))
    numbers = F.transform(F.split("mark", "[;,]"), lambda x: F.regexp_extract(x, "[0-9]+", 0).cast("int"))
    return rows.select("answer_id", F.explode(numbers).alias("doc_num")).distinct()


def renumbered_citations(citations: DataFrame) -> DataFrame:
    """New numbers 1.. in the order of the old ones, for each answer."""
    return citations.withColumn("new_num", F.dense_rank().over(Window.partitionBy("answer_id").orderBy("doc_num")))


def plain_answers(answers: DataFrame) -> DataFrame:
    """Answers as they enter the history: without markers."""
    return answers.select("answer_id", strip_citations(F.col("text")).alias("text"))


def log_rows(turns: DataFrame) -> DataFrame:
    """A user row and an assistant row for each exchange."""
    pair = F.array(
        F.struct((F.col("turn") * 2).alias("seq"), F.lit("user").alias("role"), F.length("query").alias("chars")),
        F.struct((F.col("turn") * 2 + 1).alias("seq"), F.lit("assistant").alias("role"), F.length("response").alias("chars")),
    )
    return turns.select("session_id", F.inline(pair))


def rate_limited(events: DataFrame, per_minute: int = 3) -> DataFrame:
    """Events beyond the limit of their action, session and minute (aligned windows; the anchored form is a stream)."""
    minute = F.date_trunc("minute", "ts")
    order = Window.partitionBy("session_id", "action", minute).orderBy("ts", "event_id")
    return events.withColumn("n", F.row_number().over(order)).where(F.col("n") > per_minute).select("event_id", "session_id", "action", "n")


def upload_quota(events: DataFrame, most: int = 5) -> DataFrame:
    """Uploads left in each session."""
    used = events.groupBy("session_id").agg(F.count_if(F.col("action") == "upload").alias("uploads"))
    return used.withColumn("remaining", F.greatest(F.lit(0), most - F.col("uploads")))


def session_spans(events: DataFrame, gap: str = "2 hours") -> DataFrame:
    """Sessions that end when nothing happens for the gap: their number and events by session key."""
    spans = events.groupBy("session_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("events"))
    return spans.groupBy("session_id").agg(F.count(F.lit(1)).alias("spans"), F.max("events").alias("most_events"))


def session_touch(events: DataFrame) -> DataFrame:
    """First and last touch of each session."""
    return events.groupBy("session_id").agg(F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"))


#: One citation, a group of several in one bracket, the template's own words in place of numbers, and the signs of uploaded and other sources.
ONE, GROUP = r"\[(\d+)(?:\s*→\s*Page\s*(\d+))?\]", r"\[((?:\s*\d+\s*(?:→\s*Page\s*\d+)?\s*[;,]\s*)+\s*\d+\s*(?:→\s*Page\s*\d+)?\s*)\]"
BLANK_PAGE, GIVEN_PAGE = r"\[[Nn](?:\s*→\s*Page\s*[Xx])?\]", r"\[[Nn]\s*→\s*Page\s*(\d+)\]"
UPLOADED_SIGN, OTHER_SIGN = "📤", "📁"


def _rewritten(text: Column, pattern: str, how: Callable[[Column], Column]) -> Column:
    """The text with how(match) in place of each match of the pattern."""
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), how)
    return F.array_join(F.zip_with(F.split(text, pattern, -1), found, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def cited_answers(answers: DataFrame, documents: DataFrame) -> DataFrame:
    """Answers as they are shown: (answer_id, text, sources), citations numbered from 1 by file, in the order of the files' first cited document.

    answers: (answer_id, text); documents: (answer_id, doc_num, filename, kind, first_page). The prompt's own example in place of a citation stands for the first uploaded document, else the first, and
    its first page (1 if unknown); grouped citations are taken apart; numbers of no document stay as they are, as all do where an answer has no documents; pages stay. Bold marks go. sources: each cited
    file's number, name with its sign, and kind. Null texts are empty. An answer's documents, a prompt's few, meet in one row."""
    number = F.struct(F.col("doc_num").cast("long").alias("n"), "filename", "kind", "first_page")
    docs = documents.groupBy("answer_id").agg(F.array_sort(F.collect_list(number)).alias("docs"))
    rows = answers.select("answer_id", F.coalesce("text", F.lit("")).alias("text")).join(docs, "answer_id", "left")
    first = F.coalesce(F.get(F.filter("docs", lambda d: d["kind"] == "uploaded"), 0), F.get("docs", 0))
    rows = rows.withColumn("stand_in", F.concat(F.lit("["), first["n"].cast("string"), F.lit(" → Page ")))
    page = F.concat("stand_in", F.coalesce(first["first_page"], F.lit(1)).cast("string"), F.lit("]"))
    plain = F.regexp_replace(F.regexp_replace("text", F.lit(BLANK_PAGE), page), F.lit(GIVEN_PAGE), F.concat("stand_in", F.lit("$1]")))
    rows = rows.withColumn("text", F.coalesce(F.when(F.col("docs").isNotNull(), plain), F.col("text")))
    apart = lambda g: F.array_join(F.transform(F.split(F.regexp_replace(g, r"[\[\]]", ""), "[;,]"), lambda x: F.concat(F.lit("["), F.trim(x), F.lit("]"))), " ")
    rows = rows.withColumn("text", _rewritten(F.col("text"), GROUP, apart))
    cited = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(ONE), F.lit(1)), lambda x: x.try_cast("long"))))
    of = lambda n: F.get(F.filter("docs", lambda d: d["n"] == n), 0)
    rows = rows.withColumn("known", F.filter(F.transform(cited, of), lambda d: d.isNotNull()))
    rows = rows.withColumn("files", F.array_distinct(F.transform("known", lambda d: d["filename"])))

    def renumbered(m: Column) -> Column:
        new = F.array_position("files", of(F.regexp_extract(m, ONE, 1).try_cast("long"))["filename"])
        kept = F.regexp_extract(m, ONE, 2)
        return F.when(new > 0, F.concat(F.lit("["), new.cast("string"), F.when(kept != "", F.concat(F.lit(" → Page "), kept)).otherwise(""), F.lit("]"))).otherwise(m)

    kind = lambda f: F.get(F.filter("known", lambda d: d["filename"] == f), 0)["kind"]
    sign = lambda f: F.when(kind(f) == "uploaded", UPLOADED_SIGN).otherwise(OTHER_SIGN)
    source = lambda f, i: F.struct((i + 1).alias("number"), F.concat(sign(f), F.lit(" "), f).alias("filename"), kind(f).alias("kind"))
    bare = F.regexp_replace(_rewritten(F.col("text"), ONE, renumbered), r"\*\*", "")
    return rows.select("answer_id", F.regexp_replace(bare, r"^\s+|\s+$", "").alias("text"), F.coalesce(F.transform("files", source), F.array().cast("array<struct<number:int,filename:string,kind:string>>")).alias("sources"))
