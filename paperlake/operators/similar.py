"""Fuzzy matching of short texts, and merging of observations that show one instrument."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..crowds import by_crowd
from ..folds import fold
from ..functions import is_empty
from ..functions import normalise as N
from ..tables import written

#: The ratio from which two readings are alike, and scores of a payee that holds an alias or is like a word of it.
ALIKE, HELD, WORD_ALIKE, WORD_SCORE = 0.82, 0.95, 0.80, 0.88


def with_ratio(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """pairs with ``ratio``: twice the characters in matching blocks over all characters, blocks found longest first, leftmost of equal ones.

    The ratio depends on which side is left. It is computed once for each distinct pair of texts, in Arrow batches; null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = SequenceMatcher(None)
        for batch in batches:
            out = []
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                matcher.set_seqs(a, b)
                out.append(matcher.ratio())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], [left, right, "ratio"])

    texts = pairs.select(left, right).dropna().distinct()
    # sorted, so that a right text, which the matcher prepares, isn't prepared anew for each left one
    rated = texts.repartition(right).sortWithinPartitions(right).mapInArrow(run, f"`{left}` string, `{right}` string, ratio double")
    return pairs.join(rated, [left, right], "left")


def _rated(pairs: DataFrame, *sides: tuple[str, str]) -> DataFrame:
    """pairs whose texts (left, right) of some side have a ratio of ALIKE or more, or that are ``sure``; rated where they are, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = SequenceMatcher(None)

        def alike(a: str | None, b: str | None) -> bool:
            if not a or not b:
                return False
            if a == b:
                return True
            matcher.set_seqs(a, b)
            return matcher.real_quick_ratio() >= ALIKE and matcher.quick_ratio() >= ALIKE and matcher.ratio() >= ALIKE

        for batch in batches:
            texts = [(batch.column(a).to_pylist(), batch.column(b).to_pylist()) for a, b in sides]
            sure = batch.column("sure").to_pylist()
            keep = [ok or any(alike(left[i], right[i]) for left, right in texts) for i, ok in enumerate(sure)]
            yield batch.select(kept).filter(pa.array(keep, pa.bool_()))

    kept = [c for c in pairs.columns if c != "sure" and c not in {x for side in sides for x in side}]
    return pairs.mapInArrow(run, pairs.select(kept).schema)


def _bigrams(text: Column) -> Column:
    """Pairs of neighbouring characters, the n-th of a kind marked with n, so that they count as a multiset."""
    grams = F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substring(text, i, F.lit(2)))
    return F.transform(grams, lambda g, i: F.concat(g, F.size(F.filter(F.slice(grams, 1, i + 1), lambda x: x == g)).cast("string")))


def alike_pairs(rows: DataFrame, group: str, key: str, text: str, least: float = ALIKE) -> DataFrame:
    """Pairs (group, a, b), a < b, of a group's rows whose texts have a ratio of ``least`` or more, that of b's text to a's.

    No such pair is lost: M matching characters of T in at most 1 + T - 2 M blocks share 3 M - T - 1 bigrams or more, with M at least least * T / 2; and the
    shorter text has at least least / (2 - least) of the longer one's length. So two different texts of three characters or more share a bigram
    among the rarest of each, as many as it may do without and one more; shorter ones must be equal. Empty and null texts are like nothing."""
    known = rows.where(F.length(text) > 0).select(group, F.col(key).alias("id"), F.col(text).alias("text"))
    texts = written(known.select(group, "text").distinct())
    share = (1.5 * least - 1) * 2 / (2 - least)
    grams = texts.where(F.length("text") >= 3).select(group, "text", F.explode(_bigrams(F.col("text"))).alias("gram"))
    uses = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("uses"))
    place = F.row_number().over(Window.partitionBy(group, "text").orderBy("uses", "gram"))
    needed = F.greatest(F.lit(1.0), F.ceil(F.length("text") * share - 1 - 1e-9))
    kept = grams.join(uses, "gram").withColumn("place", place).where(F.col("place") <= F.length("text") - 1 - needed + 1).select(group, "text", "gram")
    longer = F.greatest(F.length("ta"), F.length("tb")) * (least / (2 - least)) - 1e-9 <= F.least(F.length("ta"), F.length("tb"))
    near = kept.withColumnRenamed("text", "ta").join(kept.withColumnRenamed("text", "tb"), [group, "gram"]).where((F.col("ta") != F.col("tb")) & longer).select(group, "ta", "tb").distinct()
    # both directions are rated, as the ratio has one
    close = with_ratio(near, "tb", "ta").where(F.col("ratio") >= least).select(group, "ta", "tb").unionByName(texts.select(group, F.col("text").alias("ta"), F.col("text").alias("tb")))
    a, b = known.select(group, F.col("id").alias("a"), F.col("text").alias("ta")), known.select(group, F.col("id").alias("b"), F.col("text").alias("tb"))
    return close.join(a, [group, "ta"]).join(b, [group, "tb"]).where("a < b").select(group, "a", "b")


def payee_score(instruments: DataFrame, aliases: DataFrame) -> DataFrame:
    """How well each instrument's payee fits its batch's names: the best ratio to an alias, in thousandths; 0.95 if one holds the other
    (five characters at least), and a word of an alias that is like the payee to 0.80 counts 0.88 at least.

    instruments: (batch_id, line_no, payee_raw), aliases: (batch_id, alias). Letters and digits count, in upper case; without a payee or alias the score is 0."""
    compact = lambda c: F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")
    payees = instruments.select("batch_id", compact(F.col("payee_raw")).alias("p")).where("p <> ''").distinct()
    names = aliases.where(F.length("alias") > 0).select("batch_id", compact(F.col("alias")).alias("whole"), F.transform(F.regexp_extract_all("alias", F.lit("([A-Za-z0-9]{5,})")), F.upper).alias("words")).distinct()
    whole = names.where("whole <> ''").select("batch_id", F.col("whole").alias("t"), F.lit(False).alias("word"))
    words = names.select("batch_id", F.explode("words").alias("t"), F.lit(True).alias("word"))
    # no ratio is above twice the shorter text's share of both, and words below WORD_ALIKE (rounded) count nothing: most words of a long payee needn't be rated
    most = 2 * F.least(F.length("p"), F.length("t")) / (F.length("p") + F.length("t"))
    pairs = payees.join(whole.unionByName(words).distinct(), "batch_id").where(~F.col("word") | (most >= WORD_ALIKE - 0.001))
    met = with_ratio(pairs, "p", "t").withColumn("r", F.round("ratio", 3))
    held = ~F.col("word") & (F.least(F.length("p"), F.length("t")) >= 5) & (F.col("t").contains(F.col("p")) | F.col("p").contains(F.col("t")))
    score = F.when(F.col("word"), F.when(F.col("r") >= WORD_ALIKE, F.greatest(F.lit(WORD_SCORE), F.col("r")))).otherwise(F.greatest("r", F.when(held, F.lit(HELD))))
    best = met.groupBy("batch_id", "p").agg(F.max(score).alias("score"))
    rows = instruments.select("batch_id", "line_no", compact(F.col("payee_raw")).alias("p"))
    return rows.join(best, ["batch_id", "p"], "left").select("batch_id", "line_no", F.coalesce("score", F.lit(0.0)).alias("score"))


def _identities(observations: DataFrame) -> DataFrame:
    """Serials and payees as upper-case letters and digits, MICR lines as these and as digits; nothing is the empty text."""
    plain = lambda c: F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]", "")
    return observations.withColumns({"serial_": plain(F.col("serial_number")), "line_": plain(F.col("micr_line")), "micr_": N.digits(F.coalesce("micr_line", F.lit(""))), "payee_": plain(F.col("payee_raw"))})


def same_instrument_pairs(observations: DataFrame) -> DataFrame:
    """Pairs (page_id, a, b), a < b, of a page's observations that may show one instrument: like MICR digits, like serials, a serial that the other's MICR
    line holds, or the same amount, payee and type.

    observations: (page_id, row_no, serial_number, micr_line, amount_numeric, payee_raw, instrument_type). Rows of pages with up to ``SMALL`` of them all meet, by one shuffle; those of
    fuller pages by what they share (see ``_crowded_pairs``). Empty serials, lines and payees are like nothing."""
    few, many = by_crowd(observations, "page_id")
    told = lambda df: _identities(df).select("page_id", "row_no", "serial_", "line_", "micr_", "payee_", F.col("amount_numeric").cast("decimal(14,2)").alias("amount"), F.coalesce("instrument_type", F.lit("")).alias("kind"))
    # dealt as given, so that both sides are one shuffle
    dealt = told(few.repartition("page_id"))
    a, b = (dealt.select("page_id", *(F.col(c).alias(f"{c}{s}") for c in dealt.columns if c != "page_id")) for s in "ab")
    met = a.join(b.hint("merge"), "page_id").where("row_noa < row_nob")
    # a text of T characters in both with a ratio of ALIKE needs at most (1 - ALIKE) T edits
    near = lambda c: (F.col(f"{c}a") != "") & (F.col(f"{c}b") != "") & (F.levenshtein(f"{c}a", f"{c}b") <= F.floor((F.length(f"{c}a") + F.length(f"{c}b")) * (1 - ALIKE) + 1e-9))
    sure = ((F.col("serial_b") != "") & F.col("line_a").contains(F.col("serial_b"))) | ((F.col("serial_a") != "") & F.col("micr_b").contains(F.col("serial_a")))
    sure = sure | F.coalesce((F.col("amounta") == F.col("amountb")) & (F.col("payee_a") != "") & (F.col("payee_a") == F.col("payee_b")) & (F.col("kinda") == F.col("kindb")), F.lit(False))
    sides = [(f"{c}b", f"{c}a") for c in ("micr_", "serial_")]
    met = met.withColumn("sure", sure).where(F.col("sure") | near("micr_") | near("serial_"))
    pairs = _rated(met.select("page_id", F.col("row_noa").alias("a"), F.col("row_nob").alias("b"), *(x for side in sides for x in side), "sure"), *sides)
    return pairs if many is None else pairs.unionByName(_crowded_pairs(written(told(many))))


def _crowded_pairs(rows: DataFrame) -> DataFrame:
    """``same_instrument_pairs`` of full pages, whose rows (as told there) meet by what they share (see ``alike_pairs``; a serial meets MICR lines by its rarest bigram), never by page alone."""
    pairs = alike_pairs(rows, "page_id", "row_no", "micr_").unionByName(alike_pairs(rows, "page_id", "row_no", "serial_"))
    pieces = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2))))
    parts = rows.where("line_ <> ''").select("page_id", F.col("row_no").alias("r2"), "line_", "micr_", F.explode(F.array_union(pieces(F.col("line_")), F.array_union(pieces(F.col("micr_")), F.split("line_", "")))).alias("gram"))
    uses = parts.groupBy("gram").agg(F.count(F.lit(1)).alias("uses"))
    first = F.row_number().over(Window.partitionBy("page_id", "row_no").orderBy(F.coalesce("uses", F.lit(0)), "gram"))
    serials = rows.where("serial_ <> ''").select("page_id", "row_no", "serial_", F.explode(pieces(F.col("serial_"))).alias("gram")).join(uses, "gram", "left").withColumn("nth", first).where("nth = 1")
    # a later row's serial is looked for in the earlier line as it stands, an earlier row's in the digits of the later one
    later = (F.col("row_no") > F.col("r2")) & F.col("line_").contains(F.col("serial_"))
    earlier = (F.col("row_no") < F.col("r2")) & F.col("micr_").contains(F.col("serial_"))
    held = serials.join(parts, ["page_id", "gram"]).where(later | earlier).select("page_id", F.least("row_no", "r2").alias("a"), F.greatest("row_no", "r2").alias("b"))
    paid = rows.where("amount IS NOT NULL AND payee_ <> ''").select("page_id", "amount", "payee_", "kind", "row_no")
    same = paid.withColumnRenamed("row_no", "a").join(paid.withColumnRenamed("row_no", "b"), ["page_id", "amount", "payee_", "kind"]).where("a < b").select("page_id", "a", "b")
    return pairs.unionByName(held).unionByName(same).distinct()


def _first_group(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
    """Rows (row_no, earlier) in order to (row_no, group): the first group that holds one of the earlier rows it is like, else a new one. A row comes with null first, then once with each
    earlier row; row numbers that don't come with null are no rows."""
    of: dict[int, int] = {}
    groups = 0
    for row, lines in groupby(rows, lambda line: line[0]):
        earlier = [x for _, x in lines]
        if earlier[0] is not None:
            continue
        group = min((of[x] for x in earlier if x is not None), default=groups)
        groups = max(groups, group + 1)
        of[row] = group
        yield row, group


FIELDS = ("serial_number", "micr_line", "amount_numeric", "payee_raw", "instrument_type", "issue_date")


def merge_observations(observations: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row for each instrument that a page's observations show: the fullest of a group, its gaps filled by the others in their order.

    pairs: (page_id, a, b) as from ``same_instrument_pairs``. A row joins the first group with a row that it is like; groups are never joined. Different
    amounts or serials within a group leave null and flags, as no reading is better than another."""
    # a row and what it is like are lines of one fold, and its group comes to it by one shuffle of pages, in which all that follows stays
    known = observations.where(F.col("page_id").isNotNull() & F.col("row_no").isNotNull())
    lines = known.select("page_id", "row_no", F.lit(None).cast("long").alias("earlier")).unionByName(pairs.select("page_id", F.col("b").cast("long").alias("row_no"), F.col("a").cast("long").alias("earlier")))
    groups = fold(lines, ["page_id"], ["row_no", F.col("earlier").asc_nulls_first()], ["row_no", "earlier"], _first_group, "page_id long, row_no long, group_no long")
    dealt = _identities(known).unionByName(groups.withColumnRenamed("group_no", "of"), allowMissingColumns=True).repartition("page_id")
    rows = dealt.withColumns({"group_no": F.max("of").over(Window.partitionBy("page_id", "row_no")), "line": F.col("of").isNull()}).where("line")
    has = lambda c: ~is_empty(F.col(c).cast("string"))
    best = F.struct((-sum(has(c).cast("int") for c in FIELDS)).alias("f"), "row_no")
    filled = lambda c: F.coalesce(F.min_by(F.when(has(c), F.col(c)), best), F.min_by(F.when(has(c), F.col(c)), F.when(has(c), F.col("row_no")))).alias(c)
    # whether there are several values is seen from the least and the greatest
    several = lambda c: F.coalesce(F.min(c) < F.max(c), F.lit(False))
    amounts, serials = several(F.round(F.col("amount_numeric").cast("decimal(14,2)"), 2)), several(F.when(F.col("serial_") != "", F.col("serial_")))
    out = rows.groupBy("page_id", "group_no").agg(*(filled(c) for c in FIELDS), F.count(F.lit(1)).alias("observations"), amounts.alias("torn"), serials.alias("twice"))
    torn, twice = F.col("torn"), F.col("twice")
    flags = F.concat_ws(",", F.when(torn, "conflicting_region_amounts,manual_review_required"), F.when(twice, "conflicting_region_document_numbers,manual_review_required"))
    return out.withColumns({
        "amount_numeric": F.when(~torn, F.col("amount_numeric")), "serial_number": F.when(~twice, F.col("serial_number")), "image_quality": F.when(torn | twice, "unclear"), "review_flags": flags,
    }).drop("torn", "twice")


def consolidate_single_front(merged: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages of one front whose instruments have at most one amount keep the best-read instrument, marked unclear; others keep all.

    merged: rows of ``merge_observations`` with amount_words; pages: (page_id, kind, several_fronts). The first of equally good rows counts."""
    points = [("amount_words", 5), ("micr_line", 4), ("serial_number", 3), ("payee_raw", 2), ("issue_date", 2), ("amount_numeric", 1)]
    score = sum((~is_empty(F.col(c).cast("string"))).cast("int") * v for c, v in points)
    page = Window.partitionBy("page_id")
    rows = merged.join(pages.select("page_id", "kind", "several_fronts"), "page_id", "left")
    rows = rows.withColumns({"n": F.count(F.lit(1)).over(page), "kinds": F.size(F.collect_set(F.when(F.col("amount_numeric") > 0, F.col("amount_numeric"))).over(page)), "nth": F.row_number().over(page.orderBy(score.desc(), "group_no"))})
    one = F.coalesce((F.col("kind") == "instrument") & ~F.col("several_fronts"), F.lit(False)) & (F.col("n") > 1) & (F.col("kinds") <= 1)
    flags = F.when(one, F.concat_ws(",", F.when(F.col("review_flags") != "", F.col("review_flags")), F.lit("multiple_interpretations_single_front"))).otherwise(F.col("review_flags"))
    kept = rows.withColumn("one", one).where("NOT one OR nth = 1")
    return kept.withColumns({"review_flags": flags, "image_quality": F.when(F.col("one"), "unclear").otherwise(F.col("image_quality"))}).drop("kind", "several_fronts", "n", "kinds", "nth", "one")


def rollup_document(pages: DataFrame) -> DataFrame:
    """Each document's batch header: that of the page with a number, then most items, highest amount, most fields and the first page; its gaps filled by other pages in
    order, and every deposit field as the last page has it that has one.

    pages: (doc_id, page_number, batch_number, batch_amount, total_items, property_name, deposit_account, deposit_date, deposit_amount); documents without headers have nulls."""
    header, deposit = ("batch_number", "batch_amount", "total_items", "property_name"), ("deposit_account", "deposit_date", "deposit_amount")
    has = lambda c: ~is_empty(F.col(c).cast("string"))
    fields = sum(has(c).cast("int") for c in header)
    better = F.struct((~has("batch_number")).alias("a"), (-F.coalesce("total_items", F.lit(0))).alias("b"), (-F.coalesce("batch_amount", F.lit(0))).alias("c"), (-fields).alias("d"), "page_number")
    rows = pages.withColumn("better", F.when(fields > 0, better))
    lead = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("better").isNull(), "better")) == 1
    rows = rows.withColumn("order", F.when(lead, F.lit(-1)).otherwise(F.col("page_number")))
    first = lambda c: F.min_by(F.when(has(c), F.col(c)), F.when(has(c), F.col("order"))).alias(c)
    last = lambda c: F.max_by(F.when(has(c), F.col(c)), F.when(has(c), F.col("page_number"))).alias(c)
    return rows.groupBy("doc_id").agg(*map(first, header), *map(last, deposit))
