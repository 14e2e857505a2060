"""Words, regions and readings of pages: nearness, groups, merged boxes and budgets of recovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..crowds import by_crowd
from ..functions import let
from ..tables import written

#: How near two words are, the gap that parts groups of anchors, and what recovery may read of a document.
NEAR_X, NEAR_Y, LINE_X, LINE_Y = 0.30, 0.28, 0.28, 0.045
ANCHORS, ANCHOR_GAP, MARGIN = r"(?i)PAY|EXACTLY|ORDER|MONEY|CASHIER|REMITTER|PURCHASER", 0.16, 0.04
MOST_PAGES, MOST_REGIONS, MOST_CALLS, FRONT_SCORE = 8, 8, 36, 3


def components(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Groups of linked rows: nodes (key, id) with ``component``, the smallest id reachable over edges (key, a, b).

    Nodes of a key with up to ``SMALL`` of them are solved together, by one shuffle; fuller ones in rounds (see ``_by_rounds``). Nodes without edges are their own component,
    repeated nodes and edges count once, edges of a null or to no node link nothing, and rows whose key or id is null are left out."""
    few, many = by_crowd(nodes.select(key, "id").dropna(), key)
    linked = edges if many is None else edges.join(many.select(key).distinct(), key, "left_anti")
    small = _labelled(few, linked, key).select(key, F.explode("labels").alias("id", "component"))
    return small if many is None else small.unionByName(_by_rounds(many, edges, key))


def _labelled(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """One row a key with ``labels``, from each of its few nodes to its component. Each edge in turn gives the two groups that it joins the smaller of their labels."""
    groups = nodes.groupBy(key).agg(F.collect_set("id").alias("ids"))
    known = F.array_contains("ids", F.col("a")) & F.array_contains("ids", F.col("b")) & (F.col("a") != F.col("b"))
    links = F.collect_set(F.when(known, F.struct(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))))
    # an edge meets its nodes before it is gathered, so that a key has few of them
    met = groups.join(edges.select(key, "a", "b"), key, "left").groupBy(key).agg(F.first("ids").alias("ids"), links.alias("links"))

    def joined(labels: Column, link: Column) -> Column:
        of = lambda side: F.element_at(F.filter(labels, lambda x: x["id"] == link[side]), 1)["label"]
        ends = F.struct(F.least(of("a"), of("b")).alias("low"), F.greatest(of("a"), of("b")).alias("high"))
        return let(ends, lambda e: F.transform(labels, lambda x: F.struct(x["id"].alias("id"), F.when(x["label"] == e["high"], e["low"]).otherwise(x["label"]).alias("label"))))

    own = F.transform("ids", lambda i: F.struct(i.alias("id"), i.alias("label")))
    return met.select(key, F.map_from_entries(F.aggregate("links", own, joined)).alias("labels"))


def _by_rounds(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """``components`` of any number of nodes: labels take their neighbours' least and then their label's own label, so that long chains need few rounds; each
    round is a written table."""
    labels = nodes.select(key, "id").distinct().withColumn("label", F.col("id"))
    pairs = edges.join(labels.select(key).distinct(), key, "left_semi").select(key, "a", "b").where("a <> b")
    both = written(pairs.union(pairs.select(key, F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), [key, "b"]).groupBy(key, F.col("a").alias("id")).agg(F.min("label").alias("low"))
        taken = labels.join(near, [key, "id"], "left").select(key, "id", F.col("label").alias("before"), F.least("label", "low").alias("mid"))
        jumps = taken.select(key, F.col("id").alias("mid"), F.col("mid").alias("low"))
        step = written(taken.join(jumps, [key, "mid"]).select(key, "id", "before", F.least("mid", "low").alias("label")))
        labels = step.drop("before")
        if step.where("label < before").isEmpty():
            return labels.withColumnRenamed("label", "component")


def merged_regions(regions: DataFrame, pairs: DataFrame) -> DataFrame:
    """One box for each group of overlapping regions: the box around all, the highest confidence, and how many they are.

    regions: (page_id, region_idx, x0, y0, x1, y1, confidence), pairs: (page_id, region_idx_a, region_idx_b). Of pages with few regions the groups come to them page by page."""
    edges = pairs.select("page_id", F.col("region_idx_a").alias("a"), F.col("region_idx_b").alias("b"))
    few, many = by_crowd(regions.dropna(subset=["page_id", "region_idx"]), "page_id")
    linked = edges if many is None else edges.join(many.select("page_id").distinct(), "page_id", "left_anti")
    labels = _labelled(few.select("page_id", F.col("region_idx").alias("id")), linked, "page_id")
    rows = few.join(labels, "page_id").withColumn("component", F.col("labels")[F.col("region_idx")]).drop("labels")
    if many is not None:
        full = _by_rounds(many.select("page_id", F.col("region_idx").alias("id")), edges, "page_id")
        rows = rows.unionByName(many.join(full.withColumnRenamed("id", "region_idx"), ["page_id", "region_idx"]).select(rows.columns))
    box = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    return rows.groupBy("page_id", "component").agg(*box, F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("members"))


def nearby_words(words: DataFrame) -> DataFrame:
    """Pairs of a page's words (page_id, word_no, x, y) that are near each other, and whether they are on one line.

    A grid a little coarser than the distances gives the join its keys, so a page's words meet their neighbours
    only. Words without a place have no pairs."""
    grid = [("cx", "x", NEAR_X * 1.01), ("cy", "y", NEAR_Y * 1.01)]
    placed = words.select("page_id", "word_no", "x", "y", *(F.floor(F.col(c) / size).alias(n) for n, c, size in grid)).dropna()
    a = placed.select("page_id", F.col("word_no").alias("word_a"), F.col("x").alias("xa"), F.col("y").alias("ya"), "cx", "cy")
    for n, _, _ in grid:
        a = a.withColumn(n, F.explode(F.array(*(F.col(n) + d for d in (-1, 0, 1)))))
    b = placed.withColumnRenamed("word_no", "word_b")
    pairs = a.join(b, ["page_id", "cx", "cy"]).where("word_a < word_b")
    across, down = F.abs(F.col("xa") - F.col("x")), F.abs(F.col("ya") - F.col("y"))
    line = (across < LINE_X) & (down < LINE_Y)
    return pairs.where((across < NEAR_X) & (down < NEAR_Y)).select("page_id", "word_a", "word_b", line.alias("same_line"))


def words_in_regions(words: DataFrame, regions: DataFrame) -> DataFrame:
    """For each region (page_id, region_idx, x0, y0, x1, y1) how many words have their centre in it, and its text, a
    line a word in the order of their numbers. Edges belong to a region; regions without words have an empty text.
    Boxes of one index count together."""
    inside = words.select("page_id", "word_no", "x", "y", "content").join(regions, "page_id")
    inside = inside.where("x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1")
    listed = F.array_sort(F.collect_list(F.when(F.col("content") != "", F.struct("word_no", "content"))))
    text = F.array_join(F.transform(listed, lambda w: w["content"]), "\n")
    found = inside.groupBy("page_id", "region_idx").agg(F.count(F.lit(1)).alias("words"), text.alias("text"))
    out = regions.select("page_id", "region_idx").distinct().join(found, ["page_id", "region_idx"], "left")
    return out.fillna({"words": 0, "text": ""}, ["words", "text"])


def anchor_groups(words: DataFrame) -> DataFrame:
    """Strips of a page with several instruments: its anchor words by height, parted where the gap is wide.

    words: (page_id, y, content). Groups of one anchor don't count; pages need four anchors and two groups.
    A strip ends half way to the next group's mean height, and a margin beyond."""
    page = Window.partitionBy("page_id")
    anchors = words.where(F.col("content").rlike(ANCHORS) & F.col("y").isNotNull()).select("page_id", "y")
    by = page.orderBy("y")
    anchors = anchors.withColumn("anchors", F.count(F.lit(1)).over(page)).where("anchors >= 4")
    apart = F.coalesce((F.col("y") - F.lag("y").over(by) > ANCHOR_GAP).cast("int"), F.lit(0))
    anchors = anchors.withColumn("apart", apart).withColumn("part", F.sum("apart").over(by.rangeBetween(Window.unboundedPreceding, 0)))
    groups = anchors.groupBy("page_id", "part").agg(F.count(F.lit(1)).alias("anchors"), F.avg("y").alias("centre")).where("anchors >= 2")
    by = page.orderBy("part")
    groups = groups.withColumn("groups", F.count(F.lit(1)).over(page)).where("groups >= 2")
    top = F.coalesce((F.lag("centre").over(by) + F.col("centre")) / 2, F.lit(0.0))
    bottom = F.coalesce((F.col("centre") + F.lead("centre").over(by)) / 2, F.lit(1.0))
    return groups.select(
        "page_id", F.row_number().over(by).alias("strip"), "anchors",
        F.greatest(F.lit(0.0), top - MARGIN).alias("top"), F.least(F.lit(1.0), bottom + MARGIN).alias("bottom"),
    )


def recovery_pages(pages: DataFrame) -> DataFrame:
    """The pages of each document that recovery reads, and how many calls each gets.

    pages: (doc_id, page_number, kind, front_score, n_instruments, n_regions). Instruments, backs and unknown pages
    with a high front score compete: those without instruments first, then by score, number and regions. The limits of pages,
    of regions a page and of calls a document are the feature; pages for which no call is left aren't listed."""
    fits = F.col("kind").isin("instrument", "back") | ((F.col("kind") == "unknown") & (F.coalesce("front_score", F.lit(0)) >= FRONT_SCORE))
    by = Window.partitionBy("doc_id").orderBy(F.coalesce("n_instruments", F.lit(0)) > 0, F.coalesce("front_score", F.lit(0)).desc(), "page_number", F.coalesce("n_regions", F.lit(0)))
    ranked = pages.where(fits).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= MOST_PAGES)
    wish = F.least(F.coalesce("n_regions", F.lit(0)), F.lit(MOST_REGIONS)).cast("long")
    before = F.coalesce(F.sum("wish").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = ranked.withColumn("wish", wish).withColumn("left", MOST_CALLS - before).where("left > 0")
    return ranked.select("doc_id", "rank", "page_number", F.least("wish", "left").alias("calls"))


def deposit_consensus(readings: DataFrame, slack: float = 0.01) -> DataFrame:
    """Which of an item's first three readings counts: the first if the second or third agrees with it, else the second
    if the third agrees with that, else the first with ``uncertain``. A missing amount gives way to the other reading.

    readings: (item, reading_no, amount). Of repeated readings of one number the highest amount counts."""
    nth = lambda n: F.max(F.when(F.col("reading_no") == n, F.col("amount"))).alias(f"t{n}")
    by = readings.groupBy("item").agg(nth(1), nth(2), nth(3))
    agree = lambda a, b: F.coalesce(F.abs(F.col(a) - F.col(b)) <= F.lit(slack).cast("decimal(3,2)"), F.lit(False))
    both = F.col("t1").isNotNull() & F.col("t2").isNotNull()
    second = F.when(both, ~agree("t1", "t2") & ~agree("t1", "t3") & agree("t2", "t3")).otherwise(F.col("t1").isNull() & F.col("t2").isNotNull())
    unsure = both & ~agree("t1", "t2") & ~agree("t1", "t3") & ~agree("t2", "t3")
    return by.select(
        "item", F.when(second, 2).otherwise(1).alias("reading_no"), F.when(second, F.col("t2")).otherwise(F.col("t1")).alias("amount"), unsure.alias("uncertain")
    )


def front_census(pages: DataFrame) -> DataFrame:
    """Visible fronts of each document, and whether a page is known to hold several that haven't been read.

    pages: (doc_id, strong_rows, census_count, classification). A page counts what was read or what the census saw,
    whichever is more; nulls are 0."""
    strong, seen = F.coalesce("strong_rows", F.lit(0)), F.coalesce("census_count", F.lit(0))
    several = F.coalesce(F.col("classification").isin("multi_front", "report_with_fronts"), F.lit(False)) & (seen >= 2) & (seen > strong)
    return pages.groupBy("doc_id").agg(F.sum(F.greatest(strong, seen)).alias("fronts"), F.bool_or(several).alias("multi_front"))
