"""MinHash near-duplicates by a chosen-path set similarity join.

Each document is the set of hashes of its word shingles, and a sketch of minwise tokens: the smallest
element under each of SKETCH hash functions. Documents with equal sets are one class at once. For the
other classes, independent trees branch on chosen minwise tokens: at a node a class goes on to the child
named by its token under the node's hash function, and under a second one with the probability that
makes 1 / threshold children on average, so that a pair at the threshold is expected together once on
every level. Small nodes are compared exhaustively; large nodes branch on. Links are confirmed on full
sets. As links only have to join classes that aren't joined yet, a first round confirms few links of
each node, and a second one follows only nodes whose classes are still apart; so the work of a large
group of copies grows with its size and not with its square. Nodes too large for one task branch as
Spark jobs until they fit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesets import SMALL, U, mixed, pieces, word_hashes, word_spans
from .shared import bounded_batches, written

#: Minwise tokens a document; the first of them, TREES and some more, are the roots' hash functions.
SKETCH, TREES = 64, 20
#: Bins of the finer sketch that pairs of large nodes must pass: a byte of the least hash in each bin, 0 where it's empty.
BINS = 256
#: Nodes up to LEAF classes are compared exhaustively; up to LOCAL, their branches are followed in one task.
LEAF, LOCAL = 12, 5_000
#: Branches are followed this deep; classes together so far down have equal sketches for most purposes.
DEPTH = 32
#: Sketches of a pair at the threshold agree in fewer places than this many standard deviations below with probability 3e-7.
DEVIATIONS = 5.0
#: 64-bit words of the broadcast bit table that tells which texts may be wanted.
FILTER_WORDS = 1 << 18
_A = np.random.default_rng(11).integers(0, 2**63, SKETCH, dtype=U) * U(2) + U(1)
_C = np.random.default_rng(12).integers(0, 2**63, 64, dtype=U) * U(2) + U(1)


def shingle_sets(data: np.ndarray, at: np.ndarray, width: int) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its shingles; with fewer words one of the whole sequence, without words none."""
    data = SMALL[data]
    starts, ends, first = word_spans(data, at)
    words = word_hashes(data, starts, ends)
    n = len(words) - width + 1
    runs = np.zeros(max(n, 0), U)
    for k in range(width):
        if n > 0:
            runs += words[k : k + n] * _C[k % len(_C)]
    runs = mixed(runs)
    out = []
    for i, j in zip(first[:-1], first[1:], strict=True):
        if j - i >= width:
            out.append(np.unique(runs[i : j - width + 1]))
        elif j > i:
            whole = (words[i:j] * _C[: j - i]).sum(dtype=U, keepdims=True) + np.array([j - i], U) * U(0x9E3779B97F4A7C15)
            out.append(mixed(whole))
        else:
            out.append(np.zeros(0, U))
    return out


def _classes(sets: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of each whole set; equal sets are one class."""
    out = np.zeros(len(sets), U)
    sizes = np.array([len(x) for x in sets], np.int64)
    full = np.flatnonzero(sizes)
    if len(full):
        flat = np.concatenate([sets[i] for i in full])
        begin = np.cumsum(sizes[full]) - sizes[full]
        two = np.add.reduceat(mixed(flat ^ U(0x5851F42D4C957F2D)), begin)
        out[full] = mixed(np.add.reduceat(mixed(flat), begin) + mixed(two + sizes[full].astype(U)))
    return out


def _binned(sets: list[np.ndarray]) -> np.ndarray:
    """One-permutation sketches: sets are in order, so the least hash of a bin is the first with its leading byte."""
    out = np.zeros(len(sets) * BINS, np.uint8)
    flat = np.concatenate([np.zeros(0, U), *sets])
    cell = np.repeat(np.arange(len(sets)), [len(x) for x in sets]) * BINS + (flat >> U(56)).astype(np.int64)
    first = np.flatnonzero(np.append(True, np.diff(cell) != 0)) if len(cell) else cell
    out[cell[first]] = 1 + mixed(flat[first]) % U(255)
    return out


def _sketches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, at in pieces(batches):
            sets = shingle_sets(data, at, width)
            sizes = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(sizes)
            tokens = np.zeros((len(sets), SKETCH), np.uint32)
            if len(full):
                flat = np.concatenate([sets[i] for i in full])
                begin = np.cumsum(sizes[full]) - sizes[full]
                for k in range(SKETCH):
                    tokens[full, k] = (np.minimum.reduceat(flat * _A[k], begin) >> U(32)).astype(np.uint32)
            cuts = np.arange(0, len(sets) * SKETCH + 1, SKETCH, dtype=np.int32)
            sketch = pa.ListArray.from_arrays(cuts, pa.array(tokens.view(np.int32).ravel()))
            ids = pa.array(_classes(sets).view(np.int64), mask=sizes == 0)
            ends = pa.py_buffer(np.arange(0, (len(sets) + 1) * BINS, BINS, dtype=np.int32))
            bins = pa.Array.from_buffers(pa.binary(), len(sets), [None, ends, pa.py_buffer(_binned(sets))])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), ids, sketch, bins], ["doc_id", "n_shingles", "id", "sketch", "bins"])

    return run


def _sets(width: int):
    """The sets of the texts that belong to the class ``id``; other texts with the same doc_id are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, at in pieces(batches, 1 << 19):
            sets = shingle_sets(data, at, width)
            ids, copies = (part.column(part.schema.get_field_index(c)) for c in ("id", "copies"))
            own = pa.array(_classes(sets).view(np.int64) == ids.to_numpy())
            rows = pa.RecordBatch.from_arrays([ids, copies, pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "copies", "members"])
            yield rows.filter(own)

    return run


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
                p, q = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep[i] = 100 * both >= percent * (len(p) + len(q) - both)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def least_alike(percent: int) -> int:
    """Places in which two sketches must agree for the pair to be looked at."""
    p = percent / 100
    return max(1, int(np.floor(SKETCH * p - DEVIATIONS * np.sqrt(SKETCH * p * (1 - p)))))


def _leaves(sketch: np.ndarray, percent: int, seed: int, groups: np.ndarray, settled: Callable[[np.ndarray], bool] | None) -> Iterator[np.ndarray]:
    """The members of the leaves under one node: chosen-path branching as in the module's text.

    Nodes whose members have nothing to be compared for any more aren't followed, as copies that are more
    alike than the threshold would else branch without end: those that are settled or, without that
    function, those within one of the groups."""
    again = int((100 / percent - 1) * 2**32)
    stack = [(np.arange(len(sketch)), seed, 0)]
    while stack:
        who, path, depth = stack.pop()
        if len(who) <= LEAF or depth == DEPTH:
            yield who
            continue
        if settled and settled(who):
            continue
        h = int(mixed(np.array([path & (2**64 - 1)], U))[0])
        for c in [h % SKETCH] + [(h >> 8) % SKETCH] * ((h >> 32) < again):
            token = sketch[who, c]
            order = np.argsort(token, kind="stable")
            cut = np.concatenate([[0], np.flatnonzero(np.diff(token[order])) + 1, [len(order)]])
            if settled:
                open_ = np.diff(cut) > 1
            else:
                of = groups[who[order]]
                open_ = np.minimum.reduceat(of, cut[:-1]) < np.maximum.reduceat(of, cut[:-1])
            for k in np.flatnonzero(open_):
                child = order[cut[k] : cut[k + 1]]
                stack.append((who[child], h * 31 + c * 1_000_003 + int(token[child[0]]), depth + 1))


def _finer(pairs: np.ndarray, sketch: np.ndarray, bins: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """The pairs that may be links: their sizes and differing bins allow it, and so do all places of both sketches together.

    A bin that either class has, and a token, agree with the pair's similarity as probability. That is chance, but of
    two differing bins the lesser least hash is in one set only, so a pair has at least as many unshared elements as
    differing bins: this bound loses no link."""
    p = percent / 100
    small, large = np.minimum(n[pairs[:, 0]], n[pairs[:, 1]]), np.maximum(n[pairs[:, 0]], n[pairs[:, 1]])
    pairs = pairs[100 * small >= percent * large]
    keep = np.zeros(len(pairs), bool)
    for i in range(0, len(pairs), 1 << 16):
        a, b = pairs[i : i + (1 << 16)].T
        x, y = bins[a], bins[b]
        places = SKETCH + ((x | y) != 0).sum(1)
        same = ((x == y) & (x != 0)).sum(1) + (sketch[a] == sketch[b]).sum(1)
        unshared = (100 + percent) * (x != y).sum(1) <= (100 - percent) * (n[a] + n[b])
        keep[i : i + (1 << 16)] = unshared & (same >= np.floor(places * p - DEVIATIONS * np.sqrt(places * p * (1 - p))))
    return pairs[keep]


def _pairs(percent: int, by_group: bool):
    """For a large node (path, id, sketch, bins, n, grp): rows (a, others) of pairs of a leaf whose sketches allow a link.

    First round: of each leaf a forest that joins its classes with the most alike pairs. Second round
    (by_group): all pairs of different groups."""
    least, sure = least_alike(percent), int(np.ceil(SKETCH * percent / 100))

    def run(node: pd.DataFrame) -> pd.DataFrame:
        node = node.sort_values("id", ignore_index=True)
        sketch = np.array(node["sketch"].tolist(), np.int8).reshape(len(node), SKETCH)
        bins = np.frombuffer(b"".join(node["bins"]), np.uint8).reshape(len(node), BINS)
        ids, groups = node["id"].to_numpy(), node["grp"].to_numpy()
        found: list[np.ndarray] = []
        root = np.arange(len(node))

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        def settled(who: np.ndarray) -> bool:
            # compare one member with all: who is as alike as the threshold asks is joined to it
            for q in who[1:][(sketch[who[1:]] == sketch[who[0]]).sum(1) >= sure]:
                a, b = top(who[0]), top(q)
                if a != b:
                    root[max(a, b)] = min(a, b)
                    found.append(np.sort([[who[0], q]]))
            return len({top(i) for i in who}) == 1

        for who in _leaves(sketch, percent, int(node["path"].iloc[0]), groups, None if by_group else settled):
            who = np.sort(who)
            if len(who) > 4 * LEAF:  # at the full depth: equal in nearly all places
                for i, p in enumerate(who[:-1] if by_group else who[:1]):
                    q = who[i + 1 :]
                    q = q[(sketch[q] == sketch[p]).sum(1) >= least]
                    q = q[groups[q] != groups[p]] if by_group else q
                    found.append(np.stack([np.full(len(q), p), q], 1))
                continue
            part = sketch[who]
            alike = (part[:, None, :] == part[None, :, :]).sum(2)
            i, j = np.nonzero(np.triu(alike >= least, 1))
            if by_group:
                keep = groups[who[i]] != groups[who[j]]
                found.append(np.stack([who[i[keep]], who[j[keep]]], 1))
                continue
            for k in np.argsort(-alike[i, j], kind="stable"):
                p, q = top(who[i[k]]), top(who[j[k]])
                if p != q:
                    root[max(p, q)] = min(p, q)
                    found.append(np.array([[who[i[k]], who[j[k]]]]))
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        pairs = _finer(pairs, sketch, bins, node["n"].to_numpy(), percent)
        # a pair is always listed with its smaller id, so that all nodes list it alike (ids are in order here)
        pairs = np.unique(np.sort(pairs, 1), axis=0)
        first, begin = np.unique(pairs[:, 0], return_index=True)
        others = [x.tolist() for x in np.split(ids[pairs[:, 1]], begin[1:])] if len(first) else []
        return pd.DataFrame({"a": ids[first], "others": pd.Series(others, dtype=object)})

    return run


def _are_stars(edges: DataFrame) -> bool:
    """Whether each larger end a of edges (a, b) has one smaller end b, which isn't a larger end itself."""
    ends = edges.selectExpr("stack(2, a, 1, 0, b, 0, 1) AS (id, larger, smaller)").groupBy("id").agg(F.sum("larger").alias("larger"), F.max("smaller").alias("smaller"))
    return ends.where("larger > 1 OR (larger > 0 AND smaller > 0)").isEmpty()


def components(links: DataFrame, what: str = "components") -> DataFrame:
    """(id, component) of all ends of links (a, b), distinct pairs with a < b of a written table: the smallest
    id reachable, by large-star and small-star rounds (a published method). Each round is written out; the
    number of rounds grows with the logarithm, and links that are stars already take none."""
    edges = links.select(F.col("b").alias("a"), F.col("a").alias("b"))
    while not _are_stars(edges):
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = written(small.select(F.col("e.a").alias("a"), F.col("e.b").alias("b")).where("a <> b").distinct(), what)
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = 5) -> DataFrame:
    """One row for each row of docs (doc_id, text): n_shingles, component_id and kept.

    Words are split at ASCII white space after A-Z became a-z; two texts are linked when 100 times the
    common shingles are at least ``percent`` times all of both. Texts without words, null ones too, have
    no shingles and no links. Rows with one doc_id are told apart by their texts, each of which has its
    own links; the smallest doc_id reachable is that of any row. Rows whose doc_id is null have a null
    component_id, are kept, and link nothing. Sets are of 64-bit hashes, and equal sets one class known
    by a 64-bit hash. Columns other than doc_id and text aren't read; an empty table gives no rows."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, n_shingles long, id long, sketch array<int>, bins binary"
    seen = written(rows.mapInArrow(_sketches(width), schema), "sketches")
    real = seen.where("doc_id IS NOT NULL AND id IS NOT NULL")
    firsts = real.groupBy("id").agg(F.min("doc_id").alias("doc"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.first("bins").alias("bins"))
    firsts = written(firsts, "classes")

    # Nodes below the roots: a class and the token that it has under a tree's hash function.
    again = 100 / percent - 1
    roots = [t for t in range(TREES)] + [TREES + t for t in range(TREES) if mixed(np.array([t + 1], U))[0] < U(int(again * 2**64))]
    named = F.transform(F.array(*map(F.lit, roots)), lambda c: F.xxhash64(c, F.element_at("sketch", c + 1)))
    nodes = firsts.select("id", F.explode(named).alias("path"))
    # a large node's representative is drawn anew for each node, so that those of one group differ
    drawn = F.min_by("id", F.xxhash64("id", "path"))
    low = F.when(F.count(F.lit(1)) > LOCAL, drawn).otherwise(F.min("id")).alias("low")
    sizes = nodes.groupBy("path").agg(F.count(F.lit(1)).alias("members"), low).where("members > 1")
    nodes = written(nodes.join(sizes, "path"), "nodes")
    leaf, big = nodes.where(F.col("members") <= LEAF), nodes.where(F.col("members") > LOCAL)
    wide = nodes.where(F.col("members").between(LEAF + 1, LOCAL)).select("path", "id")
    # Within nodes, the lowest byte of each token does (the highest ones of a minimum are nearly always zero):
    # equal tokens have equal bytes, so no pair is lost.
    sketch = firsts.select("id", F.transform("sketch", lambda x: (x.bitwiseAND(F.lit(255)) - 128).cast("byte")).alias("sketch"), "n")
    least = least_alike(percent)

    def alike(pairs: DataFrame) -> DataFrame:
        p = pairs.join(sketch.toDF("a", "sa", "na"), "a").join(sketch.toDF("b", "sb", "nb"), "b")
        close = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
        same = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
        return p.where(close & (same >= least)).select("a", "b")

    def wide_pairs(own: DataFrame, by_group: bool) -> DataFrame:
        """own: (path, id, grp)."""
        held = own.join(sketch.select("id", "sketch"), "id").join(firsts.select("id", "bins", "n"), "id").select("path", "id", "sketch", "bins", "n", "grp")
        found = held.groupBy("path").applyInPandas(_pairs(percent, by_group), "a long, others array<long>")
        found = found.groupBy("a").agg(F.array_distinct(F.flatten(F.collect_list("others"))).alias("others"))
        return _ordered(found.select("a", F.explode("others").alias("b")))

    def confirm(pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
        texts = real.select("id", "doc_id").join(firsts.select("id", F.col("doc").alias("doc_id")).join(ids, "id", "left_semi"), ["id", "doc_id"])
        # written, so that its size is known when Spark chooses whether the texts have to be shuffled
        wanted = written(texts.groupBy("id", "doc_id").agg(F.count(F.lit(1)).alias("copies")), "wanted")
        sets = written(_likely(rows, wanted).join(wanted, "doc_id").mapInArrow(_sets(width), "id long, copies long, members binary"), "members")
        once = sets.where("copies = 1").select("id", "members")
        sets = once.union(sets.where("copies > 1").select("id", "members").dropDuplicates(["id"]))
        p = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
        return written(p.mapInArrow(_confirmed(percent), "a long, b long"), "links")

    # First round: each member of a node with its representative, and within nodes that fit a task a forest.
    star = leaf.unionByName(big).where("id <> low").select(F.col("id").alias("a"), F.col("low").alias("b"))
    forest = wide.select("path", "id", F.lit(0).cast("long").alias("grp"))
    first = written(alike(_ordered(star)).union(wide_pairs(forest, False)).distinct(), "pairs")
    groups = components(confirm(first))

    # Second round: pairs of nodes whose classes are still apart.
    def grouped(own: DataFrame) -> DataFrame:
        return own.join(groups, "id", "left").select("path", "id", F.coalesce("component", "id").alias("grp"))

    deeper_leaf, deeper_wide, last = _branched(grouped(big), firsts.select("id", "sketch"), again)
    apart = grouped(leaf).union(deeper_leaf)
    other = apart.toDF("path", "b", "grp_b")
    rest = apart.toDF("path", "a", "grp_a").join(other, "path").where("a < b AND grp_a <> grp_b").select("a", "b").union(last).distinct()
    rest = alike(rest).union(wide_pairs(grouped(wide).union(deeper_wide), True)).distinct().join(first, ["a", "b"], "left_anti")
    rest = written(rest, "pairs")
    final = firsts.select("id", "doc").join(groups, "id", "left").select("id", "doc", F.coalesce("component", "id").alias("component"))
    if not rest.isEmpty():
        # links of the second round join whole groups of the first
        of_a, of_b = groups.toDF("a", "ga"), groups.toDF("b", "gb")
        over = confirm(rest).join(of_a, "a", "left").join(of_b, "b", "left").select(F.coalesce("ga", "a").alias("a"), F.coalesce("gb", "b").alias("b"))
        over = components(written(_ordered(over.where("a <> b")), "links"), "over").toDF("component", "lowest")
        final = final.join(over, "component", "left").select("id", "doc", F.coalesce("lowest", "component").alias("component"))
    lowest = final.groupBy("component").agg(F.min("doc").alias("lowest"))
    final = final.join(lowest, "component").select("id", "lowest")
    out = seen.select("doc_id", "n_shingles", "id").join(final, "id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("lowest", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id").isNull() | (component == F.col("doc_id"))).alias("kept"))


def _likely(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """rows without most of those whose doc_id isn't wanted, so that few texts are shuffled.

    Wanted ids set bits of a table of FILTER_WORDS words, which is broadcast whatever their number."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(64 * FILTER_WORDS))
    bit = F.expr("shiftleft(1L, CAST(place % 64 AS INT))")
    words = wanted.select(place.alias("place")).select(F.floor(F.col("place") / 64).alias("word"), bit.alias("bit"))
    words = words.groupBy("word").agg(F.bit_or("bit").alias("bits"))
    held = rows.withColumn("place", place).withColumn("word", F.floor(F.col("place") / 64)).join(F.broadcast(words), "word")
    return held.where(F.col("bits").bitwiseAND(bit) != 0).select(rows.columns)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _branched(big: DataFrame, sketch: DataFrame, again: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes beyond what one task takes branch on as Spark jobs, two levels at a time, until they fit.

    big: (path, id, grp). Nodes of one group are settled and aren't followed. Returns the (path, id, grp) of
    small nodes, those of nodes that fit a task, and pairs (a, b) to be looked at besides: each member with its
    node's representative, and in nodes that are too large at the full depth with one of each other group."""
    none = written(big.limit(0), "nodes")
    leaves, wides, pairs = none, none, none.select(F.col("id").alias("a"), F.col("id").alias("b"))
    for level in range(DEPTH // 2 + 1):
        low = F.min_by(F.struct("id", "grp"), F.xxhash64("id", "path")).alias("low")
        sizes = big.groupBy("path").agg(F.count(F.lit(1)).alias("members"), F.min("grp").alias("g0"), F.max("grp").alias("g1"), low)
        here = written(big.join(sizes.where("members > 1 AND g0 < g1").drop("g0", "g1"), "path"), "nodes")
        leaves = leaves.union(here.where(F.col("members") <= LEAF).select("path", "id", "grp"))
        wides = wides.union(here.where(F.col("members").between(LEAF + 1, LOCAL)).select("path", "id", "grp"))
        big = here.where(F.col("members") > LOCAL)
        if big.isEmpty():
            break
        star = big.where("grp <> low.grp").select(F.col("id").alias("a"), F.col("low.id").alias("b"))
        pairs = pairs.union(_ordered(star))
        big = big.select("path", "id", "grp")
        if level == DEPTH // 2:
            heads = big.groupBy("path", "grp").agg(F.min("id").alias("head")).toDF("path", "head_grp", "head")
            pairs = pairs.union(_ordered(big.join(heads, "path").where("grp <> head_grp").select(F.col("id").alias("a"), F.col("head").alias("b"))))
            break
        # a class meets its sketch once for all its nodes, whose number the trees bound
        at = big.groupBy("id", "grp").agg(F.collect_list("path").alias("paths")).join(sketch, "id")
        at = at.select("id", "grp", "sketch", F.explode("paths").alias("path"))
        for _ in range(2):
            c = F.pmod(F.xxhash64("path", F.lit(1)), F.lit(SKETCH)).cast("int")
            d = F.pmod(F.xxhash64("path", F.lit(2)), F.lit(SKETCH)).cast("int")
            twice = F.pmod(F.xxhash64("path", F.lit(3)), F.lit(10_000)) < int(again * 10_000)
            at = at.withColumn("c", F.explode(F.when(twice & (c != d), F.array(c, d)).otherwise(F.array(c))))
            at = at.withColumn("path", F.xxhash64("path", "c", F.element_at("sketch", F.col("c") + 1)))
        big = at.select("path", "id", "grp").distinct()
    return leaves, wides, pairs
