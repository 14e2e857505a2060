"""Prefix trie, importance resampling and byte-level BPE against brute-force versions."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rebuilt(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return out


def brute_trie(seqs):
    nodes = collections.defaultdict(list)
    for c, seq in seqs.items():
        for d in range(len(seq) + 1):
            nodes[tuple(seq[:d])].append(c)
    children = collections.Counter(p[:-1] for p in nodes if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(members) - 1) * len(p[-1][1]) if p else 0
    return sorted(
        (min(m), len(p), -1 if not p else min(nodes[p[:-1]]), len(m), children[p], leaves[p], saved[p], hashlib.sha256(",".join(str(c) for c in sorted(m) if len(seqs[c]) == len(p)).encode()).hexdigest())
        for p, m in nodes.items()
    )


def collected(nodes):
    return sorted(tuple(-1 if x is None else x for x in r) for r in nodes.collect())


TURNS = "conv_id long, turn long, role string, text string, path string, chars int"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "p", 1) for r in rows], TURNS)


@pytest.mark.parametrize("bounds", [(1 << 18, 1 << 16), (7, 1 << 16), (1 << 18, 3), (1, 1)])
def test_trie_of_many_shapes(spark, bounds):
    from paperlake.llm.turn_trie import rebuilt_paths, trie_nodes

    rng = random.Random(5)
    rows = []
    for c in [*range(0, 260), -3, -100, 10**12]:
        kind = c % 5
        n = {0: 3, 1: rng.randint(1, 4), 2: rng.randint(1, 30), 3: 6, 4: 1}[kind]
        for i in range(n):
            text = None if rng.random() < 0.05 else "same" * (i % 3) if kind in (0, 3) else rng.choice(["", "a", "b🙂"])
            rows.append((c, None if i == 0 and kind == 2 else i, ["user", "assistant", None][i % 2 if kind else 2], text))
    rows += [(700, i, "u", f"t{i}") for i in range(3)] + [(701, i, "u", "long" * (i % 2)) for i in range(90)] + [(702, i, "u", "long" * (i % 2)) for i in range(95)]
    rows += [(None, 1, "u", "nobody's"), (503, 0, "u", "x")]
    rng.shuffle(rows)
    found = trie_nodes(rebuilt_paths(conversations(spark, rows)), *bounds)
    assert collected(found) == brute_trie(rebuilt(rows))


def test_trie_of_copies(spark):
    """One path for most conversations: the end ids of its node lie in many shards."""
    from paperlake.llm.turn_trie import prefix_trie, rebuilt_paths, trie_nodes

    rows = [(c, i, "u", "copy") for c in range(600) for i in range(6 + (c > 595))]
    assert collected(trie_nodes(rebuilt_paths(conversations(spark, rows)), 50, 9)) == brute_trie(rebuilt(rows)) == collected(prefix_trie(conversations(spark, rows)))


def test_trie_ties_repeats_and_empty(spark):
    from paperlake.llm.turn_trie import prefix_trie

    rows = [(1, 0, "u", "a"), (1, 0, "u", "a"), (2, 0, "u", "b"), (2, 0, "u", "c")]
    assert prefix_trie(conversations(spark, rows)).count() == prefix_trie(conversations(spark, rows[::-1])).count()
    assert collected(prefix_trie(conversations(spark, rows))) == collected(prefix_trie(conversations(spark, rows[::-1])))
    assert prefix_trie(conversations(spark, [])).count() == 0
    only = collected(prefix_trie(conversations(spark, [(3, None, None, None)])))  # crc32("3") % 6 first turns come from conversation 0, which is absent
    assert only[0][:4] == (3, 0, -1, 1) and len(only) == (2 if zlib.crc32(b"3") % 6 == 0 else 1)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(SMALL))


def grams(text, least, most):
    w = words(text)
    return [" ".join(w[i : i + n]) for n in range(least, most + 1) for i in range(len(w) - n + 1)]


def brute_draw(docs, target, percent, least_words, n, buckets, seed):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = (collections.Counter(bucket(g) for x in texts for g in grams(x, *n)) for texts in ([x for _, x in docs], target))
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (s.total() + buckets) / ((s[b] + 1.0) * (t.total() + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        g = grams(text, *n)
        weight = sum(gain[bucket(x)] for x in g)
        h = int(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(words(text)), len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((r for r in rows if r[1] >= least_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    place = {id(r): k for k, r in enumerate(fit[: percent * len(fit) // 100], 1)}
    return sorted((-1 if r[0] is None else r[0], *r[1:], place.get(id(r), 0)) for r in rows)


@pytest.mark.parametrize("n", [(1, 1), (1, 3), (2, 2)])
def test_importance(spark, n):
    from paperlake.llm.importance import resample

    rng = random.Random(6)
    pool = [f"W{i}é"[: rng.randint(1, 4)] for i in range(60)] + ["İ", "ß", "漢字", "x7"]
    text = lambda k: "".join(rng.choice(pool) + rng.choice([" ", ", ", "\n", "--", " ", "_", "\x00"]) for _ in range(k))
    docs = [(i, text(rng.randint(0, 40))) for i in range(200)] + [(7, text(30)), (300, None), (301, ""), (302, "..."), (None, text(25)), (303, text(6000)), (304, text(1) * 2)]
    target = [text(20) for _ in range(10)] + [None, ""]
    frame = spark.createDataFrame([(*d, 5, "p") for d in docs], "doc_id long, text string, place int, part string")
    wanted = spark.createDataFrame([(x,) for x in target], "text string")
    got = resample(frame, wanted, 30, 10, n, 500, 9)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted((-1 if r[0] is None else r[0], *r[1:5], r[5] or 0) for r in got.collect()) == brute_draw(docs, target, 30, 10, n, 500, 9)
    assert resample(frame.limit(0), wanted).count() == 0 and resample(frame, wanted.limit(0)).count() == len(docs)


def test_overlapping_spans():
    from paperlake.llm.importance import collapsed, gram_pattern

    text = collapsed("--One,two  THREE\x00four été".encode())
    assert text == "one two three four été".encode()
    assert [m[0].decode() for m in gram_pattern(3).finditer(text, overlapped=True)] == ["one two three", "two three four", "three four été"]


def exact(ranks, pattern):
    import tiktoken

    return tiktoken.Encoding("exact", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_bpe_equals_the_library(name):
    import public_tokenizers

    from paperlake.llm.byte_bpe import PATTERN, Splitter, _Memo, later_symbols, ranks, read_ranks

    assert PATTERN == public_tokenizers.PATTERN
    r = ranks(read_ranks(public_tokenizers.path(name)))
    newer = later_symbols(PATTERN)
    split, memo, known = Splitter(PATTERN, newer), _Memo(r), exact(r.rank, PATTERN)
    rng = random.Random(7)
    alphabets = ["ab", "aeiou tns'rell\n", "éèüßа한漢🙂 　", " \t\n\x1c\x85 ", "0123٣½ ", "".join(rng.choices(newer, k=5)) + "a 1!"]
    for i in range(3000):
        text = "".join(rng.choice(alphabets[i % 6]) for _ in range(rng.randint(0, 80)))
        ids = np.frombuffer(b"".join(memo[p] for p in split(text)), "<u4")
        assert ids.tolist() == known.encode_ordinary(text) and r.decode(ids) == text.encode()
    slow = __import__("regex").compile(PATTERN)
    for _ in range(3000):
        text = "".join(rng.choices("''stmdrevl aé1٣!\n\t　x", k=rng.randint(0, 30)))
        assert split(text) == slow.findall(text)
    for text in ("a" * 50_000, " " * 50_000, "".join(rng.choices("abcdefgh", k=50_000))):
        assert r.piece(text.encode()) == known.encode_ordinary(text)


def test_bpe_merges_by_rank():
    """A rank file of its own, in which longest matches alone would be wrong."""
    import base64

    from paperlake.llm.byte_bpe import Ranks

    tokens = [bytes([i]) for i in range(256)] + [b"bc", b"ab", b"abc", b"cd", b"abcd", b"aa", b"aaa"]
    r = Ranks(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens)))

    def merged(piece):
        parts = [bytes([x]) for x in piece]
        while True:
            best = min(((r.rank.get(a + b, 10**9), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(10**9, 0))
            if best[0] == 10**9:
                return [r.rank[p] for p in parts]
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    rng = random.Random(8)
    for _ in range(3000):
        piece = bytes(rng.choices(b"abcd", k=rng.randint(1, 14)))
        assert r.piece(piece) == (merged(piece) if piece not in r.rank else [r.rank[piece]])


def test_bpe_rows(spark):
    from paperlake.llm.byte_bpe import PATTERN, RANKS, decode, digest, encode, ranks, read_ranks

    known = exact(ranks(read_ranks(RANKS)).rank, PATTERN)
    texts = [(1, "Hello  world's\n\n end "), (2, None), (3, ""), (4, "漢字🙂é" * 3000), (4, "twice"), (4, "twice"), (None, "<|endoftext|>"), (5, "x" * 200_000)]
    docs = spark.createDataFrame([(*t, 1) for t in texts], "doc_id long, text string, ids int")
    want = sorted((str(i), known.encode_ordinary(t or "")) for i, t in texts)
    assert sorted((str(r.doc_id), list(r.ids)) for r in encode(docs).collect()) == want
    assert sorted((str(r.doc_id), r.text) for r in decode(encode(docs)).collect()) == sorted((str(i), t or "") for i, t in texts)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    rows = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in digest(docs).collect())
    assert rows == sorted((str(i), len(k := known.encode_ordinary(t or "")), sha(np.array(k, "<u4").tobytes()), sha((t or "").encode())) for i, t in texts)
    assert encode(docs.limit(0)).count() == 0 and digest(docs.limit(0)).count() == 0
    assert decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).first().text == ""
