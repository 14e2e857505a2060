"""Small tests of the operators of subpackage llm: edge rows, and brute-force versions."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, path string, row string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and clashing columns."""
    rng = random.Random(4)
    base = [rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(rng.randint(0, 60)) for _ in range(400)]
    rows = [(i, " ".join(base[: 60 + i % 3]), "en", "a", 1) for i in range(6)]
    rows += [(10, None, None, None, None), (11, "", "en", "b", 0), (12, "one two", "en", "b", 7), (13, "One  TWO", "en", "b", 8), (13, "One  TWO", "en", "b", 8)]
    rows += [(None, "no id here at all", "en", "a", 4), (20, " ".join(base * 40), "en", None, 9), (21, "token = abcdefghijkl0123", "en", "c", 3), (22, "x" * 350, "fr", "c", 350)]
    return spark.createDataFrame([(*r, "p", "r") for r in rows], DOCS)


def test_mixing(spark, odd):
    from paperlake.llm.mixing import mix, mix_plan

    plan = mix_plan(odd).collect()
    assert len(plan) == odd.count()
    sizes = collections.Counter()
    for r in odd.collect():
        sizes[r.source] += len(WORDS.findall(r.text or ""))
    targets = {r.source: r.target for r in plan}
    assert abs(sum(targets.values()) - sum(sizes.values())) < 1e-6
    assert all(targets[s] <= 3 * n + 1e-9 for s, n in sizes.items())
    assert all(r.source_size == sizes[r.source] and r.taken == r.copies * r.size and r.copies <= 3 for r in plan)
    assert mix(odd).count() == sum(r.copies for r in plan) and mix(odd).columns == odd.columns
    assert mix_plan(odd.limit(0)).count() == 0


def test_url_filter(spark):
    from paperlake.llm.url_filter import judge_urls

    rows = [(1, "HTTP://A.Example.ORG/es/x?y"), (2, None), (3, "nothing"), (4, "http://bad.net?x"), (5, "http://bad.net/a"), (6, "s://x.com/de/1#z"), (7, "s://x.com/fr/"), (8, "s://example.org/en/12"), (8, "s://good.net/1")]
    pages = spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, host string")
    labels = spark.createDataFrame([("http://bad.net/q", False)] * 60 + [("http://good.net/q", True)] * 60 + [("http://bad.net/q", None)], "url string, good boolean")
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages, labels).orderBy("page_id", "host").collect()]
    assert got == [
        (1, "a.example.org", "/es/x", "example.org/es/", "block"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "bad.net", "", None, "block"), (5, "bad.net", "/a", None, "block"),
        (6, "x.com", "/de/1", "com/de/", "block"), (7, "x.com", "/fr/", "com/fr/", "allow"), (8, "example.org", "/en/12", "example.org/en/1", "block"), (8, "good.net", "/1", None, "allow"),
    ]
    assert judge_urls(pages.limit(0), labels.limit(0)).count() == 0


def test_toxicity(spark, odd, tables):
    from paperlake.llm.toxicity import drop_toxic, fit, score_toxicity

    rng = random.Random(2)
    syllables = "ba be bi bo da de di do ka ke ki ko la le li lo".split()
    bad = "vexxum grompf".split()

    def text(toxic):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(80)]
        for _ in range(4 if toxic else 0):
            words[rng.randrange(80)] = rng.choice(bad)
        return " ".join(words)

    rows = [(i, text(i % 4 == 0), i % 4 == 0) for i in range(800)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(x)) for i, _, x in rows], "doc_id long, toxic int")
    model = fit(docs, labels, "crc32(cast(doc_id AS string)) % 5 <> 0")
    held = {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    got = {r.doc_id: r.predicted for r in score_toxicity(docs, model).collect()}
    assert sum(got[i] == x for i, _, x in rows if i in held) >= 0.95 * len(held)
    assert score_toxicity(odd, model).count() == odd.count() and {r.score for r in score_toxicity(odd, model).where("doc_id IN (10, 11)").collect()} == {0.0}
    assert drop_toxic(odd, model).columns == odd.columns


def test_toxicity_of_long_texts(spark):
    """What a tenth of the clean texts have by chance doesn't make many of them toxic when they are strung together."""
    from paperlake.llm.toxicity import fit, score_toxicity

    rng = random.Random(3)
    syllables = "ba be bi bo da de di do ka ke ki ko la le li lo".split()

    def text(mentions):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(80)]
        for k in rng.sample(range(80), mentions):
            words[k] = rng.choice(("vexxum", "grompf"))
        return " ".join(words)

    toxic, clean = [text(4) for _ in range(200)], [text(int(i % 10 == 1)) for i in range(600)]
    rows = [(i, t, 1) for i, t in enumerate(toxic)] + [(1000 + i, t, 0) for i, t in enumerate(clean)]
    # labelled texts that are too long for the dictionaries count as well
    rows += [(2000 + i, " ".join(text(int(k % 10 == 1)) for k in range(40)), 0) for i in range(10)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = fit(frame.select("doc_id", "text"), frame.select("doc_id", "toxic"))
    strung = [(i, " ".join(text(int(i < 10 and k % 10 == 1) or 4 * int(i >= 10)) for k in range(60))) for i in range(20)]
    got = {r.doc_id: r.predicted for r in score_toxicity(spark.createDataFrame([*strung, *((100 + i, text(4)) for i in range(50))], "doc_id long, text string"), model).collect()}
    assert sum(got[i] for i in range(10)) == 0 and all(got[i] for i in range(10, 20)) and sum(got[100 + i] for i in range(50)) >= 45


def components(docs, percent=85):
    sets = []
    for i, t in docs:
        w = WORDS.findall(lowered(t))
        sets.append((i, {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    top = list(range(len(sets)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                if p != q:
                    p, q = (p, q) if sets[p][0] < sets[q][0] else (q, p)
                    top[q] = p
    return {(sets[i][0], len(sets[i][1]), sets[find(i)][0]) for i in range(len(sets))}


def test_near_duplicates(spark, odd, monkeypatch):
    from paperlake.llm import near_dups

    rng = random.Random(7)
    base = [f"w{rng.randint(0, 500)}" for _ in range(90)]
    docs = []
    for i in range(140):  # one large group of near copies, at all similarities
        t = list(base)
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(90)] = f"v{rng.randint(0, 900)}"
        docs.append((i, " ".join(t)))
    docs += [(200 + i, " ".join(f"z{rng.randint(0, 50)}" for _ in range(rng.randint(0, 7)))) for i in range(60)]
    monkeypatch.setattr(near_dups, "LOCAL", 100)
    got = near_dups.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == components(docs)
    rows = near_dups.near_duplicates(odd).collect()
    assert len(rows) == odd.count() and all(r.kept and r.component_id is None for r in rows if r.doc_id is None)
    want = components([(r.doc_id, r.text) for r in odd.where("doc_id IS NOT NULL").collect()])
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in rows if r.doc_id is not None} == want
    assert near_dups.near_duplicates(odd.limit(0)).count() == 0


def test_bound_of_differing_bins_loses_no_link():
    """Pairs on both sides of the threshold, small and large sets: no pair beyond it is filtered by its bins."""
    from paperlake.llm import near_dups as nd

    rng = np.random.default_rng(5)
    for n in (3, 40, 150, 2000):
        for percent in (80, 85):
            sets = []
            for share in rng.uniform(0.6, 1.0, 60):
                both = int(n * share)
                pool = np.unique(rng.integers(0, 2**64, 2 * n - both, dtype=np.uint64))
                sets += [pool[rng.permutation(len(pool))[:n]] for _ in range(2)]
            sets = [np.sort(x) for x in sets]
            sizes = np.array([len(x) for x in sets])
            alike = np.zeros((len(sets), nd.SKETCH), np.int8)  # equal tokens: the bins alone decide
            pairs = np.array([(i, i + 1) for i in range(0, len(sets), 2)])
            kept = {tuple(p) for p in nd._finer(pairs, alike, nd._binned(sets).reshape(-1, nd.BINS), sizes, percent).tolist()}
            for i, j in pairs.tolist():
                common = len(np.intersect1d(sets[i], sets[j]))
                if 100 * common >= percent * (sizes[i] + sizes[j] - common):
                    assert (i, j) in kept


def test_secrets(spark, odd):
    from paperlake.llm.secrets import RULES, find_secrets, redact_secrets

    rng = random.Random(1)
    parts = ["token", "Secret", "api_key", "passwd", "=", ":", "==", " ", "   ", '"', "'", "abc", "é", "AKIA", "QWERTY0123456789", "deadbeef", "0123456789abcdef", "-", "ghp_", "eyJ", ".", "\n", "x" * 40, " " * 700, "f" * 600]
    parts += ["-----BEGIN RSA PRIVATE KEY-----", "-----END PRIVATE KEY-----", "gho_abcdefghijklmnopqrstu", "eyJabc.eyJdefghijklmnopqrstu"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))) for i in range(800)] + [(900, None), (901, "")]
    got = {r.doc_id: r for r in find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    base = (r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12), (r"AKIA[A-Z0-9]+", 0, 18), (r"[0-9a-f]+", 0, 16)
    more = (
        (r"gh[pousr]_[A-Za-z0-9]+", 0, 24), (r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)?", 0, 24),
        (r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]*-----END [A-Z ]*PRIVATE KEY-----)?", 0, 20),
    )
    for i, t in rows:
        spans = sorted((m.start(), k, m.end()) for k, (p, g, n) in enumerate(base + more) for m in re.finditer(p, t or "") if len(m.group(g)) >= n)
        assert got[i].spans == ",".join(f"{RULES[k][0]}:{a}:{b}" for a, k, b in spans)
        spans = sorted((m.start(), k, m.end()) for k, (p, g, n) in enumerate(base) for m in re.finditer(p, t or "") if len(m.group(g)) >= n)
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{RULES[k][0]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(s[1] == k for s in spans) for k in range(3)]
    assert find_secrets(odd).count() == odd.count()
    clean = redact_secrets(odd)
    assert clean.columns == odd.columns and clean.where("doc_id = 21").first().text == "[assign]"


def vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.standard_normal(8) * 0.3]) for i in range(400)]
    rows += [(400, rows[0][1]), (401, rows[0][1]), (450, None), (500, [float("nan")] * 8), (550, [0.0] * 8), (600, [None] + [1.0] * 7), (None, rows[1][1])]
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, b int, q int"), rows


def best(rows, score, fit):
    out = set()
    own = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and fit(v)]
    for i, v in own:
        if i % 50 == 0:
            top = sorted(((-score(v, w), j) for j, w in own if j != i))[:5]
            out |= {(i, r + 1, j) for r, (_, j) in enumerate(top)}
    return out


def test_vectors(spark):
    from pyspark.sql import functions as F

    from paperlake.llm.vectors import nearest_cosine, top_inner

    frame, rows = vectors(spark)
    query = F.col("vec_id") % 50 == 0
    got = {(r.query_id, r.rank, r.vec_id) for r in top_inner(frame, query).collect()}
    assert got == best(rows, lambda v, w: float(np.floor(v * 256) @ np.floor(w * 256)), lambda v: True)
    got = {(r.query_id, r.rank, r.vec_id) for r in nearest_cosine(frame, query).collect()}
    want = best(rows, lambda v, w: round(float(v @ w / np.sqrt((v @ v) * (w @ w))), 12), lambda v: any(v))
    assert len(got & want) >= 0.9 * len(want)
    odd = [(1, [1.0, 0.0]), (1, [1.0, 0.5]), (50, [1.0, 0.25]), (50, [1.0, 0.25]), (3, [1.0]), (100, [2.0]), (4, [])]
    for how in (top_inner, nearest_cosine):  # repeated ids, and vectors of several lengths
        out = how(spark.createDataFrame(odd, "vec_id long, embedding array<float>"), query).collect()
        assert sorted(r.vec_id for r in out if r.query_id == 50) == [1, 1, 1, 1, 50, 50] and [r.vec_id for r in out if r.query_id == 100] == [3]
    assert top_inner(frame.limit(0), query).count() == 0 and nearest_cosine(frame.limit(0), query).count() == 0


def test_language_model(spark, odd, tables):
    from pyspark.sql import functions as F

    from paperlake.llm import ppm

    rows = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").limit(80).collect()
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 7 == 2 for r in rows}
    counts, ends, grams = collections.Counter(), 0, collections.Counter()
    for r in rows:
        if not held[r.doc_id]:
            counts.update(WORDS.findall(lowered(r.text)))
            ends += 1
            raw = bytes(4) + lowered(r.text).encode()
            grams.update(raw[j - 4 : j + 1] for j in range(4, len(raw)))
    model = [collections.defaultdict(collections.Counter) for _ in range(5)]
    for g, n in grams.items():
        for k in range(5):
            model[k][g[4 - k : 4]][g[4]] += n

    def logp(context, symbol):
        out, gone = 0.0, set()
        for k in range(4, -1, -1):
            seen = model[k].get(context[4 - k :])
            if seen is None:
                continue
            left = {x: n for x, n in seen.items() if x not in gone}
            gone |= set(seen)
            if left:
                if symbol in left:
                    return out + math.log10(left[symbol] / (sum(left.values()) + len(left)))
                out += math.log10(len(left) / (sum(left.values()) + len(left)))
        return out - math.log10(256 - len(gone))

    total, kinds = sum(counts.values()) + ends, len(counts) + 1
    for r in ppm.score_texts(frame, F.crc32(F.col("doc_id").cast("string")) % 7 == 2).collect():
        text = lowered(next(x.text for x in rows if x.doc_id == r.doc_id))
        words = WORDS.findall(text)
        base = sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in words) + math.log10((ends + 1) / (total + kinds + 1))
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(words) + 1, sum(counts[w] > 0 for w in words) + 1, total)
        assert math.isclose(base, r.base_score, rel_tol=1e-9)
        raw = bytes(4) + text.encode()
        if len(raw) < 3000:
            assert math.isclose(sum(logp(raw[j - 4 : j], raw[j]) for j in range(4, len(raw))), r.score, rel_tol=1e-5)
    out = ppm.score_texts(odd, F.lit(False)).collect()
    assert len(out) == odd.count() and {(r.n_tokens, r.score) for r in out if r.doc_id == 10} == {(1, 0.0)}
    nothing = ppm.score_texts(odd, F.lit(True)).where("doc_id = 12").first()
    assert nothing.n_known == 0 and math.isclose(nothing.score, -7 * math.log10(256), rel_tol=1e-6)


def test_language_model_holds_every_gram(spark, monkeypatch):
    """Over 2^20 training bytes, where grams that occur once must still count; with all grams sent, and with most joined."""
    from paperlake.llm import ppm

    rng = random.Random(5)
    usual = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(usual) if rng.random() < 0.98 else "".join(rng.choice("klmnopqé漢") for _ in range(5)) for _ in range(n))
    rows = [(i, text(1500), False) for i in range(160)] + [(1000 + i, text(60), True) for i in range(20)] + [(2000, None, False), (2001, "klmno", None)]
    learned = [r for r in rows if not r[2]]
    assert sum(len((t or "").encode()) for _, t, _ in learned) > 1 << 20
    model = [collections.defaultdict(collections.Counter) for _ in range(5)]
    for _, t, _ in learned:
        raw = bytes(4) + lowered(t).encode()
        for g, n in collections.Counter(raw[j - 4 : j + 1] for j in range(4, len(raw))).items():
            for k in range(5):
                model[k][g[4 - k : 4]][g[4]] += n

    def logp(context, symbol):
        out, gone = 0.0, set()
        for k in range(4, -1, -1):
            left = {x: n for x, n in model[k].get(context[4 - k :], {}).items() if x not in gone}
            gone |= set(left)
            if symbol in left:
                return out + math.log10(left[symbol] / (sum(left.values()) + len(left)))
            if left:
                out += math.log10(len(left) / (sum(left.values()) + len(left)))
        return out - math.log10(256 - len(gone))

    frame = spark.createDataFrame(rows, "doc_id long, text string, held boolean")
    for grams in (ppm.GRAMS, 300, 0):
        monkeypatch.setattr(ppm, "GRAMS", grams)
        got = {r.doc_id: r.score for r in ppm.score_texts(frame, frame.held).collect()}
        assert len(got) == len(rows)
        for i, t, _ in rows[::20] + rows[160:]:
            raw = bytes(4) + lowered(t).encode()
            assert math.isclose(sum(logp(raw[j - 4 : j], raw[j]) for j in range(4, len(raw))), got[i], rel_tol=1e-5)


def test_pieces(spark, odd):
    from paperlake.llm import piece_tokens

    v = piece_tokens.vocabulary(piece_tokens.read_vocabulary())
    known = {v.pieces[i]: v.score[i] for i in set(v.piece[v.piece >= 0].tolist())}
    rng = random.Random(0)
    words = ["".join(rng.choice("▁▁abcdeéß漢🙂\nthe ing") for _ in range(rng.randint(1, 30))).replace(" ", "▁").encode() for _ in range(150)]
    for w, ids in zip(words, v.best(words), strict=True):
        best = [0.0] + [-math.inf] * len(w)
        for i in range(len(w)):
            if (w[i] & 0xC0) != 0x80:
                size = 1 + (w[i] >= 0xC0) + (w[i] >= 0xE0) + (w[i] >= 0xF0)
                best[i + size] = max(best[i + size], best[i] + v.fallback)
                for j in range(i + 1, len(w) + 1):
                    if w[i:j] in known:
                        best[j] = max(best[j], best[i] + known[w[i:j]])
        spelt = bytes(int(v.pieces[x][3:5], 16) for x in ids if x in v.byte_ids)
        got = sum(v.score[x] for x in ids if x not in v.byte_ids) + v.fallback * sum((c & 0xC0) != 0x80 for c in spelt)
        assert abs(got - best[-1]) < 1e-3
    rows = [(i, "".join(rng.choice(["a", "the", " ", "  ", "é", "\n", "漢", "\x00", "🙂"]) for _ in range(rng.randint(0, 40)))) for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert piece_tokens.digest(frame).where("NOT round_trip").count() == 0
    back = {r.doc_id: r.text for r in piece_tokens.decode(piece_tokens.encode(frame.selectExpr("*", "'en' lang", "'s' source"))).collect()}
    assert back == dict(rows)
    assert {r.n_pieces for r in piece_tokens.encode(odd).where("doc_id IN (10, 11)").collect()} == {0} and piece_tokens.encode(odd).count() == odd.count()


def test_repeats(spark, odd, tables):
    from paperlake.llm.deep_shallow import sorted_order
    from paperlake.llm.repeats import remove_repeats

    rng = np.random.default_rng(0)
    rows = rng.integers(0, 2, (2000, 100)).astype(np.uint8)
    rows[:, 5:70] = 0
    rows[1000:] = rows[:1000]
    put = [rows[i].tobytes() for i in sorted_order(rows)]
    assert put == sorted(put)
    draw = random.Random(3)
    blocks = ["".join(draw.choice("ab é") for _ in range(draw.randint(5, 160))) for _ in range(12)]
    docs = [(i, "".join(draw.choice(blocks) for _ in range(draw.randint(0, 8)))) for i in range(150)] + [(1000, "x" * 500), (1001, "x" * 99), (1002, None), (1003, "ab" * 200)]
    docs += [(2000 + r.doc_id, r.text) for r in spark.read.parquet(f"{tables}/documents.parquet").collect()]
    got = {r.doc_id: r for r in remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    seen = set()
    for i, t in sorted(docs):
        raw = (t or "").encode()
        mark = np.zeros(len(raw) + 1, int)
        for j in range(len(raw) - 99):
            if raw[j : j + 100] in seen:
                mark[j] += 1
                mark[j + 100] -= 1
            seen.add(raw[j : j + 100])
        gone = np.cumsum(mark[:-1]) > 0
        r = got[i]
        assert (r.n_bytes, r.n_removed) == (len(raw), int(gone.sum()))
        assert r.n_spans == int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        assert r.kept_sha256 == hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest()
    assert remove_repeats(odd).count() == odd.count() and remove_repeats(odd.limit(0)).count() == 0


def test_pipeline(spark, tables):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "secrets", "mixing", "tokens"]
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns = docs.columns
    kept = corpus_pipeline.toxicity(spark, docs, tables)
    assert kept.columns == columns
    once = corpus_pipeline.near_duplicate(spark, kept, tables)
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert {r.doc_id for r in once.collect()} == {c for _, _, c in components(rows, 80)} and once.columns == columns
    clean = corpus_pipeline.secrets(spark, once, tables)
    assert clean.columns == columns and clean.count() == once.count()
    mixed = corpus_pipeline.mixing(spark, clean, tables)
    assert mixed.columns == columns
    assert corpus_pipeline.run(spark, tables).count() == mixed.count()


def test_stages_with_clashing_names(spark, tables):
    """Columns that are named like those the stages add for themselves stay as they are."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{tables}/documents.parquet").where("n_chars < 3000")
    names = ["text_before", "ROW_KEY", "score", "rate", "row", "component_id"]
    docs = docs.select("*", *(docs.doc_id.cast("string").alias(n) for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, tables)
        assert after.columns == docs.columns, name
        assert after.where(" OR ".join(f"{n} <> doc_id" for n in names)).count() == 0 < after.count(), name
        assert stage(spark, docs.limit(0), tables).count() == 0, name
    assert corpus_pipeline.tokens(spark, docs, tables).count() == docs.count()
