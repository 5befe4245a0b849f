"""Benchmark passages, clusters and source divergence against brute force, and their edge cases."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeline.llm import clustering, contamination, divergence
from gaugeline.llm.text import texts_of

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")

ITEMS = [
    (1, "What is the capital of France, and why is it Paris rather than Lyon or Nice?"),
    (2, "short item"), (3, "Élan vital: ñandú 漢字 one"), (4, None), (5, " .,; "), (None, "an item without id"),
    (10, "What is the capital of France, and why is it Paris at all?"), (2, "another text of the same item"),
    (7, "a a a a a a a a a a a a"),
]
DOCS = [
    (1, "Intro. WHAT is the capital -- of France and why is it paris, rather than lyon? End."),
    (2, None), (3, ""), (4, "  "), (5, "nothing to see"), (None, "a SHORT item, short item; short"),
    (6, "élan vital ñandú 漢字 one two"), (6, "élan vital ñandú 漢字 one two"),
    (7, "Élan"), (8, "a " * 30), (9, "x " * 20000 + "short item " + "y " * 20000 + "élan vital ñandú 漢字 one"),
    (11, "what is the capital of france and why is it paris at"),
]


def brute(items, docs, size=10):
    windows = defaultdict(set)
    for i, t in items:
        words = WORD.findall((t or "").translate(LOWER))
        for k in range(max(len(words) - size + 1, 1) if words else 0):
            windows[tuple(words[k:k + size])].add(str(i) if i is not None else "null")
    out = []
    for i, t in docs:
        found = [(m.group(), m.start(), m.end()) for m in WORD.finditer((t or "").translate(LOWER))]
        words = [w for w, _, _ in found]
        hit, held = set(), set()
        for width in {len(k) for k in windows}:
            for k in range(len(words) - width + 1):
                own = windows.get(tuple(words[k:k + width]))
                if own:
                    held |= own
                    hit |= set(range(k, k + width))
        spans = []
        for k in sorted(hit):
            if k - 1 in hit:
                spans[-1][1] = found[k][2]
            else:
                spans.append([found[k][1], found[k][2]])
        out.append((i, len(words), len(hit), sorted(held), spans))
    return sorted(out, key=str)


def found(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"], [[s["start"], s["end"]] for s in r["spans"]])
                   for r in df.collect()), key=str)


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
@pytest.mark.parametrize("size", [10, 3, 1])
def test_passages(spark, block_bytes, size):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumns(
        {c: F.lit(1) for c in ("id", "row", "items", "spans", "n_words")})
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("id", F.lit(1))
    got = found(contamination.contamination(docs, items, size=size, block_bytes=block_bytes))
    assert got == brute(ITEMS, DOCS, size)
    if size == 10:
        assert {r[0]: r[2] for r in got}[1] == 14


def test_passages_of_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    none = found(contamination.contamination(docs, items.limit(0)))
    assert [r[2:] for r in none] == [(0, [], [])] * len(DOCS)
    assert found(contamination.contamination(docs.limit(0), items)) == []
    assert found(contamination.contamination(docs.limit(0), items, block_bytes=40)) == []


def test_passages_of_a_very_long_text():
    """Ten megabytes, hit everywhere, in one pass."""
    import pyarrow as pa

    windows = contamination.Windows(["1"], ["one two three " * 5], 10)
    part = next(texts_of(pa.array(["One, two; three! " * 600_000])))
    n_words, items, spans = contamination._scanned(part, windows)
    assert n_words[0] == 1_800_000 and items == [["1"]] and len(spans[0]) == 1


# ---------------------------------------------------------------- clusters


def lloyd(x, centroids, rounds):
    """Whole-number k-means, every distance measured."""
    centroids = [list(c) for c in centroids]
    for r in range(rounds + 1):
        near, d = [], []
        for v in x:
            all_ = [sum((int(a) - int(b)) ** 2 for a, b in zip(v, c)) for c in centroids]
            near.append(all_.index(min(all_)))
            d.append(min(all_))
        if r < rounds:
            for c in set(near):
                own = [v for v, n in zip(x, near) if n == c]
                centroids[c] = [sum(int(v[i]) for v in own) // len(own) for i in range(len(own[0]))]
    return near, d, centroids


@pytest.mark.parametrize("k, spread", [(1, 5), (2, 3), (7, 2), (16, 40), (16, 1)])
def test_search_equals_all_distances(k, spread):
    """Few values and dimensions give ties between centroids in nearly every round."""
    random = np.random.RandomState(k)
    x = random.randint(-spread, spread + 1, (400, 3)).astype(np.int64)
    c = x[random.randint(0, 400, k)]
    state = [np.zeros(400, int), np.full(400, min(1, k - 1)), np.full(400, np.inf), np.zeros(400)]
    before = None
    for r in range(6):
        *state, distance = clustering.assign(x, clustering.Centroids(c, before), *state)
        all_ = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
        assert (state[0] == all_.argmin(axis=1)).all() and (distance == all_.min(axis=1)).all()
        if k > 1:
            rest = all_.astype(float)
            rest[np.arange(400), state[0]] = np.inf
            assert (state[2] ** 2 >= distance * (1 - 1e-12)).all()
            assert (state[3] ** 2 <= rest.min(axis=1) * (1 + 1e-12)).all()
        before, c = c, c.copy()
        for i in range(k):
            own = x[state[0] == i]
            if len(own):
                c[i] = [int(s) // len(own) for s in own.sum(axis=0)]


def test_bounds_settle_most_vectors():
    """On separate groups the search looks at few centroids once the bounds are known."""
    random = np.random.RandomState(3)
    middle = random.randint(-1000, 1000, (16, 8))
    x = (middle[random.randint(0, 16, 5000)] + random.randint(-9, 10, (5000, 8))).astype(np.int64)
    state = [np.zeros(5000, int), np.ones(5000, int), np.full(5000, np.inf), np.zeros(5000)]
    *state, _ = clustering.assign(x, clustering.Centroids(middle), *state)
    centroids = clustering.Centroids(middle + 1, middle)
    upper = state[2] + centroids.moved[state[0]]
    assert (upper < np.maximum(state[3] - centroids.others[state[0]], centroids.half[state[0]])).mean() > 0.99


def vectors(n, seed=5):
    random = np.random.RandomState(seed)
    x = random.normal(size=(n, 64)) / 8
    x[n // 3:n // 2] = x[n // 3:n // 3 + 1]
    return [(i, v.tolist(), "clash") for i, v in enumerate(x)]


@pytest.mark.parametrize("n", [0, 1, 5, 300])
def test_clusters(spark, n):
    good = vectors(n)
    odd = [(900, None, "x"), (901, [1.0] * 63, "x"), (902, [1.0] * 63 + [None], "x"),
           (903, [float("nan")] * 64, "x"), (904, [float("inf")] * 64, "x"), (905, [], "x")]
    more = [(None, [0.25] * 64, "x"), (3, [0.5] * 64, "x")] if n else []
    df = spark.createDataFrame(good + odd + more, "vec_id long, embedding array<double>, near string")
    members, clusters = clustering.cluster_vectors(df, k=16, rounds=3)
    rows = good + more
    x = [[int(np.floor(64 * a)) for a in v] for _, v, _ in rows]

    def mark(i):
        own = rows[i][0]
        return (own is None, hashlib.sha256(f"1:{own}".encode()).hexdigest(), x[i])

    start = [x[i] for i in sorted(range(len(rows)), key=mark)[:16]]
    near, d, centroids = lloyd(x, start, 3) if rows else ([], [], [])
    got = sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in members.collect()), key=str)
    assert got == sorted(((r[0], c, e) for r, c, e in zip(rows, near, d)), key=str)
    out = {r["cluster"]: r for r in clusters.collect()}
    assert sorted(out) == list(range(len(centroids)))
    for c, own in enumerate(centroids):
        assert out[c]["centroid"] == own and out[c]["n"] == near.count(c) and out[c]["inertia"] == sum(d)
        assert out[c]["cluster_inertia"] == sum(e for n_, e in zip(near, d) if n_ == c)


def test_components_too_large_for_exact_distances(spark):
    df = spark.createDataFrame([(1, [3e38] * 64)], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="too large"):
        clustering.cluster_vectors(df)


# ---------------------------------------------------------------- sources


def audited(docs, least=3, top=200):
    """Part, item, value and rank of every group, with whole numbers of any size."""
    counts, held = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in docs:
        terms = TERM.findall((text or "").translate(LOWER))
        counts[lang or "", source or ""].update(terms)
        held[lang or ""].update(set(terms))
    out = []
    for lang in held:
        kept = [t for t, n in held[lang].items() if n >= least]
        own = {s: {t: c[t] for t in kept} for (l, s), c in counts.items() if l == lang}

        def p(of):
            whole = sum(of.values()) + len(kept)
            return {t: 1 + 10 ** 9 * (of[t] + 1) // whole for t in kept}

        q = p({t: sum(c[t] for c in own.values()) for t in kept})
        ps = {s: p(c) for s, c in own.items()}
        for s in own:
            pairs = [(r, sum((ps[s][t] - ps[r][t]) ** 2 // ps[r][t] for t in kept)) for r in own if r != s]
            terms = [(t, (ps[s][t] - q[t]) ** 2 // q[t]) for t in kept if own[s][t] and ps[s][t] > q[t]]
            for part, found_, most in (("pair", pairs, None), ("term", terms, top)):
                best = sorted(found_, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, v, k + 1) for k, (item, v) in enumerate(best)]
    return sorted(out)


def source_docs(n=400):
    random = np.random.RandomState(2)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)] + ["Élan", "漢字", "𝔘x", "ﬀ"]
    docs = []
    for i in range(n):
        words = [vocabulary[int(w)] for w in random.zipf(1.4, 30) if w < len(vocabulary)]
        words += [vocabulary[-1 - i % 4].upper(), "x" + str(i), "a1b"]
        docs.append((i % 350, " ".join(words) + "...", ["en", "de", None][i % 7 % 3], f"s{i % 9 if i % 3 else 0}"))
    return docs + [(1, None, None, None), (2, "", "en", "empty"), (3, None, "xx", "one"), (None, "a b", "xx", None),
                   (4, "solo solo solo", "yy", "only"), (5, "Repeat Same Words " * 30000, "en", "s1")]


SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.mark.parametrize("options", [{}, dict(cells=50, top=3), dict(least_docs=1)])
def test_sources(spark, options):
    docs = source_docs()
    df = spark.createDataFrame(docs, SCHEMA).withColumns({c: F.lit(1) for c in ("term", "n", "shard", "rank", "part")})
    got = sorted(tuple(r) for r in divergence.source_divergence(df, **options).collect())
    assert got == audited(docs, options.get("least_docs", 3), options.get("top", 200))


def test_counts_passed_on_early(spark):
    df = spark.createDataFrame(source_docs(), SCHEMA)
    whole = {tuple(r) for r in divergence.term_counts(df).collect()}
    assert {tuple(r) for r in divergence.term_counts(df, held_rows=50, slice_bytes=2000).collect()} == whole


def test_sources_of_an_empty_table(spark):
    assert divergence.source_divergence(spark.createDataFrame([], SCHEMA)).collect() == []


def test_shares_are_exact_where_products_overflow():
    count = np.array([0, 1, 10 ** 12, 8 * 10 ** 15 - 1], dtype=np.int64)
    whole = np.array([1, 3, 10 ** 12 + 7, 8 * 10 ** 15], dtype=np.int64)
    assert divergence.shares(count, whole).tolist() == [
        1 + 10 ** 9 * (int(c) + 1) // int(w) for c, w in zip(count, whole)]
