"""Pieces of the operators against plain versions, on random inputs."""

import random
import re

import numpy as np
import pytest
import public_tokenizers
import pyarrow as pa

from gaugeline.llm import bpe, packing, quality, repetition, toxicity
from gaugeline.llm.text import texts_of


def test_longest_repeats_against_all_pairs():
    random.seed(2)
    texts = ["", " ", "a a a a a a"] + [
        "".join(random.choice("ab é\n") for _ in range(random.randint(0, 90))) for _ in range(150)]
    found = []
    for part in texts_of(pa.array(texts), 300):
        found += zip(*[x.tolist() for x in repetition._judge(part, 5, 10, 10, 20, 0.15, 100)])
    for text, row in zip(texts, found, strict=True):
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        longest = 0
        for i in range(len(w)):
            for j in range(i + 1, len(w)):
                k = 0
                while j + k < len(w) and w[i + k] == w[j + k]:
                    k += 1
                longest = max(longest, k)
        assert (row[0], row[8]) == (len(w), longest)


def test_segments_against_their_definition():
    """Maximal scoring segments by repeated division around the best one."""

    def plain(s, at):
        best = max(((sum(s[i:j]), i - j, -i) for i in range(len(s)) for j in range(i + 1, len(s) + 1)),
                   default=(0, 0, 0))
        # The longest of the best ones is not minimal: prefer the shortest, as the definition does.
        best = max(((round(sum(s[i:j]), 9), -(j - i), -i) for i in range(len(s))
                    for j in range(i + 1, len(s) + 1)), default=(0, 0, 0))
        if best[0] <= 0:
            return []
        i = -best[2]
        j = i - best[1]
        return plain(s[:i], at) + [(at + i, at + j, best[0])] + plain(s[j:], at + j)

    random.seed(4)
    for _ in range(400):
        s = [random.choice([-3, -2.5, -1, 0.7, 1.3, 2.1, 4.9]) + random.random() / 50 for _ in range(random.randint(0, 14))]
        got = [(a, b, round(x, 9)) for a, b, x in toxicity.segments(np.array(s))]
        assert got == [(a, b, round(x, 9)) for a, b, x in plain(s, 0)]


def test_isotonic_against_min_max():
    random.seed(6)
    for _ in range(100):
        n = np.array([random.randint(1, 5) for _ in range(random.randint(1, 12))], float)
        s = np.array([random.uniform(0, x) for x in n])
        got = quality.isotonic(n, s)
        for k in range(len(n)):
            want = max(min(s[i:j + 1].sum() / n[i:j + 1].sum() for j in range(k, len(n))) for i in range(k + 1))
            assert abs(got[k] - want) < 1e-9


def test_cutting_stock_covers_and_places_everything():
    random.seed(8)
    for size in (16, 64, 100):
        lengths = np.array(sorted(random.sample(range(1, size), min(size // 2, 20))))
        demand = np.array([random.randint(1, 40) for _ in lengths])
        for pattern, times in packing.cutting_stock(lengths, demand, size):
            assert pattern @ lengths <= size and times > 0
        plan = packing.places(dict(zip(lengths.tolist(), demand.tolist())), size)
        rest = np.repeat(lengths, demand)
        rank = np.concatenate([np.arange(n) for n in demand])
        which, part, sequence, offset = plan.parts(rest, rank)
        assert (np.bincount(which, part, minlength=len(rest)) == rest).all()
        order = np.lexsort((offset, sequence))
        ends = {}
        for s, o, n in zip(sequence[order].tolist(), offset[order].tolist(), part[order].tolist()):
            assert o == ends.get(s, 0)
            ends[s] = o + n
        assert all(e == size or e < size and e & (e - 1) == 0 for e in ends.values())
        assert sorted(ends) == list(range(len(ends)))


def test_joined_halves_are_the_whole():
    encoder = bpe.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    random.seed(3)
    pieces = ["a", "aa", "the", "ing", "é", "1", "!", "'s", "'", "漢", "tion", "  ", " ", "\n", "!!", "<|endoftext|>"]
    for _ in range(400):
        own = random.sample(pieces, random.choice([2, 5, 16]))
        text = "".join(random.choice(own) for _ in range(random.randint(1, 200)))
        parts = bpe.halves(text, random.randint(4, 60), encoder.special)
        assert "".join(p for p, _ in parts) == text
        joined = bpe.join_tree(encoder, [(encoder.whole(p), b) for p, b in parts], random.choice([1, 4, 16]))
        assert joined == encoder.whole(text)


def test_words_from_a_small_store_are_the_library_s():
    blanks = [" ", "  ", "\n", "\t", " ", "　", "\xa0", "\x1c", "\r\n", "\x85"]
    words = ["a", "the", "é", "é", "'s", "!", "22", "́", "漢", "Σ", "İ", "<|endoftext|>", "."]
    random.seed(5)
    texts = ["".join(random.choice(random.choice([blanks, words])) for _ in range(random.randint(0, 40)))
             for _ in range(1500)]
    for file in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        encoder = bpe.Encoder(public_tokenizers.path(file), stored_words=64)
        for at in range(0, len(texts), 50):
            own = texts[at:at + 50]
            theirs = encoder.tokenizer.encode_batch(own, add_special_tokens=False)
            assert encoder.encode_all(own) == [np.array(x.ids, dtype="<u4").tobytes() for x in theirs]


def test_long_repeats_without_levels():
    """Passages of half a text, equal words, and a sequence that fools sums without a prime."""
    import tracemalloc

    from gaugeline.llm import repetition

    def longest(symbols):
        symbols = np.array(symbols, dtype=np.uint64)
        return repetition.repeat_lengths(symbols, np.full(len(symbols), len(symbols)))

    def plain(symbols):
        n, out = len(symbols), []
        for i in range(n):
            best = 0
            for j in range(n):
                k = 0
                while i != j and max(i, j) + k < n and symbols[i + k] == symbols[j + k]:
                    k += 1
                best = max(best, k)
            out.append(best)
        return out

    random.seed(8)
    for _ in range(60):
        s = [random.randrange(3) for _ in range(random.randrange(1, 40))]
        assert longest(s).tolist() == plain(s)
    half = [random.randrange(10 ** 6) for _ in range(5000)]
    assert longest(half + half)[0] == 5000 and longest(half + [1] + half[1:])[1] == 4999
    morse = [bin(i).count("1") % 2 for i in range(4096)]
    other = [1 - x for x in morse]
    assert longest(morse + [7] + other).max() == longest([2 * x for x in morse] + [7] + [2 * x for x in other]).max()
    tracemalloc.start()
    assert longest([5] * 300_000)[0] == 299_999
    assert tracemalloc.get_traced_memory()[1] < 100_000_000
    tracemalloc.stop()


def test_joins_with_the_smallest_windows():
    import public_tokenizers
    from tokenizers import Tokenizer

    from gaugeline.llm import bpe

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    encoder = bpe.Encoder(path)
    text = "  aa  \u1680aaa  aa  \u1680aaa" * 3
    wanted = library.encode(text, add_special_tokens=False).ids
    for at in range(0, len(text) + 1):
        left, right = (encoder.whole(x) for x in (text[:at], text[at:]))
        for window in (1, 2, 4):
            assert np.frombuffer(encoder.join(left, right, window), dtype=bpe.IDS).tolist() == wanted


def test_band_widths_follow_the_similarity():
    from gaugeline.llm import minhash

    assert [minhash.band_rows(p) for p in (95, 85, 80, 70, 60, 50)] == [14, 7, 6, 4, 3, 2]
    for p in range(30, 100, 5):
        rows = minhash.band_rows(p)
        assert rows == 1 or (1 - (p / 100) ** rows) ** (minhash.BINS // rows) <= minhash.MISS


@pytest.mark.parametrize("percent", [50, 70, 85])
def test_near_duplicates_against_all_pairs(spark, percent):
    from gaugeline.llm import minhash

    draw = random.Random(percent)
    texts = []
    for _ in range(25):
        words = [f"w{draw.randrange(4000)}" for _ in range(draw.randrange(20, 120))]
        for _ in range(draw.randrange(1, 9)):
            own = list(words)
            for _ in range(draw.randrange(0, 6)):
                own[draw.randrange(len(own))] = f"v{draw.randrange(4000)}"
            texts.append(" ".join(own))
    texts += [texts[0]] * 700
    sets = []
    for t in texts:
        w = t.split()
        sets.append(frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)))
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if 100 * len(x & sets[j]) >= percent * len(x | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, percent=percent).collect()}
    assert got == {i: root(i) for i in range(len(texts))}


def test_vectors_of_any_size(spark):
    from gaugeline.llm import metric

    base = [[1.0, 0.0, 0.1], [1.0, 0.01, 0.1], [0.0, 1.0, 0.0]]
    rows = [(10 * k + i, [c * s for c in v], 0) for k, s in enumerate((1.0, 1e200, 1e-200, 1e-308)) for i, v in enumerate(base)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in metric.near_vectors(df).collect()}
    assert got == {i: ((3, 2) if i % 10 == 2 else (7, 0)) for i, _, _ in rows}


def test_least_ids_of_large_components(spark):
    from gaugeline.llm.components import with_least_id
    from gaugeline.session import settle

    rows = [(i, 1 if i % 3 == 0 else 2 if i % 3 == 1 else 1000 + i // 30) for i in range(3000)] + [(None, 5), (7, None)]
    df = settle(spark.createDataFrame(rows, "doc_id long, component long"))
    wanted = {}
    for i, c in rows:
        if c is not None and i is not None:
            wanted[c] = min(i, wanted.get(c, i))
    for large in (2, 500, 10 ** 6):
        got = sorted(((r.doc_id, r.component_id) for r in with_least_id(df, "doc_id", large).collect()), key=str)
        assert got == sorted(((i, wanted.get(c)) for i, c in rows if c is not None), key=str)
