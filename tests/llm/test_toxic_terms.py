"""A word of toxic texts only is a term of the lexicon, however large the tables are."""

import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from gaugeline.llm import toxicity
from gaugeline.llm.text import texts_of

IDS = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 5]


@pytest.mark.parametrize("tens", [60, 6000])
def test_words_of_one_side_are_told(spark, tens):
    plain = "one two three four five six seven eight nineteen seventeen " * tens
    rows = [(plain + "kindly ", 0) for _ in range(90)] + [(plain + "grobnak " * 5 + "kindly ", 1) for _ in range(10)]
    table = spark.createDataFrame([(i, t, y) for i, (t, y) in zip(IDS, rows)], "doc_id long, text string, toxic int")
    lexicon = toxicity.learn(table.drop("toxic"), table.drop("text"))
    texts = next(iter(texts_of(pa.array(["grobnak grobbing kindly one unknown"]))))
    _, scores = lexicon.scores(texts)
    assert scores[0] > 0 and scores[1] > 0
    assert (scores[2:] == -lexicon.drift).all()


def test_terms_in_blocks_score_as_all_at_once(spark):
    """No term is left out where a lexicon is too large to be sent."""
    draw = random.Random(5)
    vocabulary = ["".join(draw.choice("abcdefgh") for _ in range(draw.randrange(2, 9))) for _ in range(300)]
    rows = [(i, " ".join(draw.choice(vocabulary[:200] if i % 2 else vocabulary[100:]) for _ in range(60)), i % 2)
            for i in range(400)] + [(900, None, 0), (901, "", 1), (None, "abc abc", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    docs, labels = table.drop("toxic"), table.select("doc_id", "toxic")
    one, many = toxicity.learn(docs, labels), toxicity.learn(docs, labels, sent_terms=40)
    assert one.table is None and many.blocks > 3 and len(one.hashes) > 120
    found = [sorted(map(str, toxicity.find_segments(docs, x).collect())) for x in (one, many)]
    assert found[0] == found[1] and len(found[0]) == len(rows)


def plain_score(rows, labels, held):
    """Lexicon, segments, law and curve, recounted over dictionaries of words."""
    words = {i: re.findall(r"[A-Za-z]+", t or "") for i, t in rows}
    train = {i: y for i, y in labels if not held(i)}
    kinds = lambda w: [(0, w.lower()), *((k, w.lower()[:n]) for k, n in enumerate((4, 5, 6), 1) if len(w) > n)]
    counts, sums = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for i, y in train.items():
        for w in words[i]:
            for term in kinds(w):
                counts[term][y] += 1
                sums[term[0]][y] += 1
    odds = {}
    for (kind, w), (good, bad) in counts.items():
        n_good, n_bad = sums[kind]
        share = 500.0 * (good + bad) / (n_good + n_bad)
        even_bad, even_good = n_bad / (n_good + n_bad), n_good / (n_good + n_bad)
        b, g = bad + share + even_bad, good + share + even_good
        value = math.log(b / (n_bad + 500 + even_bad - b)) - math.log(g / (n_good + 500 + even_good - g))
        if abs(value / math.sqrt(1 / b + 1 / g)) >= 2.5:
            odds[kind, w] = value

    def cut(s):
        best = max(((round(sum(s[i:j]), 9), -(j - i), -i) for i in range(len(s)) for j in range(i + 1, len(s) + 1)),
                   default=(0, 0, 0))
        if best[0] <= 0:
            return []
        i = -best[2]
        return cut(s[:i]) + [best[0]] + cut(s[i - best[1]:])

    segments = {i: cut([max((odds[t] for t in kinds(w) if t in odds), default=0.0) - 2.0 for w in ws])
                for i, ws in words.items()}
    clean = [i for i, y in train.items() if y == 0 and words[i]]
    tops = [max(segments[i], default=0.0) for i in clean]
    rate = min(max(math.pi / (math.sqrt(6) * max(np.std(tops), 1e-9)), 0.2), 2.0)
    scale = 1 / np.mean([len(words[i]) * math.exp(-rate * t) for i, t in zip(clean, tops)])

    def evidence(i):
        logs = [rate * s - math.log(scale) - math.log(len(words[i])) for s in segments[i]]
        return max([*logs, sum(x for x in logs if x > 0)])

    return {i: evidence(i) for i in words}, segments


def test_score_against_a_plain_recount(spark):
    draw = random.Random(6)
    clean = ["table", "river", "stone", "cloud", "paper", "green", "walk", "slow"]
    bad = ["grobnak", "vexling", "snarfed"]
    rows, labels = [], []
    for i in range(2000):
        y = int(i % 4 == 0)
        ws = [draw.choice(clean) for _ in range(draw.randrange(3, 14))]
        for _ in range(draw.randrange(1, 4) if y else i % 61 == 1):
            ws.insert(draw.randrange(len(ws)), draw.choice(bad))
        rows.append((i, " ".join(ws)))
        labels.append((i, y))
    rows += [(5000, None), (5001, "... 12")]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    found = toxicity.find_segments(docs, toxicity.learn(docs, known))
    law = toxicity.fit_law(found, known)
    evidence, segments = plain_score(rows, labels, held)
    mine = {r.doc_id: [s.score for s in r.segments] for r in found.collect()}
    assert any(segments.values())
    for i, own in segments.items():
        assert mine[i] == pytest.approx(own)
    for r in toxicity.score(found, law).collect():
        e = evidence[r.doc_id]
        wanted = 1 / (1 + math.exp(-(law.slope * e + law.shift)))
        assert r.score == pytest.approx(wanted) and r.predicted == int(wanted >= 0.5)
    right = [r.predicted == dict(labels)[r.doc_id] for r in toxicity.score(found, law).collect() if r.doc_id < 5000]
    assert np.mean(right) > 0.85
