"""Scans over one text take time in proportion to it, and find what the plain forms find."""

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeline.llm import pii, toxicity

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": "[0-9]([\x20-]?[0-9])+", "phone": "\\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, part):
    digits = re.sub("[^0-9]", "", part)
    if kind == "ip":
        return all(int(x) <= 255 for x in part.split("."))
    if kind == "card":
        total = sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits)))
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def test_rules_against_plain_expressions():
    draw = random.Random(3)
    order = list(PATTERNS)
    found = 0
    for i in range(20_000):
        signs = ["01 +-.()5", "0123456789", "a1.@-_", "+1 ().-@a", "4 -11", "12.0"][i % 6]
        text = "".join(draw.choice(signs) for _ in range(draw.randrange(40)))
        plain = sorted((m.start(), order.index(k), k, m.end()) for k, p in PATTERNS.items()
                       for m in re.finditer(p, text) if holds(k, m.group()))
        assert pii.rule_spans(text) == [(a, k, b) for a, _, k, b in plain], text
        found += len(plain)
    assert found > 1000


def old_touches(s, others):
    return any(s[0] < r[2] and r[0] < s[2] for r in others)


def test_taken_spans_against_all_spans():
    draw = random.Random(4)
    for _ in range(50):
        spans = [(a, "ip", a + draw.randrange(1, 700)) for a in (draw.randrange(20_000) for _ in range(40))]
        taken, held = pii.Taken(spans[:20]), spans[:20]
        for s in spans[20:]:
            assert taken.touches(s) == old_touches(s, held)
            if not taken.touches(s):
                taken.add(s)
                held.append(s)


def test_long_addresses_and_numbers_are_proposed_whole():
    local = "a" * 65
    text = f"x {local}(at)example.org, {'b' * 300}@host.example! 1 2 3 4 5 6 7 8 9 0 1 2 and 555{' ' * 70}123 4567"
    spans = {(text[a:b], kind) for a, kind, b in pii.candidates(text)}
    assert (f"{local}(at)example.org", "email") in spans and (f"{'b' * 300}@host.example", "email") in spans
    assert ("1 2 3 4 5 6 7 8 9 0 1 2", "card") in spans and (f"555{' ' * 70}123 4567", "phone") in spans
    assert not any(x.startswith("a" * 3 + "(at)") for x, _ in spans)


def plain_model():
    return pii.Model(0.0, ((np.array([-1]), np.zeros(1), np.zeros(1, int), np.zeros(1, int), np.array([3.0])),),
                     {k: 0.5 for k in pii.KINDS})


@pytest.mark.parametrize("unit, size", [
    ("jane@host.example 10.0.0.1 ", 1), ("+", 10), ("+ (", 4), ("@", 10), ("a@", 4), ("(", 10), ("1 - ", 1),
    ("a.b(at)", 1), ("212.555.0188 ", 1), ("1.", 2), (" at ", 2), ("word ", 10)])
def test_texts_of_some_megabytes_end_soon(unit, size):
    """Time doubles with the text, about; each would take minutes to days if it went with the square."""
    text = unit * (size * 100_000 // len(unit))
    pii.judged_spans(text[: len(text) // 10], plain_model())
    start = time.perf_counter()
    pii.judged_spans(text, plain_model())
    sum(1 for _ in pii.examples(text[: len(text) // 10]))
    assert time.perf_counter() - start < 40


def test_ten_megabytes_of_signs_and_toxic_words_end_soon():
    start = time.perf_counter()
    assert pii.rule_spans("+" * 10_000_000) == []
    assert pii.rule_spans("jane@host.example " * 500_000)[-1][1] == "email"
    scores = np.tile([1.0, -3.0], 1_000_000)
    assert len(toxicity.segments(scores)) == 1_000_000
    assert len(toxicity.segments(-np.abs(scores))) == 0
    drift = np.tile([2.0, -1.0], 1_000_000)
    assert [x[:2] for x in toxicity.segments(drift)] == [(0, 1_999_999)]
    random.seed(1)
    rough = np.array([random.uniform(-3, 2.4) for _ in range(1_000_000)])
    assert len(toxicity.segments(rough)) > 1000
    assert time.perf_counter() - start < 60


def test_a_rare_kind_in_a_large_table(spark):
    """Thresholds of a kind do not depend on how many examples the other kinds have."""
    draw = random.Random(9)
    word = lambda: "".join(draw.choice("aeilnorst") for _ in range(6))
    rows = [f"{word()} {word()} call +1 ({draw.randrange(200, 999)}) 555-{draw.randrange(10000):04} {word()}"
            for _ in range(900)] + [f"{word()} mail {word()}@{word()}.example {word()}" for _ in range(12)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    copies = df.where("doc_id = 5").crossJoin(spark.range(800)).select("doc_id", "text")
    model = pii.train(df.unionByName(copies), most_candidates=2000)
    assert np.isfinite(model.least["email"]) and np.isfinite(model.least["phone"])
    text = f"{word()} {word()} (at) {word()}.example {word()}"
    assert [s[1] for s in pii.judged_spans(text, model)[1]] == ["email"]


def test_finds_are_held_back_whole(spark):
    df = spark.createDataFrame([(1, "call +1 (212) 555-0188 now or +1 (213) 555-0199")], "doc_id long, text string")
    by_find = pii.candidate_table(df).groupBy("find").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("y"))
    made = [r for r in by_find.collect() if r.y]
    assert len(made) == 2 and all(r.n > 8 for r in made)
