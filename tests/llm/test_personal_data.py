"""Personal data in forms that no fixed rule knows is found; numbers of other kinds are left."""

import random

import pytest

from gaugeline.llm import pii

FOUND = [
    ("email", "jane.doe (at) example (dot) org"), ("email", "jane_doe[at]mail.example.org"),
    ("phone", "555-123-4567"), ("phone", "(212) 555-0188"), ("phone", "212.555.0188"),
    ("card", "4111.1111.1111.1111"), ("card", "5500/0000/0000/0004"), ("ip", "10[.]20[.]30[.]40"),
]
LEFT = ["1234567890", "2024-03-17", "17.03.2024", "1 234 567", "7844238401328224", "4111.1111.1111.1112",
        "12345678.25", "1990-2005", "978-3-16-148410-0", "421[.]312[.]500[.]3", "3 @ 4.99 each"]


def words(draw, n):
    return " ".join("".join(draw.choice("aeilnorst") for _ in range(draw.randrange(2, 9))) for _ in range(n))


def card(draw):
    digits = "4" + "".join(draw.choice("0123456789") for _ in range(14))
    return next(digits + d for d in "0123456789" if pii._luhn(digits + d))


@pytest.fixture(scope="module")
def docs(spark):
    """Rule finds in running text, for the model to learn from."""
    draw = random.Random(7)
    finds = [
        lambda: f"{words(draw, 1)}.{draw.randrange(100)}@mail{draw.randrange(9)}.example.com",
        lambda: ".".join(str(draw.randrange(256)) for _ in range(4)), lambda: card(draw),
        lambda: f"+1 ({draw.randrange(200, 999)}) 555-{draw.randrange(10000):04}"]
    texts = [f"{words(draw, 12)} {finds[i % 4]()} {words(draw, 12)}" for i in range(600)]
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_other_forms_are_found_and_plain_numbers_left(spark, docs):
    model = pii.train(docs)
    draw = random.Random(8)
    planted = [(kind, form) for kind, form in FOUND] + [(None, form) for form in LEFT]
    texts = [f"{words(draw, 8)} {form} {words(draw, 8)}" for _, form in planted]
    assert not any(pii.rule_spans(t) for t in texts)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.find_spans(rows, model).collect()}
    clean = {r.doc_id: r.text for r in pii.redact(rows, model).collect()}
    for i, (kind, form) in enumerate(planted):
        at = texts[i].index(form)
        assert spans[i] == (f"{kind}:{at}:{at + len(form)}" if kind else ""), form
        assert clean[i] == (texts[i].replace(form, f"[{kind.upper()}]") if kind else texts[i])


def test_unknown_candidates_are_not_counter_examples():
    text = "one two 212.555.0188 three 4111/1111/1111/1111 four jane (at) example.org five"
    assert {text[a:b] for a, _, b in pii.candidates(text)} >= {"212.555.0188", "4111/1111/1111/1111", "jane (at) example.org"}
    labelled = {(own[a:b], kind) for own, (a, kind, b), *_ in pii.examples(text)}
    assert not labelled & {("212.555.0188", "phone"), ("4111/1111/1111/1111", "card"), ("jane (at) example.org", "email")}
