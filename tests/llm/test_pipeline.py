"""The pipeline's stages, each against a plain version on its own input."""

import re
from collections import defaultdict

import corpus_pipeline
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gaugeline.llm import pii

FOLDER = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """What goes into each stage, and what comes out of the last."""
    home = tmp_path_factory.mktemp("steps")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs.toPandas()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(str(home / name))
        docs = spark.read.parquet(str(home / name))
        out.append(docs.toPandas())
    return out


def repeated(words, size):
    """Words in windows of this size that occur again."""
    places = defaultdict(list)
    for i in range(len(words) - size + 1):
        places[tuple(words[i:i + size])].append(i)
    return {j for at in places.values() if len(at) > 1 for i in at for j in range(i, i + size)}


def test_rules(steps):
    kept = set(steps[1].doc_id)
    assert 0 < len(kept) < len(steps[0])
    for i, text in zip(steps[0].doc_id, steps[0].text):
        words = WORD.findall(text)
        good = (len(words) >= 10 and 100 * len(repeated(words, 5)) <= 20 * len(words)
                and len(repeated(words, 10)) <= 0.15 * len(words) and not repeated(words, 101))
        assert (i in kept) == good


def test_classifier_keeps_the_good(steps):
    labels = pd.read_parquet(f"{FOLDER}/labels.parquet").set_index("doc_id").quality
    kept = set(steps[2].doc_id)
    known = [(i in kept, labels[i]) for i in steps[1].doc_id if i in labels]
    assert sum(k for k, q in known if q == 1) >= 0.98 * sum(q for _, q in known)
    assert sum(not k for k, q in known if q == 0) >= 0.8 * sum(1 - q for _, q in known)


def test_one_of_each_group_stays(steps):
    sets = {}
    for i, text in zip(steps[2].doc_id, steps[2].text):
        words = WORD.findall(text.translate(LOWER))
        sets[i] = {tuple(words[k:k + 5]) for k in range(max(len(words) - 4, 1))}
    holders = defaultdict(list)
    for i, own in sets.items():
        for s in own:
            holders[s].append(i)
    best = {i: i for i in sets}

    def root(i):
        while best[i] != i:
            i = best[i]
        return i

    for i, own in sets.items():
        for j in {j for s in own for j in holders[s] if j < i}:
            if 100 * len(own & sets[j]) >= 80 * len(own | sets[j]):
                a, b = root(i), root(j)
                best[max(a, b)] = min(a, b)
    assert set(steps[3].doc_id) == {i for i in sets if root(i) == i}
    assert len(steps[3]) < len(steps[2])


def test_personal_data_goes_and_the_rest_stays(steps):
    before = steps[3].set_index("doc_id")
    assert set(steps[4].doc_id) == set(steps[3].doc_id)
    changed = 0
    for r in steps[4].itertuples():
        spans = pii.rule_spans(before.text[r.doc_id])
        assert not pii.rule_spans(r.text) and r.n_chars == len(r.text)
        if not spans and "[" not in r.text:
            assert r.text == before.text[r.doc_id]
        elif spans:
            changed += 1
            assert all(before.text[r.doc_id][a:b] not in r.text for a, _, b in spans)
    assert changed


def test_packed_once_without_padding(steps):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: x.ids + [0] for i, x in zip(
        steps[4].doc_id, tokenizer.encode_batch(steps[4].text.tolist(), add_special_tokens=False))}
    pieces, rows = defaultdict(list), steps[5].sort_values(["doc_id", "start"])
    for r in rows.itertuples():
        own = [int.from_bytes(r.ids[k:k + 4], "little") for k in range(0, len(r.ids), 4)]
        assert r.start == len(pieces[r.doc_id]) and len(own) == r.length
        pieces[r.doc_id] += own
    assert dict(pieces) == ids
    filled = rows.groupby("sequence_id").length.sum()
    assert all(n == 1024 or n & (n - 1) == 0 for n in filled) and filled.max() <= 1024
