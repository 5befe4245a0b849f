"""The registered queries against SQL or plain Python over the whole smallest tables."""

import hashlib
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gaugeline.llm import queries

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def read(name):
    return pd.read_parquet(f"{FOLDER}/{name}.parquet")


def rows(spark, name):
    return queries.QUERIES[name](spark, FOLDER).toPandas()


def smallest(links, ids):
    """Smallest reachable id of each id."""
    best = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(best[a], best[b])
            if best[a] != low or best[b] != low:
                best[a] = best[b] = low
                changed = True
    return best


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    theirs, mine = con.execute(queries.SQL[name]).df(), rows(spark, name)
    columns = sorted(theirs.columns)
    assert sorted(mine.columns) == columns
    as_text = [sorted(x[columns].astype(str).replace("<NA>", "nan").to_numpy().tolist()) for x in (mine, theirs)]
    assert as_text[0] == as_text[1]


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(len(words) - 4, 1)))


def test_minhash_against_all_pairs(spark):
    docs = read("documents")
    sets = {i: shingles(t) for i, t in zip(docs.doc_id, docs.text)}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:]
             if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    best = smallest(links, ids)
    assert links
    for r in rows(spark, "op3_minhash_stars").itertuples():
        assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), best[r.doc_id])
        assert r.kept == (r.doc_id == r.component_id)


def test_vectors_against_all_pairs(spark):
    table = read("embeddings")
    x = np.stack(table.embedding.to_numpy()).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = (x @ x.T >= 0.98) & (table.label.to_numpy()[:, None] == table.label.to_numpy()[None, :])
    np.fill_diagonal(near, False)
    ids = table.vec_id.tolist()
    best = smallest([(ids[i], ids[j]) for i, j in zip(*np.nonzero(near))], ids)
    degree = dict(zip(ids, near.sum(axis=1)))
    for r in rows(spark, "op2_metric_join").itertuples():
        assert (r.n_links, r.component_id) == (degree[r.vec_id], best[r.vec_id])


@pytest.mark.parametrize("name, label, least", [
    ("op4_fourier_quality", "quality", 0.9), ("op7_toxic_segments", "toxic", 0.85)])
def test_held_out_accuracy(spark, name, label, least):
    got = queries.QUERIES[name](spark, "/root/testdata/sf0.01").toPandas()
    assert got.score.between(0, 1).all() and len(got) == 1000
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    labels = pd.read_parquet("/root/testdata/sf0.01/labels.parquet")
    held = got[got.held_out].merge(labels, on="doc_id")
    assert (held.predicted == held[label]).mean() >= least


def tokens(file, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(file))
    return [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)], tokenizer


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_encoding_against_the_library(spark):
    docs = read("documents")
    ids, tokenizer = tokens("byte_bpe_50k.json", docs.text.tolist())
    got = rows(spark, "op8_bpe_tree").set_index("doc_id")
    for i, own in zip(docs.doc_id, ids):
        assert got.n_tokens[i] == len(own)
        assert got.ids_sha256[i] == hashlib.sha256(np.array(own, dtype="<u4").tobytes()).hexdigest()
        text = tokenizer.decode(own, skip_special_tokens=False)
        assert got.decoded_sha256[i] == hashlib.sha256(text.encode()).hexdigest()


def test_token_files_against_the_library(spark):
    docs = read("documents").sort_values("doc_id")
    ids, _ = tokens("word_bpe_49k.json", docs.text.tolist())
    got = rows(spark, "op10_token_files").set_index("doc_id")
    start = 0
    for i, own in zip(docs.doc_id, ids):
        own = own + [2]
        assert (got.start[i], got.n_tokens[i], got.ids_crc32[i]) == (start, len(own), crc(own))
        start += len(own)


def test_packing_covers_each_id_once(spark):
    docs = read("documents")
    ids = dict(zip(docs.doc_id, tokens("byte_bpe_50k.json", docs.text.tolist())[0]))
    got, filled, seen = rows(spark, "op6_cutting_stock"), defaultdict(list), defaultdict(int)
    for r in got.sort_values(["doc_id", "start"]).itertuples():
        own = ids[r.doc_id] + [0]
        assert (r.doc_tokens, r.start) == (len(own), seen[r.doc_id])
        assert r.ids_crc32 == crc(own[r.start:r.start + r.length])
        seen[r.doc_id] += r.length
        filled[r.sequence_id].append((r.offset, r.length))
    assert {i: len(x) + 1 for i, x in ids.items()} == dict(seen)
    for parts in filled.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end == 1024 or end < 1024 and end & (end - 1) == 0


def test_rules_for_personal_data_against_plain_expressions(spark):
    kinds = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": "[0-9]([\x20-]?[0-9])+", "phone": "\\+[0-9][\x20().0-9-]+[0-9]",
    }

    def holds(kind, part):
        digits = re.sub("[^0-9]", "", part)
        if kind == "ip":
            return all(int(x) <= 255 for x in part.split("."))
        if kind == "card":
            total = sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10))
                        for k, d in enumerate(reversed(digits)))
            return 12 <= len(digits) <= 19 and total % 10 == 0
        return kind == "email" or 9 <= len(digits) <= 15

    texts = dict(zip(read("documents").doc_id, read("documents").text))
    found = 0
    for r in rows(spark, "op9_pii_boosting").itertuples():
        spans = [(m.start(), list(kinds).index(k), k, m.end()) for k, p in kinds.items()
                 for m in re.finditer(p, texts[r.doc_id]) if holds(k, m.group())]
        plain = [f"{k}:{a}:{b}" for a, _, k, b in sorted(spans)]
        assert r.base_sha256 == hashlib.sha256(",".join(plain).encode()).hexdigest()
        assert set(plain) <= set(r.spans.split(","))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [
            sum(p.startswith(k) for p in plain) for k in kinds]
        found += len(plain)
    assert found
