"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from gaugeline.llm import bpe, metric, minhash, packing, pii, quality, repetition, token_files, toxicity, warc

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LONG = " ".join(f"w{i * i % 7919}" for i in range(20000)) + "x" * 50000 + "é漢" * 3000
TEXTS = [
    (1, "one two three four five six seven eight nine ten eleven"), (2, None), (3, ""), (4, " \n\t "),
    (5, "one two three four five six seven eight nine ten eleven"), (None, "a null id"), (None, None),
    (1, "one two three four five six seven eight nine ten eleven"), (6, LONG), (7, "few words"),
    (8, "FEW WORDS"), (9, "mail a.b@c.example or +1 (555) 123-4567, 4111 1111 1111 1111, 10.0.0.1 <|endoftext|>"),
]
CLASH = ("kept", "n_words", "row", "ids", "body", "key", "k0", "score", "component", "spans", "n")


@pytest.fixture(scope="module", params=["rows", "empty"])
def docs(request, spark):
    df = spark.createDataFrame(
        [(i, t, "en", None, len(t or "")) for i, t in TEXTS],
        "doc_id long, text string, lang string, source string, n_chars long")
    df = df.withColumns({c: F.lit("clash") for c in CLASH})
    return df if request.param == "rows" else df.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(
        [(1, 1, 0), (5, 1, 0), (7, 0, 1), (8, 0, 1), (9, None, None), (None, 1, 1), (77, 1, 0)],
        "doc_id long, quality int, toxic int")


def got(df):
    return [r.asDict() for r in df.collect()]


def test_repetition(docs):
    out = got(repetition.repetition_rules(docs))
    assert len(out) == docs.count()
    for r in out:
        if r["doc_id"] in (2, 3, 4):
            assert r["n_words"] == 0 and r["base_failed"] and not r["kept"]
        if r["doc_id"] in (1, 5):
            assert r["kept"]
    passing = repetition.keep_passing(docs)
    assert passing.columns == docs.columns
    assert {r["doc_id"] for r in got(passing)} <= {1, 5, 6, 9}


def test_minhash(docs):
    out = got(minhash.near_duplicates(docs, percent=80))
    assert len(out) == docs.count()
    for r in out:
        if r["doc_id"] in (1, 5):
            assert r["component_id"] == 1 and r["kept"] == (r["doc_id"] == 1)
        if r["doc_id"] in (7, 8):
            assert r["component_id"] == 7 and r["n_shingles"] == 1
        if r["doc_id"] in (2, 3, 4):
            assert r["n_shingles"] == 0 and r["kept"]
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
    kept = minhash.keep_one(docs, percent=80)
    assert kept.columns == docs.columns
    if out:
        assert sorted(str(r["doc_id"]) for r in got(kept)) == sorted(
            map(str, [1, 1, 2, 3, 4, 6, 7, 9, None, None]))


def test_packing_of_a_large_vocabulary(spark, tmp_path):
    """Ids beyond two bytes stay whole."""
    import json

    from tokenizers import Tokenizer

    vocabulary = {f"w{i}": i for i in range(70_000)}
    file = {"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None,
            "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True},
            "post_processor": None, "decoder": None, "model": {}}
    file["model"] = json.load(open(BYTES))["model"]
    highest = max(file["model"]["vocab"].values())
    file["model"]["vocab"] |= {w: highest + 1 + i for w, i in vocabulary.items()}
    file["model"]["vocab"]["\u0120the"] = highest + len(vocabulary) + 1
    path = str(tmp_path / "large.json")
    json.dump(file, open(path, "w"))
    ids = Tokenizer.from_file(path).encode("one the two", add_special_tokens=False).ids
    assert max(ids) > 1 << 16
    df = spark.createDataFrame([(1, "one the two")], "doc_id long, text string")
    out = got(packing.pack(df, path, end_id=0, size=16))
    raw = b"".join(r["ids"] for r in sorted(out, key=lambda r: r["start"]))
    assert [int.from_bytes(raw[i:i + 4], "little") for i in range(0, len(raw), 4)] == [*ids, 0]


@pytest.mark.parametrize("data", [[], [
    (1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (3, [2.0, 0.0], 0), (4, [0.0, 0.0], 0), (5, None, 0),
    (6, [1.0, None], 0), (7, [float("nan"), 1.0], 0), (8, [float("inf"), 1.0], 0), (9, [1.0, 0.0], None),
    (10, [1.0, 0.0], 1), (11, [1.0, 0.0, 0.0], 0), (None, [1.0, 0.01], 0), (12, [], 0)]])
def test_vectors(spark, data):
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")
    df = df.withColumns({c: F.lit(1) for c in ("row", "node", "component", "copies")})
    out = {r["vec_id"]: r for r in got(metric.near_vectors(df, cell=2))}
    assert len(out) == len(data)
    for i, r in out.items():
        linked = i in (1, 2, 3, None)
        assert (r["n_links"], r["component_id"], r["kept"]) == (
            (3, 1, i == 1) if linked else (0, i, True))


def test_vectors_in_many_cells_and_blocks(spark):
    import numpy as np

    random = np.random.RandomState(1)
    base = random.normal(size=(30, 8))
    x = base[random.randint(0, 30, 600)] + random.normal(size=(600, 8)) * 0.12
    x[100:160] = x[100]
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)],
                               "vec_id long, embedding array<double>, label int")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = unit @ unit.T >= 0.98
    np.fill_diagonal(near, False)
    out = got(metric.near_vectors(df, cell=60, block=50))
    assert {r["vec_id"]: r["n_links"] for r in out} == dict(enumerate(near.sum(axis=1)))
    assert near.sum() > 4000


def test_quality(docs, labels):
    stats = quality.document_statistics(docs)
    for known in (labels, labels.limit(0)):
        model = quality.fit(quality.training_rows(stats, known, "quality"))
        out = got(quality.score(stats, model))
        assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)
        good = quality.keep_good(docs, model)
        assert good.columns == docs.columns and good.count() <= docs.count()


def test_toxicity(docs, labels):
    for known in (labels, labels.limit(0)):
        found = toxicity.find_segments(docs, toxicity.learn(docs, known))
        out = got(toxicity.score(found, toxicity.fit_law(found, known)))
        assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)


def test_encoding(docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BYTES)
    ids = bpe.encode_texts(docs, BYTES, keep=("doc_id", "text"), chunk_chars=1000)
    out = got(bpe.decode_ids(ids, BYTES, keep=("doc_id", "text", "ids"), to="again"))
    assert len(out) == docs.count()
    for r in out:
        own = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids
        assert len(r["ids"]) == 4 * len(own) and r["again"] == (r["text"] or "")
        assert r["ids"] == b"".join(i.to_bytes(4, "little") for i in own)


def test_token_files(docs, tmp_path):
    folder = token_files.write_token_files(docs, str(tmp_path / "t"), WORDS, end_id=2)
    out = sorted(got(token_files.read_token_files(docs.sparkSession, folder)), key=lambda r: r["start"])
    at = 0
    for r in out:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) and r["ids"][-1] == 2
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in out]
    assert len(out) == docs.count() and ids == sorted(ids, key=lambda i: -1 if i is None else i)


def test_packing(docs):
    out = got(packing.pack(docs, BYTES, size=64))
    ends = {}
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0) and len(r["ids"]) == 4 * r["length"]
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(e <= 64 and (e == 64 or e & (e - 1) == 0) for e in ends.values())
    assert sum(r["start"] == 0 for r in out) == docs.count()


def test_personal_data(docs):
    model = pii.train(docs)
    out = {r["doc_id"]: r for r in got(pii.find_spans(docs, model))}
    clean = pii.redact(docs, model)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    if out:
        r = out[9]
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [1, 1, 1, 1]
        text = {x["doc_id"]: x["text"] for x in got(clean)}[9]
        assert text.startswith("mail [EMAIL] or [PHONE], [CARD], [IP]")
        assert out[2]["spans"] == ""


@pytest.mark.parametrize("data", [[], [
    (1, "http://a/", "same"), (2, None, "same"), (2, "b\r\nc", "same"), (3, "d", None), (4, "e", ""),
    (None, "f", "same"), (None, None, None), (5, "g", "é" * 70000), (6, "h", "single")]])
def test_warc(spark, tmp_path, data):
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    df = df.withColumns({c: F.lit("x") for c in ("record", "digest", "n", "latest", "payload", "data")})
    folder = warc.write_archive(df, str(tmp_path / "w"), chunk_bytes=1000)
    out = got(warc.read_records(spark, folder))
    assert len(out) == len(data)
    types = sorted((str(r["page_id"]), r["record_type"], str(r["refers_to"])) for r in out)
    if data:
        assert types == sorted([
            ("1", "revisit", "2"), ("2", "response", "None"), ("2", "response", "None"),
            ("3", "revisit", "4"), ("4", "response", "None"), ("None", "revisit", "2"),
            ("None", "revisit", "4"), ("5", "response", "None"), ("6", "response", "None")])
        assert {r["page_id"]: r["payload_bytes"] for r in out}[5] == 140000


def test_warc_bytes_and_damage(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://a/", "x" * 2500)], "page_id long, url string, html string")
    folder = warc.write_archive(df, str(tmp_path / "w"), chunk_bytes=1000)
    chunks = spark.read.parquet(folder).orderBy("record", "chunk_no").collect()
    whole = b"".join(c.data for c in chunks)
    assert whole.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and whole.endswith(b"\r\n\r\n")
    head, _, rest = whole.partition(b"\r\n\r\n")
    assert b"Content-Length: 2500" in head and rest == b"x" * 2500 + b"\r\n\r\n"
    assert [len(c.data) for c in chunks][1:-1] == [1000, 1000, 500]
    spark.read.parquet(folder).withColumn(
        "data", F.when(F.col("chunk_no") == 2, F.lit("y" * 1000).cast("binary")).otherwise(F.col("data"))
    ).write.parquet(str(tmp_path / "bad"))
    with pytest.raises(Exception, match="does not match its digest"):
        warc.read_records(spark, str(tmp_path / "bad")).collect()


def test_warc_records_cut_by_splits(spark, tmp_path):
    """Row groups and splits far smaller than a record; a payload that a third of all pages share."""
    data = [(i, f"http://{i}/", "same" * 5000 if i % 3 == 0 else str(i) * (i * 97 % 9000)) for i in range(200)]
    df = spark.createDataFrame(data, "page_id long, url string, html string").repartition(2)
    folders = [str(tmp_path / n) for n in ("sent", "joined")]
    for folder, most in zip(folders, (10, 0)):
        chunks = warc.chunk_table(df, chunk_bytes=1000, sent_payloads=most)
        chunks.write.option("parquet.block.size", 4096).option("parquet.page.size.row.check.min", 1).option(
            "parquet.block.size.row.check.min", 1).parquet(folder)
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40k")
    try:
        chunks = spark.read.parquet(folders[0])
        assert chunks.rdd.getNumPartitions() > 20
        first = chunks.select("record", "chunk_no", "data", "running_sha1").mapInArrow(
            warc._records(whole=False), warc._READ)
        assert first.where("left_over IS NOT NULL").count() > 2
        results = [sorted((tuple(r) for r in warc.read_records(spark, f).collect()), key=str) for f in folders]
        long = chunks.where("chunk_no = 4").first()["record"]
        for no, message in ((3, "missing"), (0, "begins")):
            bad = str(tmp_path / f"bad{no}")
            chunks.where(f"NOT (record = {long} AND chunk_no = {no})").write.parquet(bad)
            with pytest.raises(Exception, match=message):
                warc.read_records(spark, bad).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert results[0] == results[1] and len(results[0]) == 200
    import base64
    import hashlib

    latest = {}
    for i, _, html in data:
        latest[html] = max(i, latest.get(html, i))
    wanted = sorted(((i, len(html), base64.b32encode(hashlib.sha1(html.encode()).digest()).decode(),
                      "response" if latest[html] == i else "revisit", None if latest[html] == i else latest[html], url)
                     for i, url, html in data), key=str)
    assert results[0] == wanted


def test_pipeline_stages(spark, docs, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = out
        stage(spark, before, str(tmp_path)).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if i < 4:
            assert out.columns == docs.columns
            assert out.count() <= before.count()
    assert set(out.columns) >= {"doc_id", "start", "length", "sequence_id", "offset"}
