"""Queries over whole tables, one for each operator, with SQL where SQL can say the same."""

from __future__ import annotations

import functools
import os
import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.llm.bpe import decode_ids, encode_texts
from gaugeline.llm import pii, quality, toxicity
from gaugeline.llm.clustering import cluster_vectors
from gaugeline.llm.contamination import contamination
from gaugeline.llm.divergence import source_divergence
from gaugeline.llm.metric import near_vectors
from gaugeline.llm.minhash import near_duplicates
from gaugeline.llm.packing import pack
from gaugeline.llm.repetition import repetition_rules
from gaugeline.llm.token_files import read_token_files, with_crc32, write_token_files
from gaugeline.llm.warc import read_records, write_archive
from gaugeline.session import settle, shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


#: Rows handed to a Python worker at once, where the session keeps Spark's 10,000: whole texts and
#: pages are large rows.
ROWS_AT_ONCE = "2000"


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it, with modest batches."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_AT_ONCE)
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])


def registered(sql: str | None = None):
    def add(query: Query) -> Query:
        @functools.wraps(query)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            importable(spark)
            return query(spark, folder)

        QUERIES[query.__name__] = run
        if sql:
            SQL[query.__name__] = sql
        return query

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors reach."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_REPEATS_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d),
w5 AS (SELECT *, hash(word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o,
    lead(word, 4) OVER o) AS h5, count(*) OVER (PARTITION BY doc_id) - i + 1 AS room
  FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
w10 AS (SELECT *, hash(h5, lead(h5, 5) OVER o) AS h10 FROM w5
  WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
w50 AS (SELECT *, hash(h10, lead(h10, 10) OVER o, lead(h10, 20) OVER o, lead(h10, 30) OVER o,
    lead(h10, 40) OVER o) AS h50 FROM w10 WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
w101 AS (SELECT *, hash(h50, lead(h50, 50) OVER o, lead(word, 100) OVER o) AS h101 FROM w50
  WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
again AS (SELECT doc_id, i,
    room >= 5 AND count(*) FILTER (room >= 5) OVER (PARTITION BY doc_id, h5) > 1 AS r5,
    room >= 10 AND count(*) FILTER (room >= 10) OVER (PARTITION BY doc_id, h10) > 1 AS r10,
    room >= 101 AND count(*) FILTER (room >= 101) OVER (PARTITION BY doc_id, h101) > 1 AS r101
  FROM w101),
cover AS (SELECT doc_id, r101,
    max(r5::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS 4 PRECEDING) AS c5,
    max(r10::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS 9 PRECEDING) AS c10 FROM again),
sums AS (SELECT doc_id, count(*) AS n_words, sum(c5)::BIGINT AS n5, sum(c10)::BIGINT AS n10,
    bool_or(r101) AS too_long FROM cover GROUP BY doc_id),
ln AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM ln
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words,
  length(array_to_string(words, '')) AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(dup.n, 0) AS n_dup_lines, coalesce(n5, 0) AS n_repeat_words,
  coalesce(n_words, 0) < 10 OR 100 * n5 > 20 * n_words AS base_failed,
  coalesce(NOT (n_words < 10 OR 100 * n5 > 20 * n_words) AND n10 <= 0.15 * n_words
    AND NOT too_long, FALSE) AS kept
FROM d LEFT JOIN sums USING (doc_id) LEFT JOIN dup USING (doc_id)
"""


@registered(_REPEATS_SQL)
def op1_suffix_repetition(spark: SparkSession, folder: str) -> DataFrame:
    return repetition_rules(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )


@registered()
def op2_metric_join(spark: SparkSession, folder: str) -> DataFrame:
    found = near_vectors(table(spark, folder, "embeddings"), least_cosine=0.98)
    return found.select("vec_id", "n_links", F.col("component_id").cast("long").alias("component_id"), "kept")


@registered()
def op3_minhash_stars(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"), percent=85)


@registered()
def op4_fourier_quality(spark: SparkSession, folder: str) -> DataFrame:
    stats = settle(quality.document_statistics(table(spark, folder, "documents")))
    model = quality.fit(quality.training_rows(stats, table(spark, folder, "labels"), "quality"))
    return quality.score(stats, model).select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@registered()
def op6_cutting_stock(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return pack(table(spark, folder, "documents"), path, end_id=0).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@registered()
def op7_toxic_segments(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    found = settle(toxicity.find_segments(docs, toxicity.learn(docs, labels)))
    scored = toxicity.score(found, toxicity.fit_law(found, labels))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"),
                         "score", "predicted", F.size("passages").alias("n_passages"))


_WARC_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS hexed,
    list_transform(range(32), lambda i: (('0x' || substr(sha1(b), 10 * (i // 8) + 1, 10))::BIGINT
      >> (35 - 5 * (i % 8))) & 31) AS letters FROM p),
r AS (SELECT *, max(page_id) OVER (PARTITION BY hexed) AS latest FROM h)
SELECT page_id, payload_bytes, list_reduce(list_transform(letters,
    lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (i + 1)::INT, 1)),
    lambda x, y: x || y) AS payload_digest,
  CASE WHEN page_id = latest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> latest THEN latest END AS refers_to
FROM r
"""


@registered(_WARC_SQL)
def op5_warc_chunks(spark: SparkSession, folder: str) -> DataFrame:
    archive = write_archive(table(spark, folder, "pages"), scratch(spark, "warc"))
    return read_records(spark, archive).drop("target_uri")


@registered()
def op8_bpe_tree(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    ids = encode_texts(table(spark, folder, "documents"), path)
    decoded = decode_ids(ids, path, keep=("doc_id", "ids"))
    return decoded.select(
        "doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


@registered()
def op9_pii_boosting(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return pii.find_spans(docs, pii.train(docs)).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone",
        F.sha2(F.col("rule_spans").cast("binary"), 256).alias("base_sha256"), "spans")


@registered()
def op10_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    files = write_token_files(
        table(spark, folder, "documents"), scratch(spark, "tokens"), path, end_id=2)
    return with_crc32(read_token_files(spark, files))


_LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ITEM_WORDS_SQL = rf"regexp_extract_all({_LOWER_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_WINDOWS_SQL = f"""
WITH dw AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i, len(words) AS total
  FROM (SELECT doc_id, {_ITEM_WORDS_SQL} AS words FROM documents)),
bw AS (SELECT item_id, unnest(words) AS word, generate_subscripts(words, 1) AS i, len(words) AS total
  FROM (SELECT item_id, {_ITEM_WORDS_SQL} AS words FROM benchmark)),
b AS (SELECT item_id, least(total, 10) AS size, array_to_string(ten[1:least(total, 10)], ' ') AS passage
  FROM (SELECT *, [word, {", ".join(f"lead(word, {k}) OVER o" for k in range(1, 10))}] AS ten FROM bw
    WINDOW o AS (PARTITION BY item_id ORDER BY i)) WHERE i + least(total, 10) - 1 <= total),
d AS (SELECT doc_id, i, size, array_to_string(ten[1:size], ' ') AS passage
  FROM (SELECT *, [word, {", ".join(f"lead(word, {k}) OVER o" for k in range(1, 10))}] AS ten FROM dw
    WINDOW o AS (PARTITION BY doc_id ORDER BY i)) JOIN (SELECT DISTINCT size FROM b) ON i + size - 1 <= total),
found AS (SELECT doc_id, i, size, item_id FROM d JOIN b USING (size, passage)),
hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + size)) AS place FROM found) GROUP BY doc_id),
held AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n_words FROM dw GROUP BY doc_id) USING (doc_id)
LEFT JOIN hit USING (doc_id) LEFT JOIN held USING (doc_id)
"""


@registered(_WINDOWS_SQL)
def op11_benchmark_automaton(spark: SparkSession, folder: str) -> DataFrame:
    found = contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


def _kmeans_sql(k: int = 16, rounds: int = 3) -> str:
    nearest = """
a{r} AS MATERIALIZED (SELECT row, vec_id, v, min(struct_pack(d := d, c := c)) AS near FROM (
  SELECT x.row, x.vec_id, x.v, c.c, list_sum(list_transform(range(1, 65),
    lambda i: (x.v[i] - c.v[i]) * (x.v[i] - c.v[i])))::BIGINT AS d FROM x, c{r} c) GROUP BY row, vec_id, v)"""
    moved = """
s{r} AS (SELECT c, i, sum(y)::HUGEINT AS s, count(*) AS n FROM (
  SELECT near.c AS c, unnest(v) AS y, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY c, i),
m{r} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM s{r} GROUP BY c),
c{n} AS MATERIALIZED (SELECT c, coalesce(m{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN m{r} USING (c))"""
    steps = [f"""
x AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id,
    list_transform(embedding, lambda y: floor(64 * y::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND list_count(embedding) = 64
    AND len(list_filter(embedding, lambda y: NOT isfinite(y))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (
  SELECT sha256('1:' || vec_id) AS h, v FROM x ORDER BY h, v LIMIT {k}))"""]
    for r in range(rounds):
        steps += [nearest.format(r=r), moved.format(r=r, n=r + 1)]
    steps.append(nearest.format(r=rounds))
    return f"""WITH {",".join(steps)}
SELECT vec_id, near.c::INT AS cluster, near.d AS distance,
  (sum(near.d) OVER (PARTITION BY near.c))::BIGINT AS cluster_inertia, (sum(near.d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} c ON near.c = c.c"""


@registered(_kmeans_sql())
def op12_shallot_clusters(spark: SparkSession, folder: str) -> DataFrame:
    members, clusters = cluster_vectors(table(spark, folder, "embeddings"))
    digest = F.sha2(F.array_join(F.transform("centroid", lambda x: x.cast("string")), ",").cast("binary"), 256)
    # One row a cluster: as many as the parameter k says.
    clusters = clusters.select("cluster", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))
    return members.join(F.broadcast(clusters), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


_DIVERGENCE_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all({_LOWER_SQL}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
uses AS (SELECT row, lang, source, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term FROM uses GROUP BY lang, term HAVING count(DISTINCT row) >= 3),
counts AS (SELECT lang, source, term, count(*) AS n FROM uses JOIN kept USING (lang, term) GROUP BY ALL),
vocab AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT lang, source, coalesce(v, 0) AS v, coalesce(total, 0) + coalesce(v, 0) AS whole
  FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN vocab USING (lang)
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM counts GROUP BY ALL) USING (lang, source)),
cells AS (SELECT lang, source, term, coalesce(n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(n, 0) + 1)) // whole AS p
  FROM groups JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)),
of_lang AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 1)) // any_value(whole) AS q
  FROM counts JOIN (SELECT lang, sum(total) + any_value(v) AS whole FROM
    (SELECT lang, source, sum(n) AS total FROM counts GROUP BY ALL) JOIN vocab USING (lang) GROUP BY lang)
    USING (lang) GROUP BY lang, term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
telling AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value
  FROM cells JOIN of_lang USING (lang, term) WHERE n > 0 AND p > q)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM telling)
QUALIFY part = 'pair' OR rank <= 200
"""


@registered(_DIVERGENCE_SQL)
def op13_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return source_divergence(table(spark, folder, "documents"))
