"""Registered queries of the operators: whole tables in, one row per document, page, piece or hit out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    cost_packing,
    decision_list,
    exact_dedup,
    fill_in_middle,
    kneser_ney,
    line_templates,
    lsh_forest,
    periodic_runs,
    quality,
    stream_viterbi,
    token_files,
    voronoi_knn,
    warc,
)
from .common import fold, fresh_folder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Score from which a document passes as of quality 1.
QUALITY_THRESHOLD = 0.3


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@query
def op1_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_templates.drop_recurring_lines(table(spark, sf_dir, "documents"))
    return cleaned.select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("clean_text").cast("binary"), 256).alias("clean_sha256")
    )


ORACLES["op1_line_templates"] = r"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
numbered AS (SELECT doc_id, unnest(lines) AS line, unnest(generate_series(1, len(lines))) AS line_no FROM docs),
masked AS (
  SELECT doc_id, line_no, regexp_replace(
    trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), ' '), '[^ ]*[0-9][^ ]*', '<*>', 'g') AS masked
  FROM numbered
),
placed AS (
  SELECT doc_id, line_no, masked, string_split(masked, ' ') AS words,
         len(string_split(masked, ' ')) - (length(masked) - length(replace(masked, '<*>', ''))) // 3 AS n_plain
  FROM masked WHERE masked <> ''
),
literal AS (
  SELECT masked, min(doc_id) AS first_doc FROM placed GROUP BY masked
  HAVING count(DISTINCT doc_id) >= 5 OR (count(DISTINCT doc_id) >= 2 AND any_value(n_plain) >= 10)
),
patterns AS (
  SELECT DISTINCT concat(len(words), ' ', array_to_string(words[1:3], ' ')) AS leaf, masked, words FROM placed WHERE len(words) >= 5
),
leaves AS (SELECT leaf, count(*) AS n_lines FROM patterns GROUP BY leaf HAVING count(*) >= 4),
places AS (
  SELECT leaf, masked, unnest(words) AS word, unnest(generate_series(1, len(words))) AS place FROM patterns SEMI JOIN leaves USING (leaf)
),
counted AS (
  SELECT *, place <= 3 OR 10 * count(*) OVER (PARTITION BY leaf, place, word) >= 3 * n_lines AS constant
  FROM places JOIN leaves USING (leaf)
),
templates AS (
  SELECT masked, string_agg(CASE WHEN constant THEN word ELSE '<*>' END, ' ' ORDER BY place) AS template
  FROM counted GROUP BY leaf, masked HAVING bool_or(NOT constant) AND count(*) FILTER (WHERE constant) >= 0.7 * count(*)
),
known AS (SELECT p.doc_id, p.line_no, t.template FROM placed p JOIN templates t USING (masked)),
recurring AS (SELECT template, min(doc_id) AS first_doc FROM known GROUP BY template HAVING count(DISTINCT doc_id) >= 5),
dropped AS (
  SELECT k.doc_id, k.line_no FROM known k JOIN recurring r USING (template) WHERE k.doc_id <> r.first_doc
  UNION SELECT p.doc_id, p.line_no FROM placed p JOIN literal l USING (masked) WHERE p.doc_id <> l.first_doc
)
SELECT n.doc_id, count(*)::INT AS n_lines, count(d.line_no)::INT AS n_dropped,
       sha256(coalesce(string_agg(n.line, chr(10) ORDER BY n.line_no) FILTER (WHERE d.line_no IS NULL), '')) AS clean_sha256
FROM numbered n LEFT JOIN dropped d ON n.doc_id = d.doc_id AND n.line_no = d.line_no GROUP BY n.doc_id
"""


@query
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "block_ok")


ORACLES["op2_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT *, sha1(html) AS hex FROM p),
g AS (
  SELECT page_id, html, list_transform(range(8), lambda i: ('0x' || substr(hex, (5 * i + 1)::INT, 5))::INT) AS parts FROM h
)
SELECT page_id, octet_length(encode(html)) AS payload_bytes,
       array_to_string(list_transform(parts, lambda v: array_to_string(list_transform([15, 10, 5, 0],
         lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> b) & 31) + 1, 1)), '')), '') AS payload_digest,
       CASE WHEN page_id = max(page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> max(page_id) OVER w THEN max(page_id) OVER w END AS refers_to, TRUE AS block_ok
FROM g WINDOW w AS (PARTITION BY html)
"""


@query
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark, "tokens")
    docs = table(spark, sf_dir, "documents")
    token_files.write_tokens(docs, folder, tokenizer_path("word_bpe_49k.json"), end_id=2)
    return token_files.digests(token_files.read_tokens(spark, folder))


@query
def op4_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.jaccard_join(table(spark, sf_dir, "documents"))


ORACLES["op4_lsh_forest"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(generate_series(1, len(ws) - 4), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS shingle FROM w
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM shingles a JOIN shingles b USING (shingle)
  WHERE a.doc_id <> b.doc_id GROUP BY 1, 2
),
links AS (
  SELECT x, y, k = a.n AND k = b.n AS same FROM common JOIN sizes a ON x = a.doc_id JOIN sizes b ON y = b.doc_id
  WHERE 5 * k >= 4 * (a.n + b.n - k)
),
reached AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reached r JOIN links l ON r.y = l.x),
names AS (SELECT x, min(y) AS least FROM reached GROUP BY x),
counts AS (SELECT x, count(*) AS n_links, min(y) FILTER (WHERE same) AS first_same FROM links GROUP BY x)
SELECT doc_id, least(doc_id, coalesce(n.least, doc_id)) AS class_id, coalesce(n_links, 0) AS n_links,
       least(doc_id, coalesce(first_same, doc_id)) AS copy_of
FROM documents LEFT JOIN names n ON doc_id = n.x LEFT JOIN counts c ON doc_id = c.x
"""


@query
def op5_stream_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokenizer_path("piece_bpe_32k.model")
    return stream_viterbi.decode_digests(stream_viterbi.encode(table(spark, sf_dir, "documents"), model), model)


@query
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


ORACLES["op6_exact_dedup"] = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm)
"""


@query
def op7_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voronoi_knn.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


ORACLES["op7_voronoi_knn"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
pairs AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


@query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return cost_packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), end_id=0).drop("ids")


@query
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = quality.classify(docs, labels, keep=["doc_id"])
    return scored.select(
        "doc_id", (fold("doc_id") == 0).alias("held_out"), "score",
        (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"),
    )


@query
def op10_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.score_texts(table(spark, sf_dir, "documents"), order=kneser_ney.ORDER)


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in a tenth of the documents, by crc32 of the id, all words from one on repeat a period.

    A null id counts as the empty text, whose crc32 is 0.
    """
    hashed = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda word: word != "")

    def periodic(w: Column) -> Column:
        n, g = F.size(w), F.floor(F.col("_h") / 10)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.when(
            n > 0, F.concat_ws(" ", F.transform(
                F.sequence(F.lit(0), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p)))),
        )

    # A list of one value binds the words, so that they are cut once and not for each place.
    planted = F.transform(F.array(words), periodic)[0]
    rows = docs.select("doc_id", "text", hashed.alias("_h"))
    return rows.select("doc_id", F.when(F.col("_h") % 10 == 0, planted).otherwise(F.col("text")).alias("text"))


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(with_planted_periods(table(spark, sf_dir, "documents")))
    best = found.withColumn("best", periodic_runs.strongest(F.col("runs")))
    lines = F.concat(periodic_runs.listing(F.col("runs")), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


@query
def op12_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decision_list.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"
    )


@query
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    restored = fill_in_middle.restore(F.col("output"), F.col("form"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored.cast("binary"), 256).alias("restored_sha256"),
    )


ORACLES["op13_fill_in_middle"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS hex,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
  FROM documents
),
h AS (
  SELECT doc_id, text, units, len(units) AS n, ('0x' || substr(hex, 1, 8))::BIGINT % (len(units) + 1) AS one,
         ('0x' || substr(hex, 9, 8))::BIGINT % (len(units) + 1) AS other,
         ('0x' || substr(hex, 17, 8))::BIGINT % 100 AS h3, ('0x' || substr(hex, 25, 8))::BIGINT % 100 AS h4 FROM d
),
cuts AS (
  SELECT doc_id, text, n,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 >= 50
           THEN 'plain' WHEN h4 < 80 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(units[1:least(one, other)], '') AS p,
         array_to_string(units[least(one, other) + 1:greatest(one, other)], '') AS m,
         array_to_string(units[greatest(one, other) + 1:], '') AS s
  FROM h
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m
         ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM cuts
"""
