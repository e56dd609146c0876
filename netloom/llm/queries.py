"""The corpus operators as registered queries, with DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm import (
    decontaminate, hard_negatives, html_text, language_id, line_dedup,
    merkle, near_dedup, packing, quality_model, quality_rules, sentence_pieces,
    span_dedup, toxicity,
)
from netloom.llm.common import id_remainder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return keep


#: Shingle sets of all documents, in DuckDB.
_SHINGLES = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                             '[^\x20\x09-\x0D]+') AS words
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_distinct([array_to_string(words[i:i + 3], ' ') FOR i IN range(1, len(words) - 2)]) END AS shingles
  FROM w)
"""


@query(_SHINGLES + """,
x AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS k
           FROM x a JOIN x b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common WHERE 100 * k >= 80 * (n + m - k)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reached AS (SELECT doc_id, doc_id AS other FROM s UNION SELECT r.doc_id, e.b FROM reached r JOIN edges e ON r.other = e.a),
c AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY 1)
SELECT doc_id, len(shingles) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c USING (doc_id)
""")
def op1_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return near_dedup.near_duplicates(table(spark, folder, "documents"), shingle=4).drop("text_key")


@query()
def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return packing.digest(packing.packed(table(spark, folder, "documents")))


@query(r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
wb AS (SELECT DISTINCT item_id, size, array_to_string(words[i:i + size - 1], ' ') AS part
       FROM (SELECT item_id, words, least(len(words), 10) AS size, unnest(range(1, len(words) - least(len(words), 10) + 2)) AS i
             FROM b WHERE len(words) > 0)),
wd AS (SELECT doc_id, i, size, array_to_string(words[i:i + size - 1], ' ') AS part
       FROM (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS i
             FROM d, (SELECT DISTINCT size FROM wb) WHERE len(words) >= size)),
m AS (SELECT doc_id, i, size, item_id FROM wd JOIN wb USING (size, part)),
hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS place FROM m) GROUP BY 1),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS joined
        FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM m) GROUP BY 1)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)
""")
def op8_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark passages in all documents."""
    return decontaminate.digest(decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark")))


@query()
def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of all documents, learned from the labels of four of five."""
    docs, held = table(spark, folder, "documents"), id_remainder(F.col("doc_id"), 5) == 0
    labels = table(spark, folder, "labels").select("doc_id", F.col("toxic").alias("label"))
    return _scores(toxicity.scored(docs, toxicity.trained(docs, labels, ~held)), held)


@query(r"""
WITH lines AS (
  SELECT doc_id, source, place, trim(line, E' \t\r') AS line FROM (
    SELECT doc_id, source, unnest(range(1, len(lines) + 1)) AS place, unnest(lines) AS line
    FROM (SELECT doc_id, source, string_split(text, E'\n') AS lines FROM documents WHERE text IS NOT NULL))),
wide AS (SELECT line, min(doc_id * 1000000 + place) AS first FROM lines WHERE line <> '' GROUP BY 1 HAVING count(DISTINCT source) >= 10),
lost AS (SELECT doc_id, list(place) AS lost FROM lines JOIN wide USING (line) WHERE doc_id * 1000000 + place <> first GROUP BY 1)
SELECT d.doc_id,
       CASE WHEN lost IS NULL THEN text ELSE array_to_string([x[2] FOR x IN [[i::VARCHAR, s[i]] FOR i IN range(1, len(s) + 1)] IF NOT list_contains(lost, x[1]::BIGINT)], E'\n') END AS text,
       coalesce(len(s), 0)::BIGINT AS n_lines, coalesce(len(lost), 0)::BIGINT AS n_removed
FROM (SELECT doc_id, text, string_split(text, E'\n') AS s FROM documents) d LEFT JOIN lost USING (doc_id)
""")
def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """All documents without the lines that ten sites or more share."""
    cleaned = line_dedup.without_widespread_lines(table(spark, folder, "documents"))
    return cleaned.select("doc_id", "text", "n_lines", "n_removed")


@query(r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS part FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, part) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS place FROM r) GROUP BY 1),
l AS (SELECT doc_id, count(*) AS n, count(DISTINCT line) AS m FROM (SELECT doc_id, unnest(string_split(text, E'\n')) AS line FROM d)
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
f AS (SELECT doc_id, text, w, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (coalesce(l.n, 0) - coalesce(l.m, 0))::BIGINT AS n_dup_lines,
             coalesce(c.n, 0)::BIGINT AS n_repeat_words, coalesce(l.n, 0) AS n_lines
      FROM d LEFT JOIN c USING (doc_id) LEFT JOIN l USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars BETWEEN 2 * n_words AND 15 * n_words AND 10 * n_symbols <= n_words AND 100 * n_dup_lines <= 30 * n_lines
       AND 10 * length(regexp_replace(text, '[^!]+', '', 'g')) <= n_words
       AND 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) <= 30 * length(regexp_replace(text, '[^A-Za-z]+', '', 'g'))
       AND 100 * len([x FOR x IN w IF regexp_matches(x, '\p{L}')]) >= 70 * n_words AS kept
FROM b
""")
def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Quality numbers and the verdict of the cascade for all documents."""
    return quality_rules.judged(table(spark, folder, "documents")).drop("rejected_by")


@query()
def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """The language of all documents, learned from three of four."""
    docs, held = table(spark, folder, "documents"), id_remainder(F.col("doc_id"), 4) == 2
    found = language_id.predicted(docs, language_id.trained(docs, ~held))
    return found.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query()
def op7_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of all documents, learned from the labels of two of three."""
    docs, held = table(spark, folder, "documents"), id_remainder(F.col("doc_id"), 3) == 1
    labels = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))
    return _scores(toxicity.scored(docs, quality_model.trained(docs, labels, ~held)), held)


def _scores(scored: DataFrame, held: F.Column) -> DataFrame:
    return scored.select(
        "doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query()
def op9_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of all pages."""
    return html_text.main_text(table(spark, folder, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@query()
def op10_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """All documents without passages that occur earlier."""
    cleaned = span_dedup.without_repeats(table(spark, folder, "documents"))
    return cleaned.select("doc_id", "n_units", "n_removed", (F.col("n_removed") > 0).alias("repeated"), "removed", "text")


@query()
def op11_sentence_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The SentencePiece ids of all documents and the texts they decode to, as digests."""
    found = sentence_pieces.encoded(table(spark, folder, "documents"))
    told = F.array_join(F.col("ids").cast("array<string>"), " ")
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(told.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query("""
WITH v AS MATERIALIZED (
  SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label,
         [floor(x::DOUBLE * 256)::BIGINT FOR x IN embedding] AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len([1 FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
scored AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.x::DOUBLE[], b.x::DOUBLE[])::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
positives AS MATERIALIZED (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) QUALIFY row_number() OVER w <= 3
""")
def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Three hard negatives for each of an anchor's five positives."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hard_negatives.integer_vectors(table(spark, folder, "embeddings"), "vec_id", "embedding", moved)
    return hard_negatives.mined(rows, F.col("vec_id") % 50 == 0)


#: A cell with its length in bytes, in DuckDB.
_CELL = "coalesce(strlen({0})::VARCHAR || ':' || {0}, '-')"
_LEAF = "sha256(concat(" + ", ".join(_CELL.format(c) for c in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", "{text}")) + "))"
#: crc32 of a column of decimal digits, bit by bit.
_CRC32 = (
    "xor(4294967295, list_reduce([4294967295] || [ascii(c)::BIGINT FOR c IN string_split({0}, '')],"
    " lambda x, b: list_reduce([xor(x, b)] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda a, z: xor(a >> 1, (a & 1) * 3988292384))))"
)


@query(f"""
WITH RECURSIVE leaves AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY k) AS n FROM (
    SELECT row_number() OVER () AS row, doc_id, coalesce('+' || lang, '') AS k, {_LEAF.format(text="text")} AS leaf,
      CASE WHEN {_CRC32.format("doc_id::VARCHAR")} % 3 = 0
        THEN {_LEAF.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS lowered FROM documents)),
low AS (
  SELECT 0 AS height, k, n, pos, leaf AS hash FROM leaves
  UNION ALL
  SELECT height + 1, k, (n + 7) // 8, pos // 8, sha256(string_agg(hash, '' ORDER BY pos)) FROM low WHERE n > 1 GROUP BY height, k, n, pos // 8),
subroots AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY k) - 1 AS pos, count(*) OVER () AS n FROM (SELECT k, hash FROM low WHERE n = 1)),
high AS (
  SELECT 0 AS height, n, pos, hash FROM subroots
  UNION ALL
  SELECT height + 1, (n + 7) // 8, pos // 8, sha256(string_agg(hash, '' ORDER BY pos)) FROM high WHERE n > 1 GROUP BY height, n, pos // 8),
low_runs AS MATERIALIZED (SELECT height, k, pos // 8 AS run, list(hash ORDER BY pos) AS h FROM low WHERE n > 1 GROUP BY height, k, pos // 8),
high_runs AS MATERIALIZED (SELECT height, pos // 8 AS run, list(hash ORDER BY pos) AS h FROM high WHERE n > 1 GROUP BY height, pos // 8),
below AS (
  SELECT row, k, n, 0 AS height, pos, '' AS proof, coalesce(lowered, leaf) AS fold FROM leaves
  UNION ALL
  SELECT row, w.k, (n + 7) // 8, w.height + 1, pos // 8, proof || array_to_string(h[1:pos % 8] || h[pos % 8 + 2:], ''),
    sha256(array_to_string(h[1:pos % 8], '') || fold || array_to_string(h[pos % 8 + 2:], ''))
  FROM below w JOIN low_runs r ON r.height = w.height AND r.k = w.k AND r.run = pos // 8),
above AS (
  SELECT row, s.n, 0 AS height, s.pos, proof, fold, s.hash AS subroot FROM below w JOIN subroots s USING (k) WHERE w.n = 1
  UNION ALL
  SELECT row, (n + 7) // 8, w.height + 1, pos // 8, proof || array_to_string(h[1:pos % 8] || h[pos % 8 + 2:], ''),
    sha256(array_to_string(h[1:pos % 8], '') || fold || array_to_string(h[pos % 8 + 2:], '')), subroot
  FROM above w JOIN high_runs r ON r.height = w.height AND r.run = pos // 8)
SELECT doc_id, leaf, subroot, hash AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = hash AS verified
FROM above a JOIN leaves USING (row), high WHERE a.n = 1 AND high.n = 1
""")
def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Leaf, roots and proof of all documents, and whether a change of case is found out."""
    docs = table(spark, folder, "documents")
    tampered = F.coalesce(id_remainder(F.col("doc_id"), 3) == 0, F.lit(False))
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = merkle.manifest(docs, held={"text": F.when(tampered, lowered).otherwise(F.col("text"))})
    root, fold = merkle.hex_text(F.col("root")), merkle.folded(F.col("held_leaf"), F.col("path"))
    return rows.select(
        "doc_id", merkle.hex_text(F.col("leaf")).alias("leaf"), merkle.hex_text(F.col("subroot")).alias("subroot"), root.alias("root"),
        merkle.proof_digest(F.col("path")).alias("proof_sha256"), fold.alias("folded_root"), (fold == root).alias("verified"),
    )
