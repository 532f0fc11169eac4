"""Registered queries of the operators: thin digests over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from valuemarts.llm import ann, ball_tree, bpe, decontam, langid, line_dedup, lm_score, near_dup, phrases, secret_scan, suffix_dedup, token_file, toxicity
from valuemarts.llm.common import keep_until_release, release, scratch_path, split_of

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


__all__ = ["ORACLE_SQL", "QUERIES", "TOKENIZER", "release", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(table(spark, sf_dir, "documents"), TOKENIZER, ids=False)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), part_words=decontam.PASSAGE_WORDS)
    return out.withColumnRenamed("id", "doc_id")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.clean(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("__lines_removed").cast("long").alias("lines_removed"),
                      F.col("__chars_removed").cast("long").alias("chars_removed"), F.sha2("text", 256).alias("text_sha256"))


OP3_SQL = """
WITH lines AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS parts FROM documents),
spread AS (
  SELECT t AS line FROM (SELECT source, trim(unnest(parts), ' ' || chr(9) || chr(13)) AS t FROM lines)
  WHERE t <> '' GROUP BY t HAVING count(DISTINCT source) >= 10),
marked AS (
  SELECT doc_id, text, parts, (SELECT list(line) FROM spread) AS bad FROM lines),
cut AS (
  SELECT doc_id, text,
         list_filter(parts, lambda x: coalesce(list_contains(bad, trim(x, ' ' || chr(9) || chr(13))), false)) AS gone,
         list_filter(parts, lambda x: NOT coalesce(list_contains(bad, trim(x, ' ' || chr(9) || chr(13))), false)) AS kept
  FROM marked),
sized AS (SELECT *, coalesce(list_sum(list_transform(gone, lambda x: length(x))), 0) AS c FROM cut),
decided AS (SELECT *, coalesce(len(gone) > 0 AND len(list_filter(kept, lambda x: trim(x, ' ' || chr(9) || chr(13)) <> '')) > 0, false) AS yes FROM sized)
SELECT doc_id, CAST(CASE WHEN yes THEN len(gone) ELSE 0 END AS BIGINT) AS lines_removed,
       CAST(CASE WHEN yes THEN c ELSE 0 END AS BIGINT) AS chars_removed,
       sha256(CASE WHEN yes THEN array_to_string(kept, chr(10)) ELSE text END) AS text_sha256
FROM decided
"""


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, split_of("doc_id", 4) != 2)
    out = langid.predict(docs, model)
    return out.select("doc_id", F.coalesce(split_of("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), split_of("doc_id", 3) != 1)
    out = toxicity.predict(docs, model)
    return out.select("doc_id", F.coalesce(split_of("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dup.groups(table(spark, sf_dir, "documents"), shingle=2, threshold=80)
    return out.withColumnRenamed("id", "doc_id")


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm_score.score(table(spark, sf_dir, "documents"), split_of("id", 10) != 0)
    return out.select(F.col("id").alias("doc_id"), F.coalesce(split_of("id", 10) == 0, F.lit(False)).alias("held_out"),
                      *[c for c in out.columns if c != "id"])


def op9_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = keep_until_release(spark, scratch_path(spark, "token-files"))
    token_file.write(table(spark, sf_dir, "documents"), path, TOKENIZER, end_id=2)
    return token_file.read_digests(spark, path)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_scan.scan(docs, secret_scan.fit(docs))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), least=100, longest=5, top=2000)


OP11_SQL = r"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang,
               unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents)),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces),
grams AS (SELECT lang, w[i:i + k - 1] AS g FROM starts, range(1, 6) t(k) WHERE i + k - 1 <= len(w)),
counts AS (SELECT lang, g, count(*) AS f FROM grams GROUP BY lang, g),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE len(g) = 1 GROUP BY lang),
f AS (SELECT lang, g, f FROM counts WHERE f >= 100),
cand AS (SELECT lang, g, f AS a FROM f WHERE len(g) >= 2),
cuts AS (SELECT lang, g, a, k, g[1:k] AS lg, g[k + 1:] AS rg
         FROM (SELECT lang, g, a, unnest(range(1, len(g))) AS k FROM cand)),
scored AS (
  SELECT c.lang, c.g, c.a, c.k, x.f AS l, y.f AS r, n,
         CAST((1000::HUGEINT * c.a * n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.g = lg JOIN f y ON y.lang = c.lang AND y.g = rg JOIN totals t ON t.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inside AS (
  SELECT lang, g[s:s + m - 1] AS g, max(a) AS longer
  FROM (SELECT lang, g, a, unnest(range(1, len(g))) AS s FROM cand), range(2, 5) t(m)
  WHERE m < len(g) AND s + m - 1 <= len(g) GROUP BY 1, 2),
kept AS (SELECT b.* FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.g = b.g WHERE longer IS NULL OR 100 * longer < 100 * a),
named AS (SELECT *, array_to_string(g, ' ') AS phrase FROM kept),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM named)
SELECT * FROM ranked WHERE rank <= 2000
"""


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=50)
    return out.select(F.col("id").alias("doc_id"), "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP12_SQL = """
WITH docs AS (SELECT doc_id, hex(coalesce(text, '')) AS h FROM documents),
places AS (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS p FROM docs),
windows AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS w FROM places),
firsts AS (SELECT w, min(doc_id) AS f FROM windows GROUP BY w),
hits AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS prev FROM windows JOIN firsts USING (w) WHERE f < doc_id),
marked AS (SELECT doc_id, p, sum(CASE WHEN prev IS NULL OR p > prev + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM hits),
runs AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM marked GROUP BY doc_id, run),
sums AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id),
pieces AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS s, a AS e FROM runs
           UNION ALL SELECT doc_id, max(b), 1000000000 FROM runs GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * s + 1, 2 * (e - s)), '' ORDER BY s) AS k FROM pieces JOIN docs USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM docs LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


OP13_SQL = r"""
WITH found AS (
  SELECT row_number() OVER () AS d, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
docs AS (SELECT d, doc_id, terms, CAST(len(terms) AS BIGINT) AS n FROM found WHERE len(terms) > 0),
totals AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM docs),
tf AS (SELECT d, doc_id, n, term, count(*) AS tf FROM (SELECT d, doc_id, n, unnest(terms) AS term FROM docs) GROUP BY ALL),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, totals GROUP BY term, nn),
impact AS (SELECT d, doc_id, tf.term, w, (1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * nn) // ll))) AS x
           FROM tf JOIN weight USING (term), totals),
items AS (SELECT i, item_id, term, count(*) AS c FROM (
            SELECT i, item_id, unnest(terms) AS term FROM (
              SELECT row_number() OVER () AS i, item_id,
                     regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
              FROM benchmark)) GROUP BY ALL),
scored AS (SELECT i, item_id, d, doc_id, CAST(sum(c * w * x) AS BIGINT) AS score
           FROM items JOIN impact USING (term) WHERE doc_id IS NOT NULL GROUP BY i, item_id, d, doc_id),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
           FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_decontaminate": op2_decontaminate,
    "op3_line_dedup": op3_line_dedup,
    "op4_langid": op4_langid,
    "op5_toxicity": op5_toxicity,
    "op6_ann": op6_ann,
    "op7_near_dup": op7_near_dup,
    "op8_lm_score": op8_lm_score,
    "op9_token_file": op9_token_file,
    "op10_secret_scan": op10_secret_scan,
    "op11_phrases": op11_phrases,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_ranked_search": op13_ranked_search,
}
ORACLE_SQL: dict[str, str] = {"op3_line_dedup": OP3_SQL, "op11_phrases": OP11_SQL, "op12_suffix_dedup": OP12_SQL, "op13_ranked_search": OP13_SQL}
