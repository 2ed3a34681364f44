"""One registered query per training-data operator, and SQL twins where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrack.llm import chat, divergence, html, lm, merkle, packing, pieces, quality, runs, simhash, toxicity, vectors
from loomtrack.llm.common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    read = chat.read_chats(chat.format_chats(turns)).withColumn("loss", chat.loss_text())
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_CONTROL = r"(<)(\\*)(/?s>|\|(?:turn|text|also|end|im_start|im_end|endoftext)\||</?SYS>>)|(\[)(\\*)(/?INST\])"
_ESCAPED = f"length(regexp_replace({{}}, '{_CONTROL}', '\\1\\4\\\\\\2\\5\\3\\6', 'g'))"

OP2_SQL = f"""
WITH all_turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
         {_ESCAPED.format('text')} AS text_len, {_ESCAPED.format('role')} AS role_len
  FROM all_turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(7 + sum(text_len + CASE WHEN before = role THEN 8 ELSE 23 + role_len END) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.embedding_duplicates(table(spark, sf_dir, "embeddings"))


OP3_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = e.vec_id
"""


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), F.coalesce(quality.fold("doc_id", 3) == 1, F.lit(False))
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"), ~held_out)
    return quality.score_quality(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), F.coalesce(quality.fold("doc_id", 10) == 0, F.lit(False))
    model, counts = lm.fit(docs.where(~held_out))
    return lm.score(docs, model, counts).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), F.coalesce(quality.fold("doc_id", 5) == 0, F.lit(False))
    machine = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"), ~held_out)
    return toxicity.score_toxicity(docs, machine).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_texts(table(spark, sf_dir, "pages"))


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_texts(table(spark, sf_dir, "documents"), pieces.load())


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS c FROM w GROUP BY ALL HAVING count(DISTINCT doc) >= 3),
langs AS (SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY ALL),
c AS (SELECT lang, source, term, count(*) AS c FROM w JOIN kept USING (lang, term) GROUP BY ALL),
grp AS (
  SELECT g.lang, g.source, coalesce(v, 0) AS v, coalesce(n, 0) AS n FROM (SELECT DISTINCT lang, source FROM d) g
  LEFT JOIN (SELECT lang, v FROM langs) USING (lang) LEFT JOIN (SELECT lang, source, sum(c) AS n FROM c GROUP BY ALL) USING (lang, source)),
p AS (
  SELECT grp.lang, grp.source, term, coalesce(c.c, 0) AS count, CAST(1 + (1000000000 * (coalesce(c.c, 0) + 1)) // (grp.n + grp.v) AS HUGEINT) AS p
  FROM grp JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source),
louder AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value
  FROM p JOIN (SELECT lang, term, CAST(1 + (1000000000 * (c + 1)) // (n + v) AS HUGEINT) AS q FROM kept JOIN langs USING (lang)) USING (lang, term)
  WHERE count > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
      FROM (SELECT * FROM every UNION ALL SELECT * FROM louder))
WHERE part = 'pair' OR rank <= 200
"""


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.periodic_runs(table(spark, sf_dir, "documents"), plant=True)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edits_and_fingerprints(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_chat": op2_chat,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_nearest": op4_nearest,
    "op5_quality": op5_quality,
    "op6_lm": op6_lm,
    "op7_packing": op7_packing,
    "op8_toxicity": op8_toxicity,
    "op9_html": op9_html,
    "op10_pieces": op10_pieces,
    "op11_divergence": op11_divergence,
    "op12_runs": op12_runs,
    "op13_merkle": op13_merkle,
}
ORACLES = {"op2_chat": OP2_SQL, "op3_embedding_dedup": OP3_SQL, "op11_divergence": OP11_SQL}
