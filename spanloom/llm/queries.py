"""The registered queries of this subpackage, one per operator, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import ann, cover_tree, decontaminate, langid, line_dedup, lm, ngram_join, packing, quality, rans, toxicity, turn_trie, whitening
from spanloom.llm.common import fold_of, table

#: The tokenizer file of the token queries; any that encodes words apart will do (see ``tokens``).
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold_of(F.col("doc_id"), 7) == 2
    model = lm.train(docs.where(~held_out))
    scored = lm.score(docs.select(F.struct("doc_id", held_out.alias("held_out")).alias("key"), "text"), model, "key")
    return scored.select("key.*", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.sequences(table(spark, sf_dir, "documents"), TOKENIZER, capacity=4096, end_id=1)


def op3_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), k=10, every=100)


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"), n=5, num=75, den=100)


def op5_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold_of(F.col("doc_id"), 5) == 0
    model = quality.train(docs, table(spark, sf_dir, "labels").where(~held_out))
    scored = quality.score(docs.select(F.struct("doc_id", held_out.alias("held_out")).alias("key"), "text"), model, "key")
    return scored.select("key.*", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold_of(F.col("doc_id"), 5) == 0
    model = langid.train(docs.where(~held_out))
    return langid.identify(docs.select(F.struct("doc_id", held_out.alias("held_out")).alias("key"), "text"), model, "key").select("key.*", "lang_pred", "score")


def op7_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.round_trip(table(spark, sf_dir, "documents"), TOKENIZER, end_id=2)


def op8_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_lines(docs, host="source", max_ratio=0.05).select("doc_id", "n_lines", "n_dropped", "text")


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)


def op10_cnn_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold_of(F.col("doc_id"), 4) == 2
    languages = langid.train(docs.where(~held_out))
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(~held_out), languages)
    scored = toxicity.score(docs.select(F.struct("doc_id", held_out.alias("held_out")).alias("key"), "text"), model, "key")
    return scored.select("key.*", "score", (F.col("score") >= toxicity.CUT).cast("int").alias("predicted"))


def op11_turn_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.93)


def op13_qd_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    whitened = whitening.whiten(table(spark, sf_dir, "embeddings"), components=16, scale=64.0, shift=1_000_000)
    return whitened.withColumn("deviation", F.col("deviation").try_cast("long"))  # null beyond a long, where the operator's decimal is whole


QUERIES = {f.__name__: f for f in (op1_kneser_ney, op2_packing, op3_nn_descent, op4_ngram_join, op5_crf_quality, op6_language, op7_rans, op8_site_lines, op9_winnowing, op10_cnn_toxicity, op11_turn_trie, op12_cover_tree, op13_qd_whitening)}
#: The line queries of op8: lines of a page once, their share of the host's pages, and what is left of each page.
OP8_SQL = """
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
h AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
c AS (SELECT source, trim(line, ' ') AS k, count(DISTINCT doc_id) AS n FROM l WHERE trim(line, ' ') <> '' GROUP BY ALL),
b AS (SELECT c.source, k FROM c JOIN h ON c.source IS NOT DISTINCT FROM h.source WHERE n > pages * 0.05::double),
m AS (SELECT l.*, b.k IS NOT NULL AS bad, trim(line, ' ') <> '' AS solid FROM l LEFT JOIN b ON l.source IS NOT DISTINCT FROM b.source AND trim(line, ' ') = b.k),
d AS (SELECT doc_id, count(*) FILTER (WHERE solid) AS n_lines, count(*) FILTER (WHERE bad) AS n_bad, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT bad) AS rest FROM m GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_bad, 0) AS n_dropped, CASE WHEN n_bad > 0 THEN coalesce(rest, '') ELSE t.text END AS text
FROM documents t LEFT JOIN d USING (doc_id)
"""

#: Words as the operator takes them; Spark and DuckDB agree on these classes.
_ABC = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

#: Links by shared shingles over whole sets, then the least id reachable.
OP4_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_ABC}), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p : p + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS p FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
g AS (SELECT doc_id, md5(string_agg(s, chr(10) ORDER BY s)) AS g FROM s GROUP BY doc_id),
f AS (SELECT g, min(doc_id) AS rep FROM g GROUP BY g),
r AS (SELECT s.doc_id, s FROM s JOIN f ON s.doc_id = f.rep),
l AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM r a JOIN r b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM l JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
      UNION SELECT rep, doc_id FROM g JOIN f USING (g) WHERE doc_id <> rep),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
c(doc_id, top) AS (SELECT doc_id, doc_id FROM n UNION SELECT u.b, c.top FROM c JOIN u ON u.a = c.doc_id WHERE c.top < u.b)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, coalesce(min(c.top), d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id) GROUP BY d.doc_id
"""

#: Every window of every item looked up at every word of every document.
OP9_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_ABC}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
i AS (SELECT item_id::varchar AS item_id, regexp_extract_all(translate(coalesce(text, ''), {_ABC}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
k AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS p FROM i WHERE len(w) > 0)),
z AS (SELECT DISTINCT n FROM k),
x AS (SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, z WHERE len(w) >= n)),
h AS (SELECT doc_id, n, p, item_id FROM x JOIN k USING (n, s)),
q AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS spot FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN q USING (doc_id) LEFT JOIN t USING (doc_id)
"""

#: crc32 bit by bit; then every prefix of every rebuilt conversation by the hash of its turns' hashes.
OP11_SQL = """
WITH RECURSIVE t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos,
    sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS said, strlen(coalesce(text, '')) AS size FROM conversations WHERE conv_id IS NOT NULL),
k(conv_id, i, crc) AS (SELECT DISTINCT conv_id, 0, 4294967295::bigint FROM t
    UNION ALL SELECT conv_id, i + 1, CASE WHEN i % 9 = 0 THEN xor(crc, ascii(substr(conv_id::varchar, i // 9 + 1, 1))::bigint) ELSE xor(crc >> 1, 3988292384::bigint * (crc & 1)) END FROM k WHERE i < 9 * length(conv_id::varchar)),
h AS (SELECT conv_id, xor(crc, 4294967295::bigint) % 9 AS h FROM k WHERE i = 9 * length(conv_id::varchar)),
r AS (SELECT h.conv_id, t.pos, t.said, t.size FROM h JOIN t ON t.conv_id = h.conv_id - h.conv_id % 5 WHERE t.pos <= h.h
      UNION ALL SELECT h.conv_id, 1000000 + t.pos, t.said, t.size FROM h JOIN t ON t.conv_id = h.conv_id WHERE t.pos > h.h),
s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS depth, said, size FROM r),
n AS (SELECT h.conv_id, coalesce(max(depth), 0) AS n FROM h LEFT JOIN s USING (conv_id) GROUP BY h.conv_id),
p(conv_id, depth, node, size) AS (SELECT conv_id, 0::bigint, '', 0::bigint FROM h UNION ALL SELECT s.conv_id, s.depth, md5(p.node || s.said), s.size FROM p JOIN s ON s.conv_id = p.conv_id AND s.depth = p.depth + 1),
a AS (SELECT node, depth, min(p.conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS own,
      coalesce(string_agg(p.conv_id::varchar, ',' ORDER BY p.conv_id) FILTER (WHERE n.n = depth), '') AS ends FROM p JOIN n USING (conv_id) GROUP BY node, depth),
u AS (SELECT a.node, a.depth, b.node AS up, c.conv_id AS up_conv FROM a LEFT JOIN p b ON b.conv_id = a.conv_id AND b.depth = a.depth - 1 LEFT JOIN a c ON c.node = b.node AND c.depth = b.depth),
c AS (SELECT up, depth - 1 AS depth, count(*) AS n_children FROM u WHERE up IS NOT NULL GROUP BY ALL),
w AS (SELECT p.node, p.depth, sum(a.own) AS saved, count(*) FILTER (WHERE c.n_children IS NULL) AS leaves FROM a LEFT JOIN c ON c.up = a.node AND c.depth = a.depth JOIN p ON p.conv_id = a.conv_id AND p.depth <= a.depth GROUP BY ALL)
SELECT a.conv_id, a.depth, u.up_conv AS parent_conv_id, a.n_convs, coalesce(c.n_children, 0)::bigint AS n_children, w.leaves::bigint AS n_leaves, w.saved::bigint AS saved_tokens, sha256(a.ends) AS ends_sha256
FROM a JOIN u USING (node, depth) LEFT JOIN c ON c.up = a.node AND c.depth = a.depth JOIN w ON w.node = a.node AND w.depth = a.depth
"""

#: All pairs of a label, then the least id reachable.
OP12_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::double[] AS x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding::double[], lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding::double[], lambda c: c <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.93::double),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
c(vec_id, top) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, c.top FROM c JOIN l ON l.a = c.vec_id WHERE c.top < l.b)
SELECT e.vec_id, coalesce(any_value(n.n), 0)::bigint AS n_links, min(c.top) AS component_id, e.vec_id = min(c.top) AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id JOIN c ON c.vec_id = e.vec_id GROUP BY e.vec_id
"""

SQL: dict[str, str] = {"op11_turn_trie": OP11_SQL, "op12_cover_tree": OP12_SQL, "op4_ngram_join": OP4_SQL, "op9_winnowing": OP9_SQL, "op8_site_lines": OP8_SQL}
