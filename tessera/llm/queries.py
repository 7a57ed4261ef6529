"""The queries of this package over the given tables, and their SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import (ann, bpe, chat, embedding_dedup, hard_negatives, language, line_dedup, mixing, pii, prefix_trie, simhash, token_counts,
                         warc)
from tessera.llm.common import table

QUALITY = {1: 2.0, 0: 0.5}


def tokenizer(name: str) -> str:
    """Path of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def quality(labels: DataFrame) -> DataFrame:
    """doc_id, weight: labelled good documents count double, bad ones half."""
    good = F.col("quality")
    return labels.select("doc_id", F.when(good == 1, QUALITY[1]).when(good == 0, QUALITY[0]).otherwise(1.0).alias("weight"))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents before and after mail addresses and long numbers are masked."""
    path = tokenizer("byte_bpe_50k.tiktoken")
    trees = token_counts.build(table(spark, sf_dir, "documents"), path)
    done = token_counts.apply_edits(token_counts.with_masks(trees), path)
    return done.select(F.col("key").alias("doc_id"), "n_edits", "n_tokens_before", "n_tokens", "n_chars", "encoded_chars")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.summary(table(spark, sf_dir, "documents"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), quality=quality(table(spark, sf_dir, "labels"))).select(
        "doc_id", "size", "source_size", "target", "taken")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(docs)).select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh vector has its label moved on, so that labels do not follow the vectors everywhere."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), label=label)


def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.round_trip(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_bpe, op3_token_counts, op4_pii, op5_embedding_dedup, op6_ann, op7_line_dedup, op8_mix, op9_warc,
                                   op10_language_id, op11_prefix_trie, op12_hard_negatives, op13_chat)}

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# base32 of a SHA-1: five hex digits are twenty bits are four letters
_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(sha1(body), {5 * g + 1}, 5))::BIGINT >> {s}) & 31)::INT, 1)"
                      for g in range(8) for s in (15, 10, 5, 0))

# CRC-32 bit by bit: -1 in the list of steps shifts, anything else is a byte to take in
_CRC32 = ("xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split({0}, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), "
          "lambda acc, s: CASE WHEN s >= 0 THEN xor(acc, s) ELSE xor(acc >> 1, CASE WHEN acc & 1 = 1 THEN 3988292384 ELSE 0 END) END))")

# what the template puts around a text, and the escapes that the text itself needs
_ESCAPES = r"(<\\*s>|<\\*/s>|\[\\*INST\]|\[\\*/INST\]|\[\\*OUT\]|\[\\*ROLE\]|\[\\*/ROLE\]|\[\\*/TURN\])"

ORACLE = {
    "op5_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a, min(b) AS low FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(low.low, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(low.low, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN low ON low.a = e.vec_id""",
    "op9_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest, sha1(body) AS h FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > min(page_id) OVER same THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > min(page_id) OVER same THEN min(page_id) OVER same END AS refers_to
FROM d WINDOW same AS (PARTITION BY h)""",
    "op7_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS place, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
keyed AS (SELECT *, translate(trim(line, {_BLANKS}), '{_UPPER}', '{_LOWER}') AS k FROM lines),
shared AS (SELECT k, max(doc_id) AS top FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT keyed.*, shared.k IS NOT NULL AND doc_id <> top AS gone FROM keyed LEFT JOIN shared ON keyed.k = shared.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op8_mix": """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
quality AS (SELECT doc_id, max(CASE quality WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 ELSE 1.0 END)::DOUBLE AS w FROM labels GROUP BY doc_id),
drawn AS (
  SELECT s.*, -ln((('0x' || substr(md5(s.doc_id::VARCHAR), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / coalesce(w, 1.0::DOUBLE) AS k
  FROM sized s LEFT JOIN quality q ON q.doc_id = s.doc_id),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM drawn GROUP BY source),
weighed AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT] AS weight FROM sources),
steps AS (
  SELECT *, coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
         sum(weight) OVER (ORDER BY 2 * source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM weighed),
level AS (
  SELECT arg_min((1.5::DOUBLE * (SELECT sum(source_size) FROM sources) - held::DOUBLE) / open, 2 * source_size / weight) AS level FROM steps
  WHERE (1.5::DOUBLE * (SELECT sum(source_size) FROM sources) - held::DOUBLE) / open <= 2 * source_size / weight),
goals AS (
  SELECT source, source_size, least((2 * source_size)::DOUBLE, weight * (SELECT level FROM level)) AS target FROM weighed),
summed AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size) ELSE 0 END AS epochs,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS before
  FROM drawn d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, round(target - epochs * source_size)::BIGINT - before)))::BIGINT AS taken
FROM summed""",
    "op11_prefix_trie": f"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS k,
         struct_pack(r := coalesce(role, ''), x := coalesce(text, '')) AS t FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(t ORDER BY k) AS l FROM t GROUP BY conv_id),
h AS (SELECT conv_id, l, ({_CRC32.format("conv_id::VARCHAR")} % 6)::INT AS h FROM own),
whole AS (SELECT h.conv_id, list_concat(coalesce(p.l[1:h], []), h.l[h + 1:]) AS l FROM h LEFT JOIN own p ON p.conv_id = h.conv_id - h.conv_id % 100),
steps AS (SELECT conv_id, l, unnest(range(0, len(l) + 1)) AS depth FROM whole),
member AS (SELECT conv_id, depth, l[1:depth] AS p, depth = len(l) AS ends FROM steps),
node AS (
  SELECT p, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * length(coalesce(p[depth].x, '')) AS saved,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM member GROUP BY p, depth),
kids AS (SELECT p[1:depth - 1] AS p, count(*) AS n FROM node WHERE depth > 0 GROUP BY 1),
tree AS (SELECT node.*, coalesce(kids.n, 0) AS n_children FROM node LEFT JOIN kids ON kids.p = node.p),
sums AS (
  SELECT p, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens
  FROM (SELECT above[1:k] AS p, n_children, saved FROM (SELECT p AS above, n_children, saved, unnest(range(0, depth + 1)) AS k FROM tree)) GROUP BY p)
SELECT tree.conv_id, tree.depth, up.conv_id AS parent_conv_id, tree.n_convs, tree.n_children, n_leaves, saved_tokens, tree.ends_sha256
FROM tree JOIN sums ON sums.p = tree.p LEFT JOIN tree up ON tree.depth > 0 AND up.p = tree.p[1:tree.depth - 1]""",
    "op12_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
met AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, list_inner_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id),
pos AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM met WHERE label = own
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT pos.anchor_id, positive_id, (row_number() OVER (PARTITION BY pos.anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id AS negative_id,
       positive_score, score AS negative_score
FROM pos JOIN met ON met.anchor_id = pos.anchor_id AND label <> own AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY pos.anchor_id, positive_id ORDER BY score DESC, vec_id) <= 5""",
    "op13_chat": f"""
WITH t AS (
  SELECT conv_id, false AS added, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, true, k, CASE k WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) r(k)),
sized AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '{_ESCAPES}'))
            + CASE role WHEN 'user' THEN 18 WHEN 'assistant' THEN 11 ELSE 24 + length(role) + len(regexp_extract_all(role, '{_ESCAPES}')) END AS chars FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id, added""",
}
