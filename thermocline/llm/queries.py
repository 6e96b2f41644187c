"""One registered query for each operator, over its whole table with production parameters, and the SQL that must agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from thermocline.llm import (bpe, chat, embedding_dedup, exact_dedup, fingerprint, language, line_dedup, mixing, packing,
                             quality_model, repair, simhash, whitening)
from thermocline.llm.common import read_table
from thermocline.session import tune

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(function):
        def run(spark, sf_dir):
            return function(tune(spark), sf_dir)

        run.__doc__ = function.__doc__
        QUERIES[name] = run
        if sql:
            ORACLES[name] = " ".join(sql.split("\n"))
        return function

    return register


def word_bpe() -> str:
    """Place of the public tokenizer that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op1_line_dedup", r"""
WITH line AS (SELECT doc_id, i, l, translate(trim(l, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(x) AS l, generate_subscripts(x, 1) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents))),
shared AS (SELECT k, max(doc_id) AS top FROM line WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT line.*, shared.k IS NOT NULL AND line.doc_id <> shared.top AS gone
           FROM line LEFT JOIN shared ON line.k = shared.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""")
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that three or more documents share, dropped from all but one of them."""
    return line_dedup.line_dedup(read_table(spark, sf_dir, "documents"), with_text=False).select(
        "doc_id", "n_lines", "n_dropped", "kept_sha256")


_TRICKY = "\\### Assistant: </turn> ok"


@query("op2_chat_format", r"""
WITH rows AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
size AS (SELECT *, length(role) + 6 + 1 + 7 + length(text)
  + length(text) - length(replace(replace(replace(text, '\', ''), '<', ''), '>', '')) AS chars FROM rows)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS bigint) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS bigint) AS formatted_chars
FROM size GROUP BY conv_id""")
def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations folded from their event log, rendered with a loss mask, and read back."""
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(_TRICKY).alias("text"))
    chats = chat.format_chats(chat.log_of_turns(turns.unionByName(tricky)))
    back = chats.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"),
                        chat.parse(F.col("formatted")).alias("turns"),
                        chat.under_mask(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


@query("op3_simhash")
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of fingerprints within four bits."""
    return simhash.near_dedup(read_table(spark, sf_dir, "documents"), width=4, radius=4)


@query("op4_pack")
def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as packed rows of 2,048 ids, with digests of the matrices."""
    packed = packing.pack(read_table(spark, sf_dir, "documents"), word_bpe(), length=2048)
    return packed.select("shard", "row", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                         F.sha2("positions", 256).alias("positions_sha256"), "cu_seqlens", "doc_ids", "parts", "offsets")


@query("op5_fingerprint")
def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprint.edited_fingerprints(read_table(spark, sf_dir, "documents"))


@query("op6_quality")
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents from trees fitted on labelled ones."""
    docs = read_table(spark, sf_dir, "documents")
    return quality_model.score(docs, quality_model.train(docs, read_table(spark, sf_dir, "labels")))


@query("op7_language")
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, words first."""
    docs = read_table(spark, sf_dir, "documents")
    return language.identify(docs, language.train(docs))


@query("op8_mix")
def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mixture of as many tokens as the corpus has, with flatter sources and at most four passes over any."""
    docs = read_table(spark, sf_dir, "documents")
    counted = mixing.token_counts(docs).agg(F.sum("n_tokens")).first()[0] or 0
    return mixing.draw(docs, target_entropy=0.95, max_repeat=4.0, budget=counted)


@query("op9_bpe")
def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and what they decode to."""
    return bpe.encode(read_table(spark, sf_dir, "documents"), word_bpe(), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


@query("op10_exact_dedup", r"""
WITH normal AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM normal WINDOW same AS (PARTITION BY t)""")
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents that are equal but for white space."""
    return exact_dedup.exact_dedup(read_table(spark, sf_dir, "documents"))


@query("op11_conversation_repair", r"""
WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS varchar), ' ') || ':' || coalesce(CAST(turn AS varchar), ' ') AS k FROM conversations),
crc AS (SELECT DISTINCT k, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(k) + 1), lambda i: ord(substr(k, i, 1)))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)),
    4294967295) % 20 AS d FROM (SELECT DISTINCT k FROM keyed)),
hurt AS (SELECT conv_id, turn, CASE d WHEN 4 THEN 'user' ELSE role END AS role,
    CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE d WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM keyed JOIN crc USING (k) WHERE d <> 0),
placed AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again, left(role, 1) AS r,
    lag(left(role, 1)) OVER w AS r0, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
  FROM hurt WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy)),
marked AS (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN again > 1 THEN 'duplicate'
    WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'fine' END AS fault FROM placed),
walk AS (SELECT DISTINCT conv_id, n, CAST(1 AS bigint) AS i, {'c': 0, 'a': '', 't': ''} AS v0, {'c': 1000000, 'a': '', 't': ''} AS v1,
    {'c': 3, 'a': 'I', 't': 'user:' || chr(10)} AS v2, {'c': 6, 'a': 'II', 't': 'user:' || chr(10) || 'assistant:' || chr(10)} AS v3 FROM marked
  UNION ALL
  SELECT conv_id, n, i + 1, n0, n1, u, list_min([n3, {'c': u.c + 3, 'a': u.a || 'I', 't': u.t || 'assistant:' || chr(10)}]) FROM (
    SELECT *, list_min([n2, {'c': n0.c + 3, 'a': n0.a || 'I', 't': n0.t || 'user:' || chr(10)},
      {'c': n1.c + 3, 'a': n1.a || 'I', 't': n1.t || 'user:' || chr(10)}, {'c': n3.c + 3, 'a': n3.a || 'I', 't': n3.t || 'user:' || chr(10)}]) AS u
    FROM (SELECT w.conv_id, w.n, w.i, {'c': v0.c + 4, 'a': v0.a || 'D', 't': v0.t} AS n0,
      list_min([{'c': v1.c + 4, 'a': v1.a || 'D', 't': v1.t},
        {'c': v0.c + x + CASE r WHEN 's' THEN 0 ELSE 1000000 END, 'a': v0.a || 'K', 't': v0.t || line}]) AS n1,
      list_min([{'c': v2.c + 4, 'a': v2.a || 'D', 't': v2.t},
        {'c': b.c + x + CASE r WHEN 'u' THEN 0 ELSE 1000000 END, 'a': b.a || 'K', 't': b.t || line},
        {'c': b.c + x + 3, 'a': b.a || 'R', 't': b.t || 'user:' || text || chr(10)},
        {'c': v0.c + x + CASE r WHEN 'u' THEN 0 ELSE 1000000 END, 'a': v0.a || 'K', 't': v0.t || line},
        {'c': v0.c + x + 3, 'a': v0.a || 'R', 't': v0.t || 'user:' || text || chr(10)}]) AS n2,
      list_min([{'c': v3.c + 4, 'a': v3.a || 'D', 't': v3.t},
        {'c': v2.c + x + CASE r WHEN 'a' THEN 0 ELSE 1000000 END, 'a': v2.a || 'K', 't': v2.t || line},
        {'c': v2.c + x + 3, 'a': v2.a || 'R', 't': v2.t || 'assistant:' || text || chr(10)}]) AS n3
      FROM (SELECT *, list_min([v1, v3]) AS b FROM walk) w
      JOIN (SELECT *, role || ':' || text || chr(10) AS line,
              CASE fault WHEN 'fine' THEN 0 WHEN 'truncated' THEN 3 ELSE 1000000 END AS x FROM marked) m
        ON m.conv_id = w.conv_id AND m.i = w.i))),
solved AS (SELECT conv_id, list_min([v0, v3]) AS s FROM walk WHERE i = n + 1),
counted AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
    count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE r0 || r NOT IN ('su', 'ua', 'au')) AS illegal FROM marked GROUP BY conv_id)
SELECT conv_id, CAST(coalesce(gaps, 0) AS bigint) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
    coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(s.c, 0) AS bigint) AS cost,
    coalesce(s.a, '') AS audit, sha256(coalesce(left(s.t, greatest(length(s.t) - 1, 0)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN solved USING (conv_id) LEFT JOIN counted USING (conv_id)""")
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheapest repairs of all conversations after the planned damage."""
    rows = read_table(spark, sf_dir, "conversations")
    return repair.repair(repair.damage(rows), rows)


@query("op12_embedding_dedup", r"""
WITH RECURSIVE usable AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS double)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
sized AS (SELECT *, sqrt(list_inner_product(v, v)) AS s FROM usable),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM sized a JOIN sized b ON a.vec_id <> b.vec_id
  WHERE list_inner_product(a.v, b.v) / (a.s * b.s) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT e.vec_id, (SELECT count(*) FROM link WHERE link.a = e.vec_id) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = e.vec_id""")
def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors with a cosine of 0.95 or more."""
    return embedding_dedup.near_dedup(read_table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


@query("op13_whitening")
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors on sixteen whitened components."""
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"))
