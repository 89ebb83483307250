"""The operators of this package over the whole given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from capital_access.llm import (
    chat_format, decontaminate, embedding_dedup, fill_in_middle, license_scan, lm_scoring, prefix_trie, quality_ranker,
    secret_scan, simhash_dedup, source_mixing, substring_dedup, warc_archive,
)
from capital_access.llm.common import table
from capital_access.llm.registry import query


@query("op1_substring_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the pieces of passages that an earlier document, or place, has."""
    return substring_dedup.remove_repeated_passages(table(spark, sf_dir, "documents"))


@query("op2_chat_formatting", r"""
    WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
               UNION ALL VALUES (CAST(-7 AS BIGINT), CAST(0 AS BIGINT), 'user', '\### Assistant: </turn> ok'),
                                (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
    s AS (SELECT *, length('<turn >' || replace(replace(replace(replace(role, '%', '%25'), '<', '%3C'), '>', '%3E'), chr(10), '%0A')) + 1
                    + length(regexp_replace(text, '<(\\*)(/?turn|image|audio|document)', '<\\\1\2', 'g')) + 9 AS chars FROM t)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
           CAST(sum(chars) AS BIGINT) AS formatted_chars
    FROM s GROUP BY conv_id
""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the conversations as read back from their formatted texts and loss masks."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = r"\### Assistant: </turn> ok"
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    turns = turns.unionByName(probe).withColumn("parts", chat_format.text_part(F.col("text")))
    done = chat_format.format_conversations(turns).select(
        "conv_id", "formatted", chat_format.read_turns(F.col("formatted")).alias("turns"),
        F.array_join(chat_format.read_loss(F.col("formatted"), F.col("loss_mask")), "").alias("loss"))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return done.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


@query("op3_embedding_near_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with their number of links and their component."""
    return embedding_dedup.vector_groups(table(spark, sf_dir, "embeddings"))


@query("op4_quality_classifier")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt from labels outside the held-out fold."""
    return quality_ranker.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_simhash_near_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    groups = simhash_dedup.simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op6_secret_scans")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document."""
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))


@query("op7_benchmark_decontamination", r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    i AS (SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(w[pos + 1:pos + least(len(w), 13)], ' ') AS words
          FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 12, 1))) AS pos FROM b WHERE len(w) > 0) x),
    p AS (SELECT doc_id, k, pos, array_to_string(w[pos + 1:pos + k], ' ') AS words
          FROM (SELECT doc_id, w, k, unnest(range(0, len(w) - k + 1)) AS pos FROM d, (SELECT DISTINCT k FROM i) l WHERE len(w) >= k) x),
    m AS (SELECT doc_id, item_id, pos, i.k FROM p JOIN i ON p.words = i.words AND p.k = i.k),
    h AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + k)) AS word FROM m) x GROUP BY doc_id),
    n AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) x GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)
""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of every document stands in the benchmark."""
    found = decontaminate.scan_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query("op8_license_scans", license_scan.scan_licences_sql())
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in every document."""
    return license_scan.scan_licences(table(spark, sf_dir, "documents"))


@query("op9_source_mixing", """
    WITH s AS (SELECT source, sum(greatest(coalesce(length(text), 0), 1)) AS size FROM documents GROUP BY source),
    r AS (SELECT source, pow(CAST(size AS DOUBLE), 0.5) / (SELECT sum(pow(CAST(size AS DOUBLE), 0.5)) FROM s)
                         * CAST((SELECT sum(size) FROM s) AS DOUBLE) / size AS rate FROM s),
    m AS (SELECT source, greatest(1, CAST(ceil(rate / 16.0) AS INT)) AS draws, rate / greatest(1, CAST(ceil(rate / 16.0) AS INT)) AS mean FROM r),
    c AS (SELECT source, draws, k, sum(exp(-mean) * pow(mean, k) / gamma(k + 1)) OVER (PARTITION BY source ORDER BY k) AS cdf
          FROM m, (SELECT unnest(range(0, 81)) AS k) x),
    u AS (SELECT *, CAST(CAST('0x' || substr(md5('42:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || draw), 1, 13) AS BIGINT) AS DOUBLE)
                    / 4503599627370496 AS u
          FROM (SELECT d.*, unnest(range(1, draws + 1)) AS draw FROM documents d JOIN m ON d.source IS NOT DISTINCT FROM m.source) x),
    n AS (SELECT doc_id, text, lang, u.source, n_chars, count(*) FILTER (WHERE cdf <= u) AS times
          FROM u JOIN c ON u.source IS NOT DISTINCT FROM c.source GROUP BY ALL),
    e AS (SELECT * EXCLUDE (times), unnest(range(1, times + 1)) AS copy FROM n)
    SELECT doc_id, text, lang, source, n_chars, CAST(copy AS INT) AS copy,
           md5('42-order:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || copy) AS shuffle_key
    FROM e
""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents repeated so that sources get the square roots of their sizes as weights, in random order."""
    return source_mixing.mix_sources(table(spark, sf_dir, "documents"))


@query("op10_warc", """
    WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
    o AS (SELECT payload_digest, payload_bytes, max(page_id) AS original FROM p WHERE payload_bytes >= 1000 GROUP BY ALL)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id <> original THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN page_id <> original THEN original END AS refers_to
    FROM p LEFT JOIN o USING (payload_digest, payload_bytes)
""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as read back from the archives they were written to."""
    archives = warc_archive.write_archives(table(spark, sf_dir, "pages"), warc_archive.archive_folder(spark))
    return warc_archive.read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op11_fill_in_middle", r"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
    u AS (SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS units, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
                 CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
    c AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS lo, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS hi FROM u),
    p AS (SELECT *, array_to_string(units[1:lo], '') AS p, array_to_string(units[lo + 1:hi], '') AS m, array_to_string(units[hi + 1:], '') AS s,
                 CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
                      WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
           sha256(text) AS restored_sha256
    FROM p
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's transformed text, and of the text restored from it."""
    made = fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    return made.withColumn("restored", fill_in_middle.restored()).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


@query("op12_lm_scoring")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every document under a model of the documents outside the held-out fold."""
    return lm_scoring.score_documents(table(spark, sf_dir, "documents"))


@query("op13_conversation_prefix_trie", r"""
    WITH RECURSIVE ids AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
    crc(c, s, k, v) AS (
        SELECT c, CAST(c AS VARCHAR), 0, CAST(4294967295 AS BIGINT) FROM ids
        UNION ALL
        SELECT c, s, k + 1, xor(b >> 1, CASE WHEN b % 2 = 1 THEN 3988292384 ELSE 0 END)
        FROM (SELECT c, s, k, CASE WHEN k % 8 = 0 THEN xor(v, CAST(ord(s[k // 8 + 1]) AS BIGINT)) ELSE v END AS b FROM crc WHERE k < 8 * length(s)) x),
    h AS (SELECT c, xor(v, 4294967295) % 4 AS h FROM crc WHERE k = 8 * length(s)),
    o AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
                 row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS p
          FROM conversations WHERE conv_id IS NOT NULL),
    r AS (SELECT h.c, 0 AS own, p, role, text FROM h JOIN o ON o.c = h.c - h.c % 20 AND p < h
          UNION ALL SELECT h.c, 1, p, role, text FROM h JOIN o ON o.c = h.c AND p >= h),
    t AS (SELECT c, row_number() OVER w AS d, string_agg(md5(length(role) || ':' || role || text), '') OVER w AS node,
                 len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words, count(*) OVER (PARTITION BY c) AS n
          FROM r WINDOW w AS (PARTITION BY c ORDER BY own, p)),
    m AS (SELECT c, d, node, lag(node, 1, '') OVER (PARTITION BY c ORDER BY d) AS up, words, n FROM t
          UNION ALL SELECT c, 0, '', NULL, 0, (SELECT count(*) FROM t WHERE t.c = ids.c) FROM ids),
    v AS (SELECT node, min(d) AS depth, min(up) AS up, min(c) AS conv_id, count(*) AS n_convs, min(words) AS words,
                 sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE d = n), '')) AS ends_sha256 FROM m GROUP BY node),
    k AS (SELECT up AS node, count(*) AS n_children FROM v WHERE up IS NOT NULL GROUP BY up),
    u AS (SELECT v.*, coalesce(n_children, 0) AS n_children FROM v LEFT JOIN k USING (node)),
    s AS (SELECT m.node, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * u.words) AS saved_tokens
          FROM u JOIN m ON m.c = u.conv_id AND m.d <= u.depth GROUP BY m.node)
    SELECT u.conv_id, CAST(u.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, u.n_convs, u.n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
           CAST(saved_tokens AS BIGINT) AS saved_tokens, u.ends_sha256
    FROM u JOIN s USING (node) LEFT JOIN v p ON p.node = u.up
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of conversations whose beginnings come from the first of twenty."""
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))
