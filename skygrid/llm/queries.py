"""The registered queries of the training-data operators, over whole tables, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import column_bwt, decontaminate, gam, line_chunks, order_minhash, piece_offsets, rule_ledger, suffix_trees, token_rollups, warc_sharded
from .common import cut, shared_path

PIECE_MODEL = "piece_bpe_32k.model"
TOKENIZERS = ("piece_bpe_32k.model", "byte_bpe_50k.tiktoken")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_piece_offsets(spark, sf_dir):
    return piece_offsets.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path(PIECE_MODEL), "digests")


def op2_warc_sharded(spark, sf_dir):
    return warc_sharded.archive_and_read(table(spark, sf_dir, "pages"))


def op3_order_minhash(spark, sf_dir):
    return order_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_suffix_trees(spark, sf_dir):
    return suffix_trees.remove_repeated_words(table(spark, sf_dir, "documents"), 13)


def op5_decontaminate(spark, sf_dir):
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 13)


def op6_line_chunks(spark, sf_dir):
    return line_chunks.remove_repeated_chunks(table(spark, sf_dir, "documents"))


def op7_gam(spark, sf_dir):
    return gam.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_rule_ledger(spark, sf_dir):
    return rule_ledger.judge(table(spark, sf_dir, "documents"))


def rule_ablation(spark, sf_dir):
    """For each source and rule of the policy: documents that fail it, and those that only this rule rejects."""
    docs = table(spark, sf_dir, "documents").select("source", "text")
    return rule_ledger.ablation(rule_ledger.ledger(docs).select("source", "fail_bits"), "v1", ["source"])


def op9_token_rollups(spark, sf_dir):
    """Totals by source, language and tokenizer version after inserts, revisions, deletes, a redelivery and a compaction.

    All documents are counted once; the counted images come in under a provisional source, are revised to their own
    one, deleted and inserted again, so that every kind of change sees the whole table.
    """
    rollup = token_rollups.Rollup(spark, shared_path(spark, "rollup"))
    images = cut(token_rollups.count_tokens(token_rollups.inserts(table(spark, sf_dir, "documents")), {name: tokenizer_path(name) for name in TOKENIZERS}), "images")
    incoming = images.withColumn("source", F.lit("incoming"))
    batches = {
        "1-inserts": incoming, "2-revisions": token_rollups.reversed_images(incoming).unionByName(images), "3-deletes": token_rollups.reversed_images(images), "4-inserts": images,
    }
    for name, changes in batches.items():
        rollup.apply_counted(name, changes)
    rollup.apply_counted("2-revisions", batches["2-revisions"])  # delivered twice, as a retry would
    rollup.compact()
    return rollup.totals()


def op10_column_bwt(spark, sf_dir):
    return column_bwt.remove_repeated_bytes(table(spark, sf_dir, "documents"), 100)


QUERIES = {f.__name__: f for f in (op1_piece_offsets, op2_warc_sharded, op3_order_minhash, op4_suffix_trees, op5_decontaminate, op6_line_chunks, op7_gam, op8_rule_ledger, op9_token_rollups, op10_column_bwt, rule_ablation)}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_LETTERS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_GRAM = "concat_ws(' ', word, " + ", ".join(f"lead(word, {k}) OVER o" for k in range(1, 13)) + ")"

ORACLE_SQL = {
    "op2_warc_sharded": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
             d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
             f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
        SELECT page_id, payload_bytes, d.payload_digest AS payload_digest,
               CASE WHEN first IS NOT NULL AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first IS NOT NULL AND first <> page_id THEN first END AS refers_to
        FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest AND payload_bytes >= 100""",
    "op4_suffix_trees": f"""
        WITH w AS (SELECT doc_id, unnest({_WORDS}) AS word, generate_subscripts({_WORDS}, 1) AS i FROM documents),
             g AS (SELECT doc_id, i, concat_ws(' ', word, {", ".join(f"lead(word, {k}) OVER o" for k in range(1, 13))}) AS gram, lead(word, 12) OVER o AS last
                   FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
             r AS (SELECT gram, min(doc_id) AS first FROM g WHERE last IS NOT NULL GROUP BY gram HAVING min(doc_id) < max(doc_id)),
             s AS (SELECT DISTINCT doc_id, i FROM g JOIN r ON g.gram = r.gram WHERE last IS NOT NULL AND doc_id > first),
             c AS (SELECT DISTINCT doc_id, i + k AS i FROM s CROSS JOIN (SELECT unnest(generate_series(0, 12)) AS k))
        SELECT d.doc_id AS doc_id, count(w.i) AS n_words, count(c.i) AS n_removed,
               sha256(coalesce(string_agg(CASE WHEN c.i IS NULL THEN w.word END, ' ' ORDER BY w.i), '')) AS kept_sha256
        FROM documents d LEFT JOIN w ON w.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = w.doc_id AND c.i = w.i GROUP BY d.doc_id""",
    "op5_decontaminate": f"""
        WITH w AS (SELECT doc_id, unnest({_LETTERS}) AS word, generate_subscripts({_LETTERS}, 1) AS i FROM documents),
             b AS (SELECT item_id, unnest({_LETTERS}) AS word, generate_subscripts({_LETTERS}, 1) AS i FROM benchmark),
             bg AS (SELECT item_id, {_GRAM} AS gram, lead(word, 12) OVER o AS last, count(*) OVER (PARTITION BY item_id) AS n FROM b WINDOW o AS (PARTITION BY item_id ORDER BY i)),
             long AS (SELECT DISTINCT item_id, gram FROM bg WHERE last IS NOT NULL),
             short AS (SELECT item_id, string_agg(word, ' ' ORDER BY i) AS gram, count(*) AS n FROM b GROUP BY item_id HAVING count(*) < 13),
             dg AS (SELECT doc_id, i, {_GRAM} AS gram, lead(word, 12) OVER o AS last FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
             h AS (SELECT doc_id, i, 13 AS n, item_id FROM dg JOIN long ON dg.gram = long.gram WHERE last IS NOT NULL
                   UNION ALL SELECT dg.doc_id AS doc_id, dg.i AS i, short.n AS n, short.item_id AS item_id FROM dg JOIN short ON starts_with(dg.gram || ' ', short.gram || ' ')),
             c AS (SELECT DISTINCT doc_id, i + unnest(generate_series(0, n - 1)) AS i FROM h),
             t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM h GROUP BY doc_id),
             k AS (SELECT d.doc_id AS doc_id, count(w.i) AS n_words, count(c.i) AS n_hit FROM documents d LEFT JOIN w ON w.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = w.doc_id AND c.i = w.i GROUP BY d.doc_id)
        SELECT k.doc_id AS doc_id, n_words, n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit > 0 AND 20 * n_hit >= n_words AS contaminated
        FROM k LEFT JOIN t ON t.doc_id = k.doc_id""",
    "op8_rule_ledger": f"""
        WITH w AS (SELECT doc_id, unnest({_WORDS}) AS word, generate_subscripts({_WORDS}, 1) AS i FROM documents),
             g AS (SELECT doc_id, i, concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o) AS gram, lead(word, 4) OVER o AS last
                   FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
             r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g WHERE last IS NOT NULL),
             c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS k) WHERE r.n > 1 GROUP BY doc_id),
             s AS (SELECT doc_id, count(*) AS n_words, sum(length(word))::BIGINT AS word_chars FROM w GROUP BY doc_id),
             l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
             u AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
             m AS (SELECT d.doc_id AS doc_id, coalesce(s.n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, (length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
                   coalesce(u.n, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 1 AS n_lines
                   FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id LEFT JOIN u ON u.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id),
             f AS (SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END + CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END
                   + CASE WHEN n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END
                   + CASE WHEN n_words > 1000000 THEN 64 ELSE 0 END)::BIGINT AS fail_bits FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits % 4 > 0 AS base_failed, fail_bits % 64 = 0 AS kept, fail_bits FROM f""",
}

ORACLE_SQL["rule_ablation"] = f"""
        SELECT source, rule, count(*) FILTER (WHERE fail_bits & (1 << k) > 0) AS n_failed, count(*) FILTER (WHERE fail_bits & 63 = 1 << k) AS n_only
        FROM ({ORACLE_SQL["op8_rule_ledger"]}) b JOIN documents d ON d.doc_id = b.doc_id
        CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4, 5])::BIGINT AS k, unnest(['few_words', 'repeated_windows', 'symbols', 'duplicate_lines', 'short_words', 'long_words']) AS rule) GROUP BY source, rule"""
