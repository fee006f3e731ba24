"""One query per operator over its whole table, with the SQL it is checked against where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adledger.llm import (bagminhash, bpe_dropout, burst_trie, context_mixing, exact_dedup, hnsw, html_blocks, packing,
                          quality_gam, secret_scan, string_kernel, token_counts, turn_repair)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op3_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_classes(_table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op5_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.score(_table(spark, sf_dir, "documents"))


def op6_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gam.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_bpe_dropout(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return bpe_dropout.encoding_digest(_table(spark, sf_dir, "documents"), path or vocabulary("piece_bpe_32k.model"))


def op8_token_counts(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), path or vocabulary("byte_bpe_50k.json"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(_table(spark, sf_dir, "documents"))


def op10_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return html_blocks.extract(pages, html_blocks.train(pages), keep=["url"])


def op11_burst_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return burst_trie.grafted_trie(_table(spark, sf_dir, "conversations"))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = _table(spark, sf_dir, "conversations")
    return turn_repair.audits(turn_repair.damaged(told), told)


def op13_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return string_kernel.identify(docs, string_kernel.train(docs))


QUERIES = {f.__name__: f for f in (op1_hnsw, op2_packing, op3_bagminhash, op4_exact_dedup, op5_context_mixing, op6_quality_gam,
                                   op7_bpe_dropout, op8_token_counts, op9_secret_scan, op10_html_blocks, op11_burst_trie,
                                   op12_turn_repair, op13_string_kernel)}


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII text in DuckDB, bit by bit."""
    rounds = ", ".join(["-1"] * 8)
    return f"""xor(4294967295, list_reduce(
            list_concat([4294967295], flatten(list_transform(string_split({text}, ''), lambda ch: [ord(ch)::BIGINT, {rounds}]))),
            lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"""


ORACLES = {
    "op4_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, text_sha256
        FROM (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                              'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
              FROM documents)
        WINDOW same AS (PARTITION BY text_sha256)""",
    "op11_burst_trie": f"""
        WITH t AS (
          SELECT conv_id, coalesce(text, '') AS body, sha256(concat(coalesce(role, ''), chr(1), coalesce(text, ''))) AS tid,
                 row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
          FROM conversations WHERE conv_id IS NOT NULL),
        ids AS (SELECT DISTINCT conv_id AS c, {_crc32("conv_id::VARCHAR")} % 9 AS h FROM t),
        rebuilt AS (
          SELECT c, 0 AS part, pos, tid, body FROM ids JOIN t ON conv_id = c - c % 5 AND pos <= h
          UNION ALL SELECT c, 1, pos, tid, body FROM ids JOIN t ON conv_id = c AND pos > h),
        seqs AS (
          SELECT c, coalesce(list(tid ORDER BY part, pos) FILTER (tid IS NOT NULL), []) AS s,
                 list(strlen(body) ORDER BY part, pos) AS sizes
          FROM ids LEFT JOIN rebuilt USING (c) GROUP BY c),
        members AS (
          SELECT c, d, len(s) = d AS ended, array_to_string(s[1:d], ',') AS prefix,
                 CASE WHEN d > 0 THEN array_to_string(s[1:d - 1], ',') END AS parent, CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS size
          FROM seqs, unnest(range(len(s) + 1)) AS depths(d)),
        nodes AS (
          SELECT prefix, min(d) AS depth, min(parent) AS parent, min(c) AS conv_id, count(*) AS n_convs, min(size) AS size,
                 coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ended), '') AS ends
          FROM members GROUP BY prefix),
        kids AS (SELECT parent AS prefix, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
        counted AS (SELECT nodes.*, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN kids USING (prefix)),
        under AS (SELECT DISTINCT a.prefix, b.prefix AS below FROM members a JOIN members b ON a.c = b.c AND a.d <= b.d),
        totals AS (
          SELECT under.prefix, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * size)::BIGINT AS saved_tokens
          FROM under JOIN counted ON counted.prefix = below GROUP BY under.prefix)
        SELECT a.conv_id, a.depth, up.conv_id AS parent_conv_id, a.n_convs, a.n_children, n_leaves, saved_tokens,
               sha256(a.ends) AS ends_sha256
        FROM counted a JOIN totals ON totals.prefix = a.prefix LEFT JOIN counted up ON up.prefix = a.parent""",
    "op12_turn_repair": f"""
        WITH RECURSIVE spaced AS (
          SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                 {_crc32("concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' '))")} % 20 AS fate
          FROM conversations),
        hurt AS (
          SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role,
                 CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                 unnest(range(CASE fate WHEN 3 THEN 2 ELSE 1 END)) AS copy
          FROM spaced WHERE fate <> 0),
        placed AS (
          SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
                 row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again
          FROM hurt),
        told AS (
          SELECT conv_id, i, turn, role, text, left(role, 1) AS ini,
                 left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) AS before,
                 CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN again > 1 THEN 2
                      WHEN regexp_matches(text, '[^\x20\x09-\x0D.!?][\x20\x09-\x0D]*$') THEN 3 ELSE 0 END AS fault
          FROM placed),
        moves(state, upto, letter, cost, ini) AS (
          SELECT s, s, 'D', 4, NULL::VARCHAR FROM range(4) AS states(s)
          UNION ALL VALUES (0, 1, 'K', 0, 's'), (0, 2, 'K', 0, 'u'), (1, 2, 'K', 0, 'u'), (3, 2, 'K', 0, 'u'), (2, 3, 'K', 0, 'a'),
            (0, 2, 'R', 3, NULL), (1, 2, 'R', 3, NULL), (3, 2, 'R', 3, NULL), (2, 3, 'R', 3, NULL)),
        puts(state, upto, letters, cost) AS (
          SELECT s, s, '', 0 FROM range(4) AS states(s)
          UNION ALL VALUES (0, 2, 'I', 3), (0, 3, 'II', 6), (1, 2, 'I', 3), (1, 3, 'II', 6), (2, 3, 'I', 3), (3, 2, 'I', 3)),
        ids AS (SELECT DISTINCT conv_id FROM conversations),
        paths AS (
          SELECT conv_id, 0::BIGINT AS i, upto AS state, {{'cost': cost::BIGINT, 'audit': letters}} AS best
          FROM ids, puts WHERE state = 0
          UNION ALL
          SELECT e.conv_id, e.i, puts.upto, min({{'cost': (e.cost + puts.cost)::BIGINT, 'audit': concat(e.audit, puts.letters)}})
          FROM (SELECT told.conv_id, told.i, moves.upto AS state, concat(best.audit, letter) AS audit,
                       best.cost + cost + CASE WHEN fault = 3 AND letter <> 'D' THEN 3 ELSE 0 END AS cost
                FROM paths JOIN told ON told.conv_id = paths.conv_id AND told.i = paths.i + 1
                JOIN moves ON moves.state = paths.state AND coalesce(moves.ini = told.ini, true)
                 AND (letter = 'D' OR fault NOT IN (1, 2))) e
          JOIN puts ON puts.state = e.state GROUP BY e.conv_id, e.i, puts.upto),
        facts AS (
          SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                 count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
                 count(*) FILTER (fault = 3) AS truncated,
                 count(*) FILTER (i > 1 AND concat(before, ini) NOT IN ('su', 'ua', 'au')) AS illegal
          FROM told GROUP BY conv_id),
        found AS (
          SELECT ids.conv_id, min(best) AS best FROM ids LEFT JOIN facts USING (conv_id)
          JOIN paths ON paths.conv_id = ids.conv_id AND paths.i = coalesce(n, 0) AND state IN (0, 3) GROUP BY ids.conv_id),
        letters AS (
          SELECT conv_id, k, best.audit[k] AS letter, k - len(replace(best.audit[1:k], 'I', '')) AS put,
                 len(replace(best.audit[1:k], 'D', '')) AS place
          FROM (SELECT conv_id, best, unnest(range(1, len(best.audit) + 1)) AS k FROM found)),
        kept AS (
          SELECT letters.conv_id, place, letter, ini, role, text,
                 bool_or(place = 1 AND letter = 'K' AND ini = 's') OVER (PARTITION BY letters.conv_id) AS led
          FROM letters LEFT JOIN told ON told.conv_id = letters.conv_id AND told.i = k - put AND letter <> 'I'
          WHERE letter <> 'D'),
        joined AS (
          SELECT conv_id, string_agg(concat(CASE WHEN letter = 'K' THEN role WHEN (place - CASE WHEN led THEN 1 ELSE 0 END) % 2 = 1
                                                 THEN 'user' ELSE 'assistant' END, ':', text), chr(10) ORDER BY place) AS whole
          FROM kept GROUP BY conv_id)
        SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
               coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, best.cost AS cost, best.audit AS audit,
               sha256(coalesce(whole, '')) AS repaired_sha256
        FROM found LEFT JOIN facts USING (conv_id) LEFT JOIN joined USING (conv_id)""",
}
