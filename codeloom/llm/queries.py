"""The registered queries of the corpus operators, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, centroids, decontam, html_extract, lm, packing, prefix_trie, quality, secrets, simhash, token_counts, token_store, url_filter
from .common import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), token_counts.default_path())


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.report(table(spark, sf_dir, "documents"), packing.default_path())


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.report(table(spark, sf_dir, "documents"), packing.default_path())


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(table(spark, sf_dir, "documents"))


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(table(spark, sf_dir, "documents"))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.nodes(table(spark, sf_dir, "conversations"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.report(table(spark, sf_dir, "embeddings"))


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.report(table(spark, sf_dir, "embeddings"))


# --- The parts of the operators' results that SQL can say, from the same reports --------------


def base_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the base patterns."""
    return op3_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def base_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures and the base rule."""
    return op5_quality(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def base_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts, paths and the rules that fit, with the verdict where one does."""
    return op10_urls(spark, sf_dir).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("decided"))


def text_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of texts, as the token counts have them."""
    return op2_token_counts(spark, sf_dir).select("doc_id", "n_bytes")


QUERIES = {
    "base_secrets": base_secrets,
    "base_quality": base_quality,
    "base_urls": base_urls,
    "text_sizes": text_sizes,
    "op1_decontamination": op1_decontamination,
    "op2_token_counts": op2_token_counts,
    "op3_secrets": op3_secrets,
    "op4_html": op4_html,
    "op5_quality": op5_quality,
    "op6_packing": op6_packing,
    "op7_token_ids": op7_token_ids,
    "op8_simhash": op8_simhash,
    "op9_lm": op9_lm,
    "op10_urls": op10_urls,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_centroids": op12_centroids,
    "op13_neighbours": op13_neighbours,
}


def _centroids_sql(k: int = 16, rounds: int = 3) -> str:
    """The clustering with one pair of subqueries a round."""
    out = [
        f"""WITH kept AS (SELECT row_number() OVER () AS r, vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
            WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        c0 AS (SELECT CAST(row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS INT) AS c, v AS w FROM (SELECT sha256('1:' || vec_id) AS h, v FROM kept ORDER BY h NULLS LAST, v LIMIT {k}))"""
    ]
    for i in range(rounds + 1):
        out.append(
            f"""a{i} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, CAST(min(d * 1000 + c) % 1000 AS INT) AS c, CAST(min(d * 1000 + c) // 1000 AS BIGINT) AS d
            FROM (SELECT r, vec_id, v, c, list_sum([(x[1] - x[2]) * (x[1] - x[2]) FOR x IN list_zip(v, w)]) AS d FROM kept, c{i}) GROUP BY r)"""
        )
        if i < rounds:
            out.append(
                f"""c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(n.w, c{i}.w) AS w FROM c{i} LEFT JOIN (SELECT c, list(CAST(s // q - CASE WHEN s % q < 0 THEN 1 ELSE 0 END AS BIGINT) ORDER BY j) AS w
                FROM (SELECT c, j, sum(v[j]) AS s, count(*) AS q FROM a{i}, range(1, 65) AS g(j) GROUP BY c, j) GROUP BY c) n ON n.c = c{i}.c)"""
            )
    return (
        ", ".join(out)
        + f""" SELECT vec_id, a{rounds}.c AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a{rounds}.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(w, ',')) AS centroid_sha256
        FROM a{rounds} JOIN c{rounds} ON c{rounds}.c = a{rounds}.c"""
    )


_WORDS_SQL = r"""[x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> '']"""

#: Every prefix of every rebuilt conversation, grouped; crc32 by its table of 256 values.
_TRIE_SQL = """
    WITH crc AS (SELECT [list_reduce(list_concat([i], range(8)), lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) FOR i IN range(256)] AS t),
    turns AS (SELECT conv_id, turn, sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, length(coalesce(text, '')) AS n FROM conversations WHERE conv_id IS NOT NULL),
    own AS (SELECT conv_id, list({'k': k, 'n': n} ORDER BY turn NULLS FIRST, k) AS own,
        any_value(xor(list_reduce(list_concat([4294967295], [ascii(x) FOR x IN string_split(CAST(conv_id AS VARCHAR), '')]), lambda a, b: xor(a // 256, t[xor(a, b) % 256 + 1])), 4294967295) % 6) AS h FROM turns, crc GROUP BY conv_id),
    seqs AS (SELECT o.conv_id, list_concat(coalesce(b.own, [])[1 : o.h], o.own[o.h + 1 :]) AS s FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 100),
    pre AS (SELECT conv_id, d, [x.k FOR x IN s[1 : d]] AS p, CASE WHEN d > 0 THEN s[d].n ELSE 0 END AS n, len(s) = d AS ends FROM seqs, unnest(range(0, len(s) + 1)) AS g(d)),
    node AS (SELECT d, p, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(n) AS own, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM pre GROUP BY d, p),
    kids AS (SELECT d - 1 AS d, p[1 : d - 1] AS p, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
    sub AS (SELECT g.d, p[1 : g.d] AS p, sum(own) AS saved, count(*) FILTER (kids.n IS NULL) AS leaves FROM node LEFT JOIN kids USING (d, p), unnest(range(0, node.d + 1)) AS g(d) GROUP BY g.d, p[1 : g.d])
    SELECT node.conv_id, CAST(node.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, node.n_convs, CAST(coalesce(kids.n, 0) AS BIGINT) AS n_children, CAST(sub.leaves AS BIGINT) AS n_leaves, CAST(sub.saved AS BIGINT) AS saved_tokens, node.ends_sha256
    FROM node LEFT JOIN kids USING (d, p) JOIN sub USING (d, p) LEFT JOIN node up ON up.d = node.d - 1 AND up.p = node.p[1 : node.d - 1]"""

ORACLES = {
    "op11_prefix_trie": _TRIE_SQL,
    "op12_centroids": _centroids_sql(),
    "text_sizes": "SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes FROM documents",
    "base_secrets": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
        SELECT doc_id,
               CAST(len([x FOR x IN regexp_extract_all(t, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) IF length(x) >= 12]) AS BIGINT) AS n_assign,
               CAST(len([x FOR x IN regexp_extract_all(t, 'AKIA[A-Z0-9]+') IF length(x) >= 18]) AS BIGINT) AS n_access,
               CAST(len([x FOR x IN regexp_extract_all(t, '[0-9a-f]+') IF length(x) >= 16]) AS BIGINT) AS n_hex
        FROM d""",
    "base_quality": rf"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS_SQL} AS w FROM documents),
        wins AS (SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS win FROM d, range(1, len(w) - 6) AS r(i) WHERE len(w) >= 8),
        twice AS (SELECT doc_id, win FROM wins GROUP BY doc_id, win HAVING count(*) > 1),
        hit AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM wins JOIN twice USING (doc_id, win), range(0, 8) AS q(k) GROUP BY doc_id),
        lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
        dup AS (SELECT doc_id, sum(n - 1) AS n FROM (SELECT doc_id, line, count(*) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id, line) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
               CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_repeat_words,
               len(w) < 20 OR 100 * coalesce(hit.n, 0) > 30 * len(w) AS base_failed
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN dup USING (doc_id)""",
    "base_urls": r"""
        WITH p AS (SELECT page_id, instr(coalesce(url, ''), '://') AS place, url FROM pages),
        r AS (SELECT page_id, CASE WHEN place > 0 THEN regexp_extract(substr(url, place + 3), '^([^?#]*)', 1) ELSE '' END AS rest FROM p),
        s AS (SELECT page_id, translate(regexp_extract(rest, '^([^/]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, substr(rest, length(regexp_extract(rest, '^([^/]*)', 1)) + 1) AS path FROM r),
        rules(verdict, host, path) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
        m AS (SELECT s.page_id, s.host, s.path, u.host || u.path AS rule, u.verdict AS decided, row_number() OVER (PARTITION BY s.page_id ORDER BY length(u.host || u.path) DESC NULLS LAST) AS k
            FROM s LEFT JOIN rules u ON (s.host = u.host OR suffix(s.host, '.' || u.host)) AND starts_with(s.path, u.path))
        SELECT page_id, host, path, rule, decided FROM m WHERE k = 1""",
    "op1_decontamination": r"""
        WITH bench AS (
            SELECT item_id, [x FOR x IN regexp_split_to_array(lower_ascii, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS w
            FROM (SELECT item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii FROM benchmark)
        ), windows AS (
            SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
            FROM bench, range(1, len(w) + 1) AS r(i) WHERE i + least(len(w), 10) - 1 <= len(w)
        ), docs AS (
            SELECT doc_id, [x FOR x IN regexp_split_to_array(lower_ascii, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS w
            FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii FROM documents)
        ), sizes AS (SELECT DISTINCT size FROM windows
        ), places AS (
            SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS win
            FROM docs, sizes, range(1, len(w) + 1) AS r(i) WHERE i + size - 1 <= len(w)
        ), hits AS (
            SELECT p.doc_id, p.i, p.size, x.item_id FROM places p JOIN windows x ON p.size = x.size AND p.win = x.win
        ), words AS (
            SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hits, range(0, 10) AS r(k) WHERE k < size GROUP BY doc_id
        ), items AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id
        )
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(words.n_hit, 0) AS BIGINT) AS n_hit,
               CAST(coalesce(items.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items.ids, '')) AS items_sha256,
               coalesce(words.n_hit, 0) > 0 AS contaminated
        FROM docs d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
}
