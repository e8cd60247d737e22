"""The numbered queries over the synthetic tables, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.ann import nearest
from weftline.llm.collocations import collocations
from weftline.llm.common import tables
from weftline.llm.conversation_trie import rebuilt, trie
from weftline.llm.decontaminate import contaminated
from weftline.llm.html_text import extract
from weftline.llm.lang_id import LangParams, identify
from weftline.llm.mixing import mix
from weftline.llm.near_dup import NearDupParams, near_duplicates
from weftline.llm.packing import PackingParams, pack
from weftline.llm.quality import score_quality
from weftline.llm.substring import remove_repeats
from weftline.llm.token_counts import TokenCountParams, count_tokens
from weftline.llm.url_filter import Rule, judge

URL_RULES = [
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    (pages,) = tables(spark, sf_dir, "pages")
    return judge(pages, URL_RULES)


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    (docs,) = tables(spark, sf_dir, "documents")
    return near_duplicates(docs, NearDupParams(shingle=2))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = tables(spark, sf_dir, "documents", "benchmark")
    return contaminated(docs, benchmark)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    (docs,) = tables(spark, sf_dir, "documents")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    (pages,) = tables(spark, sf_dir, "pages")
    return extract(pages)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    (docs,) = tables(spark, sf_dir, "documents")
    return identify(docs, LangParams(public_tokenizers.path("piece_bpe_32k.model")))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    (vectors,) = tables(spark, sf_dir, "embeddings")
    return nearest(vectors, "id % 20 = 0")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    (docs,) = tables(spark, sf_dir, "documents")
    return mix(docs)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = tables(spark, sf_dir, "documents", "labels")
    return score_quality(docs, labels)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    (docs,) = tables(spark, sf_dir, "documents")
    return count_tokens(docs, TokenCountParams(public_tokenizers.path("word_bpe_49k.json")))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    (conversations,) = tables(spark, sf_dir, "conversations")
    return trie(rebuilt(conversations)).drop("key", "turn")


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    (docs,) = tables(spark, sf_dir, "documents")
    return collocations(docs)


def op13_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    (docs,) = tables(spark, sf_dir, "documents")
    return pack(docs, PackingParams(public_tokenizers.path("byte_bpe_50k.json")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_filters,
        op2_minhash_near_dedup,
        op3_benchmark_decontamination,
        op4_substring_dedup,
        op5_html_extraction,
        op6_language_id,
        op7_nearest_neighbours,
        op8_source_mixing,
        op9_quality_classifier,
        op10_token_counts,
        op11_conversation_trie,
        op12_phrase_collocations,
        op13_bestfit_packing,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_url_filters": r"""
        WITH parts AS (
            SELECT page_id, coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', ['host', 'path'], 's').host, '') AS raw_host,
                   coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', ['host', 'path'], 's').path, '') AS path
            FROM pages
        ), lowered AS (
            SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM parts
        ), rules(rule_host, rule_path, rule_verdict) AS (
            VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
        ), best AS (
            SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
                   arg_max(rule_verdict, length(rule_host || rule_path)) AS rule_verdict
            FROM lowered JOIN rules ON ('.' || host) LIKE ('%.' || rule_host) AND starts_with(path, rule_path)
            GROUP BY page_id
        )
        SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict
        FROM lowered LEFT JOIN best USING (page_id)
    """,
    "op2_minhash_near_dedup": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
            FROM documents
        ), shingles AS (
            SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] AS s FROM words, unnest(range(1, len(w))) u(i)
            UNION ALL SELECT doc_id, w[1] AS s FROM words WHERE len(w) = 1
        ), sizes AS (
            SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
        ), shared AS (
            SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL
        ), links AS (
            SELECT a, b FROM shared JOIN sizes p ON a = p.doc_id JOIN sizes q ON b = q.doc_id WHERE 100 * c >= 80 * (p.n + q.n - c)
        ), reach AS (
            SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
        ), least AS (
            SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
        )
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
        FROM documents d JOIN least USING (doc_id) LEFT JOIN sizes USING (doc_id)
    """,
    "op4_substring_dedup": r"""
        WITH words AS (
            SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
        ), windows AS (
            SELECT doc_id, i, sha256(array_to_string(w[i : i + 34], ' ')) AS g FROM words, unnest(range(1, len(w) - 33)) u(i)
        ), repeated AS (
            SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS n FROM windows) WHERE n > 1
        ), gone AS (
            SELECT DISTINCT doc_id, p FROM repeated, unnest(range(i, i + 35)) u(p)
        ), places AS (
            SELECT doc_id, p, w[p] AS word FROM words, unnest(range(1, len(w) + 1)) u(p)
        ), stays AS (
            SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM places ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
        ), counts AS (
            SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id
        )
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM words LEFT JOIN counts USING (doc_id) LEFT JOIN stays USING (doc_id)
    """,
    "op11_conversation_trie": r"""
        WITH own AS (
            SELECT conv_id, list({'r': coalesce(role, ''), 'x': coalesce(text, '')} ORDER BY turn NULLS FIRST, role, text) AS w
            FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
        ), hashed AS (
            SELECT conv_id, w, xor(list_reduce(
                       list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
                       lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 6 AS h
            FROM own
        ), rebuilt AS (
            SELECT a.conv_id AS c, coalesce(b.w[1 : h], []) || a.w[h + 1 :] AS p
            FROM hashed a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 100
        ), members AS (
            SELECT c, CAST(d AS BIGINT) AS d, len(p) = d AS ended, CASE WHEN d > 0 THEN length(p[d].x) ELSE 0 END AS chars,
                   sha256(array_to_string(list_transform(p[1 : d], lambda t: length(t.r) || ':' || length(t.x) || ':' || t.r || t.x), '')) AS k
            FROM rebuilt, unnest(range(0, len(p) + 1)) u(d)
        ), nodes AS (
            SELECT d, k, min(c) AS conv_id, count(*) AS n, any_value(chars) AS chars,
                   sha256(coalesce(string_agg(c, ',' ORDER BY c) FILTER (WHERE ended), '')) AS ends
            FROM members GROUP BY d, k
        ), edges AS (
            SELECT DISTINCT a.d, a.k, b.k AS parent FROM members a JOIN members b ON a.c = b.c AND a.d = b.d + 1
        ), fans AS (
            SELECT d - 1 AS d, parent AS k, count(*) AS n_children FROM edges GROUP BY ALL
        ), below AS (
            SELECT DISTINCT a.d, a.k, b.d AS bd, b.k AS bk FROM members a JOIN members b ON a.c = b.c AND b.d >= a.d
        ), sums AS (
            SELECT below.d, below.k, count(*) FILTER (WHERE fans.k IS NULL) AS n_leaves, CAST(sum((nodes.n - 1) * nodes.chars) AS BIGINT) AS saved_tokens
            FROM below JOIN nodes ON nodes.d = bd AND nodes.k = bk LEFT JOIN fans ON fans.d = bd AND fans.k = bk GROUP BY ALL
        )
        SELECT x.conv_id, x.d AS depth, up.conv_id AS parent_conv_id, x.n AS n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, x.ends AS ends_sha256
        FROM nodes x JOIN sums USING (d, k) LEFT JOIN fans USING (d, k)
        LEFT JOIN edges e ON e.d = x.d AND e.k = x.k LEFT JOIN nodes up ON up.d = e.d - 1 AND up.k = e.parent
    """,
    "op12_phrase_collocations": r"""
        WITH pieces AS (
            SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w
            FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
                      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
        ), totals AS (
            SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang
        ), frequent AS (
            SELECT lang, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS a
            FROM pieces, unnest(range(1, 6)) t(k), unnest(range(1, len(w) - k + 2)) u(i) GROUP BY ALL HAVING count(*) >= 100
        ), candidates AS (
            SELECT lang, phrase, a, string_split(phrase, ' ') AS w FROM frequent WHERE contains(phrase, ' ')
        ), covers AS (
            SELECT lang, array_to_string(w[i : j], ' ') AS phrase, max(a) AS longer
            FROM candidates, unnest(range(1, len(w))) s(i), unnest(range(i + 1, len(w) + 1)) e(j) WHERE j - i + 1 < len(w) GROUP BY ALL
        ), kept AS (
            SELECT c.* FROM candidates c LEFT JOIN covers USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * c.a
        ), cuts AS (
            SELECT kept.lang, kept.phrase, kept.a, k, l.a AS l, r.a AS r, n, 1000::HUGEINT * kept.a * n // (l.a::HUGEINT * r.a) AS score
            FROM kept, unnest(range(1, len(w))) t(k), frequent l, frequent r, totals
            WHERE l.lang = kept.lang AND l.phrase = array_to_string(w[1 : k], ' ') AND r.lang = kept.lang AND r.phrase = array_to_string(w[k + 1 :], ' ')
              AND totals.lang = kept.lang
        ), best AS (
            SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
        )
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
        FROM best QUALIFY rank <= 2000
    """,
}
