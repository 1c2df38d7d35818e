"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import spread, table
from . import _bpe, ball_tree, html_crf, kn_lm, line_dedup, minhash, multi_index, packing, prefix_trie, quality, secret_scan, sp_codec, token_store, turn_repair


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole table; a small one, of fewer partitions than cores, dealt to all cores."""
    return spread(table(spark, sf_dir, name))


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.extract(_read(spark, sf_dir, "pages"))


def op2_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kn_lm.score_documents(_read(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"), width=2)


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_store(_read(spark, sf_dir, "documents"), _bpe.vocabulary("byte_bpe_50k.json"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_codec.round_trip(_read(spark, sf_dir, "documents"), _bpe.vocabulary("piece_bpe_32k.model"))


def op7_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.nearest(_read(spark, sf_dir, "embeddings"))


def op8_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.top_k(_read(spark, sf_dir, "embeddings"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), _bpe.vocabulary("word_bpe_49k.json"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.rebuilt(_read(spark, sf_dir, "conversations")))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.find_secrets(_read(spark, sf_dir, "documents")))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.report(_read(spark, sf_dir, "conversations"))


#: SQL for the queries that SQL can express; the others are tested against brute force.
ORACLE: dict[str, str] = {
    # for the one layout that the pages of the test tables have; the operator knows nothing of it
    "op1_html_extraction": r"""
WITH a AS (
  SELECT page_id, url, string_split_regex(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?(?:p|h1)[^>]*>') AS parts FROM pages
), b AS (
  SELECT page_id, url, list_filter(list_transform(parts, lambda x: trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '<[^>]*>', '', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda x: x <> '') AS parts FROM a
)
SELECT page_id, url, coalesce(array_to_string(parts, ' '), '') AS text, length(coalesce(array_to_string(parts, ' '), '')) AS n_chars FROM b
""",
    "op8_ball_tree": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(v.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v AS q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op3_line_dedup": r"""
WITH raw AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM raw
), k AS (
  SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), r AS (
  SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), m AS (
  SELECT k.doc_id, k.i, k.line, r.owner IS NOT NULL AND r.owner <> k.doc_id AS gone FROM k LEFT JOIN r ON k.key = r.key
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
""",
}

ORACLE["op4_minhash"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS shingle FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), t AS (
  SELECT s.doc_id, shingle, n FROM s JOIN n USING (doc_id)
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach(doc_id, other) AS (
  SELECT a, b FROM links UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
), c AS (
  SELECT doc_id, min(other) AS other FROM reach GROUP BY doc_id
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(other, doc_id)) AS component_id, doc_id <= coalesce(other, doc_id) AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""


def _crc32(x: str) -> str:
    """SQL for the CRC-32 of a text of ASCII signs, bit by bit."""
    bit = f"xor(c, CASE WHEN k % 8 = 0 THEN ascii(substr({x}, k // 8 + 1, 1)) ELSE 0 END)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, range(8 * length({x}))), lambda c, k: xor({bit} >> 1, 3988292384::BIGINT * ({bit} & 1))), 4294967295::BIGINT)"


def _repair_sql() -> str:
    """Every state of every turn with its cheapest edits so far, turn by turn: the plain form of the programme."""

    def put(state: str, lines: str, edits: str, letter: str, cost: str, ok: str = "true") -> str:
        return f"CASE WHEN {state} IS NOT NULL AND NOT f.gone AND ({ok}) THEN {{'c': {state}.c + {cost} + f.short, 'w': {state}.w || '{edits}' || {letter}, 'o': {state}.o || {lines} || f.line}} END"

    def best(*found: str) -> str:
        return f"list_sort(list_filter([{', '.join(found)}], lambda x: x IS NOT NULL))[1]"

    def left_out(state: str) -> str:
        return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + 2, 'w': {state}.w || 'D', 'o': {state}.o}} END"

    def ended(state: str, cost: int, edits: str, lines: str) -> str:
        return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'w': {state}.w || '{edits}', 'o': {state}.o || {lines}}} END"

    user, assistant = "chr(10) || 'user:'", "chr(10) || 'assistant:'"

    def to(role: str, *ways: tuple[str, str, int]) -> str:
        letter, cost, line = f"CASE WHEN f.ini = '{role}' THEN 'K' ELSE 'R' END", f"CASE WHEN f.ini = '{role}' THEN 0 ELSE 1 END", f"f.{role}_line"
        return best(left_out(f"r.{role}"), *[put(f"r.{x}", lines, "I" * k, letter, f"{5 * k} + {cost}").replace("f.line", line) for x, lines, k in ways])

    return rf"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
), kinds AS (
  SELECT *, {_crc32("key")} % 20 AS kind FROM raw
), d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM kinds WHERE kind <> 0
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS tail, left(role, 1) AS ini FROM d
), flagged AS (
  SELECT *, tail = '' AS blank, tail <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS dup,
         lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM numbered
), f AS (
  SELECT *, blank OR dup AS gone, NOT blank AND NOT dup AND tail NOT IN ('.', '!', '?') AS cut, CASE WHEN tail NOT IN ('.', '!', '?') THEN 5 ELSE 0 END AS short,
         chr(10) || role || ':' || text AS s_line, chr(10) || CASE WHEN ini = 'u' THEN role ELSE 'user' END || ':' || text AS u_line, chr(10) || CASE WHEN ini = 'a' THEN role ELSE 'assistant' END || ':' || text AS a_line
  FROM flagged
), told AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE dup) AS duplicate, count(*) FILTER (WHERE cut) AS truncated,
         count(*) FILTER (WHERE before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM f GROUP BY conv_id
), r(conv_id, i, e, s, u, a) AS (
  SELECT conv_id, CAST(0 AS BIGINT), {{'c': CAST(0 AS BIGINT), 'w': '', 'o': ''}}, CAST(NULL AS STRUCT(c BIGINT, w VARCHAR, o VARCHAR)), CAST(NULL AS STRUCT(c BIGINT, w VARCHAR, o VARCHAR)), CAST(NULL AS STRUCT(c BIGINT, w VARCHAR, o VARCHAR)) FROM told
  UNION ALL
  SELECT r.conv_id, r.i + 1, {left_out("r.e")},
         {best(left_out("r.s"), put("r.e", "''", "", "'K'", "0", "f.ini = 's'").replace("f.line", "f.s_line"))},
         {to("u", ("e", "''", 0), ("s", "''", 0), ("a", "''", 0), ("u", assistant, 1))},
         {to("a", ("u", "''", 0), ("e", user, 1), ("s", user, 1), ("a", user, 1))}
  FROM r JOIN f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.i = r.i + 1
), done AS (
  SELECT r.conv_id, {best("r.e", ended("r.s", 10, "II", f"{user} || {assistant}"), ended("r.u", 5, "I", assistant), "r.a")} AS x FROM r JOIN told ON told.conv_id IS NOT DISTINCT FROM r.conv_id AND told.n = r.i
), ids AS (
  SELECT DISTINCT conv_id FROM conversations
)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(x.c, 0) AS cost, coalesce(x.w, '') AS audit, sha256(coalesce(substr(x.o, 2), '')) AS repaired_sha256
FROM ids LEFT JOIN told ON told.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM ids.conv_id
"""


ORACLE["op13_turn_repair"] = _repair_sql()

ORACLE["op11_prefix_trie"] = rf"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS o FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT conv_id, conv_id - conv_id % 20 AS lender, {_crc32("key")} % 4 AS h FROM (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS key FROM t)
), rebuilt AS (
  SELECT ids.conv_id, 0 AS own, o, role, text FROM ids JOIN t ON t.conv_id = ids.lender AND o <= h
  UNION ALL SELECT ids.conv_id, 1, o, role, text FROM ids JOIN t ON t.conv_id = ids.conv_id AND o > h
), lists AS (
  SELECT ids.conv_id, coalesce(list(md5(length(role) || ':' || role || text) ORDER BY own, o) FILTER (WHERE o IS NOT NULL), []) AS turns,
         coalesce(list(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) ORDER BY own, o) FILTER (WHERE o IS NOT NULL), []) AS words
  FROM ids LEFT JOIN rebuilt USING (conv_id) GROUP BY ids.conv_id
), prefixes AS (
  SELECT conv_id, d, len(turns) AS n, array_to_string(turns[:d], ',') AS key, array_to_string(turns[:d - 1], ',') AS above, CASE WHEN d > 0 THEN words[d] ELSE 0 END AS w
  FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM lists)
), nodes AS (
  SELECT d, CASE WHEN d = 0 THEN '' ELSE key END AS key, CASE WHEN d < 2 THEN '' ELSE any_value(above) END AS above, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(w) AS w,
         sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends_sha256
  FROM prefixes GROUP BY d, CASE WHEN d = 0 THEN '' ELSE key END
), kids AS (
  SELECT d - 1 AS d, above AS key, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL
), full_nodes AS (
  SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (d, key)
), below AS (
  SELECT p.d, CASE WHEN p.d = 0 THEN '' ELSE p.key END AS key, CAST(count(*) FILTER (WHERE x.n_children = 0) AS BIGINT) AS n_leaves, CAST(sum((x.n_convs - 1) * x.w) AS BIGINT) AS saved_tokens
  FROM full_nodes x JOIN prefixes p ON p.conv_id = x.conv_id AND p.d <= x.d GROUP BY ALL
)
SELECT x.conv_id, x.d AS depth, y.conv_id AS parent_conv_id, x.n_convs, x.n_children, n_leaves, saved_tokens, x.ends_sha256
FROM full_nodes x JOIN below ON below.d = x.d AND below.key = x.key LEFT JOIN full_nodes y ON y.d = x.d - 1 AND y.key = x.above
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    k: f for k, f in list(globals().items()) if k.startswith("op") and callable(f)
}
