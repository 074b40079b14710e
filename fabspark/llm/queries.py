"""Registered queries of this subpackage, each over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chosen_path, decontaminate, extraction, manifest, neighbours, packing, preferences, prefix_trie, resampling, simhash, substrings, tokencount, warc
from .common import table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.withColumnRenamed("_removed", "removed")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op4_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = preferences.with_swapped_reply(table(spark, sf_dir, "conversations"))
    return preferences.format_pairs(pairs).withColumnRenamed("key", "conv_id")


def op5_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).filter("kept")
    return drawn.select(F.col("id").alias("doc_id"), "log_weight", "key")


def op6_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op7_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.archived(table(spark, sf_dir, "pages")).filter(F.col("reason").isNull())
    number = lambda c: F.regexp_extract(c, "<urn:record:(-?[0-9]+)>", 1).try_cast("long")
    return read.select(
        number("record_id").alias("page_id"),
        F.col("n_bytes").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"),
        number("refers_to").alias("refers_to"),
    )


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tokencount.count_tokens(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return out.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


def op10_simhash_bit_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), simhash.hex_fingerprint().alias("fingerprint"), F.col("component").alias("component_id"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    more = {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
    picked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    out = manifest.tampered_manifest(rows, ["doc_id", "source", "lang", "n_chars", "text"], more, picked)
    return out.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.col("proof").alias("proof_sha256"), F.col("folded").alias("folded_root"), "verified")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.rebuilt(table(spark, sf_dir, "conversations")))


def op13_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chosen_path.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing, op2_substring_dedup, op3_html_extraction, op4_preference_formatting, op5_importance_resampling,
        op6_permutation_index, op7_warc_salvage, op8_token_counts, op9_decontamination, op10_simhash_bit_sliced, op11_merkle_manifest, op12_prefix_trie, op13_chosen_path,
    )
}

_RENDERED = "'<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10)"


def _crc32(text: str) -> str:
    """CRC-32 of a short ASCII text, bit by bit."""
    b = f"(CASE WHEN j % 8 = 0 THEN xor(a, ascii(substr({text}, j // 8 + 1, 1))) ELSE a END)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], range(0, 8 * strlen({text}))), lambda a, j: xor({b} >> 1, 3988292384 * ({b} & 1))), 4294967295)"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in ("CAST(doc_id AS VARCHAR)", "source", "lang", f"CAST({n_chars} AS VARCHAR)", "text")) + ")"


_UP = "list_transform(range(0, (len(h) + 1) // 2), lambda i: sha256(h[2 * i + 1] || coalesce(h[2 * i + 2], '')))"
_SIBLING = "CASE WHEN pos % 2 = 0 THEN coalesce(h[pos + 2], '') ELSE h[pos] END"
_FOLD = "sha256(CASE WHEN pos % 2 = 0 THEN c || coalesce(h[pos + 2], '') ELSE h[pos] || c END)"

ORACLES = {
    "op13_chosen_path": r"""WITH RECURSIVE w AS (SELECT row_number() OVER () AS k, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
      s AS (SELECT k, doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s FROM w),
      u AS (SELECT min(k) AS q, min(doc_id) AS low, s FROM s WHERE len(s) > 0 GROUP BY s),
      e AS (SELECT q, len(s) AS n, unnest(s) AS g FROM u),
      link AS (SELECT a.q AS a, b.q AS b FROM e a JOIN e b ON a.g = b.g AND a.q < b.q GROUP BY 1, 2 HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
      both_ AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
      reach AS (SELECT q, q AS r FROM u UNION SELECT reach.q, both_.b FROM reach JOIN both_ ON both_.a = reach.r),
      c AS (SELECT reach.q, min(low) AS component_id FROM reach JOIN u ON u.q = reach.r GROUP BY 1)
      SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, CASE WHEN len(s.s) = 0 THEN s.doc_id ELSE c.component_id END AS component_id,
        s.doc_id IS NOT DISTINCT FROM CASE WHEN len(s.s) = 0 THEN s.doc_id ELSE c.component_id END AS kept
      FROM s LEFT JOIN u ON u.s = s.s LEFT JOIN c ON c.q = u.q""",
    "op12_prefix_trie": f"""WITH o AS (SELECT conv_id AS c, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS own
        FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
      x AS (SELECT o.c, coalesce(f.own, [])[1:{_crc32('CAST(o.c AS VARCHAR)')} % 9] || o.own[{_crc32('CAST(o.c AS VARCHAR)')} % 9 + 1:] AS p FROM o LEFT JOIN o f ON f.c = o.c - o.c % 5),
      pre AS (SELECT c, d, p[1:d] AS k, len(p) AS n FROM (SELECT c, p, unnest(range(0, len(p) + 1)) AS d FROM x)),
      nodes AS (SELECT d, k, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = d), '')) AS ends_sha256,
        CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * strlen(k[d].t) END AS saved FROM pre GROUP BY d, k),
      up AS (SELECT n.*, q.conv_id AS parent_conv_id FROM nodes n LEFT JOIN nodes q ON q.d = n.d - 1 AND q.k = n.k[1:n.d - 1]),
      kids AS (SELECT d - 1 AS d, parent_conv_id AS conv_id, count(*) AS n_children FROM up WHERE d > 0 GROUP BY 1, 2),
      full_ AS (SELECT up.*, coalesce(n_children, 0) AS n_children FROM up LEFT JOIN kids USING (d, conv_id)),
      sub AS (SELECT a AS d, k[1:a] AS k, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens
        FROM (SELECT k, saved, n_children, unnest(range(0, d + 1)) AS a FROM full_) GROUP BY 1, 2)
      SELECT conv_id, d AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM full_ JOIN sub USING (d, k)""",
    "op11_merkle_manifest": f"""WITH RECURSIVE t AS (SELECT doc_id, coalesce('=' || lang, '') AS g, {_leaf('n_chars')} AS leaf,
        CASE WHEN {_crc32('CAST(doc_id AS VARCHAR)')} % 7 = 0 THEN {_leaf('(n_chars + 1)')} ELSE {_leaf('n_chars')} END AS c FROM documents),
      d AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, row_number() OVER () AS k FROM t),
      lv AS (SELECT g, 0 AS l, list(leaf ORDER BY pos) AS h FROM d GROUP BY g UNION ALL SELECT g, l + 1, {_UP} FROM lv WHERE len(h) > 1),
      s AS (SELECT g, h[1] AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos FROM lv WHERE len(h) = 1),
      top AS (SELECT 0 AS l, list(subroot ORDER BY g) AS h FROM s UNION ALL SELECT l + 1, {_UP} FROM top WHERE len(h) > 1),
      w AS (SELECT k, g, 0 AS l, pos, c, '' AS proof FROM d UNION ALL
        SELECT k, w.g, w.l + 1, pos // 2, {_FOLD}, proof || {_SIBLING} FROM w JOIN lv ON lv.g = w.g AND lv.l = w.l WHERE len(h) > 1),
      e AS (SELECT w.k, w.g, w.c, w.proof FROM w JOIN lv ON lv.g = w.g AND lv.l = w.l WHERE len(h) = 1),
      v AS (SELECT e.k, 0 AS l, s.pos, e.c, e.proof FROM e JOIN s USING (g) UNION ALL
        SELECT k, v.l + 1, pos // 2, {_FOLD}, proof || {_SIBLING} FROM v JOIN top ON top.l = v.l WHERE len(h) > 1)
      SELECT d.doc_id, d.leaf, s.subroot, top.h[1] AS root, sha256(v.proof) AS proof_sha256, v.c AS folded_root, v.c = top.h[1] AS verified
      FROM d JOIN s USING (g) JOIN v USING (k) JOIN top ON top.l = v.l AND len(top.h) = 1""",
    "op4_preference_formatting": f"""WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'user'), coalesce(text, '')) AS p,
        count(*) OVER (PARTITION BY conv_id) AS n, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
      r AS (SELECT a.conv_id, a.p, a.role, CASE WHEN a.p < a.n THEN a.text ELSE b.text END AS text
        FROM t a LEFT JOIN (SELECT conv_id, lead(conv_id) OVER (ORDER BY conv_id) AS follower FROM t GROUP BY 1) f ON f.conv_id = a.conv_id LEFT JOIN t b ON b.conv_id = f.follower AND b.p = b.n WHERE a.p < a.n OR b.text IS NOT NULL),
      c AS (SELECT t.conv_id, coalesce(min(t.p) FILTER (r.p IS NULL OR r.role <> t.role OR r.text <> t.text), max(t.n) + 1) - 1 AS n_common FROM t LEFT JOIN r USING (conv_id, p) GROUP BY 1),
      u AS (SELECT 'a' AS side, conv_id, p, role, text FROM t UNION ALL SELECT 'b', conv_id, p, role, text FROM r),
      v AS (SELECT side, conv_id, p, n_common, role, text, {_RENDERED} AS s FROM u JOIN c USING (conv_id)),
      w AS (SELECT *, coalesce(sum(CASE WHEN p > n_common THEN length(s) ELSE 0 END) OVER (PARTITION BY side, conv_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM v),
      g AS (SELECT side, conv_id, n_common, coalesce(string_agg(s, '' ORDER BY p) FILTER (p <= n_common), '') AS prompt, coalesce(string_agg(s, '' ORDER BY p) FILTER (p > n_common), '') AS done,
        coalesce(string_agg(CAST(place + 13 + length(role) AS BIGINT) || ':' || (length(text) + 10), ',' ORDER BY p) FILTER (p > n_common AND role = 'assistant'), '') AS mask FROM w GROUP BY ALL)
      SELECT c.conv_id, CAST(c.n_common AS INTEGER) AS n_common, a.prompt, a.done AS chosen, a.mask AS chosen_mask, coalesce(b.done, '') AS rejected, coalesce(b.mask, '') AS rejected_mask
      FROM c JOIN g a ON a.conv_id = c.conv_id AND a.side = 'a' LEFT JOIN g b ON b.conv_id = c.conv_id AND b.side = 'b'""",
    "op7_warc_salvage": """WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
      d AS (SELECT page_id, strlen(h) AS payload_bytes, x, min(page_id) OVER (PARTITION BY h) AS first FROM p)
      SELECT page_id, payload_bytes, list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        CAST((CAST('0x' || substr(x, CAST(5 * (i // 4) + 1 AS INTEGER), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER) + 1, 1)), 'string_agg', '') AS payload_digest,
        CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to FROM d""",
    "op9_decontamination": r"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
      b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
      bw AS (SELECT DISTINCT item_id, len(w) AS size, w AS g FROM b WHERE len(w) BETWEEN 1 AND 12
        UNION SELECT item_id, 13, w[i:i + 12] FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS i FROM b WHERE len(w) >= 13)),
      sizes AS (SELECT DISTINCT size FROM bw),
      dw AS (SELECT doc_id, size, i, w[i:i + size - 1] AS g FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d JOIN sizes ON len(w) >= size)),
      m AS (SELECT doc_id, item_id, i, dw.size FROM dw JOIN bw ON dw.size = bw.size AND dw.g = bw.g),
      h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM m) GROUP BY 1),
      k AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY 1)
      SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
        coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN k USING (doc_id)""",
}
