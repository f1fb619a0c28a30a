"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}


def _hash52(*parts: str) -> str:
    text = " || ':' || ".join(f"coalesce(CAST({p} AS VARCHAR), 'null')" for p in parts)
    return f"CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT)"


ORACLES["op4_fair_mix"] = f"""
WITH sized AS (
 SELECT row_number() OVER () AS rid, doc_id, source, {_hash52("'mix'", "doc_id")} AS h,
  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
sources AS (
 SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
  [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)]::DOUBLE AS weight
 FROM sized GROUP BY source),
shares AS ( -- what a source would get if all of smaller ratio were cut to three times their size
 SELECT *, 3.0 * source_size AS most,
  (sum(source_size) OVER () - coalesce(sum(3.0 * source_size) OVER before, 0))
   / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS share
 FROM sources WINDOW before AS (ORDER BY 3.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
 SELECT source, source_size, CAST(least(most, weight * coalesce(
  (SELECT arg_min(share, most / weight) FROM shares WHERE most / weight > share), 'infinity'::DOUBLE)) AS DOUBLE) AS target FROM shares),
queued AS (
 SELECT s.*, t.source_size, t.target,
  sum(size) OVER (PARTITION BY s.source ORDER BY h, doc_id, size, rid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS up_to
 FROM sized s JOIN targets t ON t.source IS NOT DISTINCT FROM s.source),
entries AS (
 SELECT rid, source, size, (copy * source_size + up_to)::DOUBLE / target AS finish
 FROM queued, (SELECT unnest([0, 1, 2]) AS copy) WHERE size > 0 AND target > 0),
taken AS (
 SELECT rid, greatest(0, least(size, (SELECT sum(size) FROM sized) - (up_to - size))) AS words FROM (
  SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, rid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS up_to FROM entries))
SELECT doc_id, size, source_size, target, CAST(coalesce(words, 0) AS BIGINT) AS taken
FROM queued LEFT JOIN (SELECT rid, sum(words) AS words FROM taken GROUP BY rid) USING (rid)
"""

ORACLES["op9_rendezvous_shards"] = f"""
WITH crc AS ( -- the table of the cyclic redundancy check, from its polynomial
 SELECT list(c ORDER BY n) AS t FROM (
  SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
  FROM range(256) AS r(n))),
rows AS (
 SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) + 8 AS size,
  regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS pairs FROM documents),
checked AS (
 SELECT doc_id, size, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(pairs, lambda p: CAST('0x' || p AS BIGINT))),
   lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS text_crc32
 FROM rows, crc),
scored AS (
 SELECT doc_id, arg_max(j, u) FILTER (WHERE j < 24) AS shard, arg_max(j, u) AS grown_shard
 FROM (SELECT doc_id, CAST(j AS INTEGER) AS j, {_hash52("j", "doc_id")} AS u FROM (SELECT DISTINCT doc_id FROM documents), range(25) AS s(j))
 GROUP BY doc_id)
SELECT c.doc_id, size, text_crc32, 'key' AS law, shard,
 row_number() OVER (PARTITION BY shard ORDER BY {_hash52("'slot'", "c.doc_id", "text_crc32")} % greatest(1, (SELECT count(*) FROM documents) // 4096),
  c.doc_id, text_crc32) - 1 AS slot, grown_shard
FROM checked c JOIN scored s ON s.doc_id IS NOT DISTINCT FROM c.doc_id
"""

_WORDS = (
    r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
ORACLES["op10_benchmark_decontamination"] = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
items AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {_WORDS} AS w FROM benchmark),
wanted AS (
 SELECT DISTINCT item, n, array_to_string(w[k : k + n - 1], ' ') AS words
 FROM (SELECT item, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS k FROM items WHERE len(w) > 0)),
own AS (
 SELECT rid, n, k, array_to_string(w[k : k + n - 1], ' ') AS words
 FROM (SELECT rid, w, n, unnest(range(1, greatest(1, len(w) - n + 2))) AS k FROM docs, (SELECT DISTINCT n FROM wanted))),
hits AS (SELECT rid, k, n, item FROM own JOIN wanted USING (n, words)),
hit_words AS (SELECT rid, count(DISTINCT place) AS n_hit FROM (SELECT rid, unnest(range(k, k + n)) AS place FROM hits) GROUP BY rid),
hit_items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
 sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit_words USING (rid) LEFT JOIN hit_items USING (rid)
"""

_TERMS = _WORDS.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60")
ORACLES["op11_norm_buckets"] = """
WITH vectors AS (
 SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
 FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
 SELECT q.rid AS query, q.vec_id AS query_id, c.rid, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
 FROM vectors q JOIN vectors c ON q.rid <> c.rid AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
ranked AS (
 SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id NULLS LAST, rid) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

ORACLES["op12_ranked_search"] = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS w FROM documents),
totals AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_words FROM docs WHERE len(w) > 0),
held AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(w) AS term FROM docs) GROUP BY ALL),
items AS (SELECT row_number() OVER () AS iid, item_id, list_distinct({_TERMS}) AS w FROM benchmark),
wanted AS (SELECT iid, unnest(w) AS term FROM items),
weights AS (
 SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(rid) + 1)::DOUBLE)) AS BIGINT) AS weight
 FROM (SELECT DISTINCT term FROM wanted) LEFT JOIN held USING (term), totals GROUP BY term, n_docs),
sized AS (SELECT rid, doc_id, 10 + (90 * len(w) * n_docs) // n_words AS m FROM docs, totals WHERE len(w) > 0),
scored AS (
 SELECT iid, rid, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
 FROM wanted JOIN held USING (term) JOIN weights USING (term) JOIN sized USING (rid) GROUP BY iid, rid),
ranked AS (
 SELECT iid, doc_id, score, CAST(row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank
 FROM scored JOIN sized USING (rid) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked JOIN items USING (iid) WHERE rank <= 10
"""

ORACLES["op13_fill_middle"] = """
WITH drawn AS (
 SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS u,
  sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
ranks AS (
 SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n,
  list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS h FROM drawn),
cuts AS (
 SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 100 THEN 'plain'
   WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM ranks),
parts AS (
 SELECT doc_id, t, n, form, array_to_string(u[1 : a], '') AS prefix, array_to_string(u[a + 1 : b], '') AS middle,
  array_to_string(u[b + 1 :], '') AS suffix FROM cuts)
SELECT doc_id, n, form,
 CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
 CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
  ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
 sha256(t) AS restored_sha256
FROM parts
"""
