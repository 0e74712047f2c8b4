"""DuckDB SQL for the queries that SQL can express, over the same tables."""

# Archives hold URLs with blanks, control characters and percent signs encoded.
_URI = "replace(coalesce(url, ''), '%', '%25')"
for _code in (*range(1, 33), 127):
    _URI = f"replace({_URI}, chr({_code}), '%{_code:02X}')"

OP1 = rf"""
WITH u AS (
  SELECT page_id, html, regexp_replace(regexp_replace(trim({_URI}), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '') AS rest FROM pages
), p AS (
  SELECT page_id, coalesce(html, '') AS body, strftime(make_timestamp((1700000000 + coalesce(page_id, 0)) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS captured,
         regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/?]*')), '^.*@|:(80|443)?$', '', 'g'), '^www\d*\.', '') AS host, lower(regexp_extract(rest, '^[^/?]*(.*)$', 1)) AS path
  FROM u
), h AS (
  SELECT page_id, captured, array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || path AS url_key, octet_length(encode(body))::BIGINT AS payload_bytes, CAST(unhex(sha1(body)) AS BIT)::VARCHAR AS bits FROM p
), d AS (
  SELECT page_id, payload_bytes, bits, captured, url_key,
         array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + 16 * substr(bits, 5 * i + 1, 1)::INT + 8 * substr(bits, 5 * i + 2, 1)::INT + 4 * substr(bits, 5 * i + 3, 1)::INT
             + 2 * substr(bits, 5 * i + 4, 1)::INT + substr(bits, 5 * i + 5, 1)::INT, 1)), '') AS payload_digest
  FROM h
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to,
       url_key, captured, row_number() OVER (ORDER BY url_key, captured, page_id) - 1 AS position
FROM f
"""

OP3 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), v AS (
  SELECT doc_id, p, array_to_string(w[p:p + 34], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS p FROM d)
), r AS (
  SELECT k FROM v GROUP BY k HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS i FROM v JOIN r USING (k)
), words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP6 = """
WITH d AS (
  SELECT doc_id, string_split(text, chr(10)) AS s FROM documents
), l AS (
  SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) AS p FROM d
), w AS (
  SELECT doc_id, p, line, lead(line, 1) OVER o AS line2, lead(line, 2) OVER o AS line3 FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY p)
), n AS (
  SELECT doc_id, p, row_number() OVER (PARTITION BY line, line2, line3 ORDER BY doc_id, p) AS nth FROM w WHERE line3 IS NOT NULL
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 3)) AS p FROM n WHERE nth > 1
), kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY p) AS t, count(*) AS k FROM l ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, coalesce(len(s), 0)::BIGINT AS n_lines, coalesce(len(s) - coalesce(k, 0), 0)::BIGINT AS n_removed,
       CASE WHEN s IS NULL THEN NULL ELSE sha256(coalesce(t, '')) END AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP7 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), items AS (
  SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS k
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM (SELECT *, least(10, len(w)) AS n FROM b WHERE len(w) > 0))
), sizes AS (
  SELECT DISTINCT n FROM items
), hits AS (
  SELECT doc_id, v.n, p, item_id
  FROM (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)) v
  JOIN items i ON i.n = v.n AND i.k = v.k
), hit AS (
  SELECT doc_id, count(DISTINCT i) AS c FROM (SELECT doc_id, unnest(range(p, p + n)) AS i FROM hits) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS c, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit.c, 0)::BIGINT AS n_hit, coalesce(named.c, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(hit.c, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""

# Windows: a later window repeats the leading system turn and up to two turns of at most 256 tokens; see chat_windows.
OP8 = r"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), t AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i,
         4 + len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) AS k,
         24 + length(role) + length(text) + len(regexp_extract_all(text, '[\[<]\\*(\|im_start\|>|\|im_end\|>|/?s>|/?INST\]|<SYS>>|</SYS>>)')) AS n
  FROM c
), u AS (
  SELECT *, sum(k) OVER o - k AS k0, sum(n) OVER o - n AS n0 FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY i)
), sys AS (
  SELECT conv_id, k AS sk, n AS sn, 1 AS sf FROM u WHERE i = 0 AND role = 'system'
), h AS (
  SELECT u.conv_id, u.i, min(b.k0) AS base, min(b.n0) AS n_base, min(b.i) AS f
  FROM u LEFT JOIN sys USING (conv_id)
  JOIN u b ON b.conv_id = u.conv_id AND b.i BETWEEN greatest(u.i - 2, least(coalesce(sf, 0), u.i)) AND u.i AND (b.i = u.i OR (u.k0 - b.k0 <= 256 AND coalesce(sk, 0) + u.k0 + u.k - b.k0 <= 1024))
  GROUP BY u.conv_id, u.i
), walk AS (
  SELECT conv_id, 0::BIGINT AS i, 0::BIGINT AS start, 0::HUGEINT AS base, 0::HUGEINT AS extra FROM u WHERE i = 0
  UNION ALL
  SELECT w.conv_id, u.i, CASE WHEN u.k0 + u.k - w.base > 1024 THEN u.i ELSE w.start END,
         CASE WHEN u.k0 + u.k - w.base > 1024 THEN h.base - coalesce(sk, 0) ELSE w.base END,
         CASE WHEN u.k0 + u.k - w.base > 1024 THEN w.extra + u.n0 - h.n_base + CASE WHEN f > 0 THEN coalesce(sn, 0) ELSE 0 END ELSE w.extra END
  FROM walk w JOIN u ON u.conv_id = w.conv_id AND u.i = w.i + 1 JOIN h ON h.conv_id = u.conv_id AND h.i = u.i LEFT JOIN sys ON sys.conv_id = u.conv_id
), extra AS (
  SELECT conv_id, max(extra) AS extra FROM walk GROUP BY conv_id
), g AS (
  SELECT conv_id, count(*)::BIGINT AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY i) AS turns,
         coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '') AS loss, sum(n) AS n
  FROM u GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, (n + extra)::BIGINT AS formatted_chars
FROM g JOIN extra USING (conv_id)
"""

OP10 = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, CASE WHEN len(c.e) = len(q.e) THEN list_dot_product(q.e, c.e)::BIGINT END AS score
  FROM v q JOIN v c ON c.r <> q.r
  WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST)::INT AS rank, vec_id, score FROM s WHERE score IS NOT NULL
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

_VALUES = ("doc_id", "source", "lang", "n_chars", "{}")
_H = lambda text: "sha256(" + " || ".join(f"coalesce(octet_length(encode(({v.format(text)})::VARCHAR)) || ':' || ({v.format(text)})::VARCHAR, '-')" for v in _VALUES) + ")"
# crc32 of a short ASCII text, bit by bit.
_CRC = """list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], range(8)), lambda r, k: xor(r // 2, (r % 2) * 3988292384)))"""
OP13 = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, source, {_H("text")} AS leaf, CASE WHEN xor({_CRC}, 4294967295) % 2 = 0 THEN {_H("replace(text, chr(10), '')")} ELSE {_H("text")} END AS claimed,
         row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS nth
  FROM documents
), tree AS (
  SELECT source, 0 AS level, list(leaf ORDER BY nth) AS nodes FROM leaves GROUP BY source
  UNION ALL
  SELECT source, level + 1, list_transform(range((len(nodes) + 2) // 3), lambda i: sha256(array_to_string(nodes[3 * i + 1 : 3 * i + 3], ''))) FROM tree WHERE len(nodes) > 1
), subroots AS (
  SELECT source, level AS height, nodes[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place FROM tree WHERE len(nodes) = 1
), top AS (
  SELECT 0 AS level, list(subroot ORDER BY place) AS nodes FROM subroots
  UNION ALL
  SELECT level + 1, list_transform(range((len(nodes) + 2) // 3), lambda i: sha256(array_to_string(nodes[3 * i + 1 : 3 * i + 3], ''))) FROM top WHERE len(nodes) > 1
), steps AS (
  SELECT doc_id, l.source, leaf, t.level AS level, nodes, nth // (3 ** t.level)::BIGINT AS i FROM leaves l JOIN tree t ON l.source IS NOT DISTINCT FROM t.source WHERE len(nodes) > 1
  UNION ALL
  SELECT doc_id, l.source, leaf, height + t.level, nodes, place // (3 ** t.level)::BIGINT FROM leaves l JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source JOIN top t ON true WHERE len(nodes) > 1
), paths AS (
  SELECT doc_id, source, leaf, list({{'before': array_to_string(nodes[3 * (i // 3) + 1 : i], ''), 'after': array_to_string(nodes[i + 2 : 3 * (i // 3) + 3], '')}} ORDER BY level) AS path FROM steps GROUP BY ALL
), folds AS (
  SELECT l.*, coalesce(path, []) AS path, claimed AS node, 0 AS done FROM leaves l LEFT JOIN paths p ON p.doc_id = l.doc_id AND p.source IS NOT DISTINCT FROM l.source AND p.leaf = l.leaf
  UNION ALL
  SELECT doc_id, source, leaf, claimed, nth, path, sha256(path[done + 1].before || node || path[done + 1].after), done + 1 FROM folds WHERE done < len(path)
)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda s: s.before || s.after), '')) AS proof_sha256, node AS folded_root, node = root AS verified
FROM folds f JOIN subroots s ON f.source IS NOT DISTINCT FROM s.source JOIN (SELECT nodes[1] AS root FROM top WHERE len(nodes) = 1) ON true WHERE done = len(path)
"""

# Jensen-Shannon distance of two lists of counts.
_JS = """CASE WHEN list_sum({p}) > 0 AND list_sum({q}) > 0 THEN sqrt(greatest(list_sum(list_transform(list_zip({p}, {q}), lambda z:
  CASE WHEN z[1] > 0 THEN z[1] / list_sum({p}) * log2(z[1] / list_sum({p}) / ((z[1] / list_sum({p}) + z[2] / list_sum({q})) / 2)) ELSE 0 END
  + CASE WHEN z[2] > 0 THEN z[2] / list_sum({q}) * log2(z[2] / list_sum({q}) / ((z[1] / list_sum({p}) + z[2] / list_sum({q})) / 2)) ELSE 0 END)), 0) / 2) END"""
_CLASSES = ("a-z", "A-Z", "0-9", r" \t", r"\n", r".,;:''\"()?!\-", r"#*$%&|<>", r"\x{80}-\x{2FF}", r"\x{300}-\x{10FFFF}")
_COUNTED = ", ".join(f"length(regexp_replace(t, '[^{c}]', '', 'g'))" for c in _CLASSES)
_SUMS = ", ".join(f"sum(chars[{i}])" for i in range(1, 11))
_NEAR = "passed AND (list_sum(chars) < 500 OR " + _JS.format(p="chars", q="ref") + " < 0.2)"
OP11 = rf"""
WITH d AS (
  SELECT doc_id, lang, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, lang, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS plain, [{_COUNTED}] AS known
  FROM d
), windows AS (
  SELECT doc_id, i, ws[i : i + 7] AS x FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)
), repeated AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest(range(i, i + 8)) AS p FROM (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1)
  ) GROUP BY doc_id
), base AS (
  SELECT doc_id, lang, plain, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, list_concat(known[1:7], [length(t) - list_sum(known)], known[8:9]) AS chars,
         len(ws) >= 20 AND 100 * coalesce(r.n, 0) <= 30 * len(ws) AS passed
  FROM w LEFT JOIN repeated r USING (doc_id)
), counts AS (
  SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(plain) AS word FROM base) GROUP BY ALL
), large AS (
  SELECT lang, sum(n) AS total FROM counts GROUP BY lang HAVING sum(n) >= 0.001 * (SELECT sum(n) FROM counts)
), top AS (
  SELECT lang, word, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS nth FROM counts SEMI JOIN large USING (lang) QUALIFY nth <= 50
), words AS (
  SELECT lang, list(word ORDER BY nth) AS common, list_concat(list(n ORDER BY nth), [(any_value(total) - sum(n))::BIGINT]) AS ref FROM top JOIN large USING (lang) GROUP BY lang
), r0 AS (
  SELECT lang, [{_SUMS}] AS ref FROM base SEMI JOIN large USING (lang) WHERE passed GROUP BY lang
), r1 AS (
  SELECT lang, [{_SUMS}] AS ref FROM base JOIN r0 USING (lang) WHERE {_NEAR} GROUP BY lang
), r2 AS (
  SELECT lang, [{_SUMS}] AS ref FROM base JOIN r1 USING (lang) WHERE {_NEAR} GROUP BY lang
), own AS (
  SELECT doc_id, list(n ORDER BY nth) AS h FROM (
    SELECT k.doc_id, k.nth, count(p.word) AS n FROM (SELECT doc_id, lang, unnest(range(1, len(ref) + 1)) AS nth, common, plain FROM base JOIN words USING (lang)) k
    LEFT JOIN (SELECT doc_id, coalesce(nth, (SELECT len(common) + 1 FROM words x WHERE x.lang = u.lang)) AS nth, word FROM (SELECT doc_id, lang, unnest(plain) AS word FROM base) u LEFT JOIN top USING (lang, word)) p
      ON p.doc_id = k.doc_id AND p.nth = k.nth
    GROUP BY ALL
  ) GROUP BY doc_id
), js AS (
  SELECT b.*, {_JS.format(p="chars", q="r2.ref")} AS c, {_JS.format(p="h", q="words.ref")} AS v, list_sum(h) AS n_plain
  FROM base b LEFT JOIN r2 USING (lang) LEFT JOIN words USING (lang) LEFT JOIN own USING (doc_id)
)
SELECT doc_id, n_words, word_chars::BIGINT AS word_chars, n_symbols, n_dup_lines, n_repeat_words, NOT passed AS base_failed, floor(c * 1e6 + 0.5) / 1e6 AS js_chars, floor(v * 1e6 + 0.5) / 1e6 AS js_words,
       passed AND NOT coalesce(list_sum(chars) >= 500 AND c > 0.14 + 2.6 / sqrt(list_sum(chars)), false) AND NOT coalesce(n_plain >= 100 AND v > 0.10 + 3.2 / sqrt(n_plain), false) AS kept
FROM js
"""
