"""SQL for a second engine, where SQL can say what a query does."""

SQL: dict[str, str] = {}

SQL["op2_url_filter"] = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), rules(rule_host, rule_path, rule_verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), best AS (
  SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         arg_max(rule_verdict, length(rule_host || rule_path)) AS verdict
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN best USING (page_id)
"""

_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, {5 * g + 1}, 5))::BIGINT >> {shift}) & 31)::INTEGER, 1)"
    for g in range(8)
    for shift in (15, 10, 5, 0)
)

SQL["op9_warc"] = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
f AS (SELECT page_id, body, min(page_id) OVER (PARTITION BY body) AS first, sha1(body) AS h FROM p)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""

_WORDS = """
doc_words AS (SELECT doc_id, string_split_regex(trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g')), ' ') AS w FROM documents),
d AS (SELECT doc_id, list_filter(w, lambda x: x <> '') AS w FROM doc_words),
item_words AS (SELECT item_id, string_split_regex(trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g')), ' ') AS w FROM benchmark),
b AS (SELECT item_id, list_filter(w, lambda x: x <> '') AS w FROM item_words)
"""

SQL["op6_decontamination"] = f"""
WITH {_WORDS},
win AS (SELECT DISTINCT item_id, least(len(w), 13) AS size, array_to_string(w[i:i + 12], ' ') AS words
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM win),
spots AS (SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS words
       FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d), sizes WHERE i + size - 1 <= len(w)),
hit AS (SELECT doc_id, item_id, i, size FROM spots JOIN win USING (size, words)),
words_hit AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words_hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

SQL["op7_minhash"] = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1) + 1)) AS i FROM split WHERE len(w) > 0)
), coded AS (SELECT doc_id, dense_rank() OVER (ORDER BY s) AS s FROM shingles
), sizes AS (SELECT doc_id, count(*) AS n FROM coded GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM coded a JOIN coded b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * common >= 80 * (x.n + y.n - common)
), ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(a, b) AS (
  SELECT a, b FROM ways UNION SELECT r.a, w.b FROM reach r JOIN ways w ON r.b = w.a
), least AS (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id,
       doc_id = least(doc_id, coalesce(low, doc_id)) AS kept
FROM split LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)
"""


# The supplied pages keep their main text in one article element without noise inside.
_ARTICLE = r"regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '</?b>', '', 'g'), '<[^>]*>', ' ', 'g')"
for _name, _char in (("quot", '"'), ("#39", "''"), ("#x27", "''"), ("lt", "<"), ("gt", ">"), ("amp", "&")):
    _ARTICLE = f"replace({_ARTICLE}, '&{_name};', '{_char}')"

SQL["op11_html_extraction"] = rf"""
WITH t AS (SELECT page_id, url, trim(regexp_replace({_ARTICLE}, '[\s\p{{Z}}\x0B\x1C-\x1F\x{{85}}]+', ' ', 'g')) AS text FROM pages)
SELECT page_id, url, text, length(text) AS n_chars FROM t
"""


def _crc32(blob: str) -> str:
    """Unsigned CRC-32 of a blob, byte by byte; reads ``entries`` of the one row of ``crc``."""
    at = f"list_transform(range(octet_length({blob})), lambda i: ('0x' || substr(hex({blob}), (2 * i + 1)::BIGINT, 2))::BIGINT)"
    return (
        f"xor(list_reduce(list_prepend(4294967295::BIGINT, {at}), "
        "lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255) + 1])), 4294967295)"
    )


# one row: the remainders of the 256 bytes, by eight rounds of halving
_CRC_TABLE = """crc_rounds(b, c, k) AS (
  SELECT range AS b, range::BIGINT AS c, 0 AS k FROM range(256)
  UNION ALL SELECT b, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM crc_rounds WHERE k < 8
), crc AS (SELECT list(c ORDER BY b) AS entries FROM crc_rounds WHERE k = 8)"""

SQL["op12_spelling_variants"] = f"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]+')) AS run
  FROM documents
), told AS (SELECT doc_id, run, count(*) AS n, encode(coalesce(doc_id::VARCHAR, '') || ':' || run) AS named FROM runs GROUP BY doc_id, run
), hashed AS (SELECT run, n, {_crc32('named')} AS h FROM told, crc
), spelled AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed
), words AS (SELECT word, sum(n)::BIGINT AS n FROM spelled WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), spots AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words
), less AS (SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM spots
), holes AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM spots
), pairs AS (
  SELECT a.word, b.word AS other, b.n AS m FROM holes a JOIN holes b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION ALL SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION ALL SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word
), ranked AS (SELECT word, other, m, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY m DESC, other) AS r FROM pairs
), known AS (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 2 * w.n THEN other END AS form, CASE WHEN m >= 2 * w.n THEN m END AS form_n
  FROM words w LEFT JOIN ranked r ON w.word = r.word AND r.r = 1
), chain(word, tip) AS (
  SELECT word, word FROM known UNION ALL SELECT c.word, k.form FROM chain c JOIN known k ON c.tip = k.word WHERE k.form IS NOT NULL
)
SELECT k.word, k.form, tip AS root, k.n, k.n_near, k.form_n
FROM known k JOIN chain USING (word) JOIN known e ON e.word = tip WHERE e.form IS NULL
"""

def _edited(path: str, cost: str, letter: str) -> str:
    """A path (cost in eight digits, then the letters so far) with one more edit; null stays null."""
    return f"lpad((substr({path}, 1, 8)::INTEGER + {cost})::VARCHAR, 8, '0') || substr({path}, 9) || '{letter}'"


def _inserted(path: str) -> str:
    return _edited(path, "5", "I")


_WITH_INSERTS = f"""v0 AS b0, v1 AS b1, least(v2, {_inserted('v0')}, {_inserted('v1')}, {_inserted('v3')}) AS b2,
         least(v3, {_inserted('v2')}, {_inserted('(' + _inserted('v0') + ')')}, {_inserted('(' + _inserted('v1') + ')')}) AS b3"""


def _kept(initial: str, *paths: str) -> str:
    ways = ", ".join(f"CASE WHEN initial = '{initial}' AND NOT gone THEN {_edited(p, 'broken', 'K')} END" for p in paths)
    return f"least({ways}, NULL)"


def _reroled(*paths: str) -> str:
    return "least(" + ", ".join(f"CASE WHEN NOT gone THEN {_edited(p, '1 + broken', 'R')} END" for p in paths) + ", NULL)"


# Letters of the cheapest edits by a walk over the rows; a path is text, so its order is that of cost, then letters.
SQL["op13_conversation_repair"] = f"""
WITH RECURSIVE {_CRC_TABLE},
named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')) AS name
  FROM conversations
), dealt AS (SELECT conv_id, turn, role, text, {_crc32('name')} % 20 AS fault FROM named, crc
), damaged AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS copy
  FROM dealt WHERE fault <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role || ':' || text, copy) AS i,
         rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare,
         CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'x' END AS initial
  FROM damaged
), told AS (
  SELECT *, bare = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
         bare <> '' AND right(bare, 1) NOT IN ('.', '!', '?') AS open,
         lead(initial) OVER (PARTITION BY conv_id ORDER BY i) AS next
  FROM placed
), judged AS (SELECT *, blank OR again AS gone, CASE WHEN open THEN 5 ELSE 0 END AS broken FROM told
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank)::BIGINT AS blank,
         count_if(again AND NOT blank)::BIGINT AS duplicate, count_if(open AND NOT again)::BIGINT AS truncated,
         count_if(next IS NOT NULL AND initial || next NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal, max(i) AS n
  FROM judged GROUP BY conv_id
), walk(conv_id, i, v0, v1, v2, v3) AS (
  SELECT conv_id, 0::BIGINT, '00000000', NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR FROM counts
  UNION ALL
  SELECT conv_id, i, {_edited('b0', '2', 'D')},
         least({_edited('b1', '2', 'D')}, {_kept('s', 'b0')}),
         least({_edited('b2', '2', 'D')}, {_kept('u', 'b0', 'b1', 'b3')}, {_reroled('b0', 'b1', 'b3')}),
         least({_edited('b3', '2', 'D')}, {_kept('a', 'b2')}, {_reroled('b2')})
  FROM (SELECT w.conv_id, j.i, initial, gone, broken, {_WITH_INSERTS} FROM walk w JOIN judged j ON j.conv_id = w.conv_id AND j.i = w.i + 1)
), ended AS (
  SELECT conv_id, least(b0, b3) AS path FROM (SELECT w.conv_id, {_WITH_INSERTS} FROM walk w JOIN counts c ON c.conv_id = w.conv_id AND w.i = c.n)
), letters AS (
  SELECT conv_id, pos, substr(path, 8 + pos, 1) AS letter FROM (SELECT conv_id, path, unnest(range(1, length(path) - 7)) AS pos FROM ended)
), spelled AS (
  SELECT *, count_if(letter <> 'I') OVER so_far AS i, count_if(letter <> 'D') OVER so_far - 1 AS out FROM letters
  WINDOW so_far AS (PARTITION BY conv_id ORDER BY pos)
), led AS (
  SELECT s.conv_id FROM spelled s JOIN judged j ON j.conv_id = s.conv_id AND j.i = s.i WHERE out = 0 AND letter = 'K' AND initial = 's'
), lines AS (
  SELECT s.conv_id, pos, CASE WHEN letter = 'K' THEN role || ':' || text ELSE
           CASE WHEN (out - CASE WHEN led.conv_id IS NULL THEN 0 ELSE 1 END) % 2 = 0 THEN 'user:' ELSE 'assistant:' END
           || CASE WHEN letter = 'R' THEN text ELSE '' END END AS line
  FROM spelled s LEFT JOIN led ON led.conv_id = s.conv_id LEFT JOIN judged j ON j.conv_id = s.conv_id AND j.i = s.i WHERE letter <> 'D'
), whole AS (SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY pos)) AS digest FROM lines GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(substr(path, 1, 8)::BIGINT, 0) AS cost, coalesce(substr(path, 9), '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id = o.conv_id LEFT JOIN ended e ON e.conv_id = o.conv_id
     LEFT JOIN whole h ON h.conv_id = o.conv_id
"""
