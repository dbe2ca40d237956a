"""DuckDB SQL of the queries that SQL can express, written without the operators' code."""

SQL: dict[str, str] = {}

SQL["op3_url_reputation"] = """
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), known AS (
  SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1.0 WHEN quality IS NOT NULL OR toxic IS NOT NULL THEN 0.0 END) AS bad FROM labels GROUP BY doc_id
), hosts AS (
  SELECT host, CAST(count(bad) AS DOUBLE) AS n, coalesce(sum(bad), 0.0)::DOUBLE AS x FROM p LEFT JOIN known ON doc_id = page_id GROUP BY host
), leveled AS (
  SELECT host, n, x, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '[.]$', '') AS name FROM hosts
), named AS (
  SELECT *, split(name, '.') AS l, regexp_matches(name, '^([0-9]{1,3}[.]){3}[0-9]{1,3}$') OR starts_with(name, '[') AS address FROM leveled
), sized AS (
  SELECT *, CASE WHEN regexp_matches(array_to_string(l[-2:], '.'), '^(ac|co|com|edu|gob|gov|go|mil|ne|net|nom|or|org|sch)[.][a-z]{2}$') THEN 2 ELSE 1 END AS k FROM named
), h AS (
  SELECT host, n, x, CASE WHEN address THEN name ELSE array_to_string(l[-(k + 1):], '.') END AS domain, CASE WHEN address THEN name ELSE array_to_string(l[-k:], '.') END AS suffix FROM sized
), d AS (SELECT suffix, domain, sum(n) AS n, sum(x) AS x FROM h GROUP BY suffix, domain),
s AS (SELECT suffix, sum(n) AS n, sum(x) AS x FROM d GROUP BY suffix),
t AS (SELECT CASE WHEN sum(n) > 0 THEN (sum(x) + 0.5) / (sum(n) + 1) ELSE 0.0 END AS top FROM s),
lv AS (SELECT 'h' AS lv, n, x FROM h WHERE n > 0 UNION ALL SELECT 'd', n, x FROM d WHERE n > 0 UNION ALL SELECT 's', n, x FROM s WHERE n > 0),
m AS (SELECT lv, count(*) AS m, sum(n) AS n, sum(x) AS x, sum(x * x / n) AS xx, sum(n * n) AS nn FROM lv GROUP BY lv),
f AS (SELECT *, x / n * (1 - x / n) AS v, n - nn / n - (m - 1) AS w FROM m),
k AS (SELECT lv, 1 / least(greatest(CASE WHEN m > 1 AND v > 0 AND w > 0 THEN (xx - x * x / n - v * (m - 1)) / (v * w) ELSE 0.0 END, 0.0001), 0.99) - 1 AS k FROM f),
ps AS (SELECT suffix, (k * top + x) / (k + n) AS r FROM s, t, k WHERE lv = 's'),
pd AS (SELECT d.suffix, domain, (k * r + x) / (k + n) AS r FROM d JOIN ps USING (suffix), k WHERE lv = 'd'),
ph AS (SELECT host, (k * r + x) / (k + n) AS r, k + n AS z FROM h JOIN pd USING (suffix, domain), k WHERE lv = 'h'),
b AS (SELECT host, r - 1.645 * sqrt(r * (1 - r) / (z + 1)) AS bound FROM ph),
rules(verdict, rule, rhost, rpath) AS (VALUES
  ('allow', 'com/', 'com', '/'), ('block', 'example.com/en/', 'example.com', '/en/'), ('allow', 'www.example.com/en/', 'www.example.com', '/en/'),
  ('block', 'net/es/', 'net', '/es/'), ('block', 'net/fr/', 'net', '/fr/')),
fit AS (
  SELECT DISTINCT host, path, arg_max(rule, length(rule)) OVER w AS rule, arg_max(rules.verdict, length(rule)) OVER w AS verdict
  FROM (SELECT DISTINCT host, path FROM p) JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  WINDOW w AS (PARTITION BY host, path)
)
SELECT page_id, p.host, p.path, rule, coalesce(fit.verdict, CASE WHEN bound > 0.25 THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN fit ON p.host = fit.host AND p.path = fit.path LEFT JOIN b ON b.host = p.host
"""

SQL["op4_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS sha FROM pages),
bits AS (
  SELECT *, array_to_string(list_transform(string_split(sha, ''), lambda c: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][strpos('0123456789abcdef', c)]), '') AS bits FROM p
), g AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS first FROM bits)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + 16 * CAST(substr(bits, 1 + 5 * i, 1) AS INT) + 8 * CAST(substr(bits, 2 + 5 * i, 1) AS INT) + 4 * CAST(substr(bits, 3 + 5 * i, 1) AS INT)
      + 2 * CAST(substr(bits, 4 + 5 * i, 1) AS INT) + CAST(substr(bits, 5 + 5 * i, 1) AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id < first THEN first END AS refers_to
FROM g
"""

SQL["op6_suffix_dedup"] = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
d2 AS (SELECT doc_id, b, hex(b) AS h, octet_length(b) AS n FROM d),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 800)) AS k FROM (SELECT doc_id, h, unnest(range(n - 399)) AS i FROM d2 WHERE n >= 400)),
r AS (SELECT doc_id, i FROM w JOIN (SELECT k FROM w GROUP BY k HAVING count(*) > 1) USING (k)),
e AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 0 ELSE 1 END AS fresh FROM r),
g AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM e),
s AS (SELECT doc_id, min(i) AS a, max(i) + 400 AS z FROM g GROUP BY doc_id, g),
l AS (SELECT doc_id, list(a ORDER BY a) AS a, list(z ORDER BY a) AS z, sum(z - a) AS n_removed, count(*) AS n_spans FROM s GROUP BY doc_id),
k AS (SELECT doc_id, n, h, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, list_concat([0], z) AS starts, list_concat(a, [n]) AS ends FROM d2 LEFT JOIN l USING (doc_id)),
p AS (SELECT *, CASE WHEN n_spans = 0 THEN [h] ELSE list_transform(range(1, n_spans + 2), lambda i: substr(h, 2 * starts[i] + 1, 2 * (ends[i] - starts[i]))) END AS pieces FROM k)
SELECT doc_id, n AS n_bytes, CAST(n_removed AS BIGINT) AS n_removed, CAST(n_spans AS BIGINT) AS n_spans, sha256(unhex(array_to_string(pieces, ''))) AS kept_sha256,
  decode(unhex(array_to_string(list_transform(pieces, lambda x:
    regexp_replace(regexp_replace(x, '^([89AB][0-9A-F])+', ''), '^((?:[0-9A-F]{2})*?)(?:[CD][0-9A-F]|E[0-9A-F](?:[89AB][0-9A-F])?|F[0-9A-F](?:[89AB][0-9A-F]){0,2})$', '\1')), ''))) AS text
FROM p
"""

SQL["op7_minhash_dedup"] = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS sh FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS x FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * x >= 85 * (na.n + nb.n - x)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(node, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT u.b, r FROM reach JOIN u ON u.a = node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(r) AS c FROM reach GROUP BY node) m ON m.node = d.doc_id
"""

SQL["op10_winnowing"] = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS k FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
x AS (SELECT doc_id, p, n, item_id FROM dw JOIN iw USING (n, k)),
h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS pos FROM x) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM x) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

#: crc32 of a text's UTF-8 bytes, unsigned; ``crc.t`` is the table of the polynomial.
_CRC_TABLE = """crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i)) AS t)"""


def _crc32(text: str) -> str:
    hexed = f"hex(encode({text}))"
    octets = f"list_transform(range(octet_length(encode({text}))), lambda i: CAST('0x' || substr({hexed}, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))"
    return f"xor(4294967295, list_reduce({octets}, lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295))"


def _escaped(text: str, controls: str) -> str:
    return rf"regexp_replace(regexp_replace({text}, '(\\*)({controls})', '\1\1\\\2', 'g'), '(\\+)\z', '\1\1')"


_CONTROLS = r"### |</turn>|<\|endoftext\|>"

SQL["op11_chat_format"] = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))
), f AS (
  SELECT *, '### ' || {_escaped('role', _CONTROLS + '|: ')} || ': ' || {_escaped('text', _CONTROLS)} || '</turn>' || chr(10) AS formatted FROM c
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, formatted)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, formatted)) AS loss_sha256,
  CAST(sum(length(formatted)) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""


def _more(cost: str, edit: str, rest: str) -> str:
    """Cost (nine digits) and edits of ``rest`` with one edit before them."""
    return f"lpad(CAST(CAST(left({rest}, 9) AS INTEGER) + {cost} AS VARCHAR), 9, '0') || '{edit}' || substr({rest}, 10)"


def _repairs() -> str:
    """Cheapest edits to the end from the states start (a), after system (b), user (c), assistant (d), before one row more."""
    extra = "CASE WHEN x.s >= 4 AND x.s < 8 THEN 5 ELSE 0 END"
    far = "'999999999'"

    def taken(state: str, kept: list[tuple[int, str]], fit: str) -> str:
        keeps = "".join(f", CASE WHEN x.s < 8 AND x.s % 4 = {role} THEN {_more(extra, 'K', 'acc.' + to)} ELSE {far} END" for role, to in kept)
        return f"least({_more('2', 'D', 'acc.' + state)}, CASE WHEN x.s < 8 THEN {_more('1 + ' + extra, 'R', 'acc.' + fit)} ELSE {far} END{keeps})"

    rows = f"{{'s': x.s, 'a': {taken('a', [(0, 'b'), (1, 'c')], 'c')}, 'b': {taken('b', [(1, 'c')], 'c')}, 'c': {taken('c', [(2, 'd')], 'd')}, 'd': {taken('d', [(1, 'c')], 'c')}}}"
    once = {q: _more("5", "I", "y." + to) for q, to in (("a", "c"), ("b", "c"), ("c", "d"), ("d", "c"))}
    twice = _more("10", "II", "y.d")
    filled = f"{{'s': y.s, 'a': least(y.a, {once['a']}, {twice}), 'b': least(y.b, {once['b']}, {twice}), 'c': least(y.c, {once['c']}), 'd': least(y.d, {once['d']})}}"
    end = "{'s': 0, 'a': '000000000', 'b': '000000010II', 'c': '000000005I', 'd': '000000000'}"
    return f"list_reduce(list_reverse(syms), lambda acc, x: list_transform([{rows}], lambda y: {filled})[1], {end}).a"


SQL["op12_turn_repair"] = rf"""
WITH {_CRC_TABLE}, k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind FROM conversations, crc
), d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM k, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END))
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z', 1) AS final FROM d
), f AS (
  SELECT *, CASE WHEN final = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate' WHEN final NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
    left(role, 1) AS kind, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM o
), g AS (
  SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || '-' || kind NOT IN ('s-u', 'u-a', 'a-u')) AS illegal,
    list({{'s': CASE WHEN fault IN ('blank', 'duplicate') THEN 8 ELSE CASE kind WHEN 's' THEN 0 WHEN 'u' THEN 1 WHEN 'a' THEN 2 ELSE 3 END + CASE WHEN fault IS NULL THEN 0 ELSE 4 END END,
      'a': '', 'b': '', 'c': '', 'd': ''}} ORDER BY pos) AS syms
  FROM f GROUP BY conv_id
), s AS (SELECT *, {_repairs()} AS found FROM g),
a AS (SELECT *, CAST(left(found, 9) AS BIGINT) AS cost, substr(found, 10) AS audit FROM s),
e AS (SELECT conv_id, i, substr(audit, i, 1) AS edit FROM a, unnest(range(1, length(audit) + 1)) AS t(i)),
n AS (SELECT *, sum(CASE WHEN edit <> 'I' THEN 1 ELSE 0 END) OVER w AS pos, sum(CASE WHEN edit <> 'D' THEN 1 ELSE 0 END) OVER w AS place FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
m AS (
  SELECT n.conv_id, n.place, n.edit, f.role, f.text, max(CASE WHEN n.edit = 'K' AND n.place = 1 AND f.kind = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY n.conv_id) AS led
  FROM n LEFT JOIN f ON n.edit <> 'I' AND f.conv_id IS NOT DISTINCT FROM n.conv_id AND f.pos = n.pos WHERE n.edit <> 'D'
), r AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY place)) AS sha
  FROM m GROUP BY conv_id
), ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM ids LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM ids.conv_id
"""

SQL["op13_spelling_variants"] = rf"""
WITH RECURSIVE {_CRC_TABLE}, x AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
l AS (SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS c FROM x WHERE length(run) >= 7 GROUP BY ALL),
h AS (SELECT run, c, {_crc32("id || ':' || run")} AS h FROM l, crc),
w AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) + 2 AS BIGINT)) ELSE run END AS word, CAST(sum(c) AS BIGINT) AS n FROM h GROUP BY word HAVING length(word) >= 7 AND sum(c) >= 2),
dels AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM w, unnest(range(length(word))) AS t(i)),
near AS (
  SELECT a.word, b.word AS other, b.n FROM dels a JOIN dels b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT w.word, d.word, d.n FROM w JOIN dels d ON d.rest = w.word
  UNION SELECT d.word, w.word, w.n FROM w JOIN dels d ON d.rest = w.word
), best AS (SELECT word, count(*) AS n_near, max(n) AS top, arg_min(other, {{'m': -n, 'o': other}}) AS other FROM near GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 10 * w.n THEN other END AS form, CASE WHEN top >= 10 * w.n THEN top END AS form_n FROM w LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS at FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.at WHERE f.form IS NOT NULL),
ends AS (SELECT walk.word, walk.at FROM walk JOIN f ON f.word = walk.at WHERE f.form IS NULL)
SELECT f.word, form, ends.at AS root, f.n, n_near, form_n FROM f JOIN ends USING (word)
"""
