"""The SQL of queries that SQL can express, for DuckDB on the same tables."""

from skyquill.llm import divergence
from skyquill.llm.chat import CONTROL

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ESCAPE = "|".join("".join(f"\\{c}" if c in "\\[]|" else c for c in text) for text in ("\\", *CONTROL))

CHAT = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length(regexp_replace(role, '({_ESCAPE})', '\\\\\\1', 'g')) + length(regexp_replace(text, '({_ESCAPE})', '\\\\\\1', 'g'))
             + length('[TURN][BODY][END]') AS chars FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (sum(chars) + length('<s></s>'))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""

NEAR_TEXT = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS shingle
      FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN c ON c.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""

VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
u AS (SELECT *, sqrt(list_dot_product(e, e)) AS size FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE a.size > 0 AND b.size > 0 AND list_dot_product(a.e, b.e) >= 0.98 * a.size * b.size),
r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id"""


def _shrink(name: str, key: str, counts: str) -> str:
    """One level of the beta-binomial shrinkage: counts (key, bad, n, above) to posterior means and weights."""
    return f"""
{name}_m AS (SELECT sum(n * (bad / n - above) ** 2) AS between_, sum(above * (1 - above)) AS within_,
             sum((n - 1) * above * (1 - above)) AS scale_ FROM {counts} WHERE n > 0),
{name}_w AS (SELECT CASE WHEN scale_ > 0 AND (between_ - within_) / scale_ > 1.0 / 1001
             THEN greatest(1 / ((between_ - within_) / scale_) - 1, 2.0) ELSE 1000.0 END::DOUBLE AS weight FROM {name}_m),
{name} AS (SELECT {key}, n + weight AS pages, (bad + weight * above) / (n + weight) AS mean FROM {counts}, {name}_w)"""


_RULES = [("example.com", "/de/", "block"), ("example.net", "/en/", "allow"), ("org", "/fr/", "allow"), ("net", "/", "block")]


def _case(value: str) -> str:
    return "CASE " + " ".join(
        f"WHEN host <> '' AND (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}') THEN "
        + (f"'{host}{path}'" if value == "rule" else f"'{verdict}'") for host, path, verdict in _RULES) + " END"


URLS = f"""
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
                  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
h AS (SELECT host, sum(1 - quality)::DOUBLE AS bad, count(*)::DOUBLE AS n, string_split(host, '.') AS parts
      FROM p JOIN labels ON doc_id = page_id WHERE host <> '' AND quality IS NOT NULL GROUP BY host),
hosts AS (SELECT *, CASE WHEN len(parts) > 2 THEN array_to_string(parts[-2:], '.') ELSE host END AS domain, parts[-1] AS suffix FROM h),
whole AS (SELECT (coalesce(sum(bad), 0) + 1) / (coalesce(sum(n), 0) + 2) AS above FROM hosts),
s0 AS (SELECT suffix, sum(bad) AS bad, sum(n) AS n, any_value(above) AS above FROM hosts, whole GROUP BY suffix),
{_shrink('s1', 'suffix', 's0')},
d0 AS (SELECT domain, sum(bad) AS bad, sum(n) AS n, any_value(mean) AS above FROM hosts JOIN s1 USING (suffix) GROUP BY domain),
{_shrink('d1', 'domain', 'd0')},
u0 AS (SELECT host, bad, n, mean AS above FROM hosts JOIN d1 USING (domain)),
{_shrink('u1', 'host', 'u0')},
d AS (SELECT (SELECT above FROM whole) AS above, (SELECT weight / (weight + 1) FROM u1_w) AS a, (SELECT weight / (weight + 1) FROM d1_w) AS b,
             (SELECT weight / (weight + 1) FROM s1_w) AS c),
q AS (SELECT *, CASE WHEN len(string_split(host, '.')) > 2 THEN array_to_string(string_split(host, '.')[-2:], '.') ELSE host END AS domain,
             string_split(host, '.')[-1] AS suffix FROM p),
j AS (SELECT page_id, q.host, path, coalesce(u1.mean, d1.mean, s1.mean, d.above) AS mean,
             coalesce(u1.pages, 1 / (1 - a * CASE WHEN d1.mean IS NOT NULL THEN 1 WHEN s1.mean IS NOT NULL THEN b ELSE b * c END) - 1) AS pages
      FROM q CROSS JOIN d LEFT JOIN u1 ON u1.host = q.host LEFT JOIN d1 ON d1.domain = q.domain LEFT JOIN s1 ON s1.suffix = q.suffix)
SELECT page_id, host, path, {_case('rule')} AS rule,
       coalesce({_case('verdict')}, CASE WHEN host <> '' AND mean - 2 * sqrt(mean * (1 - mean) / (pages + 1)) > 0.5
                                         THEN 'block' ELSE 'allow' END) AS verdict
FROM j"""

FIM = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
                  regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w FROM documents),
d AS (SELECT *, len(w) AS n, ('0x' || h[1:8])::BIGINT % (len(w) + 1) AS p, ('0x' || h[9:16])::BIGINT % (len(w) + 1) AS q,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                       OR ('0x' || h[17:24])::BIGINT % 100 >= 50 THEN 'plain'
                  WHEN ('0x' || h[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM w),
c AS (SELECT *, array_to_string(w[1:least(p, q)], '') AS a, array_to_string(w[least(p, q) + 1:greatest(p, q)], '') AS b,
             array_to_string(w[greatest(p, q) + 1:], '') AS c FROM d)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b
                        ELSE '<S>' || c || '<P>' || a || '<M>' || b END) AS output_sha256, sha256(text) AS restored_sha256
FROM c"""


def _list(words: tuple[str, ...] | list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_EVERY = sorted({word for words in divergence.COMMON.values() for word in words})
_LISTS = "CASE lang " + " ".join(f"WHEN '{name}' THEN {_list(words)}" for name, words in divergence.COMMON.items()) + f" ELSE {_list(_EVERY)} END"
_COUNTED = [c.replace("'", "''") for c in divergence.CLASSES]
_N = len(_EVERY) + 1


def _divergence(counts: str, means: str) -> str:
    """Jensen-Shannon distance of a list of counts and one of mean shares, as a scalar over two lists."""
    x, y = f"({counts}[i] / list_sum({counts}))", f"({means}[i] / list_sum({means}))"
    part = lambda a, b: f"CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / ({a} + {b})) ELSE 0 END"
    total = f"list_sum(list_transform(range(1, len({counts}) + 1), lambda i: ({part(x, y)} + {part(y, x)}) / 2))"
    return f"CASE WHEN list_sum({counts}) > 0 AND list_sum({means}) > 0 THEN sqrt(greatest({total}, 0)) ELSE 0 END"


DIVERGENCE = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{divergence.WORD}') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{divergence.WORD}')) AS lines,
             {_LISTS} AS common FROM t),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2)),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM
        (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1) GROUP BY r),
b AS (SELECT w.*, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
             len(regexp_extract_all(text, '{_COUNTED[4]}'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             coalesce(rep.n, 0)::BIGINT AS n_repeat_words, length(text) AS size,
             [{', '.join(f"len(regexp_extract_all(text, '{c}'))" for c in _COUNTED)}] AS few FROM w LEFT JOIN rep USING (r)),
c AS (SELECT *, list_append(few, greatest(size - list_sum(few), 0))::DOUBLE[] AS chars,
             list_append(list_transform(range(1, {_N}), lambda i: CASE WHEN i <= len(common) THEN len(list_filter(w, lambda x: x = common[i])) ELSE 0 END),
                         len(list_filter(w, lambda x: NOT list_contains(common, x))))::DOUBLE[] AS found FROM b),
m AS (SELECT lang, [{', '.join(f"coalesce(avg(chars[{i}] / size) FILTER (size > 0), 0)" for i in range(1, len(_COUNTED) + 2))}] AS chars_all,
             [{', '.join(f"coalesce(avg(found[{i}] / n_words) FILTER (n_words > 0), 0)" for i in range(1, _N + 1))}] AS found_all FROM c GROUP BY lang),
d AS (SELECT c.*, {_divergence('chars', 'chars_all')} AS character_distance, {_divergence('found', 'found_all')} AS word_distance,
             n_words < {divergence.LEAST_WORDS} OR 100 * n_repeat_words > {divergence.REPEATED_PERCENT} * n_words AS base_failed
      FROM c JOIN m ON c.lang IS NOT DISTINCT FROM m.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(character_distance, 9) AS character_distance,
       round(word_distance, 9) AS word_distance, NOT base_failed
       AND NOT (size >= {divergence.LEAST_CHARACTERS} AND character_distance > {divergence.CHARACTER_DISTANCE})
       AND NOT (n_words >= {divergence.LEAST_JUDGED_WORDS} AND word_distance > {divergence.WORD_DISTANCE}) AS kept
FROM d"""
