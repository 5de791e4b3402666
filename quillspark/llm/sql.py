"""DuckDB SQL for the registered queries that SQL can express."""

from .decontaminate import BETWEEN, LOWER, UPPER  # noqa: F401
from .quality import STOP_WORDS

_STOPS = ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(set(STOP_WORDS)))

OP6 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS body FROM documents),
w AS (SELECT *, regexp_extract_all(body, '[^\\x20\\x09-\\x0D]+') AS w,
      list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
win AS (SELECT rid, unnest(range(1, len(w) - 3)) AS s, w FROM w WHERE len(w) >= 5),
txt AS (SELECT rid, s, array_to_string(w[s:s + 4], ' ') AS t FROM win),
dup AS (SELECT rid, s FROM txt QUALIFY count(*) OVER (PARTITION BY rid, t) > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(s, s + 5)) AS p FROM dup) GROUP BY rid),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
      length(regexp_replace(body, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
      (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
      len(list_filter(w, lambda x: x IN ({_STOPS})))::BIGINT AS n_stop_words, len(l)::BIGINT AS n_lines
      FROM w LEFT JOIN rep USING (rid)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND word_chars >= 2 * n_words AND word_chars <= 20 * n_words AND 10 * n_symbols <= n_words
  AND (n_words < 30 OR 100 * n_stop_words >= 4 * n_words) AND 10 * n_dup_lines <= 4 * n_lines AS kept FROM b
"""

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP2 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item, array_to_string(w[s:s + 12], ' ') AS win, least(len(w), 13) AS n
       FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 11, 2))) AS s FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT rid, n, s, array_to_string(w[s:s + n - 1], ' ') AS win
       FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens WHERE len(w) >= n)),
h AS (SELECT dw.rid, dw.s, dw.n, iw.item FROM dw JOIN iw ON dw.win = iw.win AND dw.n = iw.n),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM h) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN it USING (rid)
"""

OP4 = "SELECT doc_id, lang, source, n_chars, sha256(text) AS text_sha256 FROM documents"

ORACLE = {"op2_decontamination": OP2, "op4_compaction": OP4, "op6_quality_rules": OP6}
