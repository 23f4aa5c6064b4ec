r"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

from weblytics.llm.quality import RATES, QualityOptions

SPACED = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _places(table: str, key: str, text: str, pattern: str) -> str:
    """(key, i, word): every word with its position."""
    return (f"SELECT {key}, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i "
            f"FROM (SELECT {key}, regexp_extract_all({text}, '{pattern}') AS w FROM {table})")


def _grams(width: int) -> str:
    return " || ' ' || ".join(["word", *[f"lead(word, {k}) OVER o" for k in range(1, width)]])


def quality_sql(opt: QualityOptions = QualityOptions()) -> str:
    bucket = "CASE WHEN v < 64 THEN v ELSE 32 * (length(bin(v)) - 6) + (v >> (length(bin(v)) - 6)) END"
    value = "CASE WHEN {b} < 64 THEN {b} ELSE (32 + {b} % 32) << (({b} // 32 - 1)::INT) END"
    quant = "min(CASE WHEN 100 * up_to >= {q} * n_all THEN b END)"
    values = ", ".join(f"('{r}', {r})" for r in RATES)

    def of(part: str) -> str:
        return "CASE rate " + " ".join(f"WHEN '{r}' THEN {int(getattr(opt.rule(r), part))}" for r in RATES) + " END"

    def level(name: str, keys: str) -> str:
        by = f"{keys}, " if keys else ""
        return f"""
{name} AS (
  SELECT {by}rate, max(n_all) AS n_rows, {value.format(b=quant.format(q=f"({of('base')})"))} AS base,
         {value.format(b='(' + quant.format(q=f"({of('high')})") + ' + 1)')} - 1 AS high
  FROM (SELECT {by}rate, b, sum(n) OVER (PARTITION BY {by}rate ORDER BY b) AS up_to,
               sum(n) OVER (PARTITION BY {by}rate) AS n_all
        FROM (SELECT {by}rate, b, sum(n)::BIGINT AS n FROM sketch GROUP BY ALL)) GROUP BY ALL)"""

    return f"""
WITH places AS ({_places('documents', 'doc_id', "coalesce(text, '')", SPACED)}),
grams AS (SELECT doc_id, i, {_grams(3)} AS g FROM places WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams WHERE g IS NOT NULL)
          WHERE c > 1),
repeated AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (VALUES (0), (1), (2)) v(k) GROUP BY doc_id),
sized AS (SELECT doc_id, count(*) AS n_words, sum(length(word))::BIGINT AS word_chars FROM places GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
lined AS (SELECT doc_id, count(*) AS n_lines, count(DISTINCT line) AS n_distinct FROM lines
          WHERE regexp_matches(line, '{SPACED[:-1]}') GROUP BY doc_id),
counted AS (
  SELECT doc_id, lang, source, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
         coalesce(length(text) - length(translate(text, '#*$%&|<>', '')), 0) AS n_symbols,
         coalesce(n_lines - n_distinct, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines,
         coalesce(repeated.n, 0) AS n_repeat_words
  FROM documents LEFT JOIN lined USING (doc_id) LEFT JOIN sized USING (doc_id) LEFT JOIN repeated USING (doc_id)),
rated AS (
  SELECT *, n_words < {opt.min_words} OR 100 * n_repeat_words > {opt.max_repeat_percent} * n_words AS base_failed,
         if(n_words > 0, 100 * word_chars // n_words, 0) AS word_length,
         if(word_chars > 0, 10000 * n_symbols // word_chars, 0) AS symbol_rate,
         if(n_lines > 0, 10000 * n_dup_lines // n_lines, 0) AS dup_line_rate,
         if(n_words > 0, 10000 * n_repeat_words // n_words, 0) AS repeat_rate
  FROM counted),
sketch AS (
  SELECT lang, source, rate, {bucket} AS b, count(*) AS n
  FROM (SELECT lang, source, x.rate, x.v FROM rated, LATERAL (VALUES {values}) x(rate, v) WHERE NOT base_failed)
  GROUP BY ALL),
{level('by_source', 'lang, source')},{level('by_lang', 'lang')},{level('overall', '')},
limits AS (
  SELECT s.lang, s.source, s.rate, lo, hi FROM by_source s, LATERAL (
    SELECT base - fence * (high - base) - slack AS lo, high + fence * (high - base) + slack AS hi
    FROM (SELECT CASE WHEN s.n_rows >= {opt.min_rows} THEN s.base WHEN l.n_rows >= {opt.min_rows} THEN l.base ELSE a.base END AS base,
                 CASE WHEN s.n_rows >= {opt.min_rows} THEN s.high WHEN l.n_rows >= {opt.min_rows} THEN l.high ELSE a.high END AS high,
                 {of('fence').replace('CASE rate', 'CASE s.rate')} AS fence, {of('slack').replace('CASE rate', 'CASE s.rate')} AS slack
          FROM by_lang l, overall a
          WHERE l.lang IS NOT DISTINCT FROM s.lang AND l.rate = s.rate AND a.rate = s.rate))),
outside AS (
  SELECT r.doc_id FROM rated r JOIN limits t
    ON r.lang IS NOT DISTINCT FROM t.lang AND r.source IS NOT DISTINCT FROM t.source
  WHERE CASE t.rate {' '.join(f"WHEN '{r}' THEN r.{r} > hi" + (f" OR r.{r} < lo" if opt.rule(r).two_sided else '')
                              for r in RATES)} END)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM outside) AS kept, {', '.join(RATES)}
FROM rated"""


def passages_sql(window: int = 35) -> str:
    return f"""
WITH places AS ({_places('documents', 'doc_id', "coalesce(text, '')", SPACED)}),
windows AS (
  SELECT doc_id, i, md5(string_agg(word, ' ') OVER o) AS g, count(*) OVER o AS n FROM places
  WINDOW o AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {window - 1} FOLLOWING)),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM windows WHERE n = {window}) WHERE c > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM again, range({window}) r(k)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n FROM places ANTI JOIN gone USING (doc_id, i)
         GROUP BY doc_id),
sized AS (SELECT doc_id, count(*) AS n FROM places GROUP BY doc_id)
SELECT doc_id, coalesce(sized.n, 0) AS n_words, coalesce(sized.n, 0) - coalesce(kept.n, 0) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM documents LEFT JOIN sized USING (doc_id) LEFT JOIN kept USING (doc_id)"""


def near_sql(width: int = 4, percent: int = 80) -> str:
    return f"""
WITH RECURSIVE places AS ({_places('documents', 'doc_id', FOLD, SPACED)}),
grams AS (SELECT doc_id, {_grams(width)} AS g FROM places WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
few AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS g FROM places GROUP BY doc_id HAVING count(*) < {width}),
sets AS (SELECT DISTINCT doc_id, g FROM grams WHERE g IS NOT NULL UNION SELECT doc_id, g FROM few),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM sets a JOIN sets b USING (g)
          WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM both_ JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
          WHERE 100 * both_.n >= {percent} * (x.n + y.n - both_.n)),
reach AS (SELECT doc_id AS node, doc_id AS other FROM documents
          UNION SELECT reach.node, links.b FROM reach JOIN links ON links.a = reach.other)
SELECT doc_id, coalesce(sizes.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents LEFT JOIN sizes USING (doc_id)
JOIN (SELECT node AS doc_id, min(other) AS component_id FROM reach GROUP BY node) USING (doc_id)"""


def contamination_sql(window: int = 10) -> str:
    each = " UNION ALL ".join(
        f"SELECT doc_id, i, {k} AS size, {_grams(k)} AS g FROM places WINDOW o AS (PARTITION BY doc_id ORDER BY i)"
        for k in range(1, window + 1))
    items = " UNION ALL ".join(
        f"SELECT item_id, {k} AS size, {_grams(k)} AS g, count(*) OVER (PARTITION BY item_id) AS n FROM item_places "
        f"WINDOW o AS (PARTITION BY item_id ORDER BY i)" for k in range(1, window + 1))
    return f"""
WITH places AS ({_places('documents', 'doc_id', FOLD, ALNUM)}),
item_places AS ({_places('benchmark', 'item_id', FOLD, ALNUM)}),
item_windows AS (SELECT DISTINCT item_id, size, g FROM ({items}) WHERE g IS NOT NULL AND size = least(n, {window})),
hits AS (SELECT doc_id, i, d.size, item_id FROM ({each}) d JOIN item_windows w ON w.size = d.size AND w.g = d.g),
words AS (SELECT doc_id, count(*) AS n FROM places GROUP BY doc_id),
marked AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM hits, range({window}) r(k) WHERE k < size GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, coalesce(words.n, 0) AS n_words, coalesce(marked.n, 0) AS n_hit, coalesce(found.n, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(marked.n, 0) > 0 AS contaminated
FROM documents LEFT JOIN words USING (doc_id) LEFT JOIN marked USING (doc_id) LEFT JOIN found USING (doc_id)"""


def html_sql() -> str:
    """Main text of the test pages, all of which mark it by an article of
    headings and paragraphs; the operator deduces it from the hosts' templates."""
    return r"""
WITH numbered AS (SELECT page_id, url, coalesce(html, '') AS html, row_number() OVER () AS r FROM pages),
blocks AS (
  SELECT r, unnest(b) AS block, generate_subscripts(b, 1) AS i
  FROM (SELECT r, string_split_regex(regexp_extract(html, '(?s)<article>(.*?)(?:</article>|$)', 1), '</?(?:p|h1)>') AS b
        FROM numbered)),
bare AS (SELECT r, i, regexp_replace(replace(replace(block, '<b>', ''), '</b>', ''), '<br>', ' ', 'g') AS t FROM blocks),
plain AS (
  SELECT r, i, regexp_replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'),
                                      '&#x27;', chr(39)), '&#39;', chr(39)), '&amp;?', '&', 'g') AS t FROM bare),
spaced AS (SELECT r, i, trim(regexp_replace(t, '[\s\x0B\x1C-\x1F\x{85}\x{A0}]+', ' ', 'g')) AS t FROM plain),
whole AS (SELECT r, string_agg(t, chr(10) ORDER BY i) AS t FROM spaced WHERE t <> '' GROUP BY r)
SELECT page_id, url, coalesce(t, '') AS text, length(coalesce(t, '')) AS n_chars
FROM numbered LEFT JOIN whole USING (r)"""


def fill_in_middle_sql(seed: int = 7, percent: int = 100, spm_percent: int = 50) -> str:
    draw = ", ".join(f"('0x' || substr(h, {8 * k + 1}, 8))::BIGINT AS h{k + 1}" for k in range(4))
    return f"""
WITH drawn AS (
  SELECT doc_id, t, units, len(units) AS n, {draw}
  FROM (SELECT doc_id, coalesce(text, '') AS t, sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')) AS h,
               regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units FROM documents)),
cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= {percent}
              THEN 'plain' WHEN h4 % 100 < {spm_percent} THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
parts AS (
  SELECT doc_id, n, form, t, array_to_string(units[1:lo], '') AS p, array_to_string(units[lo + 1:hi], '') AS m,
         array_to_string(units[hi + 1:n], '') AS s
  FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts"""


def trie_sql(family: int = 20, heads: int = 4) -> str:
    """crc32 is spelled out bit by bit: the remainder of the reversed polynomial."""
    return f"""
WITH RECURSIVE turns AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos,
         md5(coalesce(role, '')) || md5(coalesce(text, '')) AS turn_key,
         len(regexp_extract_all(coalesce(text, ''), '{SPACED}')) AS words
  FROM conversations WHERE conv_id IS NOT NULL),
crc AS (
  SELECT c, 1 AS i, 4294967295 AS v FROM (SELECT DISTINCT c FROM turns)
  UNION ALL
  SELECT c, i + 1, list_reduce([xor(v, ascii(substr(c::VARCHAR, i, 1))::BIGINT), 1, 2, 3, 4, 5, 6, 7, 8],
                                lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)
  FROM crc WHERE i <= length(c::VARCHAR)),
convs AS (SELECT c, c - c % {family} AS base, xor(v, 4294967295) % {heads} AS h FROM crc WHERE i = length(c::VARCHAR) + 1),
rebuilt AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY opening DESC, pos) AS d, turn_key, words
  FROM (SELECT x.c, 1 AS opening, t.pos, turn_key, words FROM convs x JOIN turns t ON t.c = x.base AND t.pos < x.h
        UNION ALL
        SELECT x.c, 0, t.pos, turn_key, words FROM convs x JOIN turns t ON t.c = x.c AND t.pos >= x.h)),
paths AS (
  SELECT c, d, md5(string_agg(turn_key, '') OVER (PARTITION BY c ORDER BY d)) AS node, words FROM rebuilt
  UNION ALL SELECT c, 0, 'root', 0 FROM convs),
linked AS (SELECT *, lag(node) OVER (PARTITION BY c ORDER BY d) AS up, lead(node) OVER (PARTITION BY c ORDER BY d) AS down FROM paths),
nodes AS (SELECT d, node, any_value(up) AS up, count(*) AS n_convs, min(c) AS conv_id, count(DISTINCT down) AS n_children,
                 any_value(words) AS words,
                 coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE down IS NULL), '') AS ends
          FROM linked GROUP BY d, node),
pairs AS (SELECT DISTINCT x.d, x.node, y.d AS d2, y.node AS node2 FROM paths x JOIN paths y ON x.c = y.c AND y.d >= x.d),
sums AS (SELECT p.d, p.node, sum((n.n_convs - 1) * n.words)::BIGINT AS saved_tokens,
                count(*) FILTER (WHERE n.n_children = 0) AS n_leaves
         FROM pairs p JOIN nodes n ON n.d = p.d2 AND n.node = p.node2 GROUP BY ALL)
SELECT n.conv_id, n.d AS depth, u.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens,
       sha256(n.ends) AS ends_sha256
FROM nodes n JOIN sums s USING (d, node) LEFT JOIN nodes u ON u.d = n.d - 1 AND u.node = n.up"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": quality_sql(),
        "op5_repeated_passages": passages_sql(),
        "op9_near_duplicates": near_sql(),
        "op10_decontamination": contamination_sql(),
        "op11_html_extraction": html_sql(),
        "op12_fill_in_middle": fill_in_middle_sql(),
        "op13_conversation_trie": trie_sql(),
    }
