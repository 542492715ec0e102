"""DuckDB SQL for the text queries that SQL can express, over whole tables."""

from __future__ import annotations

from tidelog.llm import decontam, linkgraph, quality

WHITE = r"[\x20\x09-\x0D]"

# Fixed values, stated here once more so that a slip in an operator's shows: name, pattern, group, its least length, base.
PRIVATE_KEY = r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
SECRETS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    ("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    ("hex", r"[0-9a-f]+", 0, 24, True),
    ("pem", PRIVATE_KEY + r"(?:[^-]*(?:-{1,4}[^-]+)*-----END [A-Z ]{0,40}PRIVATE KEY-----|(?:\s+[A-Za-z0-9+/]{16,}={0,2})+(?:\s+[A-Za-z0-9+/]{1,15}={0,2})?|)", 0, 1, False),
    ("forge", r"\bgh[pousr]_[A-Za-z0-9]{36}", 0, 1, False),
)
URL_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def either_case(pattern: str) -> str:
    """(?i:...) spelled out for A-Z, as DuckDB's engine folds more letters."""
    head, rest = pattern.split("(?i:", 1)
    inner, tail = rest.split(")", 1)
    return head + "(?:" + "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in inner) + ")" + tail


def secret_rule(name: str, pattern: str, group: int, least: int, rank: int) -> str:
    pattern = (either_case(pattern) if "(?i:" in pattern else pattern).replace("'", "''")
    size = f"length(regexp_extract(hit, '{pattern}', {group}))"
    return f"""SELECT rid, '{name}' AS kind, {rank} AS rank, reach - length(hit) AS start, reach AS stop FROM (
  SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY rid ORDER BY i) AS reach FROM (
    SELECT rid, unnest(hits) AS hit, unnest(gaps[:len(hits)]) AS gap, generate_subscripts(hits, 1) AS i FROM (
      SELECT rid, regexp_extract_all(text, '{pattern}') AS hits, regexp_split_to_array(text, '{pattern}') AS gaps FROM d))) WHERE {size} >= {least}"""


def secret_scan() -> str:
    every = " UNION ALL ".join(secret_rule(*rule[:4], k) for k, rule in enumerate(SECRETS))
    base = ", ".join(f"'{rule[0]}'" for rule in SECRETS if rule[4])
    count = lambda k: f"count(*) FILTER (kind = '{k}') AS n_{k}"
    joined = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank)"
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents), s AS ({every})
SELECT doc_id, {count('assign')}, {count('access')}, {count('hex')},
  sha256(coalesce({joined} FILTER (kind IN ({base})), '')) AS base_sha256, coalesce({joined}, '') AS spans
FROM d LEFT JOIN s USING (rid) GROUP BY rid, doc_id"""


def line_frequency() -> str:
    line = f"trim(regexp_replace(regexp_replace(lower({{0}}), '{WHITE}+', ' ', 'g'), '[0-9]', '0', 'g'))"
    words = f"list_filter(regexp_split_to_array({{0}}, '{WHITE}+'), lambda x: x <> '')"
    n = quality.WINDOW
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, {words.format('text')} AS words, string_split(text, chr(10)) AS lines FROM d),
pairs AS (SELECT rid, unnest(range(1, len(words) - {n - 2})) AS i, words FROM w WHERE len(words) >= {n}),
windows AS (SELECT rid, i, array_to_string(words[i:i + {n - 1}], ' ') AS x FROM pairs),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, x) AS c FROM windows) WHERE c > 1),
repeats AS (SELECT rid, count(DISTINCT i + j) AS n_repeat_words FROM twice, range({n}) t(j) GROUP BY rid),
l AS (SELECT rid, source, text, unnest(lines) AS raw, generate_subscripts(lines, 1) AS k FROM w),
norm AS (SELECT *, {line.format('raw')} AS line FROM l),
hosts AS (SELECT source, count(DISTINCT text) AS all_docs FROM d GROUP BY source),
counts AS (SELECT source, line, count(DISTINCT text) AS docs FROM norm WHERE line <> '' GROUP BY source, line),
furniture AS (SELECT c.source, line FROM counts c JOIN hosts h ON c.source IS NOT DISTINCT FROM h.source WHERE docs >= {quality.LINE_DOCS} AND docs > {quality.LINE_SHARE} * all_docs),
marked AS (SELECT n.*, f.line IS NOT NULL AS gone FROM norm n LEFT JOIN furniture f ON n.source IS NOT DISTINCT FROM f.source AND n.line = f.line),
removed AS (SELECT rid, count(*) FILTER (gone) AS n_removed_lines, sum(len({words.format('raw')})) FILTER (NOT gone) AS left_words FROM marked GROUP BY rid),
m AS (SELECT w.rid, doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  CAST(len(list_filter(lines, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))) - len(list_distinct(list_filter(lines, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))) AS BIGINT) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, n_removed_lines, coalesce(left_words, 0) AS left_words
  FROM w LEFT JOIN repeats USING (rid) JOIN removed USING (rid)),
b AS (SELECT *, n_words < {quality.LEAST_DOC_WORDS} OR 100 * n_repeat_words > {quality.MOST_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (n_removed_lines > 0 AND (left_words < {quality.LEAST_WORDS} OR left_words < {quality.LEAST_SHARE} * n_words)) AS kept, n_removed_lines FROM b"""


def link_graph() -> str:
    """150 rounds, beyond which less than a billionth of a seed is on its way; no page of the tables hides links in scripts."""
    host = r"coalesce(translate(regexp_extract({0}, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"
    path = r"coalesce(regexp_extract({0}, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '')"
    longest = sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))
    rule = "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for _, h, p in longest) + " END"
    verdict = "CASE rule " + " ".join(f"WHEN '{h}{p}' THEN '{v}'" for v, h, p in longest) + " END"
    share = lambda v: f"count(*) FILTER (by_rule = '{v}') / count(*)"
    seed = lambda v, k: f"SELECT '{k}' AS kind, host, {share(v)} AS score FROM ruled WHERE host <> '' GROUP BY host HAVING {share(v)} >= {linkgraph.SEED_SHARE}"
    link = r'''(?i)<a\s[^>]*?href\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)'''.replace("'", "''")
    return f"""WITH RECURSIVE named AS (SELECT page_id, {host.format('url')} AS host, {path.format('url')} AS path, html FROM pages),
judged AS (SELECT *, {rule} AS rule FROM named), ruled AS (SELECT *, {verdict} AS by_rule FROM judged),
links AS (SELECT host AS src, unnest(regexp_extract_all(regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->', '', 'g'), '{link}', 1)) AS link FROM named),
ends AS (SELECT src, {host.format("CASE WHEN starts_with(link, '//') THEN 'http:' || link ELSE link END")} AS dst FROM links),
edges AS (SELECT src, dst, count(*) AS links FROM ends WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY src, dst),
both_ways AS (SELECT 'trust' AS kind, src AS giver, dst AS taker, links FROM edges UNION ALL SELECT 'distrust', dst, src, links FROM edges),
shares AS (SELECT kind, giver, taker, {linkgraph.DAMPING} * links / sum(links) OVER (PARTITION BY kind, giver) AS share FROM both_ways),
seeds AS ({seed('allow', 'trust')} UNION ALL {seed('block', 'distrust')}),
brought AS (SELECT 0 AS k, kind, host, CAST(score AS DOUBLE) AS score FROM seeds UNION ALL
  SELECT k + 1, kind, host, score FROM (SELECT b.k, b.kind, s.taker AS host, sum(b.score * s.share) AS score FROM brought b JOIN shares s ON b.kind = s.kind AND b.host = s.giver WHERE b.k < 150 GROUP BY ALL)),
scores AS (SELECT host, coalesce(sum(score) FILTER (kind = 'trust'), 0) AS trust, coalesce(sum(score) FILTER (kind = 'distrust'), 0) AS distrust FROM brought GROUP BY host),
bad AS (SELECT host FROM scores WHERE distrust >= {linkgraph.LIMIT} AND distrust > trust)
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict FROM ruled"""


def templates() -> str:
    """Names are marked in two passes: a pass misses a name right after one that it has marked."""
    n = decontam.WINDOW
    mark = "chr(57345)"
    name = r"'([\p{Ll},;:] )(\p{Lu}[\p{Ll}\p{M}]+)([^\p{L}]|$)', '\1' || " + mark + r" || '\2\3', 'g'"
    marked = f"regexp_replace(regexp_replace(translate(coalesce(text, ''), {mark}, ' '), {name}), {name})"
    token = decontam.TOKEN
    units = ", ".join(f"'{u}'" for u in decontam.UNITS)
    kind = f"CASE WHEN {{0}} >= '0' AND {{0}} <= ':' THEN '#number' WHEN starts_with({{0}}, {mark}) THEN '#name' WHEN {{0}} IN ({units}) THEN '#unit' END"
    side = lambda t, key: f"""{t}_t AS (SELECT row_number() OVER () AS {t}_row, {key}, regexp_extract_all(lower({marked}), '{token}') AS tokens FROM {t}),
{t}_w AS (SELECT *, list_transform(tokens, lambda t: coalesce({kind.format('t')}, t)) AS words FROM {t}_t),
{t}_i AS (SELECT *, unnest(range(1, len(words) - {n - 2})) AS i FROM {t}_w WHERE len(words) >= {n}),
{t}_x AS (SELECT {t}_row, {key}, i, tokens[i:i + {n - 1}] AS part, words[i:i + {n - 1}] AS w, array_to_string(words[i:i + {n - 1}], ' ') AS x FROM {t}_i)"""  # noqa: E731
    return f"""WITH {side('documents', 'doc_id')}, {side('benchmark', 'item_id')},
sizes AS (SELECT benchmark_row, count(DISTINCT x) AS item_windows FROM benchmark_x GROUP BY benchmark_row),
sought AS (SELECT * FROM benchmark_x JOIN sizes USING (benchmark_row) WHERE len(list_filter(w, lambda t: NOT starts_with(t, '#'))) >= {decontam.LEAST_FIXED}),
met AS (SELECT documents_row, benchmark_row, doc_id, item_id, item_windows, d.i - b.i AS diagonal, d.x, d.part AS doc_part, b.part AS item_part FROM documents_x d JOIN sought b ON d.x = b.x),
slots AS (SELECT DISTINCT documents_row, benchmark_row, diagonal, item_part[k] AS a, doc_part[k] AS b FROM met, range(1, {n + 1}) t(k) WHERE {kind.format('item_part[k]')} IS NOT NULL),
checked AS (SELECT documents_row, benchmark_row, diagonal, count(*) FILTER (a <> b) AS changed, count(*) = count(DISTINCT a) AS consistent FROM slots GROUP BY ALL),
good AS (SELECT m.*, coalesce(changed, 0) AS changed FROM met m LEFT JOIN checked c USING (documents_row, benchmark_row, diagonal) WHERE coalesce(consistent, true)),
held AS (SELECT doc_id, item_id, count(DISTINCT x) AS matched_windows, any_value(item_windows) AS item_windows, max(changed) AS changed_slots
FROM good GROUP BY documents_row, benchmark_row, doc_id, item_id HAVING count(DISTINCT x) >= {decontam.LEAST_SHARE} * any_value(item_windows))
SELECT doc_id, item_id, t.matched_windows, t.item_windows, t.changed_slots FROM (
  SELECT doc_id, item_id, max({{'share': matched_windows / item_windows, 'matched_windows': matched_windows, 'item_windows': item_windows, 'changed_slots': changed_slots}}) AS t FROM held GROUP BY doc_id, item_id)"""


ORACLE_SQL = {"op8_templates": templates(), "op1_link_graph": link_graph(), "op7_blob_ledger": secret_scan(), "op10_line_frequency": line_frequency()}
