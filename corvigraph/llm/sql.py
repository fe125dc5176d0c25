"""SQL with the same results as the queries, for DuckDB.

DuckDB has no NFKC, so NORMAL does what NFKC changes in these tables: full-width letters and signs become
plain ones, ligatures their letters, and all blanks one. p1 (patterns and corpus statistics) and p8 (trained model) are not
expressible; their tests use planted cases and labelled rows.
"""

from __future__ import annotations

_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_PLAIN = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)).replace("'", "''")


#: Latin ligatures and what NFKC makes of them.
_LIGATURES = {"\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl"}


def _normal(text: str) -> str:
    for one, many in _LIGATURES.items():
        text = f"replace({text}, '{one}', '{many}')"
    text = f"nfc_normalize({text})"
    return rf"nullif(trim(regexp_replace(lower(translate({text}, '{_WIDE}', '{_PLAIN}')), '[\s\x0b\x1c-\x1f\x85\p{{Z}}]+', ' ', 'g')), '')"


_CURRENT = """
current_rows AS (
  SELECT case_id, num_entities, entities FROM (
    SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY processed_at DESC NULLS LAST) AS rn
    FROM (SELECT DISTINCT * FROM rag_entities) WHERE case_id IS NOT NULL) WHERE rn = 1),
total AS (SELECT count(DISTINCT case_id) AS n FROM rag_entities),
"""

_VALUES = f"""
items AS (
  SELECT 'entities' AS field, case_id, {_normal("e.text")} AS term FROM (SELECT case_id, unnest(entities) AS e FROM current_rows)
  UNION ALL
  SELECT 'num_entities', case_id, CAST(num_entities AS VARCHAR) FROM current_rows WHERE num_entities IS NOT NULL),
counted AS (
  SELECT field, term, CAST(count(*) AS BIGINT) AS occurrences, CAST(count(DISTINCT case_id) AS BIGINT) AS cases
  FROM items WHERE term IS NOT NULL GROUP BY ALL),
marked AS (
  SELECT field, term, occurrences, cases, CASE WHEN cases <= 2 THEN 'rare' WHEN cases > 0.15 * total.n THEN 'common' END AS mark
  FROM counted, total)
"""

_PAIRS = f"""
baskets AS (
  SELECT DISTINCT case_id, {_normal("e.text")} AS term FROM (SELECT case_id, unnest(entities) AS e FROM current_rows)),
singles AS (SELECT term, count(*) AS n FROM baskets WHERE term IS NOT NULL GROUP BY term),
pairs AS (
  SELECT a.term AS term_a, b.term AS term_b, count(*) AS n FROM baskets a JOIN baskets b ON a.case_id = b.case_id AND a.term < b.term GROUP BY ALL),
scored AS (
  SELECT term_a, term_b, pairs.n, sa.n AS n_a, sb.n AS n_b, total.n AS total
  FROM pairs JOIN singles sa ON sa.term = term_a JOIN singles sb ON sb.term = term_b, total)
"""

_LONG = """
WITH long AS (
  SELECT DISTINCT report_id, field, text FROM (
    SELECT report_id, 'findings' AS field, findings AS text FROM reports_lean UNION ALL
    SELECT report_id, 'conclusions', conclusions FROM reports_lean) WHERE length(text) > 1200)
"""

_SOURCES = r"""
WITH listed AS (SELECT source, translate(lower(trim(source)), ' -', '__') AS key, target_share, max_uses FROM mix_targets),
docs AS (SELECT translate(lower(regexp_replace(source, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), ' -', '__') AS key, strlen(text) + 1 AS tokens FROM documents WHERE text IS NOT NULL),
sizes AS (SELECT listed.source, target_share, max_uses, coalesce(sum(tokens), 0) AS tokens FROM listed LEFT JOIN docs USING (key) GROUP BY ALL)
"""


#: Boundaries become line feeds one for one; stretches between them give the offsets behind each. Then piece after piece is cut by recursion.
_PIECES = r"""
WITH RECURSIVE long AS (
  SELECT DISTINCT report_id, field, text FROM (
    SELECT report_id, 'findings' AS field, findings AS text FROM reports_lean UNION ALL
    SELECT report_id, 'conclusions', conclusions FROM reports_lean) WHERE length(text) > 1200),
parts AS (
  SELECT report_id, field, text, string_split_regex(regexp_replace(text, '[.!?]([\s\x0b\x1c-\x1f\x85\p{Z}]|$)', chr(10) || '\1', 'g'), '[\n\r]') AS p FROM long),
marks AS (
  SELECT report_id, field, text, length(text)::BIGINT AS n,
         list_transform(range(1, len(p)), lambda i: list_sum(list_transform(p[1:i], lambda x: length(x) + 1))::BIGINT) AS ends FROM parts),
cuts AS (
  SELECT report_id, field, text, n, ends, -1 AS piece_no, 0::BIGINT AS start, 0::BIGINT AS done, false AS forced, 0::BIGINT AS next FROM marks
  UNION ALL
  SELECT report_id, field, text, n, ends, piece_no, start, done, forced,
    CASE WHEN done = n THEN n ELSE coalesce(list_min(list_filter(ends, lambda e: e >= done - reach AND e < done)), done - reach) END
  FROM (
    SELECT *, least(CASE WHEN run <= 1200 THEN greatest(0, least(120, 1200 - stretch)) ELSE 120 END, done - start - 1) AS reach
    FROM (
      SELECT *, coalesce(after, n) - done AS stretch, coalesce(after - 1, n) - done AS run
      FROM (
        SELECT report_id, field, text, n, ends, piece_no + 1 AS piece_no, next AS start,
          CASE WHEN n <= next + 1200 THEN n WHEN coalesce(list_max(list_filter(ends, lambda e: e <= next + 1200)), 0) > done THEN list_max(list_filter(ends, lambda e: e <= next + 1200)) ELSE next + 1200 END AS done,
          n > next + 1200 AND coalesce(list_max(list_filter(ends, lambda e: e <= next + 1200)), 0) <= done AS forced,
          list_min(list_filter(ends, lambda e: e > CASE WHEN coalesce(list_max(list_filter(ends, lambda f: f <= next + 1200)), 0) > done THEN list_max(list_filter(ends, lambda f: f <= next + 1200)) ELSE next + 1200 END)) AS after
        FROM cuts WHERE done < n)))
)
SELECT report_id, field, piece_no::INTEGER AS piece_no, start, done AS "end", forced, substring(text, start + 1, done - start) AS piece FROM cuts WHERE piece_no >= 0"""

#: Water filling: the level at which the sources that their own cap stops, and the targets of the rest, give the whole mix.
_RATES = """,
plain AS (
  SELECT listed.source, greatest(coalesce(target_share, 0), 0) AS share, coalesce(max_uses, 1) AS most, tokens, coalesce(max_uses, 1) * tokens AS cap, (SELECT sum(tokens) FROM sizes) AS total
  FROM listed JOIN sizes USING (source, target_share, max_uses)),
levels AS (
  SELECT a.source, (a.total - coalesce((SELECT sum(b.cap) FROM plain b WHERE b.share > 0 AND (b.cap / b.share, b.source) < (a.cap / a.share, a.source)), 0))
    / (SELECT sum(b.share) FROM plain b WHERE b.share > 0 AND (b.cap / b.share, b.source) >= (a.cap / a.share, a.source)) AS level, a.cap, a.share
  FROM plain a WHERE a.share > 0),
level AS (SELECT arg_min(greatest(level, 0), (cap / share, source)) AS level FROM levels WHERE greatest(level, 0) * share <= cap),
rates AS (
  SELECT source, share, most, tokens, total, cap,
    CASE WHEN tokens = 0 OR share = 0 THEN 0 ELSE least(most::DOUBLE, least(cap, coalesce(level * share, cap)) / tokens) END::DOUBLE AS rate FROM plain, level),
uses AS (
  SELECT doc_id, rates.source, strlen(text) + 1 AS tokens,
    (floor(rate) + CASE WHEN ('0x' || substring(md5('42-' || doc_id::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END)::INTEGER AS uses
  FROM documents JOIN listed ON translate(lower(regexp_replace(documents.source, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')), ' -', '__') = key JOIN rates ON rates.source = listed.source WHERE text IS NOT NULL)
"""


def _p5() -> str:
    from .queries import NO_NAMES

    names = ", ".join("'" + n + "'" for n in NO_NAMES)
    return rf"""
WITH RECURSIVE entries AS (
  SELECT unnest(map_entries(entity_map)) AS e FROM resolved_entities WHERE entity_map IS NOT NULL),
links AS (
  SELECT DISTINCT x, y FROM (SELECT {_normal("e.key")} AS x, {_normal("e.value.name")} AS y FROM entries)
  WHERE x IS NOT NULL AND y IS NOT NULL AND trim(regexp_replace(y, '[^\p{{L}}\p{{N}}]+', ' ', 'g')) NOT IN ({names})),
both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT x, y FROM both_ways UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x)
SELECT least(min(y), x) AS group_name, x AS member FROM reach GROUP BY x HAVING least(min(y), x) <> x
"""


def statements() -> dict[str, str]:
    return {
        "p2_found": f"WITH {_CURRENT} {_VALUES} SELECT field, term, mark FROM marked WHERE mark IS NOT NULL",
        "p2_terms": f"WITH {_CURRENT} {_VALUES} SELECT field, term, occurrences, cases, mark FROM marked",
        "p3_found": _LONG + r"""
SELECT report_id, field,
  CASE WHEN list_max(list_transform(string_split_regex(regexp_replace(text, '[.!?]([\s\x0b\x1c-\x1f\x85\p{Z}]|$)', chr(10) || '\1', 'g'), '[\n\r]'), lambda s: length(s))) > 1200
       THEN 'forced' ELSE 'natural' END AS cut
FROM long""",
        "p4_found": f"WITH {_CURRENT} {_PAIRS} SELECT term_a, term_b FROM scored WHERE n >= 5 AND 1000 * n >= total AND n * total >= 3 * n_a * n_b",
        "p3_pieces": _PIECES,
        "p4_pairs": f"""WITH {_CURRENT} {_PAIRS} SELECT term_a, term_b, n, n_a, n_b, round(n * total / (n_a::DOUBLE * n_b), 6) AS lift,
  round(CASE WHEN n < total THEN ln(n * total / (n_a::DOUBLE * n_b)) / -ln(n / total) ELSE 1 END, 6)::DOUBLE AS npmi FROM scored""",
        "p5_found": _p5(),
        "p6_found": "SELECT doc_id FROM documents WHERE strlen(text) + 1 > 4096",
        "p7_found": _SOURCES + "SELECT source FROM sizes WHERE max_uses * tokens < target_share * (SELECT sum(tokens) FROM sizes)",
        "p7_uses": _SOURCES + _RATES + "SELECT doc_id, source, tokens, uses FROM uses",
        "p7_shares": _SOURCES + _RATES + """SELECT r.source, share AS target_share, cap >= share * total AS reachable, round(rate, 9) AS rate, coalesce(used, 0)::BIGINT AS used_tokens, round(coalesce(used, 0) / sum(coalesce(used, 0)) OVER (), 9)::DOUBLE AS share
FROM rates r LEFT JOIN (SELECT source, sum(tokens * uses) AS used FROM uses GROUP BY source) u ON u.source = r.source""",
    }
