"""Common table expressions that the oracles share: the page rule and the tokens, in DuckDB's SQL."""

RE = r"[\p{L}\p{N}]+(?:[-'']?[\p{L}\p{N}]+)*".replace("[-'']?", "[-'']")

ITEMS = """
lines AS (SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS text FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
items AS (SELECT doc_id, CAST(pos // 5 + 1 AS INT) AS page, CAST(pos % 5 AS INT) AS item_index, text FROM lines WHERE trim(text) <> ''),
offs AS (SELECT *, CAST(sum(length(text) + 1) OVER (PARTITION BY doc_id, page ORDER BY item_index) - length(text) - 1 AS INT) AS "start", CAST(sum(length(text) + 1) OVER (PARTITION BY doc_id, page ORDER BY item_index) - 1 AS INT) AS "end" FROM items)"""

PAGES = ITEMS + """,
pg AS (SELECT doc_id, page, string_agg(text, ' ' ORDER BY item_index) AS concat FROM items GROUP BY ALL)"""

TOKENS = PAGES + f""",
tk AS (SELECT doc_id, page, regexp_extract_all(concat, '{RE}') AS ts, regexp_split_to_array(concat, '{RE}') AS gs FROM pg),
tu AS (SELECT doc_id, page, unnest(range(len(ts))) AS pos, unnest(ts) AS token, unnest(gs[1:len(ts)]) AS gap FROM tk WHERE len(ts) > 0),
tokens AS (SELECT doc_id, page, CAST(pos AS INT) AS pos, token,
  CAST(sum(length(gap) + length(token)) OVER (PARTITION BY doc_id, page ORDER BY pos) - length(token) AS INT) AS "start",
  CAST(sum(length(gap) + length(token)) OVER (PARTITION BY doc_id, page ORDER BY pos) AS INT) AS "end" FROM tu)"""

#: hits(doc_id, page, s, e, tier) -> located(doc_id, page, item_index, "start", matched, context, char_start, char_end, n_spans, tier)
LOCATED = """
located AS (
  SELECT h.doc_id, h.page, o.item_index, CAST(h.s AS INT) AS "start", substr(p.concat, CAST(h.s AS BIGINT) + 1, CAST(h.e - h.s AS BIGINT)) AS matched, o.text AS context,
    CAST(greatest(h.s - o."start", 0) AS INT) AS char_start, CAST(least(length(o.text), h.e - o."start") AS INT) AS char_end,
    (SELECT count(*) FROM offs x WHERE x.doc_id = h.doc_id AND x.page = h.page AND x."end" > h.s AND x."start" < h.e) AS n_spans, h.tier
  FROM hits h JOIN pg p ON p.doc_id = h.doc_id AND p.page = h.page
  JOIN offs o ON o.doc_id = h.doc_id AND o.page = h.page AND o."end" > h.s
  QUALIFY row_number() OVER (PARTITION BY h.doc_id, h.page, h.s, h.e, h.tier ORDER BY o."start") = 1)"""

FOLD = "lower(strip_accents({0}))"


def stem(k: str) -> str:
    return f"""(CASE WHEN NOT regexp_full_match({k}, '[a-z]+') THEN {k}
  WHEN {k} LIKE '%ies' AND length({k}) >= 5 THEN left({k}, length({k}) - 3) || 'y'
  WHEN {k} LIKE '%es' AND length({k}) >= 5 THEN CASE WHEN regexp_matches(left({k}, length({k}) - 2), '(s|x|z|ch|sh)$') THEN left({k}, length({k}) - 2) ELSE left({k}, length({k}) - 1) END
  WHEN {k} LIKE '%s' AND {k} NOT LIKE '%ss' AND length({k}) >= 4 THEN left({k}, length({k}) - 1)
  WHEN {k} LIKE '%ing' AND length({k}) >= 6 THEN left({k}, length({k}) - 3)
  WHEN {k} LIKE '%ed' AND length({k}) >= 5 THEN left({k}, length({k}) - 2) ELSE {k} END)"""


def runs(keys: list[str], key: str, tier: int) -> str:
    """SELECT of hits: runs of tokens whose key equals keys."""
    k = len(keys)
    lead = ", ".join(f"lead({key}, {j}) OVER w AS k{j}" for j in range(k))
    cond = " AND ".join(f"k{j} = '{x}'" for j, x in enumerate(keys))
    return f"""SELECT doc_id, page, s, e, {tier} AS tier FROM (SELECT doc_id, page, "start" AS s, lead("end", {k - 1}) OVER w AS e, {lead} FROM tokens WINDOW w AS (PARTITION BY doc_id, page ORDER BY pos)) WHERE {cond}"""


def fallback(q: str) -> str:
    return f"""SELECT doc_id, page, map[p] AS s, map[p + {len(q)} - 1] + 1 AS e, 0 AS tier FROM (
  SELECT doc_id, page, map, unnest(list_filter(range(1, length(st) - {len(q)} + 2), lambda i: substr(st, i, {len(q)}) = '{q}')) AS p FROM (
    SELECT doc_id, page, regexp_replace(lower(concat), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS st,
      list_filter(range(0, length(concat)), lambda i: regexp_matches(substr(concat, i + 1, 1), '[\\p{{L}}\\p{{N}}]')) AS map
    FROM pg WHERE contains(regexp_replace(lower(concat), '[^\\p{{L}}\\p{{N}}]', '', 'g'), '{q}')))
  WHERE doc_id NOT IN (SELECT doc_id FROM tokens WHERE lower(token) = '{q}')"""


def fuzzy(q: str) -> str:
    most = 1 if len(q) <= 7 else 2
    key = FOLD.format("token")
    return f"""SELECT doc_id, page, "start" AS s, "end" AS e, 3 AS tier FROM tokens WHERE {key} <> '{q}' AND abs(length({key}) - {len(q)}) <= {most} AND levenshtein({key}, '{q}') <= {most}"""


def document_hits(q: str, folded: str | None = None) -> str:
    """hits of all four tiers for a query of plain words; folded: its folded form, if it differs."""
    ts, fs = q.lower().split(), (folded or q.lower()).split()
    k = FOLD.format("token")
    parts = [runs(ts, "lower(token)", 0)]
    if len(ts) == 1:
        parts.append(fallback(ts[0]))
    parts.append(runs(fs, k, 1))
    import parchment.operators.search as search

    parts.append(runs([search._stem_py(f) for f in fs], stem(k), 2))
    if len(ts) == 1 and len(fs[0]) >= 4:
        parts.append(fuzzy(fs[0]))
    return "\nUNION ALL\n".join(parts)


def document(q: str, folded: str | None = None, name: str = "found") -> str:
    """CTEs hits, located and ``name`` (doubles removed) for one query."""
    return f"""hits_{name} AS ({document_hits(q, folded)}),
{LOCATED.replace("located AS", f"located_{name} AS").replace("FROM hits h", f"FROM hits_{name} h").strip()},
{name} AS (SELECT * FROM located_{name} QUALIFY row_number() OVER (PARTITION BY doc_id, page, item_index, char_start ORDER BY tier, "start") = 1)"""
