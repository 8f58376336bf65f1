"""Common table expressions for the SQL that queries are compared with."""

from __future__ import annotations

from edgeloom.plans.adapters import KIND_OF
from edgeloom.plans.edges import KINDS

_KIND_LIST = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
_CASE = "CASE l_returnflag || l_linestatus " + " ".join(f"WHEN '{k}' THEN {KINDS.index(v)}" for k, v in KIND_OF.items()) + " END"

NATIONS = """nf AS (
  SELECT n_nationkey AS k, 'src/' || lower(replace(r_name, ' ', '_')) || '/' || lower(replace(n_name, ' ', '_')) || '.rs' AS f, r_name AS region, n_name AS nation
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""

TRADE_REFS = f"""{NATIONS}, trade_refs AS (
  SELECT cf.f AS source, sf.f AS target, false AS external, {_CASE} AS ord
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nf cf ON cf.k = c_nationkey JOIN nf sf ON sf.k = s_nationkey)"""

BRAND_REFS = """brand_refs AS (
  SELECT cf.f AS source, lower(replace(p_brand, '#', '_')) AS target, true AS external, 0 AS ord
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey
  JOIN nf cf ON cf.k = c_nationkey)"""

SELF_REFS = "self_refs AS (SELECT f AS source, f AS target, false AS external, NULL::INTEGER AS ord FROM nf)"


def merged(name: str, refs: str) -> str:
    """Edge relation ``name`` (source, target, external, kinds: list of ordinals)."""
    return f"""{name} AS (
  SELECT source, target, bool_and(CASE WHEN source = target THEN false ELSE external END) AS external,
         coalesce(list_sort(list(DISTINCT ord) FILTER (WHERE source <> target AND ord IS NOT NULL)), []) AS kinds
  FROM ({refs}) WHERE target IS NOT NULL GROUP BY source, target)"""


def kinds(c: str = "kinds", sep: str = "|") -> str:
    return f"array_to_string(list_transform({c}, lambda o: ({_KIND_LIST})[o + 1]), '{sep}')"


_ALL = "SELECT source, target, external, ord FROM "
TRADE = f"{TRADE_REFS}, {SELF_REFS}, " + merged("edges", f"{_ALL} trade_refs UNION ALL {_ALL} self_refs")
MIXED = f"{TRADE_REFS}, {BRAND_REFS}, {SELF_REFS}, " + merged("edges", f"{_ALL} trade_refs UNION ALL {_ALL} brand_refs UNION ALL {_ALL} self_refs")
TOP3 = f"""{TRADE_REFS}, counted AS (
  SELECT source, target, count(*) AS n FROM trade_refs WHERE source <> target GROUP BY 1, 2
), ranked AS (
  SELECT source, target, row_number() OVER (PARTITION BY source ORDER BY n DESC, target) AS r FROM counted
), edges AS (
  SELECT source, target, false AS external, [0] AS kinds FROM ranked WHERE r <= 3
), nodes AS (
  SELECT source AS label FROM edges UNION SELECT target FROM edges)"""
FLOW = """nexts AS (
  SELECT event_type AS source, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS target FROM events
), edges AS (
  SELECT source, target, CASE WHEN source = target THEN [] WHEN count(*) % 2 = 0 THEN [0] ELSE [3] END AS kinds
  FROM nexts WHERE target IS NOT NULL GROUP BY 1, 2)"""
PARTS = """follows AS (
  SELECT l_partkey AS a, l_quantity AS q, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS b FROM lineitem
), edges AS (
  SELECT DISTINCT 'part_' || a AS source, 'part_' || b AS target FROM follows WHERE q >= 48 AND b IS NOT NULL)"""
DOCS = r"""files AS (
  SELECT lang || '/' || source || '/doc_' || doc_id || '.md' AS path, coalesce(text, '') AS content FROM documents)"""
LINKS = """links AS (
  SELECT DISTINCT url, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS href FROM pages)"""
TYPES = """types AS (
  SELECT 'Customer_' || c_custkey AS type, CASE WHEN c_mktsegment = 'BUILDING' THEN 'trait' ELSE 'struct' END AS kind, 'src/nation_' || c_nationkey || '.rs' AS file FROM customer
), methods AS (
  SELECT DISTINCT 'Customer_' || o_custkey AS type, o_orderkey::VARCHAR AS method FROM orders
), accesses AS (
  SELECT DISTINCT 'Customer_' || o_custkey AS type, o_orderkey::VARCHAR AS method, p_brand AS field
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
), fields AS (
  SELECT DISTINCT type, field FROM accesses
), inputs AS (
  SELECT t.type, m.m, coalesce(a.a, 0) AS a, coalesce(s.s, 0) AS s
  FROM (SELECT DISTINCT type FROM types WHERE kind = 'struct') t
  JOIN (SELECT type, count(*) AS m FROM methods GROUP BY 1) m ON m.type = t.type
  LEFT JOIN (SELECT type, count(*) AS a FROM fields GROUP BY 1) a ON a.type = t.type
  LEFT JOIN (SELECT type, count(*) AS s FROM accesses GROUP BY 1) s ON s.type = t.type)"""
DISTANCE = f"""{TOP3}, components AS (
  SELECT nf.f AS file, (SELECT count(*) FROM customer WHERE c_nationkey = nf.k AND c_acctbal > (24 - c_nationkey) * 400) AS traits,
         (SELECT count(*) FROM customer WHERE c_nationkey = nf.k AND NOT c_acctbal > (24 - c_nationkey) * 400) AS concrete,
         (SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = nf.k) AS loc,
         (SELECT count(DISTINCT source) FROM edges WHERE target = nf.f) AS ca, (SELECT count(DISTINCT target) FROM edges WHERE source = nf.f) AS ce,
         (SELECT count(*) FROM nf) AS n FROM nf
), ai AS (
  SELECT *, CASE WHEN traits + concrete = 0 THEN 0.0 ELSE traits::DOUBLE / (traits + concrete) END AS abstractness,
         CASE WHEN ca + ce = 0 THEN 0.0 ELSE ce::DOUBLE / (ca + ce) END AS instability FROM components
), values_ AS (
  SELECT *, abs(abstractness + instability - 1) AS distance, CASE WHEN n <= 1 THEN 0.0 ELSE (ca + ce)::DOUBLE / (2 * (n - 1)) END AS coupling_factor,
         abs(abstractness + instability - 1) * (1 - least(loc / 100.0::DOUBLE, 1.0) * 0.5) AS normalized_distance FROM ai)"""
IMPLS = f"""{NATIONS}, impls AS (
  SELECT k AS impl_id, CASE WHEN k % 2 = 0 THEN region || '::' || nation ELSE nation END AS name, region AS file, nation AS s FROM nf
), types AS (
  SELECT region || '::' || nation AS type, region AS file, nation AS s FROM nf UNION ALL SELECT nation, 'shared', nation FROM nf WHERE k % 3 = 0)"""
