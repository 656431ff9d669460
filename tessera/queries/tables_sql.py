"""SQL counterparts of :mod:`tessera.queries.tables`."""

from __future__ import annotations

CITY = """cities AS (SELECT c_custkey AS city_id, c_name AS name, 'C' || c_nationkey AS country_code,
  c_acctbal AS score, c_mktsegment AS segment FROM customer)"""
TIERS = f"""{CITY}, tiers AS (
  SELECT city_id, name, country_code, CASE WHEN score > 8000 AND segment = 'BUILDING' THEN 'D' WHEN score > 5000 THEN 'S' ELSE 'G' END AS tier
  FROM cities)"""
CONTEXT = """per AS (
  SELECT 'C' || s_nationkey AS country_code, CAST(count(*) AS DOUBLE) AS pop,
    CASE WHEN avg(s_acctbal) > 4000 THEN round(avg(s_acctbal), 2) END AS gdp,
    CASE WHEN count(*) > 3 THEN round(max(s_acctbal), 2) END AS urb FROM supplier GROUP BY 1)"""
DESIGNS = """designs AS (
  SELECT CAST(p_partkey AS VARCHAR) AS design_id, p_brand AS family_id, p_type AS suite, p_name AS title,
    p_type || '-' || p_size AS question, CASE WHEN p_size <= 5 THEN 'reference-implemented' ELSE 'design-only' END AS status,
    CASE WHEN p_size = 1 THEN 'tmpl-' || (p_partkey % 4000) END AS template_ref, p_size FROM part)"""
CLIMATE = """agg AS (
  SELECT user_id AS city_id, avg(value) FILTER (event_type = 'view') AS t2m, max(value) FILTER (event_type = 'click') AS t2max,
    sum(value) FILTER (event_type = 'purchase') AS prec, avg(value) FILTER (event_type = 'signup') AS wind,
    avg(value) FILTER (event_type = 'error') AS rh,
    CAST(count(*) FILTER (event_type = 'click' AND value >= 35) AS DOUBLE) AS hot,
    CAST(count(*) FILTER (event_type = 'purchase' AND value >= 20) AS DOUBLE) AS wet FROM events GROUP BY 1)"""
EXECUTIONS = """executions AS (
  SELECT o_orderkey AS execution_id, o_custkey AS city_id, ['deep', 'standard', 'reference'][o_orderkey % 3 + 1] AS kind,
    o_orderpriority AS suite, o_orderstatus AS status, o_orderpriority || ' ' || o_orderstatus AS title FROM orders)"""
TOKENS = """tok AS (
  SELECT doc_id, list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+(?:-[a-z0-9]+)*'),
    lambda t: len(t) > 1 AND NOT list_contains(['a','and','are','as','at','be','by','for','from','in','into','is','of','on','or','the','to','under','with'], t)))) AS tokens
  FROM documents)"""
CLASSES = f"""{TOKENS}, classes AS (
  SELECT tokens, len(tokens) AS size, count(*) AS members, min(doc_id) AS first_id FROM tok GROUP BY tokens),
item AS (SELECT first_id, size, members, unnest(tokens) AS token FROM classes),
pairs AS (
  SELECT a.first_id AS first_a, b.first_id AS first_b, count(*) AS shared_terms,
    round(count(*) / (any_value(a.size) + any_value(b.size) - count(*)), 6) AS similarity,
    any_value(a.members) * any_value(b.members) AS row_pairs
  FROM item a JOIN item b ON a.token = b.token AND a.first_id < b.first_id AND a.size >= b.size * 0.899 AND b.size >= a.size * 0.899 GROUP BY 1, 2),
high AS (SELECT * FROM pairs WHERE similarity >= 0.9)"""
ALL_PAIRS = CLASSES.replace(" AND a.size >= b.size * 0.899 AND b.size >= a.size * 0.899", "")
NORM = "trim(regexp_replace(lower(text), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"


def levels(leaves: str, count: int = 4) -> str:
    """Levels of the hash trees of groups g above a table ``leaves`` of (g, slot, hash, n); the last is ``root``."""
    out, below = leaves, "leaves"
    for level in [*(f"up{k}" for k in range(1, count)), "top"]:
        out += f""", {level} AS (SELECT g, slot >> 6 AS slot, sha256(string_agg(slot || ':' || hash, ',' ORDER BY slot)) AS hash,
          CAST(sum(n) AS BIGINT) AS n FROM {below} GROUP BY 1, 2)"""
        below = level
    return out + ", root AS (SELECT g, hash, n AS artifacts FROM top)"


def set_tree(lines: str) -> str:
    """Hash trees of the multisets of lines of a query of (g, line)."""
    return levels(f"""leaves AS (
          SELECT g, CAST('0x' || substr(sha256(line), 1, 6) AS BIGINT) AS slot, sum(n) AS n,
            sha256(string_agg(line || ' x' || n, chr(10) ORDER BY line || ' x' || n)) AS hash
          FROM (SELECT g, line, count(*) AS n FROM ({lines}) GROUP BY 1, 2) GROUP BY 1, 2)""")


def page(source: str, columns: str, order: str, limit: int, offset: int = 0, following: bool = True) -> str:
    """Rows of one page with position, total and next offset."""
    extra = f", CASE WHEN total > {offset + limit} THEN CAST({offset + limit} AS BIGINT) END AS next_offset" if following else ""
    return f"""SELECT {columns}, position, total{extra} FROM (
      SELECT *, row_number() OVER (ORDER BY {order}) AS position, count(*) OVER () AS total FROM {source})
      WHERE position > {offset} AND position <= {offset + limit}"""


ORACLES = {
    "breadth_first_selection": f"""WITH {CITY}, led AS (
          SELECT *, row_number() OVER (PARTITION BY country_code ORDER BY score DESC, city_id) = 1 AS leader FROM cities),
        r AS (SELECT *, row_number() OVER (ORDER BY leader DESC, score DESC, city_id) AS selection_rank FROM led)
        SELECT city_id, country_code, CASE WHEN leader THEN 'group-leader' ELSE 'global-fill' END AS selection_basis, selection_rank
        FROM r WHERE selection_rank <= 250""",
    "first_eligible": """WITH e AS (SELECT p_partkey AS rank, p_size > 40 AS eligible,
            count(*) FILTER (p_size > 40) OVER (ORDER BY p_partkey) AS seen FROM part)
        SELECT rank, CASE WHEN eligible THEN 'selected' ELSE 'excluded' END AS outcome,
          CASE WHEN eligible THEN seen END AS selection_order FROM e WHERE (eligible AND seen <= 30) OR (NOT eligible AND seen < 30)""",
    "page": page("part", "p_partkey, p_name", "lower(p_name), p_partkey", 50, 100),
    "duplicate_keys": "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "calendar_check": """WITH d AS (SELECT CAST(floor(user_id / 5) AS BIGINT) AS artifact_id, CAST(ts AS DATE) AS day,
            count(DISTINCT event_type) AS p FROM events GROUP BY 1, 2)
        SELECT artifact_id, CAST(sum(p) AS BIGINT) AS values, count(*) FILTER (p = 5) AS aligned_days,
          count(*) FILTER (p = 5) AS complete_days, CAST(0 AS BIGINT) AS unexpected_days,
          count(*) FILTER (p = 5) = 30 AS calendar_complete FROM d GROUP BY 1""",
    "missing_ids": "SELECT c_custkey AS custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
    "tolerance_join": """WITH c AS (SELECT s_suppkey AS city_id, ((s_suppkey * 3) % 89) * 0.7::DOUBLE - 30 AS lat, ((s_suppkey * 3) % 97) * 1.1::DOUBLE - 50 AS lon FROM supplier),
        s AS (SELECT c_custkey AS id, (c_custkey % 89) * 0.7::DOUBLE - 30 + 4e-10 AS lat, (c_custkey % 97) * 1.1::DOUBLE - 50 AS lon FROM customer),
        m AS (SELECT city_id, count(id) AS matches, min(id) AS id FROM c LEFT JOIN s
          ON abs(c.lat - s.lat) <= 1e-9 AND abs(c.lon - s.lon) <= 1e-9 GROUP BY 1)
        SELECT city_id, matches, CASE matches WHEN 0 THEN 'unmatched' WHEN 1 THEN 'matched' ELSE 'ambiguous' END AS status,
          CASE WHEN matches = 1 THEN id END AS artifact_id FROM m""",
    "context_join": f"""WITH {CITY}, {CONTEXT}
        SELECT city_id, country_code, pop IS NOT NULL AND gdp IS NOT NULL AND urb IS NOT NULL AS complete,
          array_to_string(list_filter([CASE WHEN pop IS NULL THEN 'SP.POP.TOTL' END, CASE WHEN gdp IS NULL THEN 'NY.GDP.PCAP.CD' END,
            CASE WHEN urb IS NULL THEN 'SP.URB.TOTL.IN.ZS' END], lambda x: x IS NOT NULL), '|') AS missing,
          round(pop, 2) AS population, round(gdp, 2) AS gdp FROM cities LEFT JOIN per USING (country_code)""",
    "population_join": """SELECT s_suppkey AS city_id, lpad(CAST(s_nationkey AS VARCHAR), 2, '0') || lpad(CAST(s_suppkey AS VARCHAR), 7, '0') AS geoid,
          CAST(round(c_acctbal * 100) AS BIGINT) AS population, CASE WHEN c_custkey IS NULL THEN 'missing' ELSE 'found' END AS outcome
        FROM supplier LEFT JOIN customer ON c_custkey = s_suppkey AND c_nationkey = s_nationkey""",
    "fk_violations": """WITH v AS (
          SELECT 'line order' AS relation, CAST(l_orderkey AS VARCHAR) AS ref FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
          UNION ALL SELECT 'line part', CAST(l_partkey AS VARCHAR) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)
          UNION ALL SELECT 'order customer', CAST(o_custkey AS VARCHAR) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
          UNION ALL SELECT 'customer as supplier', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)
          UNION ALL SELECT 'document label', CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))
        SELECT relation, count(DISTINCT ref) AS missing_references, count(*) AS rows, min(ref) AS example FROM v GROUP BY 1""",
    "reconcile_sets": """SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing' ELSE 'unexpected' END AS issue
        FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id * 3 AS doc_id FROM labels) l ON d.doc_id = l.doc_id
        WHERE d.doc_id IS NULL OR l.doc_id IS NULL""",
    "highest_tier": f"""WITH {TIERS} SELECT city_id, name, tier, CAST(CASE tier WHEN 'D' THEN 18 WHEN 'S' THEN 11 ELSE 0 END AS BIGINT) AS metric_count,
        CAST(CASE tier WHEN 'D' THEN 7 ELSE 0 END AS BIGINT) AS capability_count FROM tiers""",
    "template_expansion": f"""WITH {CITY} SELECT city_id, template_order, template_id, suite, 'tierd.' || city_id || '.0' || template_order AS scenario_id
        FROM cities, (VALUES (1, 'demand-forecast', 'public-service'), (2, 'heat-screen', 'climate-disaster'), (3, 'transit-access', 'mobility-access')) t(template_order, template_id, suite)""",
    "registry_check": "SELECT CAST(o_orderkey AS VARCHAR) AS key, 'content hash differs' AS issue FROM orders WHERE o_orderstatus = 'P'",
    "design_join": """WITH f AS (SELECT p_brand, min(p_name) AS title, max(p_type) AS suite FROM part WHERE p_size > 10 GROUP BY 1)
        SELECT p.p_brand AS family_id, f.title AS family_title, f.suite AS family_suite, count(*) AS designs
        FROM part p LEFT JOIN f ON p.p_brand = f.p_brand GROUP BY 1, 2, 3""",
    "mapping_issues": f"""WITH {DESIGNS}, a AS (SELECT template_ref, count(*) AS n FROM designs WHERE template_ref IS NOT NULL GROUP BY 1),
        t AS (SELECT DISTINCT 'tmpl-' || (s_suppkey * 2) AS id FROM supplier)
        SELECT coalesce(template_ref, id) AS template_id, CASE WHEN n IS NULL THEN 'template has no design'
          WHEN id IS NULL THEN 'design refers to an unknown template' ELSE 'template has several designs' END AS issue
        FROM a FULL JOIN t ON template_ref = id WHERE n IS NULL OR id IS NULL OR n > 1""",
    "climate_window_metrics": f"""WITH {CLIMATE} SELECT city_id, m.id AS metric_id, round(m.v, 9) AS value, 'estimated' AS evidence_type FROM (
        SELECT city_id, unnest([{{'id': 'climate.t2m-mean', 'v': t2m}}, {{'id': 'climate.t2m-max-maximum', 'v': t2max}},
          {{'id': 'climate.precipitation-total', 'v': prec}}, {{'id': 'climate.wind-speed-mean', 'v': wind}},
          {{'id': 'climate.relative-humidity-mean', 'v': rh}}]) AS m FROM agg)""",
    "climate_annual_metrics": f"""WITH {CLIMATE} SELECT city_id, m.id AS metric_id, round(m.v, 9) AS value FROM (
        SELECT city_id, unnest([{{'id': 'climate-t2m-annual-mean', 'v': t2m}}, {{'id': 'climate-t2m-max-annual-maximum', 'v': t2max}},
          {{'id': 'climate-t2m-min-annual-minimum', 'v': CAST(NULL AS DOUBLE)}}, {{'id': 'climate-days-t2m-max-ge-35c', 'v': hot}},
          {{'id': 'climate-precipitation-annual-sum', 'v': prec}}, {{'id': 'climate-days-precipitation-ge-20mm', 'v': wet}},
          {{'id': 'climate-wind-speed-annual-mean', 'v': wind}}, {{'id': 'climate-relative-humidity-annual-mean', 'v': rh}}]) AS m FROM agg)""",
    "country_metrics": f"""WITH {CONTEXT} SELECT country_code, 'country-' || replace(lower(i), '.', '-') AS metric_id, round(v, 6) AS value,
        'estimated' AS evidence_type FROM (SELECT country_code, 'SP.POP.TOTL' AS i, pop AS v FROM per UNION ALL
          SELECT country_code, 'NY.GDP.PCAP.CD', gdp FROM per UNION ALL SELECT country_code, 'SP.URB.TOTL.IN.ZS', urb FROM per) WHERE v IS NOT NULL""",
    "melt_metrics": """SELECT p_partkey, 'p_size' AS metric_id, CAST(p_size AS DOUBLE) AS value FROM part
        UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part""",
    "compare_cities": f"""WITH {CLIMATE} SELECT city_id, round(t2m, 9) AS t2m_mean, round(prec, 9) AS precipitation,
        CASE WHEN prec IS NULL THEN 'missing' ELSE regexp_replace(regexp_replace(printf('%.6f', round(prec, 2)), '0+$', ''), '\\.$', '') END AS precipitation_text FROM agg""",
    "enum_counts": """SELECT m AS member, (SELECT count(*) FROM orders WHERE o_orderpriority = m) AS n, 'priority' AS field
        FROM (VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM'), ('4-NOT SPECIFIED'), ('5-LOW'), ('6-NONE')) t(m)
        UNION ALL SELECT m, (SELECT count(*) FILTER (o_orderstatus = m) + count(*) FILTER (substr(o_orderpriority, 1, 1) = m) FROM orders), 'tags'
        FROM (VALUES ('F'), ('O'), ('P'), ('1'), ('9')) t(m)""",
    "suite_overview": f"""WITH {DESIGNS}, s AS (SELECT unnest(['1-URGENT','2-HIGH','3-MEDIUM','4-NOT SPECIFIED','5-LOW','6-NONE']) AS suite),
        r AS (SELECT o_orderpriority AS suite, count(*) AS executions, count(*) FILTER (o_orderstatus = 'F') AS completed,
          count(*) FILTER (o_orderstatus <> 'F') AS negative, count(DISTINCT o_custkey) AS cities FROM orders GROUP BY 1),
        d AS (SELECT ['1-URGENT','2-HIGH','3-MEDIUM'][len(title) % 3 + 1] AS suite, count(*) AS designs,
          count(DISTINCT family_id) AS families, count(template_ref) AS templates FROM designs GROUP BY 1)
        SELECT suite, coalesce(executions, 0) AS executions, coalesce(completed, 0) AS completed, coalesce(negative, 0) AS negative,
          coalesce(cities, 0) AS cities, coalesce(designs, 0) AS designs, coalesce(families, 0) AS families, coalesce(templates, 0) AS templates
        FROM s LEFT JOIN r USING (suite) LEFT JOIN d USING (suite)""",
    "family_summary": f"""WITH {DESIGNS} SELECT family_id, count(*) AS designs, count(*) FILTER (status = 'reference-implemented') AS implemented,
        count(*) FILTER (status = 'design-only') AS design_only FROM designs GROUP BY 1""",
    "evidence_totals": """SELECT l_returnflag AS suite, count(*) AS executions, count(*) FILTER (l_linestatus = 'F') AS completed,
        count(*) FILTER (l_linestatus <> 'F') AS negative, CAST(sum(l_quantity) AS BIGINT) AS observations,
        CAST(sum(l_linenumber) AS BIGINT) AS draws FROM lineitem GROUP BY 1""",
    "check_totals": """WITH t AS (SELECT count(*) AS e, count(*) FILTER (l_linestatus = 'F') AS c, CAST(sum(l_quantity) AS BIGINT) AS o,
            CAST(sum(l_linenumber) AS BIGINT) AS d FROM lineitem WHERE l_returnflag = 'A'),
        p AS (SELECT count(*) AS e, count(*) FILTER (l_linestatus = 'F') AS c, CAST(sum(l_quantity) AS BIGINT) AS o,
            CAST(sum(l_linenumber) AS BIGINT) AS d FROM lineitem WHERE l_returnflag = 'A' AND l_linenumber <> 7)
        SELECT 'A' AS suite, f AS figure, published, recomputed FROM (
          SELECT 'executions' AS f, p.e AS published, t.e AS recomputed FROM p, t UNION ALL SELECT 'completed', p.c, t.c FROM p, t
          UNION ALL SELECT 'negative', p.e - p.c, t.e - t.c FROM p, t UNION ALL SELECT 'observations', p.o, t.o FROM p, t
          UNION ALL SELECT 'draws', p.d, t.d FROM p, t) WHERE published <> recomputed""",
    "nearest_rank_summary": """SELECT l_returnflag, count(*) AS n, round(min(l_extendedprice), 4) AS minimum,
        round(quantile_cont(l_extendedprice, 0.5), 4) AS median, round(max(p95), 4) AS p95, round(max(l_extendedprice), 4) AS maximum
        FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice)
          = ceil(count(*) OVER (PARTITION BY l_returnflag) * 0.95) THEN l_extendedprice END AS p95 FROM lineitem) GROUP BY 1""",
    "pack_ledger": """SELECT o_orderkey AS pack_id, o_custkey AS city_id, o_orderpriority AS template_id,
        CASE WHEN o_orderstatus = 'F' THEN 'completed' ELSE 'insufficient-evidence' END AS status, CAST(round(o_totalprice) AS BIGINT) AS observed_requests,
        CAST(CASE WHEN o_orderstatus = 'F' THEN 183 ELSE 0 END AS BIGINT) AS forecast_observations, CAST(0 AS BIGINT) AS draws,
        CAST(CASE WHEN o_orderstatus = 'F' THEN 3125 ELSE 0 END AS BIGINT) AS search_space, CAST(0 AS BIGINT) AS evaluated_plans,
        CAST(0 AS BIGINT) AS feasible_plans, o_orderpriority || '|' || o_orderstatus AS source_refs, md5(CAST(o_orderkey AS VARCHAR)) AS content_hash FROM orders""",
    "screen_tally": """SELECT o_custkey AS city_id, count(*) FILTER (o_orderstatus = 'F') AS screened,
        count(*) FILTER (o_orderstatus <> 'F') AS insufficient, CAST(0 AS BIGINT) AS recommendations_issued FROM orders GROUP BY 1""",
    "dedupe_or_conflict": """SELECT source || '-' || n_chars AS k, count(*) AS copies, min(md5(text)) AS content_hash,
        CASE WHEN count(DISTINCT text) = 1 THEN 'unique' ELSE 'conflict' END AS status FROM documents GROUP BY 1""",
    "catalog_summary": """SELECT (SELECT count(*) FROM customer) AS cities, (SELECT count(DISTINCT c_nationkey) FROM customer) AS countries,
        (SELECT count(DISTINCT l_suppkey) FROM lineitem) AS sources, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS artifacts,
        (SELECT CAST(sum(l_quantity) AS BIGINT) FROM lineitem) AS records, (SELECT CAST(max(l_shipdate) AS DATE) FROM lineitem) AS latest_retrieval,
        (SELECT count(*) FROM orders) AS executions, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS completed,
        (SELECT count(*) FROM part) AS designs""",
    "search_cities": f"WITH {TIERS}, f AS (SELECT * FROM tiers WHERE tier = 'S' AND country_code = 'C7' AND contains(lower(name), 'customer#')) "
        + page("f", "city_id, name, tier", "lower(name), city_id", 40),
    "search_scenarios": f"WITH {EXECUTIONS}, f AS (SELECT * FROM executions WHERE kind = 'deep' AND status = 'F' AND contains(lower(title), 'urgent f')) "
        + page("f", "execution_id, city_id, suite", "kind, execution_id", 30, 30),
    "search_packs": f"WITH {EXECUTIONS}, f AS (SELECT * FROM executions WHERE kind <> 'standard' AND status = 'O' AND contains(lower(title), 'high')) "
        + page("f", "execution_id, city_id, kind", "execution_id", 100, following=False),
    "search_sources": """WITH f AS (SELECT source AS source_id, doc_id AS artifact_id, 'Publisher ' || upper(lang) AS publisher FROM documents
        WHERE lang = 'fr' AND source LIKE '%src1%') """ + page("f", "source_id, artifact_id, publisher", "source_id, artifact_id", 50),
    "search_designs": f"""WITH {DESIGNS}, f AS (SELECT * FROM designs WHERE status = 'design-only' AND
        contains(trim(regexp_replace(lower(design_id || ' ' || title || ' ' || question || ' ' || family_id || ' ' || suite || ' kind-' || (p_size % 8) || ' ' || status), '[^a-z0-9]+', ' ', 'g')), 'brand 1 promo')) """
        + page("f", "design_id, family_id", "design_id", 60, following=False),
    "search_families": """WITH f AS (SELECT p_brand AS family_id, min(p_name) AS title FROM part GROUP BY 1 HAVING lower(p_brand) LIKE 'brand#2%'
          OR contains(regexp_replace(lower(min(p_name)), '[^a-z0-9]+', ' ', 'g'), 'brand 2')) """
        + page("f", "family_id, title", "family_id", 10, following=False),
    "city_lookup": f"""WITH {TIERS} SELECT CAST(city_id AS VARCHAR) AS city_id, name, tier, true AS found FROM tiers WHERE city_id = 17
        UNION ALL SELECT 'no-such-city', NULL, NULL, false""",
    "city_detail": f"""WITH {TIERS} SELECT '17' AS city_id, name, tier, true AS found,
        CASE WHEN (SELECT count(*) FROM events WHERE user_id = 17) > 0 THEN
          'climate.precipitation-total|climate.relative-humidity-mean|climate.t2m-max-maximum|climate.t2m-mean|climate.wind-speed-mean' END AS metrics,
        (SELECT string_agg(p, '|' ORDER BY p) FROM (SELECT DISTINCT o_orderpriority AS p FROM orders WHERE o_custkey = 17)) AS capabilities,
        (SELECT count(*) FROM orders WHERE o_custkey = 17) AS source_count FROM tiers WHERE city_id = 17""",
    "library_overview": f"""WITH {DESIGNS} SELECT suite, count(*) AS designs, count(DISTINCT family_id) AS families,
        count(*) FILTER (status = 'reference-implemented') AS implemented, (SELECT count(DISTINCT p_brand) FROM part) AS library_families FROM designs GROUP BY 1""",
    "geographies": f"""WITH {CITY} SELECT DISTINCT 'country.' || lower(country_code) AS geography_id, 'country' AS kind, country_code AS name, CAST(NULL AS VARCHAR) AS parent_id FROM cities
        UNION ALL SELECT CAST(city_id AS VARCHAR), 'city', name, 'country.' || lower(country_code) FROM cities""",
    "seed_graph": f"""WITH {CITY} SELECT DISTINCT 'node.country.' || lower(country_code) AS id, 'country' AS kind, 'node' AS element FROM cities
        UNION ALL SELECT 'node.' || city_id, 'city', 'node' FROM cities UNION ALL SELECT 'edge.' || city_id || '.located-in', 'located-in', 'edge' FROM cities""",
    "graph_violations": """WITH e AS (SELECT 'e' || (o_orderkey % 14990) AS id, o_custkey AS s, o_custkey + 700 AS t, o_orderpriority AS p FROM orders)
        SELECT 'duplicate edge id' AS relation, count(*) AS references, CAST(sum(n) AS BIGINT) AS rows FROM (SELECT id, count(*) AS n FROM e GROUP BY 1 HAVING count(*) > 1) HAVING count(*) > 0
        UNION ALL SELECT 'edge evidence type not allowed', count(*), count(*) FROM e WHERE p = '1-URGENT' HAVING count(*) > 0
        UNION ALL SELECT 'edge source does not exist', count(DISTINCT s), count(*) FROM e WHERE s NOT IN (SELECT c_custkey FROM customer) HAVING count(*) > 0
        UNION ALL SELECT 'edge target does not exist', count(DISTINCT t), count(*) FROM e WHERE t NOT IN (SELECT c_custkey FROM customer) HAVING count(*) > 0""",
    "bundle_violations": """WITH g AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal > 0)
        SELECT 'observation geography' AS relation, count(DISTINCT l_suppkey) AS references, count(*) AS rows FROM lineitem WHERE l_suppkey NOT IN (SELECT id FROM g) HAVING count(*) > 0
        UNION ALL SELECT 'observation measure', count(DISTINCT l_partkey), count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part) HAVING count(*) > 0
        UNION ALL SELECT 'facility geography', count(DISTINCT s_suppkey), count(*) FROM supplier WHERE s_suppkey NOT IN (SELECT id FROM g) HAVING count(*) > 0
        UNION ALL SELECT 'event geography', count(DISTINCT o_custkey), count(*) FROM orders WHERE o_custkey NOT IN (SELECT id FROM g) HAVING count(*) > 0""",
    "observation_violations": """SELECT issue, count(*) AS rows FROM (
        SELECT unnest([CASE WHEN l_returnflag NOT IN ('A', 'N') THEN 'evidence type not allowed' END,
          CASE WHEN l_returnflag = 'A' AND l_tax > 0.04 THEN 'estimated observations require a method' END,
          CASE WHEN l_quantity > 40 THEN 'value lies outside the measure range' END,
          CASE WHEN l_linenumber <= 1 THEN 'interval start must precede its end' END]) AS issue FROM lineitem) WHERE issue IS NOT NULL GROUP BY 1""",
    "token_sets": f"WITH {TOKENS} SELECT doc_id, CAST(len(tokens) AS BIGINT) AS tokens FROM tok",
    "duplicate_groups": f"SELECT min(doc_id) AS first_id, count(*) AS members FROM documents GROUP BY {NORM} HAVING count(*) > 1",
    "duplicate_members": f"""SELECT first_id, doc_id, members FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY {NORM}) AS first_id,
        count(*) OVER (PARTITION BY {NORM}) AS members FROM documents) WHERE members > 1""",
    "similar_pairs": f"WITH {CLASSES} SELECT first_a, first_b, similarity, shared_terms, row_pairs FROM high",
    "similarity_totals": f"""WITH {ALL_PAIRS} SELECT (SELECT count(*) FROM documents) AS rows, (SELECT count(*) FROM classes) AS token_sets,
        CAST((SELECT sum(CASE WHEN size > 0 THEN members * (members - 1) / 2 ELSE 0 END) FROM classes) + coalesce((SELECT sum(row_pairs) FROM high), 0) AS BIGINT) AS high_similarity_pairs,
        CASE WHEN (SELECT max(members) FROM classes WHERE size > 0) > 1 THEN 1.0 ELSE coalesce((SELECT max(similarity) FROM pairs), 0) END AS maximum_similarity""",
    "closest_pairs": f"""WITH {ALL_PAIRS}, m AS (SELECT doc_id, first_id, size FROM tok JOIN classes USING (tokens)),
        every AS (SELECT a.doc_id AS id_a, b.doc_id AS id_b, CAST(1.0 AS DOUBLE) AS similarity FROM m a JOIN m b ON a.first_id = b.first_id AND a.doc_id < b.doc_id AND a.size > 0
          UNION ALL SELECT least(a.doc_id, b.doc_id), greatest(a.doc_id, b.doc_id), similarity FROM pairs JOIN m a ON a.first_id = first_a JOIN m b ON b.first_id = first_b)
        SELECT id_a, id_b, similarity FROM every ORDER BY similarity DESC, id_a, id_b LIMIT 20""",
    "closest_sets": f"""WITH {ALL_PAIRS} SELECT first_a, first_b, similarity, shared_terms, row_pairs FROM pairs
        ORDER BY similarity DESC, first_a, first_b LIMIT 2000""",
    "signature_collisions": "SELECT min(p_partkey) AS first_id, count(*) AS members FROM part GROUP BY p_brand, p_type, p_size HAVING count(*) > 1",
    "completeness": """SELECT 'question' AS rule, count(*) FILTER (len(p_type || '-' || p_size) > 8) AS satisfied, count(*) AS rows,
          count(*) FILTER (len(p_type || '-' || p_size) > 8) = count(*) AS complete FROM part
        UNION ALL SELECT 'family', count(*), count(*), true FROM part""",
    "library_audit": f"""WITH {DESIGNS}, c AS (SELECT count(*) AS n FROM (SELECT 1 FROM designs GROUP BY family_id, suite, question HAVING count(*) > 1)),
        t AS (SELECT count(*) AS n FROM (SELECT 1 FROM designs GROUP BY lower(title) HAVING count(*) > 1))
        SELECT CAST(4 AS BIGINT) AS failed_checks, false AS audit_passed,
          'duplicate-title=' || t.n || ';incomplete-rules=1;signature-collisions=' || c.n AS failures FROM c, t""",
    "artifact_set_hash": f"""WITH {set_tree("SELECT source AS g, doc_id || '=' || md5(text) AS line FROM documents")}
        SELECT g AS source, artifacts, 'sha256:' || hash AS set_hash FROM root""",
    "catalog_fingerprint": f"""WITH {set_tree("""
          SELECT 'nations' AS g, '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}' AS line FROM nation
          UNION ALL SELECT 'regions', '{"r_name":"' || r_name || '","r_regionkey":' || r_regionkey || '}' FROM region
          UNION ALL SELECT 'orders', '{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}' FROM orders""")},
        parts AS (SELECT g, hash, artifacts FROM root UNION ALL SELECT 'none', '', 0)
        SELECT count(*) AS inputs, CAST(sum(artifacts) AS BIGINT) AS rows,
          'sha256:' || sha256(string_agg(g || '=' || hash, ',' ORDER BY g)) AS fingerprint FROM parts""",
    "differing_ranges": """WITH o AS (SELECT o_orderpriority, o_orderkey >> 6 AS slot, o_orderkey % 1999 = 7 AS gone, o_orderkey % 997 = 5 AND o_orderstatus <> 'X' AS changed FROM orders)
        SELECT o_orderpriority, slot, count(*) AS left_rows, count(*) FILTER (NOT gone) AS right_rows
        FROM o GROUP BY 1, 2 HAVING bool_or(gone OR changed)""",
    "forbidden_literals": """WITH r(rule_id, literal) AS (VALUES ('html-tag', '<'), ('license', 'Licensed under'), ('guarantee', 'guaranteed impact'), ('the-word', ' the '))
        SELECT rule_id, count(doc_id) AS documents, min(doc_id) AS first_document, count(doc_id) = 0 AS passed
        FROM r LEFT JOIN documents ON contains(text, literal) GROUP BY 1""",
    "required_phrases": """SELECT 'r' || l.doc_id AS rule_id, l.doc_id AS document,
        coalesce(contains(text, CASE WHEN quality = 1 THEN ' the ' ELSE ' und ' END), false) AS passed FROM labels l LEFT JOIN documents d ON l.doc_id = d.doc_id""",
    "claim_values": """WITH c AS (SELECT event_id, event_type, CAST(props::JSON->>'k' AS BIGINT) AS k FROM events)
        SELECT event_id AS claim_id, CASE event_type WHEN 'view' THEN 'choose-two' WHEN 'click' THEN 'count' ELSE 'single' END AS operation,
          CASE event_type WHEN 'view' THEN CAST(k * (k - 1) // 2 AS VARCHAR) WHEN 'click' THEN '1' WHEN 'signup' THEN CAST(k + 1 AS VARCHAR) ELSE CAST(k AS VARCHAR) END AS expected,
          CASE event_type WHEN 'view' THEN CAST(k * (k - 1) // 2 AS VARCHAR) WHEN 'click' THEN '1' WHEN 'error' THEN NULL ELSE CAST(k AS VARCHAR) END AS value,
          event_type NOT IN ('error', 'signup') AS passed,
          CASE event_type WHEN 'error' THEN 'JSON pointer component is absent' WHEN 'signup' THEN 'resolved value differs from the expected value' END AS reason FROM c""",
    "claim_renderings": """WITH c AS (SELECT event_id, event_type, CAST(props::JSON->>'k' AS BIGINT) AS k FROM events)
        SELECT event_id || ':rendering-1' AS check, event_id AS document, CASE event_type WHEN 'view' THEN k * (k - 1) // 2 = k WHEN 'click' THEN k = 1 ELSE true END AS passed
        FROM c WHERE event_type <> 'error'""",
    "audit_summary": """SELECT CASE event_type WHEN 'view' THEN 'choose-two' WHEN 'click' THEN 'count' ELSE 'single' END AS operation, count(*) AS checks_total,
        count(*) FILTER (event_type NOT IN ('error', 'signup')) AS checks_passed, count(*) FILTER (event_type IN ('error', 'signup')) AS checks_failed FROM events GROUP BY 1""",
    "canonical_documents": """WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice * (1 - l_discount) AS net FROM lineitem),
        d AS (SELECT l_orderkey, CAST(CAST(printf('%.11e', sum(net)) AS DOUBLE) AS VARCHAR) AS total,
          string_agg('{"line":' || l_linenumber || ',"net":' || CAST(CAST(printf('%.11e', net) AS DOUBLE) AS VARCHAR) || ',"part":' || l_partkey || '}', ','
            ORDER BY l_linenumber, l_partkey, net) AS lines FROM l GROUP BY 1),
        j AS (SELECT o_orderkey, '{' || coalesce('"lines":[' || lines || '],', '') || '"o_orderkey":' || o_orderkey || ',"order":{"day":"' || CAST(o_orderdate AS DATE)
          || CASE WHEN o_orderpriority <> '5-LOW' THEN '","priority":"' || o_orderpriority ELSE '' END || '","status":"' || o_orderstatus || '"}'
          || coalesce(',"total":' || total, '') || '}' AS document FROM orders LEFT JOIN d ON o_orderkey = l_orderkey)
        SELECT o_orderkey, document, 'sha256:' || sha256(document) AS content_hash FROM j""",
    "canonical_variants": """SELECT event_id, '{"v":{"at":[null,{"seventh":' || CASE WHEN seventh = floor(seventh) THEN CAST(CAST(seventh AS BIGINT) AS VARCHAR) ELSE CAST(seventh AS VARCHAR) END || '}],"props":' || replace(props, ' ', '') || '}}' AS document
        FROM (SELECT *, CAST(printf('%.11e', value / 7) AS DOUBLE) AS seventh FROM events WHERE value IS NOT NULL AND props IS NOT NULL)""",
    "content_hash": """SELECT c_custkey, 'sha256:' || sha256('{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","n_name":"' || n_name || '"}') AS content_hash,
        substr(sha256(c_custkey || '/' || n_name), 1, 12) AS short_key, CAST('0x' || substr(sha256(c_custkey || '/' || n_name), 1, 8) AS BIGINT) AS seed
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "scalar_rules": """SELECT c_custkey, round(greatest(-180, c_acctbal / 50 - 0.5), 6) AS west, round(least(90, c_acctbal / 120 + 0.5), 6) AS north,
        round((greatest(-90, c_acctbal / 120 - 0.5) + least(90, c_acctbal / 120 + 0.5)) / 2, 6) AS centre_latitude,
        CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_mktsegment END AS code,
        trim(regexp_replace(lower(c_name || '-#' || c_mktsegment), '[^a-z0-9]+', ' ', 'g')) AS search_key,
        least(5000.0::DOUBLE, greatest(0.0::DOUBLE, c_acctbal)) AS clamped, CAST(printf('%.11e', c_acctbal / 7) AS DOUBLE) + 0 AS portable,
        regexp_replace(regexp_replace(printf('%.6f', round(c_acctbal, 2)), '0+$', ''), '\\.$', '') AS text,
        CASE WHEN c_custkey % 3 = 0 THEN '(missing)' ELSE c_mktsegment END AS label FROM customer""",
    "missing_labels": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)",
    "demand_points": """SELECT 'area-' || c_nationkey AS area_id, CAST(c_custkey AS VARCHAR) AS id, CAST(c_custkey % 60 AS DOUBLE) AS latitude,
        CAST(c_custkey % 170 AS DOUBLE) AS longitude, CAST(floor(abs(c_acctbal)) AS BIGINT) AS population,
        round(floor(abs(c_acctbal)) * CAST(c_custkey * 13 % 101 AS DOUBLE) / 100, 6) AS need, CAST(c_custkey * 13 % 101 AS DOUBLE) AS rate
        FROM customer WHERE c_acctbal >= 0""",
    # summer time of New York as ruled from 1987 to 2006: first Sunday of April to last Sunday of October, at two o'clock
    "local_time": """WITH d AS (SELECT o_orderkey, o_orderkey % 3 AS zone, CAST(o_orderdate AS DATE) AS day, make_date(year(o_orderdate), 4, 1) AS april,
          make_date(year(o_orderdate), 10, 31) AS october FROM orders),
        r AS (SELECT *, april + CAST((7 - dayofweek(april)) % 7 AS INTEGER) AS starts, october - CAST(dayofweek(october) AS INTEGER) AS ends,
          date_diff('day', DATE '1970-01-01', day) * 86400 AS utc FROM d)
        SELECT o_orderkey, CAST(utc + CASE zone WHEN 0 THEN CASE WHEN day > starts AND day <= ends THEN 14400 ELSE 18000 END WHEN 1 THEN -32400 ELSE 0 END AS BIGINT) AS midnight,
          CAST((utc + 86400 + CASE zone WHEN 0 THEN CASE WHEN day >= starts AND day < ends THEN 14400 ELSE 18000 END WHEN 1 THEN -32400 ELSE 0 END) * 1000000 - 1 AS BIGINT) AS cutoff FROM r""",
}
ORACLES |= {f"indexed_{name}": ORACLES[f"search_{name}"] for name in ("cities", "scenarios", "packs", "sources", "designs", "families")}
