"""SQL over the given tables for the logical tables that the oracles share, as common table expressions."""

NODES = """nodes AS (
  SELECT p_partkey + 1 AS node_id, substr(repeat(translate(lpad(p_partkey::VARCHAR, 9, '0'), '0123456789', 'ACGTTGCAAC'), 2), 1, (1 + p_size % 17)::INT) AS seq FROM part)"""

REFERENCE_WALK = """reference_walk AS (
  SELECT p_brand AS contig, p_partkey AS ord, (p_partkey + 1) * 2 AS handle, p_partkey + 1 AS node_id, (1 + p_size % 17)::BIGINT AS seq_len,
         (100 * length(p_brand) + 7)::BIGINT AS path_start FROM part)"""

VISITS = """visits AS (
  SELECT contig, ord, handle, node_id, seq_len,
         (path_start + sum(seq_len) OVER (PARTITION BY contig ORDER BY ord) - seq_len)::BIGINT AS s,
         (path_start + sum(seq_len) OVER (PARTITION BY contig ORDER BY ord))::BIGINT AS e FROM reference_walk)"""

MANIFESTS = """manifests AS (
  SELECT row_number() OVER (ORDER BY contig)::BIGINT AS manifest_id, 'REF' AS sample, contig, s, e, 64::BIGINT AS window_size, 2048::BIGINT AS bucket_span
  FROM (SELECT contig, min(path_start) AS s, (min(path_start) + sum(seq_len))::BIGINT AS e FROM reference_walk GROUP BY contig))"""

TILES = """tiles AS (
  SELECT *, (w - grid) // 64 AS tile_index, (w - grid) // 2048 AS bucket_id, greatest(s, w) AS core_start, least(e, w + 64) AS core_end
  FROM (SELECT *, (s // 64) * 64 AS grid, unnest(range((s // 64) * 64, e, 64)) AS w FROM manifests))"""

STORED = """held AS (
  SELECT t.manifest_id, t.bucket_id, t.tile_index, t.core_start, t.core_end, count(*) AS node_records, sum(v.seq_len)::BIGINT AS bases
  FROM tiles t JOIN visits v ON t.contig = v.contig AND v.s < t.core_end AND v.e > t.core_start GROUP BY ALL),
stored AS (
  SELECT *, 128 + 16 * node_records + bases AS ulen, (128 + 16 * node_records + bases) // 3 + 20 AS clen,
         (manifest_id * 1000000 + (tile_index // 2) * 1000)::BIGINT AS payload_offset FROM held)"""

QUERIES = """region_queries AS (
  SELECT query_id, 'REF' AS sample, contig, (s + query_id * 7919 % (e - s))::BIGINT AS q_start, (s + query_id * 7919 % (e - s) + 1 + query_id * 13 % 200)::BIGINT AS q_end
  FROM (SELECT s_suppkey AS query_id, 'Brand#' || (s_suppkey % 25 + 1)::VARCHAR AS contig FROM supplier) JOIN manifests USING (contig))"""

SELECTED = """selected AS (
  SELECT q.*, m.manifest_id, m.s, m.e FROM region_queries q JOIN manifests m ON q.sample = m.sample AND q.contig = m.contig AND m.s < q.q_end AND m.e > q.q_start)"""

FOUND = """found AS (
  SELECT q.query_id, t.* FROM selected q JOIN stored t ON q.manifest_id = t.manifest_id AND t.core_start < q.q_end AND t.core_end > q.q_start)"""

REFERENCE = ", ".join((REFERENCE_WALK, VISITS, MANIFESTS, TILES))
ARCHIVE = ", ".join((REFERENCE, STORED, QUERIES, SELECTED, FOUND))

ORDER_WALKS = """order_walks AS (
  SELECT l_orderkey AS path_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ord,
         (l_partkey + 1) * 2 + CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS handle, l_partkey + 1 AS node_id FROM lineitem)"""

HAPLOTYPES = """placed AS (SELECT contig, ord, node_id, row_number() OVER (PARTITION BY contig ORDER BY ord) - 1 AS place, count(*) OVER (PARTITION BY contig) AS length FROM reference_walk),
lines AS (
  SELECT l_orderkey AS path_id, row_number() OVER w AS ord, first_value(l_partkey) OVER w AS anchor, l_quantity::BIGINT % 7 = 0 AS turned,
         CASE WHEN row_number() OVER w = 1 THEN 0 ELSE 1 + (l_partkey + l_suppkey) % 3 END AS step
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)),
moved AS (SELECT *, sum(step) OVER (PARTITION BY path_id ORDER BY ord) AS shift FROM lines),
haplotypes AS (
  SELECT m.path_id, m.ord, p.node_id * 2 + CASE WHEN m.turned THEN 1 ELSE 0 END AS handle, p.node_id
  FROM moved m JOIN placed a ON a.ord = m.anchor JOIN placed p ON p.contig = a.contig AND p.place = (a.place + m.shift) % a.length)"""

EVENT_VISITS = """event_visits AS (
  SELECT epoch_us(ts) // 21600000000 AS tile_id, user_id AS path_id,
         row_number() OVER (PARTITION BY user_id, epoch_us(ts) // 21600000000 ORDER BY ts, event_id) AS ord,
         list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type)::BIGINT * 2 + event_id % 2 AS handle
  FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)"""

EVENT_WALKS = """event_walks AS (
  SELECT tile_id, path_id, list(handle ORDER BY ord) AS walk FROM event_visits GROUP BY tile_id, path_id)"""

_EDGE = "CASE WHEN {a} % 2 = 1 THEN {b} // 2 > {a} // 2 OR ({b} // 2 = {a} // 2 AND {b} % 2 = 0) ELSE {b} // 2 >= {a} // 2 END"


def canonical_edge(a: str, b: str) -> str:
    return f"({_EDGE.format(a=a, b=b)})"


STRANDS = f"""strands AS (
  SELECT tile_id, path_id, false AS is_reversed, walk FROM event_walks
  UNION ALL SELECT tile_id, path_id, true, list_transform(list_reverse(walk), lambda h: xor(h, 1::BIGINT)) FROM event_walks),
canonical AS (
  SELECT * FROM strands
  WHERE CASE WHEN walk[1] % 2 = walk[len(walk)] % 2 THEN walk[1] % 2 = 0 ELSE {canonical_edge("walk[1]", "walk[len(walk)]")} END)"""

WEIGHTED = "weighted AS (SELECT tile_id, walk, count(*) AS weight FROM canonical GROUP BY tile_id, walk)"
EVENT_GROUPS = ", ".join((EVENT_VISITS, EVENT_WALKS, STRANDS, WEIGHTED))
WALK_TEXT = "array_to_string(list_transform(walk, lambda h: h::VARCHAR), ',')"

PATHS = """paths AS (
  SELECT o_orderkey AS path_id, n_name || '#' || left(o_orderpriority, 1) || '#' || c_mktsegment || CASE WHEN o_custkey % 7 <> 0 THEN '#fragment=' || (o_custkey % 7)::VARCHAR ELSE '' END AS canonical_name,
         n_name AS sample, c_mktsegment AS contig, left(o_orderpriority, 1)::BIGINT AS haplotype, o_custkey % 7 AS fragment
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""

READS = "reads AS (SELECT l_suppkey AS key, l_partkey * 64 AS s, l_partkey * 64 + l_quantity::BIGINT * 8 AS e FROM lineitem)"


def islands(table: str, key: str, gap: int, name: str = "islands") -> str:
    return f"""{name} AS (
  SELECT *, sum(opens) OVER (PARTITION BY {key} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT *, CASE WHEN max(e) OVER w IS NULL OR s > max(e) OVER w + {gap} THEN 1 ELSE 0 END AS opens FROM {table}
    WINDOW w AS (PARTITION BY {key} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))"""


def merged(key: str, source: str = "islands", name: str = "merged") -> str:
    return f"{name} AS (SELECT {key}, min(s) AS s, max(e) AS e, count(*) AS members FROM {source} GROUP BY {key}, island)"


def chosen_levels(most: int) -> str:
    """The level of each manifest of a view, from series(view, manifest_id, level, bins): coarsen what saves most while there are too many bins."""
    return f"""finest AS (SELECT view, list({{'m': manifest_id, 'l': 0}} ORDER BY manifest_id) AS chosen FROM series WHERE level = 0 GROUP BY view),
saved AS (SELECT a.view, a.manifest_id, a.level, a.bins - b.bins AS saves FROM series a JOIN series b ON b.view = a.view AND b.manifest_id = a.manifest_id AND b.level = a.level + 1),
state AS (SELECT view, chosen, 0 AS step FROM finest
  UNION ALL SELECT s.view, list_transform(s.chosen, lambda c: {{'m': c.m, 'l': c.l + CASE WHEN c.m = w.manifest_id THEN 1 ELSE 0 END}}), s.step + 1
  FROM state s, LATERAL (SELECT x.manifest_id FROM saved x WHERE x.view = s.view AND list_contains(s.chosen, {{'m': x.manifest_id, 'l': x.level}}) AND x.saves > 0 ORDER BY x.saves DESC, x.manifest_id LIMIT 1) w
  WHERE (SELECT sum(y.bins) FROM series y WHERE y.view = s.view AND list_contains(s.chosen, {{'m': y.manifest_id, 'l': y.level}})) > {most})
SELECT view, c.m AS manifest_id, c.l::INT AS level FROM (SELECT view, unnest(chosen) AS c FROM (SELECT *, row_number() OVER (PARTITION BY view ORDER BY step DESC) AS r FROM state) WHERE r = 1)"""


def tree_digest(source: str, keys: str, order: str, content: str, name: str, levels: int = 3) -> str:
    """Common table expressions of a hash tree over the rows of each key; the last is `name` (keys, digest)."""
    steps = [f"{name}_0 AS (SELECT {keys}, {order} AS pos, sha256('leaf:' || {content}) AS h FROM {source})"]
    for level in range(1, levels + 1):
        steps.append(f"{name}_{level} AS (SELECT {keys}, pos // 256 AS pos, sha256('node {level}:' || count(*) || ':' || string_agg(h, ',' ORDER BY {name}_{level - 1}.pos, h)) AS h FROM {name}_{level - 1} GROUP BY {keys}, {name}_{level - 1}.pos // 256)")
    steps.append(f"{name} AS (SELECT {keys}, sha256('top:' || count(*) || ':' || string_agg(h, ',' ORDER BY pos, h)) AS digest FROM {name}_{levels} GROUP BY {keys})")
    return ", ".join(steps)
