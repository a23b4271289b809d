"""SQL counterparts of the queries, for a second engine on the same tables.

Distances on the unit lattice have a closed form, so the SQL never follows the
path operators it checks.
"""

from __future__ import annotations

SQL: dict[str, str] = {}

NODES = "nodes AS (SELECT p_partkey AS id, p_partkey // 40 AS r, p_partkey % 40 AS c, p_size AS size FROM part)"
HITS = "hits AS (SELECT l_orderkey AS shot, l_partkey AS det FROM lineitem GROUP BY 1, 2 HAVING count(*) % 2 = 1)"
PLACED = (
    "placed AS (SELECT shot, det, det // 40 AS r, det % 40 AS c, 2 * (least(det % 40, 39 - det % 40) + 1) AS rim FROM hits)"
)
PAIRS = (
    "pairs AS (SELECT a.shot, a.det AS u, b.det AS v, 2 * (abs(a.r - b.r) + abs(a.c - b.c)) AS d, a.rim AS rim_u, b.rim AS rim_v "
    "FROM placed a JOIN placed b ON a.shot = b.shot AND a.det < b.det)"
)
STEPS = (
    "steps AS (SELECT a.id AS u, b.id AS v, a.size AS su, b.size AS sv, a.id * 4 AS ord FROM nodes a JOIN nodes b ON b.id = a.id + 1 WHERE a.c < 39 "
    "UNION ALL SELECT a.id, b.id, a.size, b.size, a.id * 4 + 1 FROM nodes a JOIN nodes b ON b.id = a.id + 40)"
)
NOISY = (
    "noisy AS (SELECT u, v, (su + sv) / 1000.0::DOUBLE AS p, -1 AS obs, ord FROM steps "
    "UNION ALL SELECT id, NULL, size / 500.0::DOUBLE, 0, id * 4 + 2 FROM nodes WHERE c = 0 "
    "UNION ALL SELECT id, NULL, size / 500.0::DOUBLE, -1, id * 4 + 3 FROM nodes WHERE c = 39), "
    "weighted AS (SELECT *, ln((1 - p) / p) AS w FROM noisy), "
    "scaled AS (SELECT *, (round(w * (SELECT 16777215.0::DOUBLE / max(abs(w)) FROM weighted)) * 2)::BIGINT AS dw FROM weighted)"
)
LOG = (
    "log AS (SELECT user_id AS shot, ((day(ts) - 1) // 5)::BIGINT AS level, event_type AS cluster, event_id AS seq, "
    "((hour(ts) * 3600 + minute(ts) * 60 + second(ts)) % 3600 + ((day(ts) - 1) // 5) * 900)::BIGINT AS t FROM events)"
)
COSTS = (
    LOG + ", stops AS (SELECT shot, level, max(t) AS stop FROM log GROUP BY 1, 2), "
    "cut AS (SELECT shot, level, max(stop) OVER (PARTITION BY shot ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cutoff FROM stops), "
    "costs AS (SELECT shot, level, cluster, count(*) AS n, max(t) AS stop, count(*) FILTER (WHERE cutoff IS NOT NULL AND t <= cutoff) AS before, "
    "count(*) FILTER (WHERE cutoff IS NULL OR t > cutoff) AS after FROM log JOIN cut USING (shot, level) GROUP BY 1, 2, 3)"
)
# The fold over levels, one level at a time.
FOLD = (
    COSTS + ", numbered AS (SELECT *, row_number() OVER (PARTITION BY shot ORDER BY level) AS k FROM stops), "
    "fold(shot, k, level, critical, stop) AS (SELECT shot, 0, CAST(-1 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM (SELECT DISTINCT shot FROM log) "
    "UNION ALL SELECT f.shot, f.k + 1, n.level, greatest(f.critical, (SELECT max(greatest(f.critical, c.before) + c.after) FROM costs c WHERE c.shot = f.shot AND c.level = n.level))::BIGINT, "
    "greatest(f.stop, n.stop) FROM fold f JOIN numbered n ON n.shot = f.shot AND n.k = f.k + 1)"
)
MULTI = (
    "multi AS (SELECT least(l_suppkey, l_partkey % 100) AS u, greatest(l_suppkey, l_partkey % 100) AS v, l_discount AS p, "
    "ln((1 - l_discount) / l_discount) AS w, l_linenumber - 1 AS obs, "
    "row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount) AS ord FROM lineitem WHERE l_discount > 0)"
)


def chained(bound: int, source: str = "placed", name: str = "chain") -> str:
    """CTEs giving (shot, det, root) of the threshold components of ``source``."""
    return (
        f"{name}_near AS (SELECT a.shot, a.det AS x, b.det AS y FROM {source} a JOIN {source} b ON a.shot = b.shot AND a.det <> b.det "
        f"WHERE 2 * (abs(a.r - b.r) + abs(a.c - b.c)) <= {bound}), "
        f"{name}_reach(shot, det, other) AS (SELECT shot, det, det FROM {source} UNION SELECT k.shot, k.det, n.y FROM {name}_reach k JOIN {name}_near n ON n.shot = k.shot AND n.x = k.other), "
        f"{name} AS (SELECT shot, det, min(other) AS root FROM {name}_reach GROUP BY 1, 2)"
    )


def with_(*parts: str) -> str:
    return "WITH RECURSIVE " + ", ".join(parts) + " "


# Levels 1 and 2 of the unit lattice; the second buffer covers the graph. Left-over hits form one root.
LEVEL1 = (
    chained(10) + ", sized AS (SELECT k.shot, k.root, count(*) AS size, min(p.rim) AS near_rim, max(p.rim) AS far_rim FROM chain k JOIN placed p USING (shot, det) GROUP BY 1, 2), "
    "spread AS (SELECT a.shot, a.root, max(p.d) AS diameter FROM pairs p JOIN chain a ON a.shot = p.shot AND a.det = p.u JOIN chain b ON b.shot = p.shot AND b.det = p.v AND b.root = a.root GROUP BY 1, 2), "
    "judged AS (SELECT s.shot, s.root, s.size, coalesce(x.diameter, 0) AS diameter, near_rim, far_rim, coalesce(x.diameter, 0) <= 3 AND (s.size % 2 = 0 OR far_rim <= 3) AS accepted FROM sized s LEFT JOIN spread x USING (shot, root))"
)
LEVELS = (
    LEVEL1 + ", taken1 AS (SELECT k.shot, 1 AS level, k.root, k.det, j.size, j.diameter FROM chain k JOIN judged j USING (shot, root) WHERE j.accepted), "
    "left1 AS (SELECT * FROM placed p WHERE NOT EXISTS (SELECT 1 FROM taken1 t WHERE t.shot = p.shot AND t.det = p.det)), "
    "whole AS (SELECT shot, min(det) AS root, count(*) AS size, max(rim) AS far_rim FROM left1 GROUP BY 1), "
    "wide AS (SELECT a.shot, max(2 * (abs(a.r - b.r) + abs(a.c - b.c))) AS diameter FROM left1 a JOIN left1 b ON a.shot = b.shot GROUP BY 1), "
    "taken2 AS (SELECT l.shot, 2 AS level, w.root, l.det, w.size, x.diameter FROM left1 l JOIN whole w USING (shot) JOIN wide x USING (shot) WHERE x.diameter <= 53 AND (w.size % 2 = 0 OR w.far_rim <= 53)), "
    "rest AS (SELECT * FROM left1 p WHERE NOT EXISTS (SELECT 1 FROM taken2 t WHERE t.shot = p.shot AND t.det = p.det)), "
    "members AS (SELECT shot, level, root, det, size, diameter, false AS forced FROM (SELECT * FROM taken1 UNION ALL SELECT * FROM taken2) "
    "UNION ALL SELECT r.shot, CASE WHEN EXISTS (SELECT 1 FROM taken1 t WHERE t.shot = r.shot) THEN 2 ELSE 1 END, m.root, r.det, m.size, NULL, true FROM rest r JOIN (SELECT shot, min(det) AS root, count(*) AS size FROM rest GROUP BY 1) m USING (shot))"
)



def levelled(levels: list[tuple[int, int]]) -> str:
    """CTEs ending in ``members`` (shot, level, root, det, size, diameter, forced) for levels (d, b), one after the other."""
    parts, source = [], "placed"
    for k, (d, b) in enumerate(levels, start=1):
        parts += [
            chained(b, source, f"chain{k}"),
            f"sized{k} AS (SELECT c.shot, c.root, count(*) AS size, max(p.rim) AS far_rim FROM chain{k} c JOIN placed p USING (shot, det) GROUP BY 1, 2)",
            f"wide{k} AS (SELECT a.shot, a.root, max(p.d) AS diameter FROM pairs p JOIN chain{k} a ON a.shot = p.shot AND a.det = p.u JOIN chain{k} b ON b.shot = p.shot AND b.det = p.v AND b.root = a.root GROUP BY 1, 2)",
            f"taken{k} AS (SELECT c.shot, {k} AS level, c.root, c.det, s.size, coalesce(w.diameter, 0) AS diameter FROM chain{k} c JOIN sized{k} s USING (shot, root) LEFT JOIN wide{k} w USING (shot, root) "
            f"WHERE coalesce(w.diameter, 0) <= {d} AND (s.size % 2 = 0 OR s.far_rim <= {d}))",
            f"left{k} AS (SELECT * FROM {source} p WHERE NOT EXISTS (SELECT 1 FROM taken{k} t WHERE t.shot = p.shot AND t.det = p.det))",
        ]
        source = f"left{k}"
    every = " UNION ALL ".join(f"SELECT * FROM taken{k}" for k in range(1, len(levels) + 1))
    parts += [
        f"taken AS ({every})",
        f"rest AS (SELECT shot, min(det) OVER (PARTITION BY shot) AS root, det, count(*) OVER (PARTITION BY shot) AS size FROM {source})",
        "members AS (SELECT *, false AS forced FROM taken UNION ALL SELECT r.shot, coalesce(m.level, 0) + 1, r.root, r.det, r.size, NULL, true "
        "FROM rest r LEFT JOIN (SELECT shot, max(level) AS level FROM taken GROUP BY 1) m USING (shot))",
    ]
    return ", ".join(parts)


def pairing(source: str, name: str, steps: int = 20) -> str:
    """CTEs giving (shot, n_hits, weight): the least weight by removing the lowest hit, ``steps`` times.

    ``source`` has shot, det, r, c, rim.
    """
    parts = [
        f"{name}_i AS (SELECT *, (row_number() OVER (PARTITION BY shot ORDER BY det) - 1)::INTEGER AS i FROM {source})",
        f"{name}_p AS (SELECT a.shot, a.i, (1::BIGINT << a.i) AS bits, a.rim AS cost FROM {name}_i a UNION ALL "
        f"SELECT a.shot, a.i, (1::BIGINT << a.i) + (1::BIGINT << b.i), 2 * (abs(a.r - b.r) + abs(a.c - b.c)) FROM {name}_i a JOIN {name}_i b ON a.shot = b.shot AND a.i < b.i)",
        f"{name}_0 AS (SELECT shot, ((1::BIGINT << count(*)::INTEGER) - 1) AS mask, 0::BIGINT AS cost FROM {name}_i GROUP BY 1)",
    ]
    for k in range(steps):
        parts.append(
            f"{name}_{k + 1} AS (SELECT s.shot, s.mask - coalesce(p.bits, 0) AS mask, min(s.cost + coalesce(p.cost, 0))::BIGINT AS cost FROM {name}_{k} s "
            f"LEFT JOIN {name}_p p ON p.shot = s.shot AND s.mask <> 0 AND (s.mask & (-s.mask)) = (1::BIGINT << p.i) AND (s.mask & p.bits) = p.bits GROUP BY 1, 2)"
        )
    parts.append(
        f"{name} AS (SELECT s.shot, n.n_hits, s.cost AS weight FROM {name}_{steps} s JOIN (SELECT shot, count(*) AS n_hits FROM {source} GROUP BY 1) n USING (shot) WHERE s.mask = 0)"
    )
    return ", ".join(parts)


# Edges ---------------------------------------------------------------------

SQL["edge_merge_independent"] = with_(MULTI) + (
    ", g AS (SELECT u, v, product(1 - 2 * p) AS t, arg_min(obs, ord) AS obs, count(*) AS parallel FROM multi GROUP BY 1, 2) "
    "SELECT u, v, round((1 - t) / 2, 9) AS p, round(ln((1 + t) / (1 - t)), 9) AS w, obs::VARCHAR AS obs, parallel FROM g"
).lstrip(" ")
for _key, _order in {"edge_merge_smallest": "w, ord", "edge_merge_keep": "ord", "edge_merge_replace": "ord DESC"}.items():
    SQL[_key] = with_(MULTI) + (
        f"SELECT u, v, round(w, 9) AS w, round(p, 9) AS p, obs::VARCHAR AS obs, count(*) OVER (PARTITION BY u, v) AS parallel "
        f"FROM multi QUALIFY row_number() OVER (PARTITION BY u, v ORDER BY {_order}) = 1"
    )
SQL["edge_merge_disallow_count"] = with_(MULTI) + (
    "SELECT count(*) FILTER (WHERE n > 1) AS n_offending, count(*) AS n_pairs FROM (SELECT count(*) AS n FROM multi GROUP BY u, v)"
)
SQL["edge_weights"] = with_(NODES, STEPS, NOISY) + "SELECT u, v, round(p, 9) AS p, round(w, 9) AS w FROM weighted"
SQL["edge_normaliser"] = with_(NODES, STEPS, NOISY) + (
    "SELECT round(max(abs(w)), 9) AS largest, bool_and(w = round(w)) AS integral, round(16777215.0::DOUBLE / max(abs(w)), 3) AS norm FROM weighted"
)
SQL["edge_discretize"] = with_(NODES, STEPS, NOISY) + (
    "SELECT u, v, abs(dw)::BIGINT AS w, CASE WHEN dw < 0 THEN -1 ELSE 1 END::BIGINT AS sign, CASE WHEN obs = 0 THEN 1 ELSE 0 END::BIGINT AS obs_mask FROM scaled"
)
SQL["boundary_edge_min"] = with_(NODES, STEPS, NOISY) + (
    "SELECT u, v, abs(dw)::BIGINT AS w FROM scaled WHERE v IS NOT NULL AND u % 7 <> 3 AND v % 7 <> 3 UNION ALL "
    "SELECT u, NULL, min(w)::BIGINT FROM (SELECT CASE WHEN u % 7 = 3 THEN v ELSE u END AS u, dw AS w FROM scaled WHERE "
    "(v IS NULL AND u % 7 <> 3) OR (v IS NOT NULL AND (u % 7 = 3) <> (v % 7 = 3))) GROUP BY u"
)
SQL["edge_lookup"] = with_(NODES, STEPS, NOISY) + (
    ", asked AS (SELECT DISTINCT l_partkey + 1 AS a, CASE WHEN l_quantity > 10 THEN l_partkey END AS b FROM lineitem WHERE l_linenumber = 1), "
    "wanted AS (SELECT least(a, coalesce(b, a)) AS u, CASE WHEN b IS NOT NULL THEN greatest(a, b) END AS v FROM asked) "
    "SELECT w.u, w.v, round(e.w, 9) AS w FROM wanted w JOIN weighted e ON e.u = w.u AND e.v IS NOT DISTINCT FROM w.v"
)
SQL["edge_exists"] = with_(NODES, STEPS) + (
    "SELECT DISTINCT l_partkey AS u, l_partkey + l_linenumber AS v FROM lineitem l WHERE EXISTS (SELECT 1 FROM steps s WHERE s.u = l_partkey AND s.v = l_partkey + l_linenumber)"
)
SQL["edge_graph_size"] = with_(MULTI) + "SELECT max(v) + 1 AS num_nodes, (max(obs) + 1)::BIGINT AS num_observables FROM multi"
SQL["max_weight_plus_one"] = with_(NODES, STEPS, NOISY) + "SELECT max(abs(dw))::BIGINT AS w_max, (max(abs(dw)) + 1)::BIGINT AS first_diameter FROM scaled"
_SIGNED = "signed AS (SELECT *, round(p * 1000)::BIGINT % 7 = 0 AS neg FROM scaled)"
SQL["negative_weight_sync"] = with_(NODES, STEPS, NOISY, _SIGNED) + (
    "SELECT (-coalesce(sum(abs(dw)), 0))::BIGINT AS negative_weight, coalesce(bit_xor(CASE WHEN obs = 0 THEN 1 ELSE 0 END), 0)::BIGINT AS negative_mask, count(*) AS negative_edges FROM signed WHERE neg"
)
SQL["negative_toggles"] = with_(NODES, STEPS, NOISY, _SIGNED) + (
    "SELECT id FROM (SELECT u AS id FROM signed WHERE neg UNION ALL SELECT v FROM signed WHERE neg AND v IS NOT NULL) GROUP BY id HAVING count(*) % 2 = 1"
)
SQL["negative_observables"] = with_(NODES, STEPS, NOISY, _SIGNED) + (
    "SELECT (u % 5000)::BIGINT AS obs FROM signed WHERE neg GROUP BY 1 HAVING count(*) % 2 = 1"
)
_PIECES = (
    "raw AS (SELECT l_orderkey AS error, l_suppkey AS u, l_suppkey + 1 + l_partkey % 5 AS v, l_linenumber = 1 AS flag, "
    "'D' || l_suppkey || ' D' || (l_suppkey + 1 + l_partkey % 5) || CASE WHEN l_linenumber = 1 THEN ' L0' ELSE '' END AS body, "
    "min(l_discount) OVER (PARTITION BY l_orderkey) / 3 AS p FROM lineitem), "
    "pieces AS (SELECT error, row_number() OVER (PARTITION BY error ORDER BY body) - 1 AS piece, u, v, p, flag FROM raw WHERE p > 0)"
)
SQL["model_pieces"] = with_(_PIECES) + "SELECT error, piece::BIGINT AS piece, u, v, round(p, 9) AS p, CASE WHEN flag THEN '0' ELSE '' END AS obs FROM pieces"
SQL["model_graph"] = with_(_PIECES) + (
    ", g AS (SELECT u, v, product(1 - 2 * p) AS t, arg_min(flag, (error, piece)) AS flag, count(*) AS parallel FROM pieces GROUP BY 1, 2) "
    "SELECT u, v, round(ln((1 + t) / (1 - t)), 9) AS w, round((1 - t) / 2, 9) AS p, CASE WHEN flag THEN '0' ELSE '' END AS obs, parallel FROM g"
)
SQL["model_edges"] = with_(NODES, STEPS, NOISY) + "SELECT u, v, round(p, 9) AS p, CASE WHEN obs = 0 THEN '0' ELSE '' END AS obs FROM noisy"
_JOINT = (
    _PIECES + ", tied AS (SELECT a.u, a.v, b.u AS other_u, b.v AS other_v, a.p FROM pieces a JOIN pieces b ON a.error = b.error AND a.piece <> b.piece "
    "UNION ALL SELECT u, v, u, v, p FROM pieces), joint AS (SELECT u, v, other_u, other_v, (1 - product(1 - 2 * p)) / 2 AS joint FROM tied GROUP BY 1, 2, 3, 4)"
)
SQL["joint_probability"] = with_(_JOINT) + "SELECT u, v, other_u, other_v, round(joint, 9) AS joint FROM joint"
SQL["implied_weight"] = with_(_JOINT) + (
    ", known AS (SELECT *, max(joint) FILTER (WHERE u = other_u AND v = other_v) OVER (PARTITION BY u, v) AS own FROM joint), "
    "share AS (SELECT u, v, other_u, other_v, least(0.5, joint / own) AS q FROM known WHERE NOT (u = other_u AND v = other_v) AND own <> 0) SELECT u, v, other_u, other_v, round(ln((1 - q) / q), 9) AS w FROM share"
)

# Scalars -------------------------------------------------------------------

SQL["weight_functions"] = (
    "WITH i AS (SELECT DISTINCT l_discount AS p, l_tax AS q FROM lineitem WHERE l_discount > 0 AND l_tax > 0), "
    "x AS (SELECT p, q, p * (1 - q) + q * (1 - p) AS x FROM i) "
    # Flipping the sign of one weight replaces its probability by the complement.
    "SELECT p, q, round(ln((1 - p) / p), 9) AS w, round(x, 9) AS x, "
    "round(ln((1 - (p * q + (1 - p) * (1 - q))) / (p * q + (1 - p) * (1 - q))), 9) AS merged, 1::BIGINT AS valid FROM x"
)
SQL["obs_mask_pack"] = "SELECT l_orderkey AS shot, bit_xor(1::BIGINT << (l_linenumber - 1)) AS obs_mask FROM lineitem GROUP BY 1"
SQL["obs_mask_unpack"] = (
    "WITH m AS (SELECT l_orderkey AS shot, bit_xor(1::BIGINT << (l_linenumber - 1)) AS mask FROM lineitem GROUP BY 1), "
    "b AS (SELECT shot, mask, i, (mask >> i::INTEGER) & 1 AS bit FROM m, range(7) t(i)) "
    "SELECT shot, string_agg(bit::VARCHAR, '' ORDER BY i) AS bits, coalesce(string_agg(i::VARCHAR, ';' ORDER BY i) FILTER (WHERE bit = 1), '') AS set_bits, any_value(mask) AS again FROM b GROUP BY shot"
)
SQL["hits_joined_text"] = (
    "SELECT shot, string_agg(k::VARCHAR, ';' ORDER BY k) AS ids, count(*) AS n_parts FROM (SELECT DISTINCT l_orderkey AS shot, l_partkey AS k FROM lineitem) GROUP BY shot"
)
_POINTS = (
    "points AS (SELECT 'case_r' || d || '_d' || d || '_p' || noise AS \"case\", d AS distance, noise, mode, y, ord FROM (SELECT (year(o_orderdate) - 1995) * 4 + 9 AS d, "
    "substr(o_orderpriority, 1, 1)::INTEGER AS noise, CASE WHEN o_orderstatus = 'F' THEN 'global' ELSE 'parallel_' || lower(o_orderstatus) END AS mode, o_totalprice AS y, o_orderkey AS ord FROM orders))"
)
SQL["name_functions"] = with_(_POINTS) + (
    "SELECT \"case\", distance::BIGINT AS parsed, 'r' || distance || '_d' || distance || '_p' || (noise * 10) AS label, "
    "'case_r' || distance || '_d' || distance || '_p0.00' || (noise * 10) || '_s' || count(*) || '_seed' || (noise + 20) AS file, '0.00' || (noise * 10) AS p4 FROM points GROUP BY \"case\", distance, noise"
)
SQL["number_functions"] = (
    "WITH i AS (SELECT DISTINCT l_orderkey AS k, l_linenumber::BIGINT AS n, l_quantity::BIGINT AS q, l_extendedprice AS x, l_discount AS r FROM lineitem), "
    "y AS (SELECT *, x * r AS y FROM i) SELECT k, n, q, x, r, greatest(n - q, 0)::BIGINT AS less, ((3 * q + 1) // 2)::BIGINT AS scaled, "
    "CASE WHEN abs(y - round(y)) <= greatest(1e-9, abs(y) * 1e-15) THEN round(y) ELSE ceil(y) END::BIGINT AS up, floor(y)::BIGINT AS down, floor(x / 7.0::DOUBLE)::BIGINT + 1 AS above, "
    "round(CASE WHEN q = 0 THEN 0 ELSE q * ln(q) END, 6) AS exponent, "
    "least(q::HUGEINT * 100000000000000000 + 2000000000000000000, 2305843009213693951)::BIGINT AS total, least(q::HUGEINT * 100000000000000000, 2305843009213693951)::BIGINT AS product, "
    "CASE n WHEN 1 THEN q ELSE 0 END::BIGINT AS element, CASE WHEN n > 4 THEN 0 ELSE n END::DOUBLE AS number, "
    "CASE WHEN n <= 4 THEN n ELSE q END::DOUBLE AS first, "
    "CASE n WHEN 1 THEN 'RUNNING' WHEN 2 THEN 'QUIESCENT_STOPPED' WHEN 3 THEN 'DRAINED_WITH_LIVE_ALT_TREE' WHEN 4 THEN 'IMPORTED_INTO_PARENT' ELSE 'UNKNOWN' END AS state FROM y"
)

# Hits, pairs, paths --------------------------------------------------------

SQL["shot_hits_normalized"] = with_(HITS) + "SELECT shot, det FROM hits WHERE det % 50 <> 7"
SQL["shot_slice"] = with_(HITS) + "SELECT shot, det FROM hits WHERE shot IN (SELECT DISTINCT shot FROM hits WHERE shot >= 100 ORDER BY shot LIMIT 500)"
SQL["pair_candidates"] = with_(HITS, PLACED, PAIRS) + "SELECT shot, u, v, d, d // 2 AS time FROM pairs WHERE d <= 40"
SQL["pair_dist_bounded"] = with_(NODES) + (
    "SELECT a.id AS u, b.id AS v, 2 * (abs(a.r - b.r) + abs(a.c - b.c)) AS d FROM nodes a JOIN nodes b ON b.id BETWEEN a.id AND a.id + 328 WHERE 2 * (abs(a.r - b.r) + abs(a.c - b.c)) <= 16"
)
SQL["pair_dist_labels"] = with_(HITS) + (
    ", n AS (SELECT det AS u, lead(det) OVER (PARTITION BY shot ORDER BY det) AS v FROM hits) "
    "SELECT DISTINCT u, v, 2 * (abs(u // 40 - v // 40) + abs(u % 40 - v % 40)) AS d FROM n WHERE v IS NOT NULL"
)
SQL["distance_unit"] = with_(HITS, PLACED, PAIRS) + "SELECT ceil(avg(d))::BIGINT AS unit FROM pairs WHERE d <= 16"
SQL["boundary_dist"] = with_(NODES) + "SELECT id AS node, 2 * (least(c, 39 - c) + 1) AS d, CASE WHEN c < 20 THEN 1 ELSE 0 END::BIGINT AS mask FROM nodes"
SQL["graph_components"] = with_(NODES, STEPS) + (
    ", links AS (SELECT o_custkey AS u, 1000000000 + o_orderkey AS v FROM orders UNION ALL SELECT 2000000000 + u, 2000000000 + v FROM steps), "
    "ends AS (SELECT u AS x, v AS y FROM links UNION ALL SELECT v, u FROM links "
    "UNION ALL SELECT c_custkey, c_custkey FROM customer), "
    "reach(id, other) AS (SELECT x, x FROM ends UNION SELECT r.id, e.y FROM reach r JOIN ends e ON e.x = r.other) SELECT id, min(other) AS comp FROM reach GROUP BY id"
)
SQL["component_span_bounds"] = with_(NODES) + "SELECT 0::BIGINT AS comp, (2 * (max(r) + 39))::BIGINT AS span FROM nodes"
SQL["shortest_path_weight_noisy"] = with_(NODES, STEPS, NOISY) + (
    ", arcs AS (SELECT u, v, dw AS w FROM scaled WHERE v IS NOT NULL UNION ALL SELECT v, u, dw FROM scaled WHERE v IS NOT NULL), "
    "h1 AS (SELECT u, v, w AS d FROM arcs WHERE w <= 40000000), "
    "h2 AS (SELECT h.u, a.v, h.d + a.w AS d FROM h1 h JOIN arcs a ON a.u = h.v WHERE h.d + a.w <= 40000000), "
    "h3 AS (SELECT h.u, a.v, h.d + a.w AS d FROM h2 h JOIN arcs a ON a.u = h.v WHERE h.d + a.w <= 40000000), "
    "h4 AS (SELECT h.u, a.v, h.d + a.w AS d FROM h3 h JOIN arcs a ON a.u = h.v WHERE h.d + a.w <= 40000000) "
    "SELECT u, v, min(d)::BIGINT AS d FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3 UNION ALL SELECT * FROM h4) WHERE u < v GROUP BY 1, 2"
)
SQL["path_edges"] = with_(HITS, PLACED, PAIRS) + (
    "SELECT DISTINCT u, v, d // 2 AS n_edges, u AS first_node, v AS last_node, d // 2 AS n_real FROM pairs WHERE d <= 16"
)
SQL["radius_neighbors"] = with_(NODES) + (
    "SELECT level, a.id AS u, count(*) AS n, sum(b.id)::BIGINT AS v_sum, max(2 * (abs(a.r - b.r) + abs(a.c - b.c))) AS farthest FROM nodes a JOIN nodes b ON b.id BETWEEN a.id - 246 AND a.id + 246 AND a.id <> b.id "
    "JOIN (VALUES (1::BIGINT, 4), (2, 8), (3, 12)) t(level, b) ON 2 * (abs(a.r - b.r) + abs(a.c - b.c)) <= t.b GROUP BY 1, 2"
)

# Clusters ------------------------------------------------------------------

_CHAIN = (HITS, PLACED, PAIRS, chained(16))
SQL["threshold_components"] = with_(*_CHAIN) + "SELECT shot, det, root FROM chain"
_SPREAD = (
    "inner_pairs AS (SELECT a.shot, a.root, p.d FROM pairs p JOIN chain a ON a.shot = p.shot AND a.det = p.u JOIN chain b ON b.shot = p.shot AND b.det = p.v AND b.root = a.root)"
)
SQL["component_diameter"] = with_(*_CHAIN, _SPREAD) + (
    ", s AS (SELECT shot, root, count(*) AS size FROM chain GROUP BY 1, 2), x AS (SELECT shot, root, max(d) AS d FROM inner_pairs GROUP BY 1, 2) "
    "SELECT s.shot, s.root, s.size, CASE WHEN coalesce(x.d, 0) <= 30 THEN coalesce(x.d, 0) END AS diameter FROM s LEFT JOIN x USING (shot, root)"
)
SQL["cluster_level1"] = with_(HITS, PLACED, PAIRS, LEVEL1) + (
    "SELECT shot, root, size, CASE WHEN accepted THEN diameter END AS diameter, near_rim, far_rim, accepted FROM judged"
)
SQL["cluster_residual"] = with_(HITS, PLACED, PAIRS, LEVEL1) + "SELECT k.shot, k.det FROM chain k JOIN judged j USING (shot, root) WHERE NOT j.accepted"
SQL["cluster_deferral"] = with_(HITS, PLACED, PAIRS, LEVEL1) + (
    "SELECT k.shot, k.det, CASE WHEN j.accepted AND j.size <= 1 THEN 'kept' ELSE 'next' END AS place FROM chain k JOIN judged j USING (shot, root)"
)
_MEMBERS = (HITS, PLACED, PAIRS, LEVELS)
SQL["cluster_levels"] = with_(*_MEMBERS) + "SELECT shot, level::BIGINT AS level, root, det, size, diameter, forced FROM members"
_NARROW = (HITS, PLACED, PAIRS, levelled([(3, 10), (9, 24), (27, 72)]))
SQL["cluster_levels_narrow"] = with_(*_NARROW) + "SELECT shot, level::BIGINT AS level, root, det, size, diameter, forced FROM members"
SQL["owner_regions"] = with_(NODES, HITS, PLACED) + (
    ", offsets AS (SELECT dr, dc, 2 * (abs(dr) + abs(dc)) AS d FROM range(-4, 5) a(dr), range(-4, 5) b(dc) WHERE abs(dr) + abs(dc) <= 4), "
    "near AS (SELECT p.shot, p.det, n.id AS node, o.d FROM placed p, offsets o JOIN nodes n ON n.r = p.r + o.dr AND n.c = p.c + o.dc), "
    "nearest AS (SELECT shot, node, arg_min(det, (d, det)) AS det, min(d) AS d FROM near GROUP BY 1, 2) "
    "SELECT shot, det, count(*) AS n, sum(node)::BIGINT AS node_sum, sum(d)::BIGINT AS d_sum FROM nearest GROUP BY 1, 2"
)
SQL["cluster_forced_top"] = with_(HITS) + "SELECT shot, min(det) OVER (PARTITION BY shot) AS root, det FROM hits"
SQL["cluster_shape"] = with_(*_MEMBERS) + (
    ", heads AS (SELECT shot, level, root, count(*) AS size FROM members GROUP BY 1, 2, 3), widths AS (SELECT shot, level, count(*) AS width, sum(size) AS covered, max(size) AS largest FROM heads GROUP BY 1, 2) "
    "SELECT shot, sum(width)::BIGINT AS clusters, sum(covered)::BIGINT AS covered, max(largest) AS largest, max(level)::BIGINT AS max_level, max(width) AS peak_width FROM widths GROUP BY 1"
)
SQL["ready_time"] = with_(*_CHAIN) + (
    ", near16 AS (SELECT shot, u AS x, v AS y, d FROM pairs WHERE d <= 16 UNION ALL SELECT shot, v, u, d FROM pairs WHERE d <= 16), "
    "levels AS (SELECT unnest([2, 4, 6, 8, 10, 12, 14, 16]) AS t), "
    "walk(shot, t, det, other) AS (SELECT shot, t, det, det FROM hits, levels UNION SELECT w.shot, w.t, w.det, n.y FROM walk w JOIN near16 n ON n.shot = w.shot AND n.x = w.other AND n.d <= w.t), "
    "part AS (SELECT shot, t, det, min(other) AS p FROM walk GROUP BY 1, 2, 3), "
    "joined AS (SELECT k.shot, k.root, p.t FROM part p JOIN chain k USING (shot, det) GROUP BY 1, 2, 3 HAVING count(DISTINCT p.p) = 1) "
    "SELECT shot, root, CASE WHEN any_value(size) = 1 THEN 0 ELSE min(t) // 2 END::BIGINT AS ready FROM joined JOIN (SELECT shot, root, count(*) AS size FROM chain GROUP BY 1, 2) s USING (shot, root) GROUP BY 1, 2"
)
SQL["first_external"] = with_(*_CHAIN) + (
    ", apart AS (SELECT p.shot, a.root AS x, b.root AS y, d FROM pairs p JOIN chain a ON a.shot = p.shot AND a.det = p.u JOIN chain b ON b.shot = p.shot AND b.det = p.v WHERE a.root <> b.root) "
    "SELECT shot, root, (min(d) // 2)::BIGINT AS external FROM (SELECT shot, x AS root, d FROM apart UNION ALL SELECT shot, y, d FROM apart) GROUP BY 1, 2"
)
SQL["cluster_members_text"] = with_(*_MEMBERS) + (
    "SELECT shot, level::BIGINT AS level, root, count(*) AS active_detectors, string_agg(det::VARCHAR, ';' ORDER BY det) AS members FROM members GROUP BY 1, 2, 3"
)
SQL["cluster_members_exploded"] = with_(*_MEMBERS) + "SELECT shot, level::BIGINT AS level, root, det AS active_detector FROM members"


def _regions(step: int) -> tuple[str, ...]:
    return (
        *_MEMBERS, NODES,
        f"offsets AS (SELECT dr, dc, 2 * (abs(dr) + abs(dc)) AS d FROM range({-2 * step}, {2 * step + 1}) a(dr), range({-2 * step}, {2 * step + 1}) b(dc)), "
        f"regions AS (SELECT DISTINCT m.shot, m.level, m.root, n.id AS node FROM members m JOIN offsets o ON o.d <= (m.level + 1) * {step} JOIN nodes n ON n.r = m.det // 40 + o.dr AND n.c = m.det % 40 + o.dc)",
    )


_REGIONS = _regions(2)
SQL["influence_vertices"] = with_(*_REGIONS) + "SELECT shot, level::BIGINT AS level, root, count(*) AS n, sum(node)::BIGINT AS node_sum FROM regions GROUP BY 1, 2, 3"
SQL["cluster_parent"] = with_(*_regions(6)) + (
    "SELECT DISTINCT a.shot, a.level::BIGINT AS level, a.root, b.level::BIGINT AS parent_level, b.root AS parent_root FROM regions a JOIN regions b ON a.shot = b.shot AND a.node = b.node AND b.level > a.level "
    "QUALIFY row_number() OVER (PARTITION BY a.shot, a.level, a.root ORDER BY b.level, b.root) = 1"
)
SQL["greedy_cover"] = with_(*_REGIONS) + (
    "SELECT m.shot, m.det, r.level::BIGINT AS level, r.root FROM members m JOIN regions r ON r.shot = m.shot AND r.node = m.det "
    "JOIN (SELECT shot, level, root, count(*) AS size FROM members GROUP BY 1, 2, 3) s ON s.shot = r.shot AND s.level = r.level AND s.root = r.root "
    "QUALIFY row_number() OVER (PARTITION BY m.shot, m.det ORDER BY r.level DESC, s.size DESC, r.root) = 1"
)
SQL["cluster_subgraph"] = with_(*_REGIONS, STEPS) + (
    ", cutout AS (SELECT a.shot, a.level, a.root, 0 AS rim FROM regions a JOIN steps s ON s.u = a.node JOIN regions b ON b.shot = a.shot AND b.level = a.level AND b.root = a.root AND b.node = s.v "
    "UNION ALL SELECT shot, level, root, 1 FROM regions WHERE node % 40 IN (0, 39)) "
    "SELECT shot, level::BIGINT AS level, root, count(*) AS n_edges, sum(rim)::BIGINT AS n_rim, (2 * count(*))::BIGINT AS weight FROM cutout GROUP BY 1, 2, 3"
)
SQL["upper_targets"] = with_(*_MEMBERS) + (
    ", heads AS (SELECT DISTINCT shot, level, root FROM members) SELECT a.shot, a.level::BIGINT AS level, a.root, count(b.root) AS targets FROM heads a LEFT JOIN heads b ON a.shot = b.shot AND b.level > a.level GROUP BY 1, 2, 3"
)
SQL["short_pairs_mutual"] = with_(HITS, PLACED, PAIRS) + (
    ", ends AS (SELECT shot, u AS x, v AS y, d FROM pairs UNION ALL SELECT shot, v, u, d FROM pairs), best AS (SELECT shot, x, min(d) AS d FROM ends GROUP BY 1, 2), "
    "one AS (SELECT e.shot, e.x, min(e.y) AS y, b.d FROM ends e JOIN best b ON b.shot = e.shot AND b.x = e.x AND b.d = e.d GROUP BY e.shot, e.x, b.d HAVING count(*) = 1) "
    "SELECT a.shot, a.x AS u, a.y AS v, a.d FROM one a JOIN one b ON a.shot = b.shot AND a.x = b.y AND a.y = b.x WHERE a.x < a.y AND a.d <= 10"
)
# Pairs one by one in order, with the hits used so far at hand.
SQL["short_pairs_accepted"] = with_(HITS, PLACED, PAIRS, LEVEL1) + (
    ", rest AS (SELECT k.shot, k.det FROM chain k JOIN judged j USING (shot, root) WHERE NOT j.accepted), "
    "near4 AS (SELECT shot, u AS x, v AS y FROM pairs WHERE d <= 4 UNION ALL SELECT shot, v, u FROM pairs WHERE d <= 4), "
    "asked AS (SELECT p.shot, p.u, p.v, p.d, row_number() OVER (PARTITION BY p.shot ORDER BY p.d, p.u, p.v) AS k FROM pairs p "
    "JOIN rest a ON a.shot = p.shot AND a.det = p.u JOIN rest b ON b.shot = p.shot AND b.det = p.v WHERE p.d <= 30 "
    "AND NOT EXISTS (SELECT 1 FROM near4 n WHERE n.shot = p.shot AND n.x IN (p.u, p.v) AND n.y NOT IN (p.u, p.v))), "
    "walk(shot, k, used) AS (SELECT DISTINCT shot, 0::BIGINT, []::BIGINT[] FROM asked UNION ALL "
    "SELECT w.shot, a.k, CASE WHEN list_contains(w.used, a.u) OR list_contains(w.used, a.v) THEN w.used ELSE list_concat(w.used, [a.u, a.v]) END FROM walk w JOIN asked a ON a.shot = w.shot AND a.k = w.k + 1) "
    "SELECT a.shot, a.u, a.v, a.d FROM asked a JOIN walk w ON w.shot = a.shot AND w.k = a.k - 1 WHERE NOT list_contains(w.used, a.u) AND NOT list_contains(w.used, a.v)"
)
SQL["parent_cover"] = with_(*_NARROW, NODES) + (
    ", offsets AS (SELECT dr, dc, 2 * (abs(dr) + abs(dc)) AS d FROM range(-16, 17) a(dr), range(-16, 17) b(dc)), "
    "regions AS (SELECT DISTINCT m.shot, m.level, m.root, n.id AS node FROM members m JOIN offsets o ON o.d <= m.level * 8 JOIN nodes n ON n.r = m.det // 40 + o.dr AND n.c = m.det % 40 + o.dc), "
    "up AS (SELECT DISTINCT a.shot, a.level, a.root, b.level AS up_level, b.root AS up_root FROM regions a JOIN regions b ON a.shot = b.shot AND a.node = b.node AND b.level > a.level "
    "QUALIFY row_number() OVER (PARTITION BY a.shot, a.level, a.root ORDER BY b.level, b.root) = 1), "
    "ways(shot, level, root, up_level, up_root) AS (SELECT * FROM up UNION SELECT w.shot, w.level, w.root, u.up_level, u.up_root FROM ways w JOIN up u ON u.shot = w.shot AND u.level = w.up_level AND u.root = w.up_root), "
    "wide AS (SELECT shot, level, root, node FROM regions UNION SELECT w.shot, w.up_level, w.up_root, r.node FROM ways w JOIN regions r ON r.shot = w.shot AND r.level = w.level AND r.root = w.root), "
    "sums AS (SELECT shot, level, root, count(*) AS n, sum(node)::BIGINT AS node_sum FROM wide GROUP BY 1, 2, 3) "
    "SELECT shot, level::BIGINT AS level, root, CASE WHEN n < (SELECT count(*) FROM nodes) THEN n END AS n, CASE WHEN n < (SELECT count(*) FROM nodes) THEN node_sum END AS node_sum FROM sums"
)
SQL["bounds_schedule"] = (
    "SELECT * FROM (VALUES (1::BIGINT, 3::BIGINT, 10::BIGINT, 1.0::DOUBLE, 10::BIGINT, false), (2, 53, 1300, 0.294117647, 369, false), (3, 5363, 59798120, 0.020005972, 536241, false), "
    "(4, 239208573, 49103972738869, 0.01099, 43532042228, false), (5, 196416608581199, 1152921504606846975, 0.010099, 38898229246697652, true)) t(level, d, b, phi, phi_needs, clamped) "
    "WHERE (SELECT count(*) FROM part) > 1"
)

# Matching ------------------------------------------------------------------

SQL["match_weight"] = with_(HITS, PLACED, pairing("placed", "best")) + "SELECT shot, n_hits, weight, 'ok' AS status FROM best"
# Every boundary edge flips the one flag, so it tells whether the number of hits is odd.
_TWO = (
    "cased AS (SELECT CASE WHEN shot % 2 = 0 THEN 'unit' ELSE 'threefold' END AS \"case\", row_number() OVER (PARTITION BY shot % 2 ORDER BY shot) - 1 AS shot, n_hits, "
    "weight * (1 + 2 * (shot % 2)) AS weight, n_hits % 2 AS obs_mask, shot % 3 % 2 AS true_mask FROM best)"
)
SQL["case_run"] = with_(HITS, PLACED, pairing("placed", "best"), _TWO) + "SELECT \"case\", shot, n_hits, weight, obs_mask, 'ok' AS status, true_mask FROM cased"
SQL["case_mistakes"] = with_(HITS, PLACED, pairing("placed", "best"), _TWO) + (
    "SELECT \"case\", shot, obs_mask AS predicted, true_mask AS expected, CASE WHEN obs_mask = 1 THEN '0' ELSE '' END AS predicted_bits, CASE WHEN true_mask = 1 THEN '0' ELSE '' END AS expected_bits "
    "FROM cased WHERE obs_mask <> true_mask"
)
SQL["case_totals"] = with_(HITS, PLACED, pairing("placed", "best"), _TWO) + (
    "SELECT \"case\", count(*) AS shots, count_if(obs_mask <> true_mask)::BIGINT AS mistakes, 0::BIGINT AS exceptions, round(avg(weight), 6) AS mean_weight FROM cased GROUP BY 1"
)
SQL["observables_many"] = with_(HITS, PLACED, pairing("placed", "best")) + (
    ", flips AS (SELECT shot, det % 200 AS obs FROM hits GROUP BY 1, 2 HAVING count(*) % 2 = 1), "
    "told AS (SELECT shot, string_agg(obs::VARCHAR, ';' ORDER BY obs) AS obs, max(obs) // 64 + 1 AS n_words FROM flips GROUP BY 1) "
    "SELECT shot, weight, coalesce(obs, '') AS obs, coalesce(n_words, 0)::BIGINT AS n_words FROM best LEFT JOIN told USING (shot)"
)
SQL["case_decode"] = f"SELECT row_number() OVER (ORDER BY shot) - 1 AS shot, n_hits, weight, status FROM ({SQL['match_weight']})"
SQL["match_pairs_check"] = with_(HITS, PLACED, pairing("placed", "best")) + "SELECT shot, n_hits, weight FROM best"
_ALONE = (
    *_MEMBERS,
    "keyed AS (SELECT dense_rank() OVER (ORDER BY m.shot, m.level, m.root) AS shot, m.det, p.r, p.c, p.rim, m.shot AS real_shot, m.level AS real_level, m.root FROM members m JOIN placed p USING (shot, det))",
    pairing("keyed", "alone"),
    "results AS (SELECT k.real_shot AS shot, k.real_level AS level, k.root, a.weight FROM alone a JOIN (SELECT DISTINCT shot, real_shot, real_level, root FROM keyed) k USING (shot))",
)
_KEYED = "keyed AS (SELECT dense_rank() OVER (ORDER BY shot, level, root) AS shot, det, det // 40 AS r, det % 40 AS c, 2 * (least(det % 40, 39 - det % 40) + 1) AS rim, shot AS own, level, root FROM members)"
SQL["cluster_weights"] = with_(*_NARROW, _KEYED, pairing("keyed", "alone")) + (
    "SELECT k.own AS shot, k.level::BIGINT AS level, k.root, a.n_hits AS size, a.weight, 'ok' AS status FROM alone a JOIN (SELECT DISTINCT shot, own, level, root FROM keyed) k USING (shot)"
)
SQL["isolated_vs_global"] = with_(*_ALONE, pairing("placed", "best")) + (
    "SELECT shot, sum(r.weight)::BIGINT AS isolated, any_value(b.weight) AS whole FROM results r JOIN best b USING (shot) GROUP BY shot HAVING sum(r.weight) <> any_value(b.weight)"
)
SQL["root_totals"] = with_(*_ALONE) + "SELECT shot, sum(weight)::BIGINT AS weight FROM results WHERE level <> 2 GROUP BY shot"
SQL["decode_mistakes"] = with_(HITS) + "SELECT count(DISTINCT shot) AS shots, 0::BIGINT AS mistakes, 0::BIGINT AS exceptions FROM hits"

# Accounting ----------------------------------------------------------------

SQL["critical_path"] = with_(FOLD) + "SELECT shot, level, critical, stop FROM fold WHERE k > 0"
SQL["cluster_event_costs"] = with_(FOLD) + (
    "SELECT c.shot, c.level, c.cluster, c.n, c.before, c.after, greatest(f.critical, c.before) AS base, greatest(f.critical, c.before) + c.after AS critical "
    "FROM costs c JOIN numbered n ON n.shot = c.shot AND n.level = c.level JOIN fold f ON f.shot = c.shot AND f.k = n.k - 1"
)
_SHOT_COSTS = (
    "widths AS (SELECT shot, level, count(*) AS width, sum(n) AS events FROM costs GROUP BY 1, 2), "
    "shaped AS (SELECT shot, sum(width)::BIGINT AS clusters, sum(events)::BIGINT AS events, count(*) FILTER (WHERE events > 0) AS nonempty_levels, max(level) AS max_level, max(width) AS peak_width FROM widths GROUP BY 1), "
    "shot_costs AS (SELECT s.*, f.critical, f.stop FROM shaped s JOIN (SELECT shot, max(critical) AS critical, max(stop) AS stop FROM fold GROUP BY 1) f USING (shot))"
)
SQL["shot_costs"] = with_(FOLD, _SHOT_COSTS) + "SELECT * FROM shot_costs"
SQL["adaptive_level_cost"] = with_(COSTS) + "SELECT shot, sum(f)::BIGINT AS critical FROM (SELECT shot, level, max(after) AS f FROM costs GROUP BY 1, 2) GROUP BY shot"
SQL["slowest_cluster"] = with_(COSTS) + (
    "SELECT shot, level, cluster AS slowest, n AS time FROM costs QUALIFY row_number() OVER (PARTITION BY shot, level ORDER BY n DESC, cluster DESC) = 1"
)
SQL["makespan_lpt"] = with_(COSTS) + (
    ", queues AS (SELECT shot, level, list([n] ORDER BY n DESC) AS q FROM costs GROUP BY 1, 2) SELECT shot, level, list_max(list_reduce(list_concat([[0, 0, 0]::BIGINT[]], q), "
    "lambda acc, x: list_sort(list_concat([acc[1] + x[1]], acc[2:]))))::BIGINT AS makespan FROM queues"
)

# Summaries -----------------------------------------------------------------

SQL["sem_by_case"] = (
    "SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 9) AS mean, round(stddev_samp(l_quantity) / sqrt(count(*)), 9) AS sem, "
    "round(stddev_samp(l_quantity) / sqrt(count(*)), 6) AS sem_from_sums FROM lineitem GROUP BY 1, 2"
)
SQL["percentile_linear"] = (
    "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.9), 6) AS p90, round(quantile_cont(l_extendedprice, 0.99), 6) AS p99 FROM lineitem GROUP BY 1"
)
SQL["percentile_lower"] = (
    "WITH s AS (SELECT l_returnflag, list(l_extendedprice ORDER BY l_extendedprice) AS x FROM lineitem GROUP BY 1) SELECT l_returnflag, "
    "x[(floor(0.5 * (len(x) - 1)) + 1)::BIGINT] AS p50, x[(floor(0.9 * (len(x) - 1)) + 1)::BIGINT] AS p90, x[(floor(0.99 * (len(x) - 1)) + 1)::BIGINT] AS p99 FROM s"
)
_TABLE = LOG + (
    ", ctab AS (SELECT CASE WHEN shot % 2 = 0 THEN 'r9_d9_p1' ELSE 'r13_d13_p1' END AS \"case\", seq % 2 AS rep, shot, level, cluster, count(*) AS events, count(DISTINCT t) AS size, max(t) - min(t) AS diameter, max(t) AS buffer FROM log GROUP BY ALL)"
)
SQL["level_stats"] = with_(_TABLE) + (
    ", ps AS (SELECT \"case\", level, rep, shot, count(*) AS n FROM ctab GROUP BY ALL), tot AS (SELECT \"case\", count(DISTINCT (rep, shot)) AS shots FROM ctab GROUP BY 1), "
    "w AS (SELECT \"case\", level, count(*) AS nonempty_shots, max(n) AS max_clusters_in_shot FROM ps GROUP BY ALL) "
    "SELECT c.\"case\", any_value(shots) AS shots, any_value(nonempty_shots) AS nonempty_shots, count(*) AS total_clusters, any_value(max_clusters_in_shot) AS max_clusters_in_shot, sum(events)::BIGINT AS total_events, "
    "min(events) AS min_events_per_cluster, max(events) AS max_events_per_cluster, c.level, round(median(events), 6) AS median_events_per_cluster, round(quantile_cont(events, 0.9), 6) AS p90_events_per_cluster, "
    "round(avg(events), 6) AS mean_events_per_cluster, round(avg(size), 6) AS mean_active_detectors_per_cluster, round(avg(diameter), 6) AS mean_diameter_per_cluster, round(avg(buffer), 6) AS mean_buffer_bound_per_cluster, "
    "round(count(*) / any_value(shots), 6) AS avg_clusters_per_shot FROM ctab c JOIN tot USING (\"case\") JOIN w ON w.\"case\" = c.\"case\" AND w.level = c.level GROUP BY c.\"case\", c.level"
)
_LEVEL_TABLE = _TABLE + (
    ", ltab AS (SELECT \"case\", 'event_log' AS method, rep, shot, level, count(*) AS a, sum(size) AS b, max(size) AS c, max(events) AS e FROM ctab GROUP BY ALL), "
    "sk AS (SELECT DISTINCT \"case\", method, rep, shot FROM ltab), top AS (SELECT \"case\", max(level) AS top FROM ltab GROUP BY 1), "
    "grid AS (SELECT sk.*, g.l AS level FROM sk JOIN top USING (\"case\"), LATERAL (SELECT unnest(range(0, top + 1)) AS l) g), "
    "filled AS (SELECT g.*, coalesce(a, 0) AS a, coalesce(b, 0) AS b, coalesce(c, 0) AS c, coalesce(e, 0) AS e FROM grid g LEFT JOIN ltab USING (\"case\", method, rep, shot, level))"
)
SQL["level_counts_zero_filled"] = with_(_LEVEL_TABLE) + (
    "SELECT \"case\", method, level, count(*) AS shots, count(*) FILTER (WHERE a > 0) AS nonempty_shots, round(count(*) FILTER (WHERE a > 0) / count(*), 6) AS nonempty_fraction, "
    "round(avg(a), 6) AS mean_cluster_count, round(median(a), 6) AS median_cluster_count, round(quantile_cont(a, 0.9), 6) AS p90_cluster_count, round(quantile_cont(a, 0.95), 6) AS p95_cluster_count, round(quantile_cont(a, 0.99), 6) AS p99_cluster_count, max(a) AS max_cluster_count, "
    "round(avg(b), 6) AS mean_assigned_active_detector_count, round(quantile_cont(b, 0.95), 6) AS p95_assigned_active_detector_count, max(b)::BIGINT AS max_assigned_active_detector_count, "
    "round(avg(c), 6) AS mean_max_cluster_active_detectors, round(quantile_cont(c, 0.95), 6) AS p95_max_cluster_active_detectors, max(c) AS max_cluster_active_detectors, "
    "round(avg(e), 6) AS mean_max_cluster_event_count, max(e) AS max_cluster_event_count, round(avg(e), 6) AS mean_max_cluster_critical_path_event_count, max(e) AS max_cluster_critical_path_event_count "
    "FROM filled GROUP BY \"case\", method, level"
)
SQL["level_count_histogram"] = with_(_LEVEL_TABLE) + (
    "SELECT \"case\", method, level, a AS cluster_count, count(*) AS shots, round(count(*) / (sum(count(*)) OVER (PARTITION BY \"case\", method, level))::DOUBLE, 9) AS fraction FROM filled GROUP BY \"case\", method, level, a"
)
SQL["level_parameter_rows"] = with_(FOLD) + (
    ", cp AS (SELECT c.shot, c.level, c.n, c.before + 1 AS size, greatest(f.critical, c.before) + c.after AS critical FROM costs c JOIN numbered n ON n.shot = c.shot AND n.level = c.level JOIN fold f ON f.shot = c.shot AND f.k = n.k - 1) "
    "SELECT shot, level, count(*) AS cluster_count, sum(size)::BIGINT AS assigned_active_detector_count, max(size) AS max_cluster_active_detectors, max(n) AS max_cluster_event_count, max(critical) AS max_cluster_critical_path_event_count FROM cp GROUP BY 1, 2"
)
SQL["power_law_fit"] = with_(_POINTS) + (
    ", summary AS (SELECT noise, distance, avg(y) AS per_shot, sum(y) / sum(distance * distance) AS per_round FROM points GROUP BY 1, 2), "
    "long AS (SELECT noise, distance, 'per_shot' AS metric, per_shot AS y FROM summary UNION ALL SELECT noise, distance, 'per_round', per_round FROM summary), "
    "tails AS (SELECT noise, list(distance ORDER BY distance)[len(list(distance)) // 3 + 1] AS tail_min FROM summary GROUP BY 1 HAVING count(*) >= 6), "
    "ranged AS (SELECT *, 'all_distances' AS fit_range FROM long UNION ALL SELECT l.*, 'tail_d_ge_' || tail_min FROM long l JOIN tails USING (noise) WHERE distance >= tail_min) "
    "SELECT noise::BIGINT AS noise, metric, fit_range, min(distance)::BIGINT AS x_min, max(distance)::BIGINT AS x_max, round(exp(regr_intercept(ln(y), ln(distance))), 3) AS coefficient, round(regr_slope(ln(y), ln(distance)), 7) AS exponent, round(regr_r2(ln(y), ln(distance)), 7) AS r2 FROM ranged GROUP BY 1, 2, 3 HAVING count(*) >= 2"
)
SQL["speedup_pairing"] = with_(_POINTS) + (
    ", g AS (SELECT \"case\", y FROM points WHERE mode = 'global' QUALIFY row_number() OVER (PARTITION BY \"case\" ORDER BY ord) = 1), "
    "p AS (SELECT \"case\", y, mode FROM points WHERE mode LIKE 'parallel%' QUALIFY row_number() OVER (PARTITION BY \"case\" ORDER BY ord) = 1) "
    "SELECT g.\"case\", g.y AS global_y, p.y AS parallel_y, p.mode AS parallel_mode, round(CASE WHEN p.y > 0 THEN g.y / p.y ELSE 0 END, 6) AS speedup FROM g JOIN p USING (\"case\")"
)
SQL["best_trial"] = with_(LOG) + (
    ", t AS (SELECT shot, cluster, count(*) AS clusters, count(DISTINCT level) AS active, max(t) AS residual FROM log GROUP BY 1, 2) "
    "SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY shot ORDER BY clusters DESC, active DESC, residual, cluster DESC) = 1"
)
SQL["spaced_sample"] = with_(LOG) + (
    ", s AS (SELECT shot, list(DISTINCT t) AS x FROM log GROUP BY 1), o AS (SELECT shot, list_sort(x) AS x, len(x) AS n FROM s), "
    "k AS (SELECT shot, x, n, unnest(range(0, CASE WHEN n <= 8 THEN n ELSE 8 END)) AS k FROM o) SELECT DISTINCT shot, x[CASE WHEN n <= 8 THEN k ELSE (k * (n - 1)) // 7 END + 1] AS t FROM k"
)
_SEM = "round(coalesce(stddev_samp({0}) / sqrt(count({0})), 0), 6)"
SQL["bench_rows"] = with_(FOLD, _SHOT_COSTS) + (
    "SELECT CASE WHEN shot % 2 = 0 THEN 'r9_d9_p1' ELSE 'r13_d13_p1' END AS \"case\", 'parallel_fixed' AS mode, round(avg(events), 6) AS global_mwpm_events_per_shot, "
    + _SEM.format("events") + " AS global_mwpm_events_std_error_per_shot, round(avg(events), 6) AS parallel_cluster_events_total_per_shot, " + _SEM.format("events") + " AS parallel_cluster_events_total_std_error_per_shot, "
    "round(avg(critical), 6) AS parallel_level_critical_events_per_shot, " + _SEM.format("critical") + " AS parallel_level_critical_events_std_error_per_shot, "
    "round(avg(stop), 6) AS parallel_critical_path_algorithmic_time_per_shot, " + _SEM.format("stop") + " AS parallel_critical_path_algorithmic_time_std_error_per_shot, "
    "max(critical) AS parallel_critical_events_seen, round(avg(nonempty_levels), 6) AS parallel_nonempty_event_levels_per_shot, round(avg(clusters), 6) AS child_import_messages_per_shot, round(avg(clusters), 6) AS avg_clusters, "
    "round(avg(max_level), 6) AS avg_max_level, round(avg(peak_width), 6) AS avg_peak_width, round(avg(peak_width), 6) AS avg_max_cluster_size, 0::BIGINT AS mistakes, 0::BIGINT AS exceptions FROM shot_costs GROUP BY 1"
)

# Sampling and files --------------------------------------------------------

SQL["error_sampling"] = with_(NODES, STEPS, NOISY) + (
    ", blocks AS (SELECT e.*, b, least(1024, n - b * 1024) AS size FROM noisy e, (SELECT count(*) AS n FROM customer), range(10000) t(b) WHERE b * 1024 < n), "
    "draws AS (SELECT *, unnest(range((size * p + 10 * sqrt(size * p))::BIGINT + 20)) AS i FROM blocks), "
    "skips AS (SELECT *, floor(ln(1 - ('0x' || substr(md5('20260101:' || ord || ':' || b || ':' || i), 1, 8))::BIGINT / 4294967296.0::DOUBLE) / ln(1 - p))::BIGINT AS skip FROM draws), "
    "places AS (SELECT *, sum(skip + 1) OVER (PARTITION BY ord, b ORDER BY i) - 1 AS place FROM skips), "
    "fired AS (SELECT b * 1024 + place AS shot, u, v, obs FROM places WHERE place < size), "
    "hit AS (SELECT shot, det FROM (SELECT shot, u AS det FROM fired UNION ALL SELECT shot, v FROM fired WHERE v IS NOT NULL) GROUP BY 1, 2 HAVING count(*) % 2 = 1), "
    "flips AS (SELECT shot, bit_xor(CASE WHEN obs = 0 THEN 1 ELSE 0 END)::BIGINT AS m FROM fired GROUP BY 1) "
    "SELECT h.shot, count(*) AS n_hits, sum(det)::BIGINT AS det_sum, coalesce(any_value(m), 0) AS obs_mask FROM hit h LEFT JOIN flips USING (shot) GROUP BY h.shot"
)
SQL["case_roundtrip"] = with_(NODES, STEPS, NOISY, HITS) + (
    ", f(fact, value) AS (SELECT 'edges', count(*) FROM noisy UNION ALL SELECT 'inner_edges', count(v) FROM noisy UNION ALL SELECT 'u_sum', sum(u) FROM noisy UNION ALL SELECT 'p_sum_1e6', round(sum(p) * 1e6) FROM noisy "
    "UNION ALL SELECT 'observables', count(*) FILTER (WHERE obs = 0) FROM noisy UNION ALL SELECT 'shots', count(DISTINCT shot) FROM hits UNION ALL SELECT 'mask_sum', sum(m) FROM (SELECT DISTINCT shot, shot % 4 AS m FROM hits) "
    "UNION ALL SELECT 'hits', count(*) FROM hits UNION ALL SELECT 'det_sum', sum(det) FROM hits UNION ALL SELECT 'header_detectors', max(greatest(u, coalesce(v, u))) + 1 FROM noisy UNION ALL SELECT 'header_edges', count(*) FROM noisy "
    "UNION ALL SELECT 'header_shots', count(DISTINCT shot) FROM hits) SELECT fact, value::BIGINT AS value FROM f"
)
# Bounds chosen from the data ------------------------------------------------

SQL["adaptive_diameter_candidates"] = with_(HITS, PLACED, PAIRS) + (
    "SELECT DISTINCT shot, d FROM (SELECT shot, d FROM pairs UNION ALL SELECT shot, rim FROM placed UNION ALL SELECT shot, 3 FROM placed) WHERE d <= 9"
)
SQL["adaptive_buffer_candidates"] = with_(HITS, PLACED, PAIRS) + (
    "SELECT DISTINCT shot, b FROM (SELECT shot, unnest([d, d - 1, 2 * d + 3]) AS b FROM pairs UNION ALL SELECT shot, unnest([rim, 10, 11]) FROM placed) WHERE b >= 10"
)
# Every distance is tried as a buffer, and the hits are chained anew for each.
SQL["adaptive_breakpoints"] = with_(HITS, PLACED, PAIRS, LEVEL1) + (
    ", rest AS (SELECT p.* FROM placed p JOIN chain k USING (shot, det) JOIN judged j ON j.shot = k.shot AND j.root = k.root WHERE NOT j.accepted), "
    "rp AS (SELECT p.shot, p.u, p.v, p.d FROM pairs p JOIN rest a ON a.shot = p.shot AND a.det = p.u JOIN rest b ON b.shot = p.shot AND b.det = p.v), "
    "tries AS (SELECT DISTINCT shot, b FROM (SELECT shot, unnest([d, d - 1, 2 * d + 3]) AS b FROM rp UNION ALL SELECT shot, unnest([rim, 2 * rim + 3, 10, 11]) FROM rest) WHERE b >= 10), "
    "near AS (SELECT t.shot, t.b, p.u AS x, p.v AS y FROM tries t JOIN rp p ON p.shot = t.shot AND p.d <= t.b UNION ALL SELECT t.shot, t.b, p.v, p.u FROM tries t JOIN rp p ON p.shot = t.shot AND p.d <= t.b), "
    "reach(shot, b, det, other) AS (SELECT t.shot, t.b, r.det, r.det FROM tries t JOIN rest r USING (shot) UNION SELECT k.shot, k.b, k.det, n.y FROM reach k JOIN near n ON n.shot = k.shot AND n.b = k.b AND n.x = k.other), "
    "part AS (SELECT shot, b, det, min(other) AS root FROM reach GROUP BY 1, 2, 3), "
    "spans AS (SELECT x.shot, x.b, x.root, max(p.d) AS diameter FROM part x JOIN part y ON y.shot = x.shot AND y.b = x.b AND y.root = x.root JOIN rp p ON p.shot = x.shot AND p.u = x.det AND p.v = y.det GROUP BY 1, 2, 3), "
    "groups AS (SELECT a.shot, a.b, a.root, count(*) AS size, max(r.rim) AS far, min(r.rim) AS near_rim FROM part a JOIN rest r USING (shot, det) GROUP BY 1, 2, 3), "
    "needs AS (SELECT shot, b, size, coalesce(diameter, 0) AS diameter, CASE WHEN size % 2 = 1 THEN far ELSE 0 END AS far, CASE WHEN size % 2 = 1 THEN near_rim ELSE 0 END AS nearest, (b - 1) // 2 - 1 AS most "
    "FROM groups LEFT JOIN spans USING (shot, b, root)), "
    "asked AS (SELECT shot, b, greatest(3, max(greatest(diameter, nearest))) AS d FROM needs WHERE diameter <= most AND far <= most AND most >= 3 GROUP BY 1, 2), "
    "scored AS (SELECT n.shot, a.d, n.b, count(*) AS clusters, sum(size)::BIGINT AS active FROM needs n JOIN asked a USING (shot, b) WHERE n.diameter <= a.d AND n.far <= a.d GROUP BY 1, 2, 3) "
    "SELECT shot, d, b, clusters, active, total - active AS residual FROM scored JOIN (SELECT shot, count(*) AS total FROM rest GROUP BY 1) USING (shot) "
    "QUALIFY row_number() OVER (PARTITION BY shot ORDER BY clusters DESC, active DESC, d, b) = 1"
)
_TRIALS = []
for _d in (3, 5, 7):
    _b, _n = 2 * _d + 3, f"try{_d}"
    _TRIALS += [
        chained(_b, "placed", _n),
        f"{_n}_s AS (SELECT k.shot, k.root, count(*) AS size, max(p.rim) AS far_rim FROM {_n} k JOIN placed p USING (shot, det) GROUP BY 1, 2)",
        f"{_n}_x AS (SELECT a.shot, a.root, max(p.d) AS diameter FROM pairs p JOIN {_n} a ON a.shot = p.shot AND a.det = p.u JOIN {_n} b ON b.shot = p.shot AND b.det = p.v AND b.root = a.root GROUP BY 1, 2)",
        f"{_n}_t AS (SELECT s.shot, {_d}::BIGINT AS d, {_b}::BIGINT AS b, s.size, coalesce(diameter, 0) <= {_d} AND (s.size % 2 = 0 OR far_rim <= {_d}) AS ok FROM {_n}_s s LEFT JOIN {_n}_x x USING (shot, root))",
    ]
SQL["adaptive_level1"] = with_(HITS, PLACED, PAIRS, *_TRIALS) + (
    ", scored AS (SELECT shot, d, b, count(*) FILTER (WHERE ok) AS clusters, coalesce(sum(size) FILTER (WHERE ok), 0)::BIGINT AS active, coalesce(sum(size) FILTER (WHERE NOT ok), 0)::BIGINT AS residual "
    "FROM (SELECT * FROM try3_t UNION ALL SELECT * FROM try5_t UNION ALL SELECT * FROM try7_t) GROUP BY 1, 2, 3) "
    "SELECT shot, d, b, clusters, active, residual FROM scored QUALIFY row_number() OVER (PARTITION BY shot ORDER BY clusters DESC, active DESC, residual, d, b) = 1"
)
SQL["observables_from_paths"] = with_(HITS) + "SELECT DISTINCT shot, true AS agree FROM hits"

# ``with_`` ends in a blank; statements that continue the CTE list start with a comma.
SQL = {key: sql.replace(" , ", ", ") for key, sql in SQL.items()}
