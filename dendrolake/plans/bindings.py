"""Domain tables as deterministic views over the driver's tables, in both dialects.

aln(dataset, taxon, site, ch)            embeddings: one character for each component
taxon(doc_id, header, seq, raw_date)     documents: sequence records with partial dates
node(tree_id, node, parent, is_leaf, height, n_tips)   customers of a nation are the tips of a heap tree
leaf_first_node, leaf_first_mut, ...   the same trees and events, leaves numbered first and the root last
mut(tree_id, node, time, site, old_state, new_state)   lineitem: events on branches, consistent along paths
ref(site, state), iupac(ch, mask, class), rate, freq   small dimensions
trace(method, experiment, seed, line_no, sample, value) events: one chain for each method, experiment, seed
op_timing(operator, ...)                 lineitem by flags: counters of sampler operators
metadata(id, raw_date, line_no)          orders: accession with version, partial date
"""

from __future__ import annotations

from .plan import Dialect

# Codes of nucleotides, the states they allow (A 1, C 2, G 4, T 8), and their class.
IUPAC = [
    ("A", 1, "nucleotide"), ("C", 2, "nucleotide"), ("G", 4, "nucleotide"), ("T", 8, "nucleotide"),
    ("R", 5, "ambiguous"), ("Y", 10, "ambiguous"), ("S", 6, "ambiguous"), ("W", 9, "ambiguous"), ("K", 12, "ambiguous"),
    ("M", 3, "ambiguous"), ("B", 14, "ambiguous"), ("D", 13, "ambiguous"), ("H", 11, "ambiguous"), ("V", 7, "ambiguous"),
    ("N", 15, "missing"), ("?", 15, "missing"), ("-", 15, "missing"), (".", 15, "missing"), ("X", 15, "missing"),
]
STATES = 4


def _values(rows: list[tuple], names: str) -> str:
    quoted = ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {quoted}) AS t({names})"


def views(d: Dialect) -> dict[str, tuple[tuple[str, ...], str]]:
    """name -> (views it reads, text)."""
    cells = (
        "SELECT label, vec_id, site, CAST(v AS DOUBLE) AS v FROM embeddings LATERAL VIEW posexplode(embedding) e AS site, v"
        if d.spark
        else "SELECT label, vec_id, unnest(range(len(embedding))) AS site, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings"
    )
    depth = "CAST(length(bin(node)) - 1 AS BIGINT)"
    up = f"shiftright(node, CAST({{k}} AS INT))" if d.spark else "(node >> {k})"

    def leaf_first(n: str) -> str:
        return f"CASE WHEN {n} >= n_tips THEN {n} - n_tips ELSE 2 * n_tips - 1 - {n} END"

    stamp = "o_orderdate"
    partial = f"substring({d.iso(stamp)}, 1, CASE o_orderkey % 3 WHEN 0 THEN 4 WHEN 1 THEN 7 ELSE 10 END)"
    return {
        "aln": ((), f"""
SELECT CAST(label AS BIGINT) AS dataset, vec_id AS taxon, CAST(site AS BIGINT) AS site,
  CASE WHEN site = 59 THEN '-' WHEN site >= 60 THEN 'A'
    WHEN (vec_id * 7 + site * 13) % 97 = 0 THEN 'N' WHEN (vec_id * 5 + site * 11) % 89 = 0 THEN '-'
    WHEN (vec_id * 3 + site * 17) % 83 = 0 THEN 'R'
    WHEN v < -0.12 THEN 'A' WHEN v < 0.0 THEN 'C' WHEN v < 0.12 THEN 'G' ELSE 'T' END AS ch
FROM ({cells}) c"""),
        "iupac": ((), _values(IUPAC, "ch, mask, class")),
        "masked": (("aln", "iupac"), "SELECT a.dataset, a.taxon, a.site, a.ch, CAST(i.mask AS INT) AS mask, i.class FROM aln a JOIN iupac i ON a.ch = i.ch"),
        "taxon": ((), f"""
SELECT doc_id, concat(source, '_', CAST(doc_id AS {d.text}), '|', raw_date) AS header, upper(replace(coalesce(text, ''), 'ß', 'ss')) AS seq, raw_date FROM (
  SELECT doc_id, source, text, substring({d.iso("dt")}, 1, CASE doc_id % 3 WHEN 0 THEN 4 WHEN 1 THEN 7 ELSE 10 END) AS raw_date FROM (
    SELECT doc_id, source, text, {d.plus_days("DATE '2020-01-01'", "doc_id % 1000")} AS dt FROM documents) a) b"""),
        "metadata": ((), f"""
SELECT concat('AC', CAST(o_custkey AS {d.text}), '.', CAST(1 + o_orderkey % 2 AS {d.text})) AS id, {partial} AS raw_date, o_orderkey AS line_no FROM orders"""),
        "tips": ((), "SELECT CAST(c_nationkey AS BIGINT) AS tree_id, count(*) AS n_tips FROM customer GROUP BY c_nationkey HAVING count(*) > 1"),
        "numbered": (("tips",), d.series("1", "2 * n_tips - 1", "node", "tips", "tree_id, n_tips")),
        "node": (("numbered",), f"""
SELECT tree_id, node, CASE WHEN node > 1 THEN {d.idiv("node", "2")} END AS parent, node >= n_tips AS is_leaf, n_tips, {depth} AS depth,
  CASE WHEN node >= n_tips THEN (node % 4) / 8.0E0 ELSE CAST(length(bin(2 * n_tips - 1)) AS DOUBLE) - {depth} + (node % 4) / 16.0E0 END AS height
FROM numbered"""),
        # the same trees with leaves numbered first and the root last
        "leaf_first_node": (("node",), f"SELECT tree_id, {leaf_first('node')} AS node, {leaf_first('parent')} AS parent, is_leaf, n_tips, depth, height FROM node"),
        "leaf_first_mut": (("mut", "tips"), f"SELECT m.tree_id, {leaf_first('m.node')} AS node, m.time, m.site, m.old_state, m.new_state FROM mut m JOIN tips t ON t.tree_id = m.tree_id"),
        "leaf_first_tip_state": (("tip_state", "tips"), f"SELECT s.tree_id, {leaf_first('s.node')} AS node, s.site, s.mask FROM tip_state s JOIN tips t ON t.tree_id = s.tree_id"),
        "leaf_first_closure": (("closure", "tips"), f"SELECT c.tree_id, {leaf_first('c.node')} AS node, {leaf_first('c.ancestor')} AS ancestor, c.steps FROM closure c JOIN tips t ON t.tree_id = c.tree_id"),
        "ref": ((), d.series("0", "63", "site", "(SELECT 1 AS one) z", "one").replace("SELECT one,", "SELECT CAST(1 AS BIGINT) AS one,")),
        "reference": (("ref",), "SELECT site, (site * 5 + 1) % 4 AS state FROM ref"),
        "raw_events": (("tips",), """
SELECT tree_id, 2 + l_orderkey % (2 * n_tips - 2) AS node, l_partkey % 64 AS site, l_linenumber / 8.0E0 AS frac, min(1 + l_suppkey % 3) AS inc
FROM lineitem JOIN tips ON l_suppkey % 25 = tree_id GROUP BY tree_id, 2 + l_orderkey % (2 * n_tips - 2), l_partkey % 64, l_linenumber / 8.0E0"""),
        "placed": (("raw_events", "node"), """
SELECT e.tree_id, e.node, e.site, e.inc, n.height + e.frac * (p.height - n.height) AS time
FROM raw_events e JOIN node n ON e.tree_id = n.tree_id AND e.node = n.node JOIN node p ON p.tree_id = n.tree_id AND p.node = n.parent"""),
        "path_nodes": (("node",), d.series("0", "depth", "k", "node", "tree_id, node, height")),
        "closure": (("path_nodes",), f"SELECT tree_id, node, {up.format(k='k')} AS ancestor, k AS steps FROM path_nodes"),
        "branch_inc": (("placed",), "SELECT tree_id, node, site, CAST(sum(inc) AS BIGINT) AS inc FROM placed GROUP BY tree_id, node, site"),
        "above": (("closure", "branch_inc"), """
SELECT c.tree_id, c.node, b.site, CAST(sum(b.inc) AS BIGINT) AS inc FROM closure c
JOIN branch_inc b ON b.tree_id = c.tree_id AND b.node = c.ancestor AND c.steps > 0 GROUP BY c.tree_id, c.node, b.site"""),
        "mut": (("placed", "above", "reference"), f"""
SELECT tree_id, node, time, site, (base + upto - inc) % 4 AS old_state, (base + upto) % 4 AS new_state FROM (
  SELECT {d.merge("a")}p.tree_id, p.node, p.time, p.site, p.inc, r.state + coalesce(a.inc, 0) AS base,
    CAST(sum(p.inc) OVER (PARTITION BY p.tree_id, p.node, p.site ORDER BY p.time DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
  FROM placed p JOIN reference r ON p.site = r.site
  LEFT JOIN above a ON a.tree_id = p.tree_id AND a.node = p.node AND a.site = p.site) x"""),
        "broken": (("mut",), """
SELECT tree_id, node,
  CASE WHEN site = 7 AND node % 5 = 0 THEN time + 100 ELSE time END AS time, site, old_state,
  CASE WHEN site = 11 AND node % 7 = 0 THEN old_state WHEN site = 13 AND node % 6 = 0 THEN (new_state + 1) % 4 ELSE new_state END AS new_state
FROM mut"""),
        # event lists as they are stored, with some above the root; and the same with a breach of each rule
        "root_events": (("node", "reference"), """
SELECT n.tree_id, n.node, n.height AS time, r.site, (r.state + k.k) % 4 AS old_state, (r.state + k.k + 1) % 4 AS new_state, k.k FROM node n JOIN reference r ON r.site % 9 = 4 AND n.parent IS NULL JOIN (VALUES (0, 1), (1, 1)) AS k(k, one) ON k.one = 1"""),
        "listed": (("mut", "root_events"), """
SELECT tree_id, node, row_number() OVER (PARTITION BY tree_id, node ORDER BY time DESC, site, k) AS pos, node AS branch, time, lag(time) OVER (PARTITION BY tree_id, node, site ORDER BY time DESC, k) AS prev_time, site, old_state, new_state
FROM (SELECT tree_id, node, time, site, old_state, new_state, 0 AS k FROM mut UNION ALL SELECT tree_id, node, time, site, old_state, new_state, k FROM root_events) e"""),
        "broken_list": (("listed",), """
SELECT tree_id, node, CASE WHEN site = 17 AND node % 4 = 1 THEN pos + 1000 ELSE pos END AS pos, CASE WHEN site = 3 AND node % 5 = 0 THEN branch + 1 ELSE branch END AS branch,
  CASE WHEN site = 7 AND node % 5 = 0 THEN time + 100 ELSE time END AS time, CASE WHEN site % 8 = 5 AND node % 3 = 0 THEN time - 0.01E0 WHEN site % 8 = 6 AND node % 3 = 1 THEN NULL ELSE prev_time END AS prev_time, site, old_state,
  CASE WHEN site = 11 AND node % 7 = 0 THEN old_state WHEN site % 13 = 4 AND node % 6 = 1 THEN (new_state + 1) % 4 ELSE new_state END AS new_state FROM listed"""),
        "linked": (("mut",), """
SELECT tree_id, node, site, time, lag(time) OVER (PARTITION BY tree_id, node, site ORDER BY time DESC) AS prev_time, old_state, new_state FROM mut"""),
        "tip_state": (("node",), """
SELECT tree_id, node, site, CASE WHEN (node * 7 + site * 3) % 19 = 0 THEN 15 WHEN (node + site) % 23 = 0 THEN 5
  WHEN (node * 3 + site * 5 + node * site) % 4 = 0 THEN 1 WHEN (node * 3 + site * 5 + node * site) % 4 = 1 THEN 2
  WHEN (node * 3 + site * 5 + node * site) % 4 = 2 THEN 4 ELSE 8 END AS mask FROM (""" + d.series("0", "15", "site", "node WHERE is_leaf", "tree_id, node") + ") s"),
        # samples of trees over the same tips: three shapes, 30 trees each, whose tips move along
        "sample_tree": (("node",), d.series("0", "29", "i", "node WHERE tree_id < 3", "tree_id AS run, node, parent, is_leaf, depth, height, n_tips")),
        "sample_node": (("sample_tree",), "SELECT run * 100 + i AS tree_id, node, parent, is_leaf, n_tips, depth, height FROM sample_tree"),
        "sampled": (("sample_tree",), f"SELECT run * 100 + i AS tree_id, node, run, i, (node - n_tips + {d.hash32(f'CAST(i AS {d.text})')}) % n_tips AS tip FROM sample_tree WHERE is_leaf"),
        "sample_tip_state": (("sampled",), """
SELECT tree_id, node, site, CASE WHEN (tip * 7 + site * 3) % 19 = 0 THEN 15 WHEN (tip + site) % 23 = 0 THEN 5 WHEN (tip * 3 + site * 5 + tip * site) % 11 < 5 THEN 1
  WHEN (tip * 3 + site * 5 + tip * site) % 11 < 8 THEN 2 WHEN (tip * 3 + site * 5 + tip * site) % 11 < 10 THEN 4 ELSE 8 END AS mask FROM (""" + d.series("0", "11", "site", "sampled", "tree_id, node, tip") + ") s"),
        "site_category": (("ref",), "SELECT site, (site * 7 + 3) % 4 AS category FROM ref"),
        "weight": (("ref",), "SELECT site, 1 + 0.37E0 * (site * site % 7) + 0.0113E0 * (site * 5 % 13) AS weight FROM ref"),
        "trace": ((), f"""
SELECT event_type AS method, concat('e', CAST(user_id % 3 AS {d.text})) AS experiment, user_id % 5 AS seed, event_id AS line_no,
  1000 * row_number() OVER (PARTITION BY event_type, user_id % 3, user_id % 5 ORDER BY event_id) AS sample, value FROM events"""),
        # several parameters of each run: two that vary, one that doesn't, and one that isn't a parameter
        "param_trace": (("trace",), """
SELECT method, experiment, seed, 'value' AS param, sample, value FROM trace UNION ALL SELECT method, experiment, seed, 'square', sample, (value - 40) * (value - 40) + line_no % 7 FROM trace
UNION ALL SELECT method, experiment, seed, 'constant', sample, 1.5E0 FROM trace UNION ALL SELECT method, experiment, seed, 'mutations.excessCount', sample, value FROM trace
UNION ALL SELECT method, experiment, seed, 'slow', sample, sum(value - 40) OVER (PARTITION BY method, experiment, seed ORDER BY sample ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) FROM trace"""),
        "merged_trace": (("trace",), "SELECT method, experiment, seed, line_no, CASE WHEN line_no % 17 = 0 THEN sample * 10 ELSE sample END AS sample, value FROM trace"),
        "branch_rate": (("node",), "SELECT tree_id, node, 0.5E0 + (node % 5) / 4.0E0 AS rate FROM node"),
        "node_rate": (("node",), "SELECT tree_id, node, 1.0E0 + (node % 3) / 8.0E0 AS total_rate FROM node"),
        "base_operator": (("op_timing",), """
SELECT 'base' AS model, operator, CASE WHEN operator = 'AF' THEN 'slice.Move' ELSE concat('move.', operator) END AS spec, row_number() OVER (ORDER BY operator DESC) AS position FROM (SELECT DISTINCT operator FROM op_timing) o"""),
        "base_attribute": (("base_operator",), f"""
SELECT operator, 'weight' AS key, CAST(position * 2 AS {d.text}) AS value FROM base_operator UNION ALL SELECT operator, 'size', CAST(position AS {d.text}) FROM base_operator WHERE position > 1"""),
        "configuration": (("base_operator",), f"""
SELECT concat('without_', operator) AS config, 'base' AS model, operator, 0 AS kind FROM base_operator WHERE spec NOT LIKE 'slice.%' UNION ALL SELECT concat('tuned_', operator), 'base', operator, 1 FROM base_operator WHERE spec NOT LIKE 'slice.%'
UNION ALL SELECT concat('doubled_', operator), 'base', operator, 2 FROM base_operator WHERE spec NOT LIKE 'slice.%'"""),
        "removed_operator": (("configuration",), "SELECT config, operator FROM configuration WHERE kind = 0"),
        "changed_attribute": (("configuration",), "SELECT config, operator, 'size' AS key, '0.25' AS value FROM configuration WHERE kind > 0 UNION ALL SELECT config, operator, 'tuned', 'true' FROM configuration WHERE kind = 1"),
        "added_operator": (("configuration",), "SELECT c.config, c.operator AS template, concat(c.operator, CASE k.k WHEN 1 THEN '.a' ELSE '.b' END) AS operator, k.k AS nth FROM configuration c JOIN (VALUES (1, 2), (2, 2)) AS k(k, kind) ON k.kind = c.kind"),
        "added_attribute": (("added_operator",), "SELECT config, operator, 'weight' AS key, CASE nth WHEN 1 THEN '9' ELSE '8' END AS value FROM added_operator"),
        "op_timing": ((), f"""
SELECT concat(l_returnflag, l_linestatus) AS operator, l_linenumber AS run, count(*) AS proposals,
  count(*) FILTER (WHERE l_discount > 0.05) AS accepted, count(*) FILTER (WHERE l_discount < 0.01) AS direct_rejects,
  count(*) FILTER (WHERE l_tax > 0.06) AS topology_changes, CAST(sum(l_quantity) AS BIGINT) AS proposal_ns,
  CAST(sum(l_suppkey) AS BIGINT) AS evaluation_ns, CAST(sum(l_partkey % 100) AS BIGINT) AS resolution_ns, min(CAST(l_linenumber AS DOUBLE)) AS weight
FROM lineitem GROUP BY concat(l_returnflag, l_linestatus), l_linenumber"""),
    }


def with_views(d: Dialect, names: tuple[str, ...], body: str) -> str:
    """body with the views it needs as common table expressions."""
    known, order = views(d), []

    def add(name: str) -> None:
        if name in known and name not in order:
            for x in known[name][0]:
                add(x)
            order.append(name)

    for name in names:
        add(name)
    heads = ", ".join(f"{x} AS ({known[x][1]})" for x in order)
    return f"WITH {heads} {body}" if heads else body
