"""Queries of the domain: which plan runs over which views, in Spark, and their texts for a second engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import branch_histories, carries, clustering, configurations, convergence, density, hazards, history, kernels, likelihood, neighbours, parsimony, ratios, records, refresh, regions, sequences, tilted, tip_removal, traces, tree_samples, trees
from ..functions.ctmc import hky
from .bindings import views, with_views
from .lineage import cut, sized
from .plan import ANSI, SPARK, Dialect, Plan

# Fixed tables of the driver that views read.
DRIVER_TABLES = ("embeddings", "documents", "customer", "orders", "lineitem", "events", "pages", "supplier")


def more_views(d: Dialect) -> dict[str, tuple[tuple[str, ...], str]]:
    """Views that only queries need: results of plans under a name, and texts cut in lines."""

    def of(p: Plan, **names: str) -> tuple[tuple[str, ...], str]:
        given = {t: names.get(t, t) for t in p.tables}
        return tuple(given.values()), f"SELECT * FROM ({p.text(d).format(**given)}) {p.name}_rows"

    fasta = "concat('junk', chr(10), '>', replace(replace(coalesce(text, ''), '. ', concat(chr(10), '>')), '.', chr(10)))"
    return {
        "lines": ((), d.lines("documents_with_fasta", "file", "fasta").replace("documents_with_fasta", f"(SELECT doc_id AS file, {fasta} AS fasta FROM documents) f")),
        "parts": ((), d.lines("documents_with_fasta", "file", "fasta", "'>'").replace("documents_with_fasta", f"(SELECT doc_id AS file, {fasta} AS fasta FROM documents) f")),
        "wanted": ((), f"SELECT concat('AC', CAST(c_custkey * 2 AS {d.text}), '.', CAST(1 + c_custkey % 3 AS {d.text})) AS id FROM customer"),
        "lineages": (("node",), f"SELECT l.*, n.is_leaf FROM ({trees.lineages_through_time.text(d).format(node='node')}) l JOIN node n ON n.tree_id = l.tree_id AND n.node = l.node"),
        "aligned": ((), f"""SELECT concat(CAST(l_orderkey AS {d.text}), '-', CAST(l_linenumber AS {d.text})) AS id, repeat('ACGTTGCA', 4) AS seq, CAST(l_quantity AS INT) % 5 AS ref_start, 30 AS ref_len,
            concat(CAST(3 + l_linenumber AS {d.text}), 'M', CAST(1 + l_suppkey % 2 AS {d.text}), 'I', CAST(1 + l_partkey % 3 AS {d.text}), 'D', '9M') AS cigar
            FROM (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey, min(l_partkey) AS l_partkey, min(l_quantity) AS l_quantity FROM lineitem GROUP BY l_orderkey, l_linenumber) l"""),
        "weighted": ((), "SELECT l_orderkey AS grp, CAST(l_linenumber AS BIGINT) AS item, sum(l_quantity) AS weight FROM lineitem GROUP BY l_orderkey, l_linenumber"),
        "branch_sums": of(likelihood.branch_stats),
        "ends": (("tip_state", "reference"), "SELECT t.tree_id, t.node, t.site, t.mask, CAST(r.state AS BIGINT) AS start_state, CAST(length(bin(t.mask & -t.mask)) - 1 AS BIGINT) AS end_state FROM tip_state t JOIN reference r ON r.site = t.site"),
        "starts": (("ends", "node"), f"SELECT {d.merge('e')}e.tree_id, e.node, e.site, e.start_state, e.mask, 0.3E0 * (p.height - n.height) AS jumps FROM ends e JOIN node n ON n.tree_id = e.tree_id AND n.node = e.node JOIN node p ON p.tree_id = n.tree_id AND p.node = n.parent"),
        "settings": ((), "SELECT c_custkey AS config, k.key, (c_custkey * k.step % 23) / 20.0E0 - 0.05E0 AS value FROM customer JOIN (VALUES ('windowProbability', 3, 1), ('sortingErrorProbability', 5, 1), ('maxLevels', 7, 1), ('maxSites', 11, 1), ('pseudoCount', 13, 1), ('missingWeight', 17, 1), ('fullExplorationProbability', 19, 1), ('sortedExplorationProbability', 2, 1), ('other', 1, 1)) AS k(key, step, one) ON k.one = 1"),
        "tree_events": of(tree_samples.single_events),
        "chosen": (("tips",), "SELECT tree_id, CAST(5 AS BIGINT) AS x FROM tips WHERE n_tips > 5"),
        "shortcut": (("tips",), "SELECT tree_id, n_tips AS a, n_tips + 3 AS b FROM tips WHERE n_tips > 5"),
        "few_sites": (("masked",), "SELECT dataset % 2 AS dataset, taxon, site, mask, class FROM masked WHERE site < 7"),
        "base": of(sequences.base_sequence, masked="few_sites"),
        "regions": of(history.branch_regions),
        "stats": of(trees.subtree_stats),
        # what moves with a node: its own branch with its events, too
        "moved_stats": (("stats", "node", "mut"), """SELECT s.tree_id, s.node, s.tips, s.oldest_tip, s.youngest_tip, s.mutations + coalesce(e.m, 0) AS mutations FROM stats s LEFT JOIN (SELECT m.tree_id, m.node, count(*) AS m FROM mut m
            JOIN node n ON n.tree_id = m.tree_id AND n.node = m.node AND n.parent IS NOT NULL GROUP BY m.tree_id, m.node) e ON e.tree_id = s.tree_id AND e.node = s.node"""),
        "times": of(traces.first_stable),
        "unconstrained": of(history.unconstrained_nodes),
        "pairs": (("node",), "SELECT tree_id, node AS x, node + 1 AS y FROM node WHERE is_leaf AND node + 1 < 2 * n_tips"),
        "leaf_first_stats": of(trees.subtree_stats, node="leaf_first_node", closure="leaf_first_closure", mut="leaf_first_mut"),
        # for a second engine; here sweeps make these
        "carried": of(carries.states_by_closure), "broken_carried": of(carries.states_by_closure, mut="broken"),
        "leaf_first_carried": of(carries.states_by_closure, closure="leaf_first_closure", mut="leaf_first_mut"),
        "below": of(carries.lengths_by_closure), "branch_rates": of(carries.rates_by_closure),
        "one": of(trees.clades),
        "other_clades": (("one",), "SELECT tree_id, replace(clade, '1,2', '1,3') AS clade FROM one"),
        "ess": of(traces.ess_by_lags),
        "cost": (("trace",), "SELECT method, 1000.0E0 + 100 * count(DISTINCT experiment) + min(seed) AS us FROM trace GROUP BY method"),
        "root_state": (("tips",), d.series("0", "15", "site", "tips", "tree_id").replace("SELECT tree_id,", "SELECT tree_id, CAST(tree_id % 4 AS BIGINT) AS state,", 1)),
        "ticks": (("trace",), d.series("0", "5", "k", f"(SELECT concat(method, experiment, '-', CAST(seed AS {d.text})) AS run, row_number() OVER (PARTITION BY method, experiment, seed ORDER BY sample) - 1 AS i, value FROM trace) t", "run, i, value")),
        "tree_log": (("ticks",), f"SELECT run, CAST(i AS BIGINT) AS i, concat(CAST(k AS {d.text}), ':', CAST(CAST(floor(value / (10.0E0 * (k + 1))) AS BIGINT) % 3 AS {d.text})) AS clade FROM ticks"),
        "tree_numbers": (("ticks",), "SELECT DISTINCT run, i FROM ticks"),
        "stem_log": (("ticks",), f"SELECT run, CAST(i AS BIGINT) AS i, concat(CAST(k AS {d.text}), ':', CAST(CAST(floor(value / (10.0E0 * (k + 1))) AS BIGINT) % 3 AS {d.text})) AS clade, 0.0005E0 * (1 + (i * 7 + k * 11) % 13) AS stem FROM ticks"),
        "tree_states": (("tree_numbers",), "SELECT run, CAST(i AS BIGINT) AS i, CAST(5000 + 1000 * i AS BIGINT) AS state FROM tree_numbers"),
        "pace": (("tree_numbers",), "SELECT run, 20.0E0 + length(run) AS seconds FROM tree_numbers GROUP BY run"),
        "clock": (("tree_numbers",), "SELECT run, 150.0E0 * length(run) AS per_time FROM tree_numbers GROUP BY run"),
        "refreshes": of(refresh.clade_refreshes, stems="stem_log", samples="tree_states"),
        "design": of(hazards.hat_design),
        "hazard_densities": of(hazards.tree_hazard_density),
        "target": (("hazard_densities",), "SELECT tree_id AS obs, log_density AS y FROM hazard_densities"),
        "ratios": of(ratios.anchored_ratios),
        "root_ratios": of(ratios.anchored_ratios.given(low="youngest", anchor="root")),
        "classes": of(ratios.node_classes),
        "new_height": (("node",), "SELECT tree_id, node, CASE WHEN is_leaf THEN height ELSE height * 1.5E0 + 0.25E0 END AS height FROM node"),
        "replaced": (("mut",), "SELECT DISTINCT tree_id, node, site FROM mut WHERE (site + node) % 3 = 0"),
        "replacement": (("replaced", "node", "reference"), """SELECT r.tree_id, r.node, n.height + k.k * (p.height - n.height) / 4 AS time, r.site, (f.state + 3 - k.k) % 4 AS old_state, (f.state + 4 - k.k) % 4 AS new_state
            FROM replaced r JOIN node n ON n.tree_id = r.tree_id AND n.node = r.node JOIN node p ON p.tree_id = n.tree_id AND p.node = n.parent JOIN reference f ON f.site = r.site JOIN (VALUES (1, 0), (2, 0), (3, 1)) AS k(k, odd) ON k.odd = r.node % 2"""),
        "site_scores": (("masked",), "SELECT dataset, site, count(DISTINCT mask) - 1 AS score FROM masked WHERE site % 10 <> 3 GROUP BY dataset, site"),
        "named": ((), f"SELECT concat(CASE doc_id % 3 WHEN 0 THEN 'England' ELSE 'Wales' END, CASE doc_id % 17 WHEN 0 THEN '-' ELSE '/' END, 'SHEF-', CAST(doc_id % 97 AS {d.text}), '/2020') AS name, CASE doc_id % 5 WHEN 0 THEN 'FR' ELSE 'UK' END AS country, CASE doc_id % 7 WHEN 0 THEN '' ELSE concat('2020-0', CAST(1 + doc_id % 9 AS {d.text})) END AS date, doc_id AS line_no FROM documents"),
        "date_rows": (("metadata",), "SELECT line_no AS doc_id, id AS header, raw_date FROM metadata"),
        "dated": (("date_rows",), f"SELECT doc_id, lo, hi FROM ({records.date_bounds.text(d).format(taxon='date_rows')}) b"),
        "bounds": (("dated",), "SELECT doc_id % 7 AS dataset, doc_id AS position, CASE WHEN doc_id % 11 > 0 THEN CAST(lo AS DATE) END AS first, CAST(hi AS DATE) AS last FROM dated"),
        "experiment_stats": of(traces.mean_by_experiment),
        "summary": of(traces.convergence_summary),
        "rate": ((), "SELECT * FROM (VALUES " + ", ".join(f"({i}, {j}, {(0.1, 0.2, 0.3, 0.4)[j] * (2 if abs(i - j) == 2 else 1)!r}E0)" for i in range(4) for j in range(4) if i != j) + ") AS t(from_state, to_state, q)"),
        "freq": ((), "SELECT * FROM (VALUES (0, 0.1E0), (1, 0.2E0), (2, 0.3E0), (3, 0.4E0)) AS t(state, pi)"),
    }


#: name -> (plan, views in place of its tables where they have another name)
QUERIES: dict[str, tuple[Plan, dict[str, str]]] = {}


def _register(*plans: Plan, **renamed: str) -> None:
    for p in plans:
        QUERIES[p.name] = (p, {t: renamed.get(t, t) for t in p.tables})


_register(
    sequences.alignment_summary, sequences.char_fractions, sequences.constant_sites, sequences.nucleotide_diversity, sequences.site_patterns,
    sequences.missing_sites, sequences.site_ranges, sequences.base_sequence, sequences.tip_classes, sequences.unresolved_fraction,
    sequences.site_weights, sequences.site_classes, sequences.without_missing_columns,
)
_register(
    records.fasta_records, records.fasta_split, records.date_bounds, records.date_ranges, records.taxon_headers, records.ambiguous_filter, records.first_wins,
    records.last_wins, records.duplicate_ids, records.metadata_join, records.missing_accessions, records.alias_smallest, records.sample_until,
    records.render_traits, records.render_alignment, records.write_fasta, records.xml_values, records.json_values,
)
_register(
    trees.closure_rows, trees.mrca, trees.tree_length, trees.lineages_through_time, trees.hazard_events, trees.hazard_log_density, trees.clades,
    trees.rf_distance, trees.unrooted_splits, trees.node_bounds, trees.decay_rate, trees.interval_scaled, trees.subtree_choice,
)
_register(
    history.linked_mutations, history.branch_split, history.branch_join, history.mutation_count, history.transition_counts, history.link_violations,
    history.state_at_node, history.path_changes, history.differing_sites, history.map_times, history.branch_regions, history.region_weights, history.region_stab,
    history.site_replace, history.time_bounds, history.unconstrained_nodes, history.tip_missing_sites,
)
_register(trees.node_ratios, stats="moved_stats")
for _p in (history.mutation_count, history.differing_sites, history.missing_clade_regions, trees.clades, trees.rf_distance, trees.unrooted_splits, trees.node_ratios.given(whole=False), trees.subtree_choice, parsimony.fitch_scores):
    QUERIES[f"leaf_first_{_p.name}"] = (_p, {t: t if t == "reference" else f"leaf_first_{t}" for t in _p.tables})
_register(trees.rf_between, other="other_clades")
QUERIES["merged_intervals"] = (tree_samples.interval_rows, {"events": "tree_events"})
_register(convergence.param_times, convergence.run_times, convergence.run_summary, convergence.param_slowness, convergence.method_speedup, convergence.least_param, convergence.remaining_samples)
_register(likelihood.branch_stats, likelihood.path_density, likelihood.compatible_end_density)
_register(likelihood.hybrid_branch_density, stats="branch_sums")
_register(likelihood.rounded_partials, likelihood.site_likelihood)
_register(history.set_root_states, sequences.without_gap_columns, traces.mean_by_experiment, traces.stats_join)
_register(traces.cleaned_trace, trace="merged_trace")
_register(parsimony.fitch_site_filter, scores="fitch_roots")
_register(traces.ess_curve, traces.converged_at)
_register(tree_samples.clade_flips, tree_samples.topology_changes, clades="tree_log", trees="tree_numbers")
_register(history.violations, mut="broken", carried="broken_carried")
_register(history.history_distance, other_carried="broken_carried")
_register(history.list_violations, listed="broken_list")
_register(carries.total_rate_on_branch)
_register(history.missing_clade_regions, trees.time_change, trees.spline_integral, traces.average_ranks, traces.remaining_time)
_register(kernels.categorical_pick, records.cigar_project)
_register(parsimony.fitch_scores, parsimony.fitch_rows, parsimony.excess_mutations)
_register(density.genetic_prior, density.category_posterior, density.transition_probs, density.jc_branch_density, density.dwell_times)
_register(
    traces.burnin_rows, traces.burnin_value, traces.prefix_points, traces.ess_by_lags, traces.first_stable, traces.convergence_summary,
    traces.relative_to_slowest, traces.relative_stats, traces.timing_speedup, traces.describe_by_seed, traces.load_bins, traces.clade_refresh, traces.running_moments,
    traces.batch_means, traces.thinned, traces.interpolated, traces.normal_equations, traces.gamma_fit, traces.operator_rollup, traces.ess_per_cost, traces.config_means,
    traces.config_grid, traces.minutes_text,
)


_register(refresh.clade_refreshes, stems="stem_log", samples="tree_states")
_register(refresh.refresh_bins, refresh.loaded_share)
_register(hazards.exposure_pieces, hazards.join_events, hazards.tree_hazard_density, hazards.warped_time, hazards.hat_design, hazards.ridge_sums)
QUERIES["birth_hazard_density"] = (hazards.tree_hazard_density.given(hazard="birth_death", intercept=0.5), {"node": "leaf_first_node"})
_register(ratios.ratio_rows, ratios.node_classes, ratios.odds_fit)
QUERIES["root_ratio_rows"] = (ratios.ratio_rows, {"ratios": "root_ratios"})
_register(history.replaced_sites, branch_histories.end_states)
_register(history.mapped_events, history.mapping_jacobian, linked="listed")
for _kind in ("uniform", "parsimony", "missing"):
    QUERIES[f"{_kind}_site_weights"] = (sequences.selection_weights.given(kind=_kind), {"masked": "masked", "scores": "site_scores"})
_register(sequences.pattern_of_site, trees.rated_length, configurations.setting_violations)
_register(records.wanted_aliases, records.trait_lists, records.imputed_in_order)
QUERIES |= {"field_ids": (records.field_ids.given(field=1), {"taxon": "taxon"}), "first_words": (records.field_ids, {"taxon": "taxon"})}


def _needs(names: tuple[str, ...], known: dict) -> list[str]:
    out: list[str] = []

    def add(name: str) -> None:
        if name in known and name not in out:
            for x in known[name][0]:
                add(x)
            out.append(name)

    for name in names:
        add(name)
    return out


# Views that are made once for a query, as tables: what is exploded looks as small to Spark as what it comes from, and would be sent to every executor.
# Tips are a row for each tree, which doesn't show in the size of the table that they are counted in.
MADE = ("tips", "placed", "mut", "tip_state", "sample_tip_state")


# Tables of plans that are met by merging: levels of sweeps are packed files, which look small enough to be sent to every executor.
MERGED = {("violations", "carried"), ("differing_sites", "carried")}
# Of these, those that are dealt by node to all partitions of a shuffle: as they travel packed, partitions joined up to a usual size would have millions of rows in one sort.
DEALT = {("differing_sites", "carried")}


def _merged(plan: str, name: str, df: DataFrame) -> DataFrame:
    if (plan, name) in DEALT:
        df = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "tree_id", "node")
    return df.hint("merge") if (plan, name) in MERGED else df


class Domain:
    """The views over the Parquet tables of sf_dir, as DataFrames. Those that are made, by sweeps or as tables, are made once, and the texts of the others read them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        for t in DRIVER_TABLES:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
        self.spark, self.known, self.done = spark, views(SPARK) | more_views(SPARK), {}
        self.ways: dict[str, Callable[[], DataFrame]] = {
            "node": lambda: sized(self._text("node")), "sample_tree": lambda: sized(self._text("sample_tree")),
            "closure": lambda: cut(trees.ancestor_closure(self.table("node"))), "leaf_first_closure": lambda: cut(trees.ancestor_closure(self.table("leaf_first_node"))),
            # along the tree, in place of a join with all ancestors
            "above": lambda: cut(carries.sums_of_sites(self.table("node"), self.table("branch_inc"))),
            "fitch_roots": lambda: parsimony.fitch_scores(**self("fitch", "node")),
            # a row for each node: as levels they are packed files, which look small enough to be sent to every executor
            "below": lambda: sized(carries.lengths_below(self.table("node"))), "branch_rates": lambda: sized(carries.branch_rates(**self("node", "mut", "reference", "rate"))),
            "param_trajectory": lambda: convergence.param_trajectory(self.table("param_trace")),
            "param_times": lambda: convergence.param_times.given(target=40.0)(**self("param_trajectory", "cost")), "run_times": lambda: convergence.run_times(**self("param_times")),
            "partials": lambda: likelihood.partial_likelihoods(*self("node", "tip_state", "branch_rate", "site_category").values()), "trajectory": lambda: traces.ess_trajectory(self.table("trace")),
            "ess": lambda: traces.ess_by_blocks(self.table("trace")),
            "broken_carried": lambda: carries.states(*self("node", "broken").values()),
        }
        for first in ("", "leaf_first_"):
            self.ways |= {
                f"{first}fitch": lambda x=first: parsimony.fitch_sets(*self(f"{x}node", f"{x}tip_state").values()), f"{first}carried": lambda x=first: carries.states(*self(f"{x}node", f"{x}mut").values()),
                f"{first}stats": lambda x=first: sized(carries.subtree_stats(*self(f"{x}node", f"{x}mut").values())),
            }

    def __call__(self, *names: str) -> dict[str, DataFrame]:
        return {x: self.table(x) for x in names}

    def table(self, name: str) -> DataFrame:
        if name not in self.done:
            self.done[name] = self.ways[name]() if name in self.ways else cut(self._text(name)) if name in MADE else self._text(name) if name in self.known else self.spark.table(name)
        return self.done[name]

    def _text(self, name: str) -> DataFrame:
        heads, given = {}, {}

        def add(x: str) -> None:
            if x in heads or x not in self.known:
                return
            if x != name and (x in self.ways or x in MADE):
                given[x] = self.table(x)
                heads[x] = f"SELECT * FROM {{{x}}}"
                return
            for y in self.known[x][0]:
                add(y)
            heads[x] = self.known[x][1].replace("{", "{{").replace("}", "}}")

        add(name)
        return self.spark.sql(f"WITH {', '.join(f'{x} AS ({text})' for x, text in heads.items())} SELECT * FROM {name}", **given)


def domain(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    """The named views as DataFrames over the Parquet tables of sf_dir."""
    return Domain(spark, sf_dir)(*names)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def runner(p: Plan, names: dict[str, str]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            tables = domain(spark, sf_dir, *names.values())
            return p(**{t: _merged(p.name, t, tables[v]) for t, v in names.items()})

        return run

    out = {name: runner(*x) for name, x in QUERIES.items()}
    out["trace_ess"] = lambda spark, sf_dir: traces.trace_ess(domain(spark, sf_dir, "trace")["trace"])
    out["tracer_ess"] = lambda spark, sf_dir: traces.tracer_ess(domain(spark, sf_dir, "trace")["trace"])
    out["ess_by_lags"] = lambda spark, sf_dir: domain(spark, sf_dir, "ess")["ess"]
    out["tree_ess"] = lambda spark, sf_dir: tree_samples.tree_ess(domain(spark, sf_dir, "tree_log")["tree_log"])
    out["joint_intervals"] = lambda spark, sf_dir: tree_samples.merged_intervals(domain(spark, sf_dir, "node")["node"], 0.4)
    out["ess_trajectory"] = lambda spark, sf_dir: domain(spark, sf_dir, "trajectory")["trajectory"]

    def fitch_states(spark: SparkSession, sf_dir: str) -> DataFrame:
        return parsimony.fitch_states(**fitch_tables(spark, sf_dir))

    def fitch_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
        t = domain(spark, sf_dir, "node", "fitch", "reference")
        return {"node": t["node"], "sets": t["fitch"], "reference": t["reference"]}

    def parsimony_events(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = fitch_tables(spark, sf_dir)
        return parsimony.parsimony_events(t["node"], parsimony.fitch_states(**t))

    def parsimony_history(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = fitch_tables(spark, sf_dir)
        reference, events = parsimony.parsimony_history(t["node"], parsimony.fitch_states(**t))
        rooted = reference.selectExpr("tree_id", "CAST(NULL AS BIGINT) AS node", "CAST(NULL AS DOUBLE) AS time", "site", "CAST(NULL AS BIGINT) AS old_state", "state AS new_state")
        return rooted.unionByName(events)

    def removal_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = domain(spark, sf_dir, "node", "tip_state")
        return tip_removal.removal_scores(t["node"], t["tip_state"])

    def removal_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = domain(spark, sf_dir, "sample_node", "sample_tip_state", "sampled", "weight")
        removed = tip_removal.removal_scores(t["sample_node"], t["sample_tip_state"])
        return tip_removal.removal_trace.given(burnin=0.1, thinning=2)(removed=removed, sampled=t["sampled"], weight=t["weight"])

    def tip_removal_ess(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tip_removal.tip_removal_ess(removal_trace(spark, sf_dir))

    def close_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = domain(spark, sf_dir, "few_sites", "base")
        return neighbours.close_classes(t["few_sites"], t["base"])

    def classes_two_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = domain(spark, sf_dir, "few_sites", "base")
        return neighbours.close_classes(t["few_sites"], t["base"], 2)

    def tip_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = domain(spark, sf_dir, "few_sites", "base")
        return neighbours.tip_neighbours(t["few_sites"], t["base"])

    def history_density(spark: SparkSession, sf_dir: str) -> DataFrame:
        return likelihood.history_density(**domain(spark, sf_dir, "node", "mut", "reference", "branch_rate", "site_category"))

    def applied_configurations(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = domain(spark, sf_dir, "base_operator", "base_attribute", "configuration", "removed_operator", "changed_attribute", "added_operator", "added_attribute")

        def maps(rows: DataFrame, *keys: str) -> DataFrame:
            return rows.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("attributes"))

        base = t["base_operator"].join(maps(t["base_attribute"], "operator"), "operator")
        added = t["added_operator"].join(maps(t["added_attribute"], "config", "operator"), ["config", "operator"])
        out = configurations.apply_configurations(base, t["configuration"].select("config", "model"), t["removed_operator"], maps(t["changed_attribute"], "config", "operator"), added)
        return out.select("config", "place", "operator", "spec", configurations.attributes_text().alias("attributes"))

    out["param_trajectory"] = lambda spark, sf_dir: domain(spark, sf_dir, "param_trajectory")["param_trajectory"]
    out["applied_configurations"] = applied_configurations

    def explored_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = domain(spark, sf_dir, "node", "mut", "carried", "reference", "chosen", "shortcut")
        found = regions.attachment_regions(t["node"], t["mut"], t["carried"], t["reference"], t["chosen"])
        return regions.explore(found, t["node"], t["chosen"], 2, t["shortcut"])

    def upgma_site_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
        return parsimony.fitch_site_filter(scores=clustering.upgma_scores(domain(spark, sf_dir, "masked")["masked"], 100))

    def ratio_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = domain(spark, sf_dir, "node", "stats", "ratios")
        top = t["node"].where("parent IS NULL").join(t["stats"], ["tree_id", "node"]).selectExpr("tree_id", "oldest_tip + (height - oldest_tip) * 1.25D AS height")
        return ratios.heights_from_ratios(t["node"], t["ratios"], top).select("tree_id", "node", F.round("height", 6).alias("height"), F.round("log_jacobian", 6).alias("log_jacobian"))

    def sorted_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = domain(spark, sf_dir, "node", "mut", "carried", "reference", "chosen")
        return regions.sorted_regions(t["node"], t["mut"], t["carried"], t["reference"], t["chosen"], 3)

    def branch_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = domain(spark, sf_dir, "node", "mut", "reference", "site_category", "branch_rate")
        states = cut(carries.states_of_sites(t["node"], t["mut"]))
        differing = t["mut"].groupBy("tree_id", "node", "site").agg(F.max_by("old_state", "time").alias("start_state"), F.min_by("new_state", "time").alias("end_state")).where("start_state <> end_state")
        return branch_histories.branch_histories(t["node"], differing, states, t["reference"], t["site_category"], t["branch_rate"], hky((0.1, 0.2, 0.3, 0.4), 2.0).tolist(), (0.1, 0.2, 0.3, 0.4), (0.01, 0.02, 0.04, 0.08))

    def exact_history(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = domain(spark, sf_dir, "node", "tip_state")
        return branch_histories.exact_histories(t["node"], t["tip_state"], hky((0.1, 0.2, 0.3, 0.4), 2.0).tolist(), (0.1, 0.2, 0.3, 0.4))[1]

    def removal_description(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tip_removal.removal_description(sizes=cut(tip_removal_ess(spark, sf_dir)))

    def sloped_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = domain(spark, sf_dir, "node", "mut")
        rows = trees.node_bounds(node=t["node"], mut=t["mut"]).where("upper IS NOT NULL").selectExpr("tree_id", "node", "1.0D AS decay", "lower", "upper")
        return tilted.sample_sloped(rows, ["tree_id", "node"], trees.SLOPES)

    out |= {"removal_description": removal_description, "sloped_heights": sloped_heights}
    out["ratio_heights"] = ratio_heights
    out |= {"sorted_regions": sorted_regions, "branch_paths": branch_paths, "exact_history": exact_history}
    out |= {"explored_regions": explored_regions, "upgma_site_filter": upgma_site_filter, "upgma_tree": lambda spark, sf_dir: clustering.upgma_tree(domain(spark, sf_dir, "masked")["masked"], 100)}
    out["path_changes"] = lambda spark, sf_dir: carries.path_changes(**domain(spark, sf_dir, "node", "mut"))
    out["subtree_stats"] = lambda spark, sf_dir: domain(spark, sf_dir, "stats")["stats"]
    out |= {"history_density": history_density, "close_classes": close_classes, "classes_two_apart": classes_two_apart, "tip_neighbours": tip_neighbours}
    return out | {"fitch_states": fitch_states, "parsimony_events": parsimony_events, "parsimony_history": parsimony_history, "removal_scores": removal_scores, "tip_removal_ess": tip_removal_ess}


def oracle_sql() -> dict[str, str]:
    known = views(ANSI) | more_views(ANSI)

    def text(names: tuple[str, ...], body: str) -> str:
        """body over the named views, with what is computed by other means than plans on the side of Spark."""
        order = _needs(names, known)
        heads = [f"{x} AS ({known[x][1]})" for x in order]
        if {"fitch", "fitch_roots"} & set(names):
            heads += [f"{x} AS ({known[x][1]})" for x in _needs(("node", "tip_state"), known) if x not in order] + [parsimony.fitch_text(ANSI)]
            heads += [f"{x} AS ({known[x][1]})" for x in _needs(("node",), known) if not any(h.startswith(f"{x} AS") for h in heads)]
            heads.append(f"fitch_roots AS ({parsimony.fitch_scores.text(ANSI).format(fitch='fitch', node='node')})")
        if "partials" in names:
            heads += [f"{x} AS ({known[x][1]})" for x in _needs(("node", "tip_state", "branch_rate", "site_category"), known) if x not in order] + [f"partials AS ({likelihood.partials_text()})"]
        if {"param_trajectory", "param_times", "run_times"} & set(names):
            heads += [f"{x} AS ({known[x][1]})" for x in _needs(("param_trace", "cost"), known) if x not in order] + [f"param_trajectory AS ({convergence.param_trajectory_text('param_trace')})"]
            heads.append(f"param_times AS ({convergence.param_times.given(target=40.0).text(ANSI).format(param_trajectory='param_trajectory', cost='cost')})")
            heads.append(f"run_times AS ({convergence.run_times.text(ANSI).format(param_times='param_times')})")
        if "trajectory" in names:
            heads += [f"trace AS ({known['trace'][1]})"] * ("trace" not in order) + [f"trajectory AS ({traces.trajectory_text().format(trace='trace')})"]
        return f"WITH {', '.join(heads)} SELECT * FROM ({body}) final_rows" if heads else body

    out = {name: text(tuple(names.values()), p.text(ANSI).format(**names)) for name, (p, names) in QUERIES.items() if name != "leaf_first_fitch_scores"}
    out["leaf_first_fitch_scores"] = out["fitch_scores"]  # scores don't depend on how nodes are numbered
    out["ess_trajectory"] = text(("trajectory",), "SELECT * FROM trajectory")
    for name, most in (("close_classes", 1), ("classes_two_apart", 2)):
        out[name] = text(("few_sites", "base"), f"WITH {neighbours.close_text(most).replace('FROM masked m', 'FROM few_sites m')} SELECT dataset, a, b, distance FROM close")
    out["tip_neighbours"] = text(("few_sites", "base"), neighbours.neighbours_text(1).replace("FROM masked m", "FROM few_sites m"))
    out["history_density"] = text(("node", "mut", "reference", "branch_rate", "site_category"), likelihood.history_text())
    out["param_trajectory"] = text(("param_trajectory",), "SELECT * FROM param_trajectory")
    out["applied_configurations"] = text(("base_operator", "base_attribute", "configuration", "removed_operator", "changed_attribute", "added_operator", "added_attribute"), configurations.applied_text())
    out["joint_intervals"] = text(("node",), tree_samples.interval_rows.text(ANSI).format(events=f"({tree_samples.joint_events_text(0.4)})"))
    states = f"({parsimony.fitch_states_text()})"
    events, rooted = parsimony.placed_events, parsimony.rebased_reference.text(ANSI).format(states=states, node="node")
    out["parsimony_events"] = text(("node", "fitch", "reference"), events.text(ANSI).format(states=states, node="node"))
    below = events.given(above=False).text(ANSI).format(states=states, node="node")
    out["parsimony_history"] = text(("node", "fitch", "reference"), f"SELECT tree_id, NULL AS node, NULL AS time, site, NULL AS old_state, state AS new_state FROM ({rooted}) r UNION ALL SELECT tree_id, node, time, site, old_state, new_state FROM ({below}) b")
    out["explored_regions"] = text(("node", "mut", "carried", "reference", "chosen", "shortcut"), regions.explored_text(2))
    out["subtree_stats"] = text(("stats",), "SELECT * FROM stats")
    out["sorted_regions"] = text(("node", "mut", "carried", "reference", "chosen"), regions.sorted_text(3))
    out["ratio_heights"] = text(("node", "stats", "ratios"), ratios.heights_text("oldest", 1.25))
    out["tracer_ess"] = out["ess_by_lags"]
    out["removal_scores"] = text(("node", "tip_state"), tip_removal.removal_text())
    of_samples = tip_removal.removal_text().replace("tip_state t", "sample_tip_state t").replace(" node n ", " sample_node n ").replace("FROM node", "FROM sample_node")
    series = tip_removal.removal_trace.given(burnin=0.1, thinning=2).text(ANSI).format(removed=f"({of_samples})", sampled="sampled", weight="weight")
    by_lags = traces.ess_by_lags.text(ANSI)
    out["tip_removal_ess"] = text(("sample_node", "sample_tip_state", "sampled", "weight"), f"WITH series AS ({series}) {tip_removal.removal_ess_text('series', lambda source: by_lags.format(trace=source))}")
    sizes = f"({tip_removal.removal_ess_text('series', lambda source: by_lags.format(trace=source))})"
    out["removal_description"] = text(("sample_node", "sample_tip_state", "sampled", "weight"), f"WITH series AS ({series}) {tip_removal.removal_description.text(ANSI).format(sizes=sizes)}")
    out["fitch_states"] = text(("node", "fitch", "reference"), parsimony.fitch_states_text())
    return out
