"""Sequence and site statistics of alignments: aln(dataset, taxon, site, ch), masked(... mask, class)."""

from __future__ import annotations

from ..plans.plan import Dialect, plan

MAX_PAIRS = 50_000


@plan("masked")
def char_fractions(d: Dialect) -> str:
    """Missing and ambiguous characters of all characters, by data set."""
    return """SELECT dataset, count(*) AS chars, count(*) FILTER (WHERE class = 'missing') AS missing,
      round(count(*) FILTER (WHERE class = 'missing') / CAST(count(*) AS DOUBLE), 6) AS missing_fraction,
      round(count(*) FILTER (WHERE class = 'ambiguous') / CAST(count(*) AS DOUBLE), 6) AS ambiguous_fraction
      FROM {masked} GROUP BY dataset"""


@plan("masked")
def constant_sites(d: Dialect) -> str:
    """Sites at which all taxa have the same of A, C, G, T."""
    return """SELECT dataset, site, min(ch) AS ch FROM {masked} GROUP BY dataset, site
      HAVING min(ch) = max(ch) AND min(class) = 'nucleotide' AND max(class) = 'nucleotide'"""


@plan("masked")
def alignment_summary(d: Dialect) -> str:
    """One row for each data set: taxa, lengths, fractions, and constant sites where lengths are equal."""
    return """WITH len AS (SELECT dataset, taxon, count(*) AS n FROM {masked} GROUP BY dataset, taxon),
      size AS (SELECT dataset, count(*) AS taxa, min(n) AS min_length, max(n) AS max_length FROM len GROUP BY dataset),
      chars AS (SELECT dataset, avg(CASE WHEN class = 'missing' THEN 1.0E0 ELSE 0.0E0 END) AS missing, avg(CASE WHEN class = 'ambiguous' THEN 1.0E0 ELSE 0.0E0 END) AS ambiguous
        FROM {masked} GROUP BY dataset),
      same AS (SELECT dataset, site FROM {masked} GROUP BY dataset, site HAVING min(ch) = max(ch) AND min(class) = 'nucleotide' AND max(class) = 'nucleotide'),
      fixed AS (SELECT dataset, count(*) AS constant FROM same GROUP BY dataset)
      SELECT s.dataset, s.taxa, s.min_length, s.max_length, round(c.missing, 6) AS missing_fraction, round(c.ambiguous, 6) AS ambiguous_fraction,
        CASE WHEN s.min_length = s.max_length THEN coalesce(f.constant, 0) END AS constant_sites
      FROM size s JOIN chars c ON s.dataset = c.dataset LEFT JOIN fixed f ON s.dataset = f.dataset"""


@plan("masked")
def nucleotide_diversity(d: Dialect) -> str:
    """Mean share of differing sites, over pairs of taxa, of the sites where both have a nucleotide. All pairs
    up to MAX_PAIRS; beyond, MAX_PAIRS pairs drawn with replacement by a hash of their number. Pairs are made
    from their numbers, so that no product of taxa is formed."""
    half = d.idiv("n * (n - 1)", "2")
    # of pair k among all: j is the largest with j (j - 1) / 2 <= k
    guess = "CAST(floor((1 + sqrt(1 + 8.0E0 * k)) / 2) AS BIGINT)"
    pick = f"""SELECT dataset, k, n, all_pairs,
        CASE WHEN all_pairs <= {MAX_PAIRS} THEN {guess} ELSE {d.hash32(f"concat('i', CAST(k AS {d.text}))")} % n END AS a,
        CASE WHEN all_pairs <= {MAX_PAIRS} THEN 0 ELSE {d.hash32(f"concat('j', CAST(k AS {d.text}))")} % (n - 1) END AS b FROM numbered"""
    return f"""WITH taxa AS (SELECT dataset, taxon, row_number() OVER (PARTITION BY dataset ORDER BY taxon) - 1 AS i FROM (SELECT DISTINCT dataset, taxon FROM {{masked}}) t),
      counts AS (SELECT dataset, count(*) AS n, {half.replace('n', 'count(*)')} AS all_pairs FROM taxa GROUP BY dataset HAVING count(*) > 1),
      numbered AS ({d.series("0", f"least(all_pairs, {MAX_PAIRS}) - 1", "k", "counts", "dataset, n, all_pairs")}),
      drawn AS ({pick}),
      pairs AS (SELECT dataset, k, CASE WHEN all_pairs <= {MAX_PAIRS} THEN a ELSE b + CASE WHEN b >= a THEN 1 ELSE 0 END END AS x,
        CASE WHEN all_pairs <= {MAX_PAIRS} THEN k - {d.idiv("a * (a - 1)", "2")} ELSE a END AS y FROM drawn),
      sites AS (SELECT m.dataset, t.i, m.site, m.ch FROM {{masked}} m JOIN taxa t ON m.dataset = t.dataset AND m.taxon = t.taxon WHERE m.class = 'nucleotide'),
      per AS (SELECT p.dataset, p.k, avg(CASE WHEN a.ch <> b.ch THEN 1.0E0 ELSE 0.0E0 END) AS diff
        FROM pairs p JOIN sites a ON a.dataset = p.dataset AND a.i = p.x JOIN sites b ON b.dataset = p.dataset AND b.i = p.y AND b.site = a.site GROUP BY p.dataset, p.k)
      SELECT dataset, round(avg(diff), 6) AS pi, count(*) AS pairs FROM per GROUP BY dataset"""


@plan("masked")
def site_patterns(d: Dialect) -> str:
    """Distinct columns with at least two unambiguous states, and how many sites have each."""
    return f"""WITH cols AS (SELECT dataset, site, {d.collect("mask", "taxon")} AS pattern,
        count(DISTINCT CASE WHEN class = 'nucleotide' THEN mask END) AS states FROM {{masked}} GROUP BY dataset, site)
      SELECT dataset, pattern, count(*) AS weight, min(site) AS first_site FROM cols WHERE states >= 2 GROUP BY dataset, pattern"""


@plan("masked")
def missing_sites(d: Dialect) -> str:
    """Every site, and whether it is missing in all taxa."""
    return "SELECT dataset, site, min(mask) = 15 AS all_missing FROM {masked} GROUP BY dataset, site"


@plan("masked")
def site_ranges(d: Dialect) -> str:
    """Sites with data as 1-based ranges: consecutive sites are merged, an empty selection is 2-1."""
    return f"""WITH kept AS (SELECT dataset, site, site - row_number() OVER (PARTITION BY dataset ORDER BY site) AS island
        FROM (SELECT dataset, site FROM {{masked}} GROUP BY dataset, site HAVING min(mask) < 15) s),
      ranges AS (SELECT dataset, min(site) + 1 AS lo, max(site) + 1 AS hi FROM kept GROUP BY dataset, island),
      texts AS (SELECT dataset, lo, CASE WHEN lo = hi THEN CAST(lo AS {d.text}) ELSE concat(CAST(lo AS {d.text}), '-', CAST(hi AS {d.text})) END AS part FROM ranges),
      named AS (SELECT DISTINCT dataset FROM {{masked}})
      SELECT n.dataset, coalesce({d.listagg("t.part", ",", "t.lo")}, '2-1') AS ranges FROM named n LEFT JOIN texts t ON n.dataset = t.dataset GROUP BY n.dataset"""


@plan("masked", "reference")
def base_sequence(d: Dialect) -> str:
    """The most common single state of each site; ties go to the reference state, then the lowest."""
    return """WITH c AS (SELECT dataset, site, mask, count(*) AS n FROM {masked} WHERE class = 'nucleotide' GROUP BY dataset, site, mask),
      s AS (SELECT dataset, site, n, CASE mask WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 4 THEN 2 ELSE 3 END AS state FROM c),
      r AS (SELECT s.dataset, s.site, s.state, s.n, row_number() OVER (PARTITION BY s.dataset, s.site
        ORDER BY s.n DESC, CASE WHEN s.state = f.state THEN 0 ELSE 1 END, s.state) AS nth FROM s LEFT JOIN {reference} f ON s.site = f.site)
      SELECT dataset, site, CAST(state AS BIGINT) AS state, n FROM r WHERE nth = 1"""


@plan("masked")
def tip_classes(d: Dialect) -> str:
    """Taxa with identical data: differences from the column's commonest mask, as one key."""
    return f"""WITH c AS (SELECT dataset, site, mask, count(*) AS n FROM {{masked}} GROUP BY dataset, site, mask),
      base AS (SELECT dataset, site, mask FROM (SELECT dataset, site, mask, row_number() OVER (PARTITION BY dataset, site ORDER BY n DESC, mask) AS nth FROM c) r WHERE nth = 1),
      diffs AS (SELECT m.dataset, m.taxon, m.site, m.mask FROM {{masked}} m JOIN base b ON m.dataset = b.dataset AND m.site = b.site WHERE m.mask <> b.mask),
      taxa AS (SELECT DISTINCT dataset, taxon FROM {{masked}}),
      keys AS (SELECT t.dataset, t.taxon, coalesce({d.listagg(f"concat(CAST(x.site AS {d.text}), ':', CAST(x.mask AS {d.text}))", ",", "x.site")}, '') AS data
        FROM taxa t LEFT JOIN diffs x ON t.dataset = x.dataset AND t.taxon = x.taxon GROUP BY t.dataset, t.taxon)
      SELECT dataset, data, min(taxon) AS class_id, count(*) AS members FROM keys GROUP BY dataset, data"""


@plan("masked")
def unresolved_fraction(d: Dialect) -> str:
    """Share of taxa with more than one compatible state, by site."""
    return "SELECT dataset, site, round(avg(CASE WHEN bit_count(mask) > 1 THEN 1.0E0 ELSE 0.0E0 END), 6) AS unresolved FROM {masked} GROUP BY dataset, site"


@plan("masked")
def site_weights(d: Dialect) -> str:
    """Selection weights of sites, one and their unresolved share, with cumulative weight and probability."""
    return """WITH w AS (SELECT dataset, site, 1 + sum(CASE WHEN bit_count(mask) > 1 THEN 1.0E0 ELSE 0.0E0 END) / count(*) AS weight FROM {masked} GROUP BY dataset, site)
      SELECT dataset, site, round(weight, 6) AS weight, round(sum(weight) OVER (PARTITION BY dataset ORDER BY site ROWS UNBOUNDED PRECEDING), 6) AS cumulative,
        round(weight / sum(weight) OVER (PARTITION BY dataset), 6) AS probability FROM w"""


@plan("masked")
def site_classes(d: Dialect) -> str:
    """Cells of each site by class, and both kinds of mask: exact, and coarse (all but A, C, G, T allow all)."""
    return """SELECT dataset, site, class, count(*) AS n, CAST(sum(mask) AS BIGINT) AS exact_masks,
      CAST(sum(CASE WHEN class = 'nucleotide' THEN mask ELSE 15 END) AS BIGINT) AS coarse_masks FROM {masked} GROUP BY dataset, site, class"""


@plan("aln")
def without_missing_columns(d: Dialect) -> str:
    """Each taxon's sequence without the sites at which no taxon has data (N, ? or -)."""
    return f"""WITH kept AS (SELECT dataset, site FROM {{aln}} GROUP BY dataset, site HAVING max(CASE WHEN ch IN ('N', '?', '-') THEN 0 ELSE 1 END) = 1)
      SELECT a.dataset, a.taxon, {d.listagg("a.ch", "", "a.site")} AS sequence, count(*) AS length
      FROM {{aln}} a JOIN kept k ON a.dataset = k.dataset AND a.site = k.site GROUP BY a.dataset, a.taxon"""


@plan("aln")
def without_gap_columns(d: Dialect) -> str:
    """Each taxon's sequence without the columns in which all taxa have a gap."""
    return f"""WITH kept AS (SELECT dataset, site FROM {{aln}} GROUP BY dataset, site HAVING max(CASE WHEN ch = '-' THEN 0 ELSE 1 END) = 1)
      SELECT a.dataset, a.taxon, {d.listagg("a.ch", "", "a.site")} AS sequence FROM {{aln}} a JOIN kept k ON a.dataset = k.dataset AND a.site = k.site GROUP BY a.dataset, a.taxon"""


@plan("masked", "scores")
def selection_weights(d: Dialect, kind: str = "missing", pseudo: float = 0.1, missing: float = 1.0) -> str:
    """Weights by which sites are picked, their running sum and their chance. kind: uniform, all one; parsimony, scores(dataset, site, score) plus a pseudo count; missing, that plus a
    weight times the share of taxa with several states. Sites without a score have zero; datasets whose weights are all zero have no chance (null)."""
    if kind not in ("uniform", "parsimony", "missing"):
        raise ValueError(f"unknown kind of weights: {kind}")
    if pseudo < 0 or missing < 0:
        raise ValueError("pseudo counts and weights must not be negative")
    weight = {"uniform": "1.0E0", "parsimony": f"coalesce(s.score, 0) + {pseudo!r}E0", "missing": f"coalesce(s.score, 0) + {pseudo!r}E0 + {missing!r}E0 * u.share"}[kind]
    return f"""WITH u AS (SELECT dataset, site, avg(CASE WHEN bit_count(mask) > 1 THEN 1.0E0 ELSE 0.0E0 END) AS share FROM {{masked}} GROUP BY dataset, site),
      w AS (SELECT u.dataset, u.site, {weight} AS weight FROM u LEFT JOIN {{scores}} s ON s.dataset = u.dataset AND s.site = u.site)
      SELECT dataset, site, round(weight, 6) AS weight, round(sum(weight) OVER (PARTITION BY dataset ORDER BY site ROWS UNBOUNDED PRECEDING), 6) AS cumulative, round(weight / nullif(sum(weight) OVER (PARTITION BY dataset), 0), 6) AS chance FROM w"""


@plan("masked")
def pattern_of_site(d: Dialect) -> str:
    """The column of each site as the number of its pattern, in the order in which patterns come first, with how many sites have it."""
    return f"""WITH cols AS (SELECT dataset, site, {d.collect("mask", "taxon")} AS pattern FROM {{masked}} GROUP BY dataset, site),
      p AS (SELECT dataset, site, min(site) OVER (PARTITION BY dataset, pattern) AS first_site, count(*) OVER (PARTITION BY dataset, pattern) AS weight FROM cols)
      SELECT dataset, site, dense_rank() OVER (PARTITION BY dataset ORDER BY first_site) - 1 AS pattern, weight FROM p"""
