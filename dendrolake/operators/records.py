"""Sequence records, headers, partial dates, metadata joins."""

from __future__ import annotations

from ..plans.plan import Dialect, plan


@plan("lines")
def fasta_records(d: Dialect) -> str:
    """lines(file, line_no, line) -> records: `>` starts one, lines are stripped and joined, text before the first
    header is discarded, a record without lines has an empty sequence."""
    strip = d.replace_all("line", r"^\s+|\s+$", "")
    return f"""WITH s AS (SELECT file, line_no, {strip} AS line FROM {{lines}}),
      n AS (SELECT file, line_no, line, sum(CASE WHEN line LIKE '>%' THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS record FROM s)
      SELECT file, CAST(record AS BIGINT) AS record, max(CASE WHEN line LIKE '>%' THEN substring(line, 2) END) AS header,
        coalesce({d.listagg("CASE WHEN line LIKE '>%' THEN NULL ELSE line END", "", "line_no")}, '') AS sequence
      FROM n WHERE record > 0 GROUP BY file, record"""


@plan("parts")
def fasta_split(d: Dialect) -> str:
    """parts(file, line_no, line), a file split at every `>`: the first part is discarded, the header goes up to
    the line end, line ends are removed from the rest. Unlike records by line, a `>` inside a header splits."""
    return """SELECT file, line_no AS record, CASE WHEN strpos(line, chr(10)) > 0 THEN substring(line, 1, strpos(line, chr(10)) - 1) ELSE line END AS header,
        CASE WHEN strpos(line, chr(10)) > 0 THEN replace(substring(line, strpos(line, chr(10)) + 1), chr(10), '') ELSE '' END AS sequence
      FROM {parts} WHERE line_no > 0""".replace("strpos(line, chr(10))", "instr(line, chr(10))")


def _bounds(d: Dialect, raw: str) -> tuple[str, str]:
    year, month, day = (f"CAST(substring({raw}, {a}, {n}) AS INT)" for a, n in ((1, 4), (6, 2), (9, 2)))
    size = f"length({raw})"
    lo = f"make_date({year}, CASE WHEN {size} >= 7 THEN {month} ELSE 1 END, CASE WHEN {size} >= 10 THEN {day} ELSE 1 END)"
    hi = f"CASE WHEN {size} >= 10 THEN {lo} WHEN {size} >= 7 THEN last_day({lo}) ELSE make_date({year}, 12, 31) END"
    return lo, hi


@plan("taxon")
def date_bounds(d: Dialect) -> str:
    """First and last day of a partial date, its ISO form, and a day drawn between them by the record's name
    alone, so that it doesn't depend on other records."""
    lo, hi = _bounds(d, "raw_date")
    span = d.days("hi", "lo")
    return f"""WITH b AS (SELECT doc_id, header, raw_date, {lo} AS lo, {hi} AS hi FROM {{taxon}})
      SELECT doc_id, raw_date, {d.iso("lo")} AS lo, {d.iso("hi")} AS hi, {d.iso(d.plus_days("lo", f"{d.hash32('header')} % ({span} + 1)"))} AS imputed FROM b"""


@plan("taxon")
def date_ranges(d: Dialect, upto: str = "2025-12") -> str:
    """Ranges `a/b`, from a row's date to a given one: from the first day of a to the last of b."""
    first, last = _bounds(d, "a")[0], _bounds(d, "b")[1]
    return f"""WITH r AS (SELECT doc_id, concat(raw_date, '/', '{upto}') AS raw FROM {{taxon}}),
      p AS (SELECT doc_id, raw, split_part(raw, '/', 1) AS a, split_part(raw, '/', 2) AS b FROM r)
      SELECT doc_id, raw, {d.iso(first)} AS lo, {d.iso(last)} AS hi FROM p"""


@plan("taxon")
def taxon_headers(d: Dialect) -> str:
    """The parts of a header: date after the last bar, id up to the first bar or blank, id without version in
    both readings (last suffix dropped, everything from the first dot dropped), alias, and a clean name."""
    return f"""SELECT doc_id, header, {d.extract("header", "[^|]*$", 0)} AS header_date, {d.extract("header", r"^[^\s|]*", 0)} AS id,
        {d.replace_all("concat(header, '.1')", r"\.[^.]*$", "")} AS without_last, split_part(concat(header, '.1.2'), '.', 1) AS before_first,
        concat('COG-UK/', split_part(header, '_', 2)) AS alias,
        coalesce(nullif({d.replace_all("header", "[^A-Za-z0-9]+", "")}, ''), 'dataset') AS clean FROM {{taxon}}"""


@plan("taxon")
def ambiguous_filter(d: Dialect, most: float = 0.05) -> str:
    """Records of which at most a share of the characters is N, a twentieth unless told otherwise."""
    return f"""SELECT doc_id, length(seq) AS length, length(seq) - length(replace(seq, 'N', '')) AS n FROM {{taxon}}
      WHERE length(seq) > 0 AND (length(seq) - length(replace(seq, 'N', ''))) / CAST(length(seq) AS DOUBLE) <= {most!r}"""


@plan("metadata")
def first_wins(d: Dialect) -> str:
    """The first row of each accession without version, its date up to the first blank."""
    return """SELECT id, date FROM (SELECT split_part(id, '.', 1) AS id, split_part(raw_date, ' ', 1) AS date,
      row_number() OVER (PARTITION BY split_part(id, '.', 1) ORDER BY line_no) AS nth FROM {metadata}) r WHERE nth = 1"""


@plan("metadata")
def last_wins(d: Dialect) -> str:
    """The last row of each id."""
    return "SELECT id, max(line_no) AS line_no, max_by(raw_date, line_no) AS date FROM {metadata} GROUP BY id"


@plan("metadata")
def duplicate_ids(d: Dialect) -> str:
    """Ids with more than one row, which a strict reader refuses."""
    return "SELECT id, count(*) AS n, min(line_no) AS first_line FROM {metadata} GROUP BY id HAVING count(*) > 1"


@plan("wanted", "metadata")
def metadata_join(d: Dialect) -> str:
    """wanted(id) with the date of its id, else of the id without version; an empty date falls through as
    well; unmatched ids keep a null."""
    return """WITH m AS (SELECT id, min(raw_date) AS raw_date FROM {metadata} GROUP BY id),
      base AS (SELECT split_part(id, '.', 1) AS id, min(raw_date) AS raw_date FROM {metadata} GROUP BY split_part(id, '.', 1))
      SELECT w.id, coalesce(nullif(a.raw_date, ''), nullif(b.raw_date, '')) AS date,
        w.id || '|' || coalesce(nullif(a.raw_date, ''), nullif(b.raw_date, '')) AS name
      FROM {wanted} w LEFT JOIN m a ON w.id = a.id LEFT JOIN base b ON split_part(w.id, '.', 1) = b.id"""


@plan("wanted", "metadata")
def missing_accessions(d: Dialect) -> str:
    """Wanted ids that the metadata doesn't have."""
    return "SELECT w.id FROM {wanted} w LEFT ANTI JOIN {metadata} m ON split_part(w.id, '.', 1) = split_part(m.id, '.', 1)" if d.spark else (
        "SELECT w.id FROM {wanted} w ANTI JOIN {metadata} m ON split_part(w.id, '.', 1) = split_part(m.id, '.', 1)")


@plan("metadata")
def alias_smallest(d: Dialect) -> str:
    """Alias -> sample -> sequence; of several sequences of an alias the smallest accession."""
    return """WITH sample AS (SELECT DISTINCT split_part(id, '.', 1) AS sample, concat('S', substring(split_part(id, '.', 1), 3, 2)) AS alias FROM {metadata}),
      sequence AS (SELECT DISTINCT split_part(id, '.', 1) AS sample, id AS accession FROM {metadata})
      SELECT s.alias, min(q.accession) AS accession, count(*) AS sequences FROM sample s JOIN sequence q ON s.sample = q.sample GROUP BY s.alias"""


@plan("taxon")
def sample_until(d: Dialect, most: float = 0.05, seed: int = 1, n: int | None = None) -> str:
    """The order in which records would be fetched: by a hash of seed and name, the accepted ones numbered; all, or the
    first n, as in a draw without repetition. Each of the 1024 ranges of the hash is numbered for itself, after the
    sizes of those before it, so no task holds all rows."""
    good = f"length(seq) > 0 AND (length(seq) - length(replace(seq, 'N', ''))) / CAST(length(seq) AS DOUBLE) <= {most!r}"
    keep = "" if n is None else f" WHERE nth <= {n}"
    return f"""WITH h AS (SELECT doc_id, {d.hash32(f"concat('{seed}', header)")} AS h FROM {{taxon}} WHERE {good}),
      r AS (SELECT doc_id, {d.idiv("h", "4194304")} AS part, row_number() OVER (PARTITION BY {d.idiv("h", "4194304")} ORDER BY h, doc_id) AS k FROM h),
      s AS (SELECT part, sum(count(*)) OVER (ORDER BY part) - count(*) AS before FROM r GROUP BY part)
      SELECT doc_id, nth FROM (SELECT r.doc_id, CAST(s.before + r.k AS BIGINT) AS nth FROM r JOIN s ON s.part = r.part) x{keep}"""


@plan("taxon")
def render_traits(d: Dialect) -> str:
    """`name=date` of the records of each source month, joined in order of their names."""
    return f"""SELECT substring(raw_date, 1, 4) AS dataset, {d.listagg("concat(header, '=', raw_date)", ",", "header, doc_id")} AS traits, count(*) AS n
      FROM {{taxon}} GROUP BY substring(raw_date, 1, 4)"""


@plan("taxon")
def render_alignment(d: Dialect) -> str:
    """An XML element for each record, name and sequence escaped."""
    def esc(x):
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            x = f"replace({x}, '{a}', '{b}')"
        return x
    return f"""SELECT doc_id, concat('<sequence taxon="', {esc("header")}, '" value="', {esc("seq")}, '"/>') AS element FROM {{taxon}}"""


@plan("taxon")
def write_fasta(d: Dialect) -> str:
    """The text of a record in FASTA form."""
    return "SELECT doc_id, concat('>', header, chr(10), seq, chr(10)) AS record FROM {taxon}"


@plan("pages")
def xml_values(d: Dialect) -> str:
    """Attribute values of all links of a page, in order."""
    if d.spark:
        return r"""SELECT page_id, CAST(pos AS BIGINT) AS pos, value FROM {pages} LATERAL VIEW posexplode(regexp_extract_all(html, r'href="([^"]*)"', 1)) e AS pos, value"""
    return r"""SELECT page_id, CAST(generate_subscripts(v, 1) - 1 AS BIGINT) AS pos, unnest(v) AS value FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS v FROM {pages}) x"""


@plan("events")
def json_values(d: Dialect) -> str:
    """Fields of a JSON column, null where it has none."""
    get = "get_json_object(props, '$.{0}')" if d.spark else "json_extract_string(props, '$.{0}')"
    return f"SELECT event_id, {get.replace('{0}', 'k')} AS k, {get.replace('{0}', 'page')} AS page FROM {{events}}"


@plan("aligned")
def cigar_project(d: Dialect) -> str:
    """aligned(id, cigar, seq, ref_start, ref_len) in reference coordinates: matches copy, insertions are dropped,
    deletions are gaps, what isn't covered is N."""
    if d.spark:
        ops = r"SELECT id, pos, op FROM {aligned} LATERAL VIEW posexplode(regexp_extract_all(cigar, r'\d+[A-Z=]', 0)) o AS pos, op"
    else:
        ops = r"SELECT id, generate_subscripts(o, 1) AS pos, unnest(o) AS op FROM (SELECT id, regexp_extract_all(cigar, '\d+[A-Z=]') AS o FROM {aligned}) x"
    return f"""WITH ops AS ({ops}),
      s AS (SELECT id, pos, CAST({d.extract("op", "^[0-9]+", 0)} AS INT) AS n, {d.extract("op", "[A-Z=]$", 0)} AS kind FROM ops),
      q AS (SELECT id, pos, n, kind, coalesce(sum(CASE WHEN kind IN ('M', 'I', 'S', '=', 'X') THEN n ELSE 0 END) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM s),
      p AS (SELECT q.id, q.pos, CASE WHEN kind IN ('M', '=', 'X') THEN substring(a.seq, CAST(used AS INT) + 1, n) WHEN kind IN ('D', 'N') THEN repeat('-', n) ELSE '' END AS part
        FROM q JOIN {{aligned}} a ON a.id = q.id),
      j AS (SELECT id, {d.listagg("part", "", "pos")} AS body FROM p GROUP BY id)
      SELECT a.id, concat(repeat('N', a.ref_start), j.body, repeat('N', greatest(0, a.ref_len - a.ref_start - CAST(length(j.body) AS INT)))) AS sequence FROM j JOIN {{aligned}} a ON a.id = j.id"""


@plan("taxon")
def field_ids(d: Dialect, field: int | None = None) -> str:
    """The id of a header: the field between bars with a number from zero on, blanks around it dropped, null where there is none; without a number the first word, words being apart by blanks or bars."""
    value = f"trim(split_part(header, '|', {field + 1}))" if field is not None else d.extract("trim(header)", r"^[^\s|]*", 0)
    bars = "length(header) - length(replace(header, '|', ''))"
    return f"SELECT doc_id, header, {value if field is None else f'CASE WHEN {bars} >= {field} THEN {value} END'} AS id FROM {{taxon}}"


@plan("named")
def wanted_aliases(d: Dialect, country: str = "UK", prefix: str = "COG-UK/") -> str:
    """named(name, country, date, line_no) of a study: the aliases (a prefix and the second part between slashes) of a country's dated samples; of several rows of an alias the last one stays. Names without a second part have no alias."""
    return f"""SELECT alias, max_by(name, line_no) AS name, max_by(date, line_no) AS date, count(*) AS n FROM (SELECT concat('{prefix}', split_part(name, '/', 2)) AS alias, name, date, line_no FROM {{named}}
      WHERE country = '{country}' AND date <> '' AND name LIKE '%/%') x GROUP BY alias"""


@plan("taxon")
def trait_lists(d: Dialect) -> str:
    """Traits of the records of each year, in the order of their ids: `name=date`, each on a line of its own, and `name=NOT_SET`, on one line."""
    dates = d.listagg("concat(header, '=', raw_date)", "@", "doc_id")
    return f"""SELECT substring(raw_date, 1, 4) AS dataset, replace({dates}, '@', concat(',', chr(10))) AS dates, {d.listagg("concat(header, '=NOT_SET')", ",", "doc_id")} AS types, count(*) AS n FROM {{taxon}} GROUP BY substring(raw_date, 1, 4)"""


@plan("bounds")
def imputed_in_order(d: Dialect, seed: int = 0) -> str:
    """bounds(dataset, position, first, last): dates drawn from first to last, the k-th dated row of a dataset by the k-th draw, whatever its id: rows without a date take none. A draw is
    a hash of seed, dataset and k, so that draws don't wait for each other; only the numbering reads a dataset in order."""
    days = d.days("last", "first")
    draw = d.hash32(f"concat('{seed}:', CAST(dataset AS {d.text}), ':', CAST(k AS {d.text}))")
    offset = d.idiv(f"{draw} * ({days} + 1)", "4294967296")
    return f"""SELECT dataset, position, k, {d.iso(d.plus_days("first", offset))} AS date, {days} > 0 AS imputed FROM (SELECT dataset, position, first, last, row_number() OVER (PARTITION BY dataset ORDER BY position) AS k FROM {{bounds}} WHERE first IS NOT NULL AND last >= first) b"""
