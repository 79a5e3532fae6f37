"""The same queries as SQL text for another engine, to hold results against."""

from __future__ import annotations

from phylospan.functions.bits import FIRST, SECOND
from phylospan.functions.sequence import AMINO_ACIDS
from phylospan.model import IndexOptions
from phylospan.operators.minimizers import PROTEIN_GROUPS
from phylospan.plans.bridges import BASES, BASES_N, HEX, SHORT

PROTEIN = IndexOptions(k=6, l=4, dna=False)
_joined = "concat_ws(' ', p_name, p_brand, p_type)"


def _dna(text: str, alphabet: str = BASES) -> str:
    return f"translate(hex({text}), '{HEX}', '{alphabet}')"


def _murmur(x: str) -> str:
    """The hash of a BIGINT expression as UBIGINT."""
    u = f"(({x})::HUGEINT & 18446744073709551615::HUGEINT)::UBIGINT"
    times = lambda v, c: f"((({v})::UHUGEINT * {c}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT"
    fold = lambda v: f"(SELECT xor(q, q >> 33) FROM (SELECT {v} AS q))"
    return fold(times(fold(times(fold(u), FIRST)), SECOND))


def _signed(u: str) -> str:
    return f"(CASE WHEN {u} >= 9223372036854775808::UBIGINT THEN ({u}::HUGEINT - 18446744073709551616::HUGEINT)::BIGINT ELSE {u}::BIGINT END)"


def _sketch(p: int = 12) -> str:
    """From ``k(own, g, key)``: the estimates of the sketches of ``g``, merged from those of ``own``, as ``done``."""
    rank = lambda w, width: f"CASE WHEN {w} = 0 THEN {width + 1} ELSE {width + 1} - length(bin({w})) END"
    more = 25 - p
    return f""",
    hashed AS (SELECT own, g, {_murmur("key + 1")} AS h FROM k),
    sl AS (SELECT own, g, (h >> 39)::BIGINT AS slot, {rank("(h & 549755813887)::BIGINT", 39)} AS rank FROM hashed),
    kinds AS (SELECT own, count(DISTINCT slot) > {1 << (p - 2)} AS dense FROM sl GROUP BY own),
    kind AS (SELECT g, bool_or(dense) AS dense, sum(n)::BIGINT AS observed FROM (SELECT g, own, count(*) AS n FROM sl GROUP BY ALL) JOIN kinds USING (own) GROUP BY g),
    low AS (SELECT g, slot >> {more} AS r, CASE WHEN slot & {(1 << more) - 1} = 0 THEN {more} + rank ELSE {more + 1} - length(bin(slot & {(1 << more) - 1})) END AS rank FROM sl),
    reg AS (SELECT g, r, max(rank) AS rank FROM low GROUP BY ALL),
    big AS (SELECT g, slot AS r, max(rank) AS rank FROM sl GROUP BY ALL),
    own_slots AS (SELECT g, rank, {p} AS bits FROM reg JOIN kind USING (g) WHERE dense UNION ALL SELECT g, rank, 25 FROM big JOIN kind USING (g) WHERE NOT dense),
    f AS (SELECT g, bits, pow(2.0::DOUBLE, bits) AS m, count(*) AS used, sum(CASE WHEN rank <= 64 - bits THEN pow(2.0::DOUBLE, -rank) ELSE 0 END) AS s, sum((rank > 64 - bits)::INT) AS full_ FROM own_slots GROUP BY g, bits),
    f2 AS (SELECT *, (m - used) / m AS e, 1 - full_ / m AS u FROM f),
    f3 AS (SELECT *, e + list_sum(list_transform(range(1, 65), lambda i: pow(e, pow(2.0::DOUBLE, i)) * pow(2.0::DOUBLE, i - 1))) AS sigma,
      CASE WHEN u = 0 OR u = 1 THEN 0 ELSE (1 - u - list_sum(list_transform(range(1, 65), lambda i: pow(1 - pow(u, pow(2.0::DOUBLE, -i)), 2) * pow(2.0::DOUBLE, -i)))) / 3 END AS tau FROM f2),
    f4 AS (SELECT g, m * m / (2 * ln(2)) / (m * tau * pow(2.0::DOUBLE, bits - 64) + s + m * sigma) AS est FROM f3),
    raw AS (SELECT g, {0.7213 / (1 + 1.079 / (1 << p)) * (1 << p) ** 2!r}::DOUBLE / (sum(pow(2.0::DOUBLE, -rank)) + {1 << p} - count(*)) AS x, {1 << p} - count(*) AS free_ FROM reg GROUP BY g),
    lin AS (SELECT g, CASE WHEN x <= {2.5 * (1 << p)} AND free_ > 0 THEN {1 << p} * ln({1 << p}::DOUBLE / free_) ELSE x END AS l FROM raw),
    done AS (SELECT g, observed, CASE WHEN observed < est THEN observed ELSE round(est)::BIGINT END AS estimate, CASE WHEN observed < l THEN observed ELSE round(l)::BIGINT END AS estimate_linear FROM kind JOIN f4 USING (g) JOIN lin USING (g))"""


MARKET = """
WITH nodes_in AS (
  SELECT 1::BIGINT AS ext_id, 0::BIGINT AS parent_ext, 'root' AS name, 'no rank' AS rank, 0 AS depth
  UNION ALL SELECT 2 + r_regionkey, 1, r_name, 'domain', 1 FROM region
  UNION ALL SELECT 100 + n_nationkey, 2 + n_regionkey, n_name, 'kingdom', 2 FROM nation
  UNION ALL SELECT 1000000000 + c_custkey, 100 + c_nationkey, c_name, 'species', 3 FROM customer
  UNION ALL SELECT 2000000000 + s_suppkey, 100 + s_nationkey, s_name, 'clade', 3 FROM supplier),
""" + """
l0 AS (SELECT 1::BIGINT AS node, 0::BIGINT AS parent, ext_id, name, rank, depth FROM nodes_in WHERE depth = 0),
l1 AS (SELECT (SELECT count(*) FROM l0) + row_number() OVER (ORDER BY p.node, n.ext_id) AS node, p.node AS parent, n.ext_id, n.name, n.rank, n.depth FROM nodes_in n JOIN l0 p ON n.parent_ext = p.ext_id WHERE n.depth = 1),
l2 AS (SELECT (SELECT count(*) FROM l0) + (SELECT count(*) FROM l1) + row_number() OVER (ORDER BY p.node, n.ext_id) AS node, p.node AS parent, n.ext_id, n.name, n.rank, n.depth FROM nodes_in n JOIN l1 p ON n.parent_ext = p.ext_id WHERE n.depth = 2),
l3 AS (SELECT (SELECT count(*) FROM l0) + (SELECT count(*) FROM l1) + (SELECT count(*) FROM l2) + row_number() OVER (ORDER BY p.node, n.ext_id) AS node, p.node AS parent, n.ext_id, n.name, n.rank, n.depth FROM nodes_in n JOIN l2 p ON n.parent_ext = p.ext_id WHERE n.depth = 3),
tax AS (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3),
closure AS (
  SELECT node, node AS ancestor, 0 AS dist FROM tax
  UNION ALL SELECT t.node, t.parent, 1 FROM tax t WHERE t.parent > 0
  UNION ALL SELECT t.node, p.parent, 2 FROM tax t JOIN tax p ON t.parent = p.node WHERE p.parent > 0
  UNION ALL SELECT t.node, q.parent, 3 FROM tax t JOIN tax p ON t.parent = p.node JOIN tax q ON p.parent = q.node WHERE q.parent > 0)
"""  # fmt: skip

TRADE = MARKET + """,
trade AS (SELECT DISTINCT a.node AS a, b.node AS b FROM orders JOIN lineitem ON o_orderkey = l_orderkey
  JOIN tax a ON a.ext_id = 1000000000 + o_custkey JOIN tax b ON b.ext_id = 2000000000 + l_suppkey)
"""

COUNTS = MARKET + """,
counts AS (SELECT t.node AS taxon, count(*) AS reads FROM orders JOIN tax t ON t.ext_id = 1000000000 + o_custkey GROUP BY t.node),
clade AS (SELECT ancestor AS node, sum(reads)::BIGINT AS clade FROM counts JOIN closure ON node = taxon GROUP BY ancestor)
"""


def _report(head: str) -> str:
    """Depth-first order by a key of falling clade counts, for trees given by tax, closure, counts and clade."""
    return head + """,
step AS (SELECT t.*, c.clade, coalesce(k.reads, 0) AS own,
    lpad((1000000000000000 - c.clade)::VARCHAR, 16, '0') || ':' || lpad(t.node::VARCHAR, 12, '0') AS step,
    CASE rank WHEN 'domain' THEN 'D' WHEN 'kingdom' THEN 'K' WHEN 'genus' THEN 'G' WHEN 'species' THEN 'S' END AS letter
  FROM tax t JOIN clade c ON c.node = t.node LEFT JOIN counts k ON k.taxon = t.node),
keyed AS (SELECT s.node, string_agg(a.step, '/' ORDER BY a.depth) AS key, max(a.depth) FILTER (a.letter IS NOT NULL) AS ranked,
    string_agg(lower(a.letter) || '__' || a.name, '|' ORDER BY a.depth) FILTER (a.letter IS NOT NULL) AS clade_path,
    arg_max(a.letter, a.depth) FILTER (a.letter IS NOT NULL) AS letter
  FROM step s JOIN closure c ON c.node = s.node JOIN step a ON a.node = c.ancestor GROUP BY s.node),
lines AS (SELECT s.*, k.key, k.clade_path, coalesce(k.letter, 'R') || CASE WHEN s.depth = coalesce(k.ranked, 0) THEN '' ELSE (s.depth - coalesce(k.ranked, 0))::VARCHAR END AS rank_code
  FROM step s JOIN keyed k ON k.node = s.node)
"""


PARTS = """
WITH words AS (SELECT split_part(p_name, ' ', 1) AS w, 2 * min(p_partkey) + 2 AS ext_id FROM part GROUP BY 1),
names AS (SELECT p_name, split_part(p_name, ' ', 1) AS w, 2 * min(p_partkey) + 3 AS ext_id FROM part GROUP BY p_name),
l1 AS (SELECT 1 + row_number() OVER (ORDER BY ext_id) AS node, 1::BIGINT AS parent, ext_id, w AS name, 'genus' AS rank, 1 AS depth FROM words),
l2 AS (SELECT 1 + (SELECT count(*) FROM l1) + row_number() OVER (ORDER BY l1.node, n.ext_id) AS node, l1.node AS parent, n.ext_id, n.p_name AS name, 'species' AS rank, 2 AS depth FROM names n JOIN l1 ON l1.name = n.w),
tax AS (SELECT 1::BIGINT AS node, 0::BIGINT AS parent, 1::BIGINT AS ext_id, 'root' AS name, 'no rank' AS rank, 0 AS depth UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2),
closure AS (SELECT node, node AS ancestor FROM tax UNION ALL SELECT node, parent FROM tax WHERE parent > 0
  UNION ALL SELECT t.node, p.parent FROM tax t JOIN tax p ON t.parent = p.node WHERE p.parent > 0)
"""  # fmt: skip


def _tokens(name: str, source: str, o: IndexOptions = SHORT) -> str:
    """CTEs ``{name}(read, mate, pos, minimizer, ambiguous)`` of the sequences ``source`` selects as (read, mate, s)."""
    letters = "ACGT" if o.dna else "".join(PROTEIN_GROUPS)
    good = f"^[{letters.replace('*', chr(92) + '*')}]*$"
    if o.dna:
        code = "(instr('ACGT', c) - 1)::BIGINT"
        other = "least(f, list_reduce(list_transform(string_split(reverse(translate(lm, 'ACGT', 'TGCA')), ''), lambda c: " + code + f"), lambda a, b: a * {1 << o.bits} + b))"
    else:
        digits = "".join("0123456789ABCDEF"[k] * len(g) for k, g in enumerate(PROTEIN_GROUPS))
        code = f"(instr('0123456789ABCDEF', translate(c, '{letters}', '{digits}')) - 1)::BIGINT"
        other = "f"
    value = other if not o.spaced_seed_mask else f"(({other}) & {o.spaced_seed_mask}::BIGINT)"
    need = o.k - 1 if o.k > o.l else o.k
    return f"""
{name}_s AS ({source}),
{name}_l AS (SELECT read, mate, s, i, substr(s, i::INT + 1, {o.l}) AS lm FROM (SELECT *, unnest(range(0, greatest(length(s) - {o.l} + 1, 0))) AS i FROM {name}_s)),
{name}_f AS (SELECT *, list_reduce(list_transform(string_split(lm, ''), lambda c: {code}), lambda a, b: a * {1 << o.bits} + b) AS f FROM {name}_l),
{name}_c AS (SELECT read, mate, s, i, CASE WHEN regexp_matches(lm, '{good}') THEN xor({value}, {o.toggle}::BIGINT) END AS c FROM {name}_f),
{name}_w AS (SELECT read, mate, s, i, min(c) OVER (PARTITION BY read, mate ORDER BY i ROWS BETWEEN {o.k - o.l} PRECEDING AND CURRENT ROW) AS m FROM {name}_c),
{name}_a AS (SELECT read, mate, i - {o.k - o.l} AS pos, m, NOT regexp_matches(substr(s, (i + {o.l} - {need})::INT + 1, {need}), '{good}') AS ambiguous FROM {name}_w WHERE i >= {o.k - o.l}),
{name} AS (SELECT read, mate, pos, CASE WHEN NOT ambiguous THEN xor(m, {o.toggle}::BIGINT) END AS minimizer, ambiguous FROM {name}_a)"""


INDEX = PARTS + "," + _tokens("lib", f"SELECT p_partkey AS read, 0 AS mate, {_dna('p_name')} AS s FROM part") + """,
held AS (SELECT DISTINCT lib.minimizer, t.node AS taxon FROM lib JOIN part ON p_partkey = read JOIN tax t ON t.name = p_name AND t.depth = 2 WHERE NOT ambiguous),
held_n AS (SELECT minimizer, count(*) AS n FROM held GROUP BY 1),
idx AS (SELECT minimizer, max(ancestor) AS taxon FROM (
  SELECT h.minimizer, c.ancestor, count(*) AS k, any_value(n.n) AS n FROM held h JOIN closure c ON c.node = h.taxon JOIN held_n n ON n.minimizer = h.minimizer GROUP BY 1, 2) WHERE k = n GROUP BY 1)
"""


def _classify(confidence: float = 0.0, groups: int = 0, paired: bool = False, quick: bool = False) -> str:
    """CTEs up to ``calls(read, call, total, hit_groups, hitlist)``."""
    first = f"SELECT p_partkey AS read, 0 AS mate, {_dna(_joined, BASES_N)} AS s FROM part"
    if paired:
        first += f" WHERE p_partkey + 1 IN (SELECT p_partkey FROM part) UNION ALL SELECT p_partkey - 1, 1, {_dna('p_name')} FROM part WHERE p_partkey - 1 IN (SELECT p_partkey FROM part)"
    text = INDEX + "," + _tokens("tok", first) + """,
probed AS (SELECT read, mate, pos, tok.minimizer, ambiguous, CASE WHEN ambiguous THEN -1 ELSE coalesce(idx.taxon, 0) END AS code FROM tok LEFT JOIN idx ON idx.minimizer = tok.minimizer),
clear AS (SELECT read, mate, pos, code, (lag(minimizer) OVER w IS NULL OR lag(minimizer) OVER w <> minimizer) AS fresh FROM probed WHERE NOT ambiguous WINDOW w AS (PARTITION BY read, mate ORDER BY pos)),
"""
    if quick:
        text += f"""
open_groups AS (SELECT *, sum((fresh AND code > 0)::INT) OVER (PARTITION BY read ORDER BY mate, pos) AS so_far FROM clear),
stops AS (SELECT read, min(mate * 1000000 + pos) AS stop, any_value(1) AS x FROM open_groups WHERE code > 0 AND so_far >= {groups} GROUP BY read),
grouped AS (SELECT c.read, sum((fresh AND code > 0)::INT)::BIGINT AS hit_groups FROM clear c LEFT JOIN stops USING (read) WHERE stop IS NULL OR mate * 1000000 + pos <= stop GROUP BY c.read),
used AS (SELECT p.* FROM probed p LEFT JOIN stops USING (read) WHERE stop IS NULL OR mate * 1000000 + pos < stop),
"""
    else:
        text += """
grouped AS (SELECT read, sum((fresh AND code > 0)::INT)::BIGINT AS hit_groups FROM clear GROUP BY read),
used AS (SELECT * FROM probed),
"""
    text += f"""
hits AS (SELECT read, code AS taxon, count(*) AS n FROM used WHERE code > 0 GROUP BY 1, 2),
totals AS (SELECT s.read, coalesce(u.total, 0)::BIGINT AS total FROM (SELECT DISTINCT read FROM tok_s) s LEFT JOIN (SELECT read, count(*) AS total FROM used GROUP BY 1) u ON u.read = s.read),
scores AS (SELECT h.read, h.taxon, sum(g.n) AS score FROM hits h JOIN closure c ON c.node = h.taxon JOIN hits g ON g.read = h.read AND g.taxon = c.ancestor GROUP BY 1, 2),
best AS (SELECT * FROM scores QUALIFY score = max(score) OVER (PARTITION BY read)),
best_n AS (SELECT read, count(*) AS n FROM best GROUP BY 1),
tops AS (SELECT read, max(ancestor) AS top FROM (SELECT b.read, c.ancestor, count(*) AS k, any_value(n.n) AS n FROM best b JOIN closure c ON c.node = b.taxon JOIN best_n n ON n.read = b.read GROUP BY 1, 2) WHERE k = n GROUP BY 1),
below AS (SELECT h.read, c.ancestor, sum(h.n) AS below FROM hits h JOIN closure c ON c.node = h.taxon GROUP BY 1, 2),
needs AS (SELECT t.read, t.top, ceil(CAST({confidence} AS DOUBLE) * totals.total) AS need FROM tops t JOIN totals ON totals.read = t.read),
walked AS (SELECT n.read, max(CASE WHEN coalesce(b.below, 0) >= n.need THEN c.ancestor ELSE 0 END) AS walked FROM needs n JOIN closure c ON c.node = n.top LEFT JOIN below b ON b.read = n.read AND b.ancestor = c.ancestor GROUP BY 1),
called AS (SELECT totals.read, totals.total, coalesce(g.hit_groups, 0)::BIGINT AS hit_groups, CASE WHEN coalesce(g.hit_groups, 0) < {groups} THEN 0 WHEN n.need = 0 THEN n.top ELSE coalesce(w.walked, 0) END AS call
  FROM totals LEFT JOIN grouped g ON g.read = totals.read LEFT JOIN needs n ON n.read = totals.read LEFT JOIN walked w ON w.read = totals.read),
"""
    border = "UNION ALL SELECT DISTINCT read, 0, 1000000000, -2 FROM tok_s" if paired else ""
    text += f"""
coded AS (SELECT read, mate, pos, code FROM used {border}),
islands AS (SELECT *, row_number() OVER (PARTITION BY read ORDER BY mate, pos) - row_number() OVER (PARTITION BY read, code ORDER BY mate, pos) AS g FROM coded),
spans AS (SELECT read, code, g, min(mate::BIGINT * 2000000000 + pos) AS place, count(*) AS n FROM islands GROUP BY 1, 2, 3),
lists AS (SELECT s.read, string_agg(CASE WHEN code = -2 THEN '|:|' WHEN code = -1 THEN 'A:' || n::VARCHAR ELSE coalesce(t.ext_id, 0)::VARCHAR || ':' || n::VARCHAR END, ' ' ORDER BY place) AS hitlist FROM spans s LEFT JOIN tax t ON t.node = s.code GROUP BY 1),
calls AS (SELECT c.read, c.call, coalesce(t.ext_id, 0)::BIGINT AS taxid, c.total, c.hit_groups, coalesce(l.hitlist, '0:0') AS hitlist, t.name FROM called c LEFT JOIN tax t ON t.node = c.call LEFT JOIN lists l ON l.read = c.read)
"""
    return text


CALLS = "SELECT read, taxid, total, hitlist, hit_groups FROM calls"


def _six_frames() -> str:
    s = _dna("p_name", BASES_N)
    codon = f"CASE WHEN regexp_matches(z, '^[ACGT][ACGT][ACGT]$') THEN substr('{AMINO_ACIDS}', (16 * (instr('AGCT', z[1]) - 1) + 4 * (instr('AGCT', z[2]) - 1) + instr('AGCT', z[3]))::INT, 1) ELSE 'X' END"
    return f"""
WITH seqs AS (SELECT p_partkey, {s} AS s FROM part),
starts AS (SELECT p_partkey, s, i, unnest(range(0, length(s) - 2)) AS k FROM (SELECT *, 0 AS i FROM seqs WHERE length(s) >= 3)),
codons AS (SELECT p_partkey, k, (k + 2) % 3 AS frame, substr(s, k::INT + 1, 3) AS z FROM starts),
both_ways AS (SELECT p_partkey, frame, k AS place, z FROM codons UNION ALL SELECT p_partkey, 3 + frame, -k, reverse(translate(z, 'ACGT', 'TGCA')) FROM codons),
made AS (SELECT p_partkey, frame, string_agg({codon}, '' ORDER BY place) AS protein FROM both_ways GROUP BY 1, 2),
frames AS (SELECT p_partkey, s, unnest(range(0, 6)) AS frame FROM seqs)
SELECT f.p_partkey, f.frame::INT AS frame, CASE WHEN length(f.s) < 3 THEN repeat(' ', (length(f.s) // 3 + 1)::INT) ELSE coalesce(m.protein, '') END AS protein FROM frames f LEFT JOIN made m ON m.p_partkey = f.p_partkey AND m.frame = f.frame
"""


def _plain_tokens(o: IndexOptions, text: str) -> str:
    return "WITH" + _tokens("tok", f"SELECT p_partkey AS read, 0 AS mate, {text} AS s FROM part", o) + " SELECT read, pos::INT AS pos, minimizer, ambiguous FROM tok"


_head = "concat('read', o_orderkey, '/', o_orderkey % 3)"
_accession = """WITH maps AS (SELECT 'ACC' || (p_partkey // 2)::VARCHAR AS accession, 'ACC' || (p_partkey // 2)::VARCHAR || '.' || (p_partkey % 2)::VARCHAR AS accession_version, p_size::BIGINT AS taxid, p_partkey % 3 AS file_no, p_partkey AS line_no FROM part),
targets AS (SELECT DISTINCT 'seq' || l_suppkey::VARCHAR AS seqid, 'ACC' || (l_partkey - 20)::VARCHAR AS accession FROM lineitem),
first_line AS (SELECT accession, arg_min(taxid, file_no * 100000000 + line_no) AS taxid FROM maps GROUP BY 1),
last_line AS (SELECT a AS accession, arg_max(taxid, line_no) AS taxid FROM (SELECT accession AS a, taxid, line_no FROM maps UNION ALL SELECT accession_version, taxid, line_no FROM maps) GROUP BY 1)
"""
_quals = f"translate(hex(p_name), '{HEX}', '!$&(*,.02468:<>@')"

ORACLE_SQL = {
    "classify_calls": _classify() + CALLS,
    "classify_joins": _classify(0.2) + CALLS,
    "classify_confidence": _classify(0.2) + CALLS,
    "classify_hit_groups": _classify(groups=4) + CALLS,
    "classify_paired": _classify(0.1, paired=True) + CALLS,
    "classify_quick": _classify(groups=2, quick=True) + "SELECT read, taxid, taxid::VARCHAR || ':Q' AS hitlist FROM calls",
    "classify_lines": _classify() + "SELECT c.read, concat_ws(chr(9), CASE WHEN call > 0 THEN 'C' ELSE 'U' END, 'part' || c.read::VARCHAR || '/1', CASE WHEN call > 0 THEN c.name ELSE 'unclassified' END || ' (taxid ' || taxid::VARCHAR || ')', length(s.s)::VARCHAR, hitlist) AS line FROM calls c JOIN tok_s s ON s.read = c.read",
    "classify_stats": _classify(0.2) + "SELECT count(*) AS sequences, sum(length(s.s))::BIGINT AS bases, sum((call > 0)::INT)::BIGINT AS classified, sum((call = 0)::INT)::BIGINT AS unclassified FROM calls c JOIN tok_s s ON s.read = c.read",
    "split_outputs": _classify(0.2) + "SELECT c.read, call > 0 AS classified, '>part' || c.read::VARCHAR || '/1' || CASE WHEN call > 0 THEN ' taxid|' || taxid::VARCHAR ELSE '' END || chr(10) || s.s AS record FROM calls c JOIN tok_s s ON s.read = c.read",
    "classify_report": _report(_classify() + """,
counts AS (SELECT call AS taxon, count(*) AS reads FROM calls WHERE call > 0 GROUP BY 1),
clade AS (SELECT ancestor AS node, sum(reads)::BIGINT AS clade FROM counts JOIN closure ON node = taxon GROUP BY 1),
opened AS (SELECT p.code AS taxon, p.minimizer, count(*) AS c FROM probed p JOIN clear k ON k.read = p.read AND k.mate = p.mate AND k.pos = p.pos WHERE k.fresh AND p.code > 0 GROUP BY 1, 2),
kmers AS (SELECT ancestor AS node, sum(c)::BIGINT AS clade_kmers, count(DISTINCT minimizer) AS clade_distinct_kmers FROM opened JOIN closure ON node = taxon GROUP BY 1)""") + """,
every AS (SELECT '' AS key, count(*) AS clade_reads, count(*) AS own_reads, 0 AS clade_kmers, 0 AS clade_distinct_kmers, 'U' AS rank_code, 0 AS ext_id, 'unclassified' AS name, 0 AS depth FROM calls WHERE call = 0 HAVING count(*) > 0
  UNION ALL SELECT key, clade, own, coalesce(clade_kmers, 0), coalesce(clade_distinct_kmers, 0), rank_code, ext_id, name, depth FROM lines LEFT JOIN kmers ON kmers.node = lines.node)
SELECT row_number() OVER (ORDER BY key)::INT AS line_no, clade_reads::BIGINT AS clade_reads, own_reads::BIGINT AS own_reads, clade_kmers::BIGINT AS clade_kmers, clade_distinct_kmers::BIGINT AS clade_distinct_kmers, rank_code, ext_id::BIGINT AS ext_id, name, depth::INT AS depth FROM every""",
    "output_files": _classify() + """, rec AS (SELECT c.*, s.s, CASE WHEN call > 0 THEN 'classified' ELSE 'unclassified' END AS kind FROM calls c JOIN tok_s s ON s.read = c.read)
SELECT 'lines' AS output, concat_ws(chr(9), CASE WHEN call > 0 THEN 'C' ELSE 'U' END, 'part' || read::VARCHAR || '/1', CASE WHEN call > 0 THEN name ELSE 'unclassified' END || ' (taxid ' || taxid::VARCHAR || ')', length(s)::VARCHAR, hitlist) AS line FROM rec
UNION ALL SELECT kind, '>part' || read::VARCHAR || '/1' || CASE WHEN call > 0 THEN ' taxid|' || taxid::VARCHAR ELSE '' END FROM rec
UNION ALL SELECT kind, s FROM rec""",
    "stream_call_counts": _classify() + "SELECT taxid, count(*) AS reads FROM calls GROUP BY 1",
    "tax_bfs_ids": MARKET + "SELECT node, parent, ext_id, name, rank, depth FROM tax",
    "tax_closure": MARKET + "SELECT node, ancestor, dist FROM closure",
    "tax_children": MARKET + "SELECT t.node, coalesce(min(c.node), 0)::BIGINT AS first_child, count(c.node) AS child_count FROM tax t LEFT JOIN tax c ON c.parent = t.node GROUP BY 1",
    "tax_mark_prune": MARKET + "SELECT ext_id, parent_ext, name, rank FROM nodes_in WHERE ext_id = 1 OR ext_id IN (SELECT a.ext_id FROM customer JOIN tax t ON t.ext_id = 1000000000 + c_custkey JOIN closure c ON c.node = t.node JOIN tax a ON a.node = c.ancestor WHERE c_acctbal < 0)",
    "tax_lca_pairs": TRADE + "SELECT a, b, max(x.ancestor) AS lca FROM trade JOIN closure x ON x.node = a JOIN closure y ON y.node = b AND y.ancestor = x.ancestor GROUP BY 1, 2",
    "tax_is_ancestor": TRADE + ", pairs AS (SELECT DISTINCT t.parent AS a, trade.a AS b FROM trade JOIN tax t ON t.node = trade.b) SELECT a, b, EXISTS (SELECT 1 FROM closure c WHERE c.node = b AND c.ancestor = a) AS above FROM pairs",
    "clade_rollup_counts": COUNTS + "SELECT node, clade AS reads FROM clade",
    "clade_rollup_distinct": MARKET + "SELECT c.ancestor AS node, count(*) AS parts, count(DISTINCT l_partkey) AS distinct_parts FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN tax t ON t.ext_id = 1000000000 + o_custkey JOIN closure c ON c.node = t.node GROUP BY 1",
    "clade_report": _report(COUNTS) + ", every AS (SELECT '' AS key, 7 AS clade_reads, 7 AS own_reads, 'U' AS rank_code, 0 AS ext_id, 'unclassified' AS name, 0 AS depth UNION ALL SELECT key, clade, own, rank_code, ext_id, name, depth FROM lines) SELECT row_number() OVER (ORDER BY key)::INT AS line_no, clade_reads::BIGINT AS clade_reads, own_reads::BIGINT AS own_reads, rank_code, ext_id::BIGINT AS ext_id, name, depth::INT AS depth FROM every",
    "clade_report_lines": _report(COUNTS) + """, every AS (SELECT '' AS key, 7 AS n, 7 AS own, 'U' AS code, 0 AS ext, 'unclassified' AS name, 0 AS depth UNION ALL SELECT key, clade, own, rank_code, ext_id, name, depth FROM lines),
    shown AS (SELECT *, printf('%6.2f', 100.0::DOUBLE * n / (7 + (SELECT sum(reads) FROM counts))) AS pct FROM every)
    SELECT row_number() OVER (ORDER BY key)::INT AS line_no, pct, concat_ws(chr(9), pct, n::BIGINT::VARCHAR, own::BIGINT::VARCHAR, code, ext::BIGINT::VARCHAR, repeat('  ', depth::INT) || name) AS line FROM shown""",
    "first_fields": "SELECT p_partkey, array_to_string(string_split(concat_ws('.', p_name, p_type, p_brand), '.')[:2], '|') AS fields FROM part",
    "taxdump_scan": MARKET + " SELECT ext_id::BIGINT AS ext_id, parent_ext::BIGINT AS parent_ext, name, rank FROM nodes_in",
    "assembly_scan": "SELECT p_partkey AS taxid, CASE p_size % 4 WHEN 0 THEN 'Complete Genome' ELSE 'Chromosome' END AS level, 'ftp/' || p_name AS ftp_path FROM part WHERE p_size % 4 < 2 AND p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 11 <> 0",
    "path_report": _report(COUNTS) + " SELECT row_number() OVER (ORDER BY key)::INT AS line_no, clade_path, clade AS clade_reads FROM lines WHERE letter IS NOT NULL",
    "murmur_hash": f"SELECT o_orderkey, {_signed('h')} AS h FROM (SELECT o_orderkey, {_murmur('o_orderkey')} AS h FROM orders)",
    "revcomp": f"SELECT p_partkey, translate(reverse({_dna('p_name', BASES_N)}), 'ACGT', 'TGCA') AS rc FROM part",
    "quality_mask": f"SELECT p_partkey, array_to_string(list_transform(range(1, length(s) + 1), lambda k: CASE WHEN ascii(q[k]) - 33 < 15 THEN 'x' ELSE s[k] END), '') AS masked FROM (SELECT p_partkey, {_dna('p_name')} AS s, {_quals} AS q FROM part)",
    "trim_pair": f"SELECT o_orderkey, CASE WHEN {_head} LIKE '%/1' OR {_head} LIKE '%/2' THEN left({_head}, length({_head}) - 2) ELSE {_head} END AS header FROM orders",
    "seqid_extract": "SELECT p_partkey, split_part(p_name, ' ', 1) || '|' || split_part(p_brand, ' ', 1) AS ids FROM part",
    "header_taxids": "SELECT concat_ws(chr(9), 'TAXID', 'db:taxid|' || p_size::VARCHAR || '|' || p_partkey::VARCHAR, p_size::VARCHAR) AS value FROM part",
    "fasta_wrap": f"SELECT p_partkey, '>' || p_name || ' ' || p_type || chr(10) || array_to_string(list_transform(range(0, (length(s) + 6) // 7), lambda k: substr(s, (k * 7 + 1)::INT, 7)), chr(10)) AS record FROM (SELECT *, {_dna('p_name')} AS s FROM part)",
    "six_frame": _six_frames(),
    "minimizers_dna": _plain_tokens(SHORT, _dna("p_name")),
    "minimizers_ambiguous": _plain_tokens(SHORT, _dna("p_name", BASES_N)),
    "minimizers_spaced": _plain_tokens(IndexOptions(k=12, l=8, spaced_seed_mask=0b1111110011001111), _dna("p_name")),
    "minimizers_protein": _plain_tokens(PROTEIN, "upper(p_name)"),
    "minimizers_scan": "WITH" + _tokens("tok", f"SELECT item_id AS read, 0 AS mate, {_dna('text', BASES_N)} AS s FROM benchmark") + " SELECT DISTINCT read, minimizer FROM tok WHERE NOT ambiguous",
    "index_build_lca": INDEX + "SELECT minimizer, taxon FROM idx",
    "index_value_counts": INDEX + "SELECT taxon, count(*) AS minimizers FROM idx GROUP BY 1",
    "index_subsample": INDEX + f"SELECT minimizer, taxon FROM (SELECT *, {_murmur('minimizer')} AS h FROM idx) WHERE h >= 9223372036854775808::UBIGINT",
    "capacity": INDEX + f"SELECT count(*) AS distinct_sampled, floor((count(*) + 1) * 1024.0::DOUBLE / 512)::BIGINT AS capacity FROM (SELECT {_murmur('minimizer')} AS h FROM idx) WHERE h % 1024 < 512",
    "accession_lookup": _accession + "SELECT seqid, targets.accession, taxid FROM targets JOIN first_line USING (accession)",
    "accession_unmapped": _accession + "SELECT DISTINCT accession FROM targets WHERE accession NOT IN (SELECT accession FROM maps)",
    "accession_any_version": _accession + "SELECT seqid, targets.accession, coalesce(taxid, 0) AS taxid FROM targets LEFT JOIN last_line USING (accession)",
    "id_map": "SELECT seqid, arg_max(taxid, o_orderkey) AS taxid FROM (SELECT 'seq' || o_custkey::VARCHAR AS seqid, o_orderkey % 7 AS taxid, o_orderkey FROM orders) WHERE taxid > 0 GROUP BY 1",
    "distinct_sketch": "WITH k AS (SELECT l_suppkey AS own, l_suppkey AS g, l_partkey AS key FROM lineitem)" + _sketch() + " SELECT g, observed, estimate, estimate_linear FROM done",
    "distinct_sketch_dense": "WITH k AS (SELECT l_linenumber AS own, l_linenumber AS g, l_orderkey * 100003 + l_partkey AS key FROM lineitem)" + _sketch() + " SELECT g::BIGINT AS g, observed, estimate, estimate_linear FROM done",
    "clade_rollup_sketch": MARKET + ", k AS (SELECT t.node AS own, c.ancestor AS g, l_partkey AS key FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN tax t ON t.ext_id = 1000000000 + o_custkey JOIN closure c ON c.node = t.node)" + _sketch() + " SELECT g AS node, observed, estimate FROM done",
    "fastx_scan": f"SELECT doc_id, lang, CASE WHEN doc_id % 2 = 0 THEN 'fastq' ELSE 'fasta' END AS format, length(s)::BIGINT AS bases, md5(s) AS seq_md5, md5(CASE WHEN doc_id % 2 = 0 THEN translate(hex(coalesce(text, '')), '{HEX}', '@>+$&(*,.02468:<') ELSE '' END) AS quals_md5 FROM (SELECT *, {_dna("coalesce(text, '')", BASES_N)} AS s FROM documents)",
    "dust_mask_parts": f"""
WITH p AS (SELECT p_partkey, {_dna("p_name")} AS s FROM part),
t AS (SELECT p_partkey AS k, i, substr(s, (i + 1)::INT, 3) AS c FROM (SELECT *, unnest(range(0, greatest(length(s) - 2, 0))) AS i FROM p)),
pairs AS (SELECT a.k, a.i AS s, b.i AS e, (a.c = b.c)::INT AS q FROM t a JOIN t b ON a.k = b.k AND b.i BETWEEN a.i AND a.i + 61),
more AS (SELECT *, sum(q) OVER (PARTITION BY k, s ORDER BY e) - 1 AS q2 FROM pairs),
whole AS (SELECT *, sum(q2) OVER (PARTITION BY k, e ORDER BY s DESC) AS n FROM more),
scored AS (SELECT *, CASE WHEN e > s AND 10 * n > 20 * (e - s) THEN n / (e - s) END AS score FROM whole),
ending AS (SELECT *, max(score) OVER (PARTITION BY k, e ORDER BY s DESC) AS top FROM scored),
within AS (SELECT *, max(top) OVER (PARTITION BY k, s ORDER BY e) AS best FROM ending),
low AS (SELECT DISTINCT k, unnest(range(s, e + 3)) AS i FROM within WHERE score >= best),
bases AS (SELECT p_partkey, i, substr(s, (i + 1)::INT, 1) AS b FROM (SELECT *, unnest(range(0, length(s))) AS i FROM p)),
shown AS (SELECT p_partkey, bases.i, CASE WHEN low.k IS NULL THEN b ELSE lower(b) END AS b FROM bases LEFT JOIN low ON low.k = p_partkey AND low.i = bases.i)
SELECT p_partkey AS seq_no, string_agg(b, '' ORDER BY i) AS seq FROM shown GROUP BY 1""",
    "distinct_exact": "SELECT l_suppkey AS supplier, count(*) AS observed, count(DISTINCT l_partkey) AS distinct_keys FROM lineitem GROUP BY 1",
}

ORACLE_SQL["stream_report"] = f"SELECT * EXCLUDE (clade_distinct_kmers) FROM ({ORACLE_SQL['classify_report']})"
