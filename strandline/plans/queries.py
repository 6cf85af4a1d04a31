"""The queries of the core: the general problems and the operators of variant analysis."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandline.operators import compare, coverage, packed, quarantine
from strandline.plans import catalog
from strandline.plans import genome as _genome  # noqa: F401  (its queries join those of the catalog)
from strandline.session import table

Query = Callable[[SparkSession, str], DataFrame]

P2_SQL = r"""
WITH rows_ AS (
  SELECT 'svcalls' AS origin, callset AS owner_name, regexp_replace(chrom, '^chr', '') AS chrom, pos AS s, end_pos AS e FROM svcalls
  UNION ALL
  SELECT 'hr_regions', sample_name, regexp_replace(chrom, '^chr', ''), hr_start, hr_end FROM hr_regions
), good AS (SELECT * FROM rows_ WHERE chrom IS NOT NULL AND s >= 1 AND e >= s),
marked AS (
  SELECT *, max(e) OVER (PARTITION BY origin, owner_name, chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM good
), islands AS (
  SELECT *, sum(CASE WHEN before IS NULL OR s > before + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY origin, owner_name, chrom ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS n FROM marked
), periods AS (SELECT origin, owner_name, chrom, n, min(s) AS a, max(e) AS z FROM islands GROUP BY ALL)
SELECT origin, owner_name, chrom, 'period' AS kind, a AS first_base, z AS last_base FROM periods
UNION ALL
SELECT origin, owner_name, chrom, 'gap', last_z + 1, a - 1
FROM (SELECT *, lag(z) OVER (PARTITION BY origin, owner_name, chrom ORDER BY n) AS last_z FROM periods) WHERE last_z IS NOT NULL
"""

_NUMBER = "CASE WHEN regexp_full_match(replace(trim({0}), ',', ''), '[+-]?[0-9]+(\\.0*)?') THEN CAST(regexp_extract(replace(trim({0}), ',', ''), '^[+-]?[0-9]+') AS BIGINT) END"
_TYPE = "CASE WHEN upper(trim(svtype)) NOT IN ('', '.', 'NA') THEN upper(trim(svtype)) END"
_TOKENS = "regexp_extract_all({0}, $$\"(?:[^\"]|\"\")*\"?|'(?:[^']|'')*'?|{1}$$)"
_ITEM = "CASE WHEN t[1] IN (chr(34), chr(39)) THEN replace(CASE WHEN (length(t) - length(replace(t, t[1], '')) - 1) % 2 = 1 THEN t[2:-2] ELSE t[2:] END, t[1] || t[1], t[1]) ELSE t END"
_ENTRIES = "regexp_extract_all(info, $$(?:\"(?:[^\"]|\"\")*\"?|'(?:[^']|'')*'?|[^;\"'])+$$)"


def _packed(name: str, field: str, items: str) -> str:
    listed = f"list_filter(list_transform({_TOKENS.format(field, items)}, lambda t: {_ITEM}), lambda x: x <> '')"
    return f"SELECT row_id, '{name}' AS packed_field, {listed} AS items FROM svcalls"


def _tag(name: str) -> str:
    return f"list_filter(list_transform({_ENTRIES}, lambda e: trim(e)), lambda e: starts_with(e, '{name}='))[1][{len(name) + 2}:]"


P3_SQL = " UNION ALL ".join(
    [_packed("ALT", "alt_allele", r"""<[^<>"']*>|\*|[A-Za-z]*[\[\]][^\[\]\s"']+[\[\]][A-Za-z]*|[A-Za-z]+"""), *(_packed(n, _tag(n), r"[A-Za-z0-9_.\-]+") for n in packed.ID_TAGS)]
)
P3_SQL = f"SELECT row_id, packed_field, unnest(range(1, len(items) + 1)) AS idx, unnest(items) AS item FROM ({P3_SQL}) WHERE len(items) >= 2"
P4_SQL = f"""
WITH a AS (
  SELECT call_id, pos, {_TYPE} AS svtype, svlen FROM calls_a WHERE call_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY updated_at DESC NULLS LAST, pos DESC NULLS LAST, {_TYPE} DESC NULLS LAST, svlen DESC NULLS LAST) = 1
), t AS (SELECT call_id, updated_at, {_NUMBER.format("pos")} AS pos, {_TYPE} AS svtype, {_NUMBER.format("svlen")} AS svlen FROM calls_b WHERE call_id IS NOT NULL),
b AS (
  SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY updated_at DESC NULLS LAST, pos DESC NULLS LAST, svtype DESC NULLS LAST, svlen DESC NULLS LAST) = 1
)
SELECT call_id, 'only_a' AS kind, 'none' AS diff_field FROM a ANTI JOIN b USING (call_id)
UNION ALL SELECT call_id, 'only_b', 'none' FROM b ANTI JOIN a USING (call_id)
UNION ALL SELECT call_id, 'differs', 'POS' FROM a JOIN b USING (call_id) WHERE a.pos IS DISTINCT FROM b.pos
UNION ALL SELECT call_id, 'differs', 'SVTYPE' FROM a JOIN b USING (call_id) WHERE a.svtype IS DISTINCT FROM b.svtype
UNION ALL SELECT call_id, 'differs', 'SVLEN' FROM a JOIN b USING (call_id) WHERE a.svlen IS DISTINCT FROM b.svlen
"""

P5_SQL = r"""
WITH lines AS (
  SELECT line_id, regexp_replace(raw_line, '\r\z', '') AS line FROM vcf_raw
), data AS (
  SELECT line_id, line, string_split(line, '"') AS pieces FROM lines
  WHERE line IS NOT NULL AND NOT regexp_full_match(line, '\s*') AND NOT starts_with(line, '#')
), masked AS (
  SELECT line_id, line,
    len(pieces) % 2 = 1 AND len(list_filter(pieces, lambda p, i: i % 2 = 1 AND (
      (i < len(pieces) AND NOT ends_with(p, '=')) OR (i > 1 AND NOT (starts_with(p, ';') OR starts_with(p, chr(9)) OR (i = len(pieces) AND p = '')))))) = 0 AS quoting_ok,
    string_split(array_to_string(list_transform(pieces, lambda p, i: CASE WHEN i % 2 = 0 THEN translate(p, chr(9) || ';', chr(26) || chr(26)) ELSE p END), '"'), chr(9)) AS cells
  FROM data
), judged AS (
  SELECT line_id, quoting_ok, len(cells) AS n, cells[2] AS pos,
    CASE WHEN len(string_split(cells[8], ';')) > 1 AND ends_with(cells[8], ';') THEN string_split(cells[8][:-2], ';') ELSE string_split(cells[8], ';') END AS entries,
    cells[8] AS info FROM masked
), reasons AS (
  SELECT line_id, CASE
    WHEN NOT quoting_ok THEN 'quoting'
    WHEN n <> 10 THEN 'columns'
    WHEN NOT regexp_full_match(pos, '[0-9]+') OR TRY_CAST(pos AS HUGEINT) IS NULL OR TRY_CAST(pos AS HUGEINT) > 400000000 THEN 'pos'
    WHEN info <> '.' AND (
      len(list_filter(entries, lambda x: NOT regexp_full_match(x, '(?s)[A-Za-z_][A-Za-z0-9_.]*(=.+)?'))) > 0
      OR len(list_filter(entries, lambda x: regexp_full_match(x, '(?s)(END|SVLEN)(=.*)?') AND NOT regexp_full_match(x, '(END|SVLEN)=-?[0-9]+'))) > 0
      OR len(list_filter(entries, lambda x: starts_with(x, 'END=') AND TRY_CAST(x[5:] AS HUGEINT) < TRY_CAST(pos AS HUGEINT))) > 0
    ) THEN 'info' END AS reason FROM judged
)
SELECT line_id, reason FROM reasons WHERE reason IS NOT NULL
"""


def queries() -> dict[str, Query]:
    return catalog.QUERIES | {
        "p2_found": lambda s, d: coverage.coverage(table(s, d, "svcalls"), table(s, d, "hr_regions")),
        "p3_found": lambda s, d: packed.split_packed(table(s, d, "svcalls")),
        "p4_found": lambda s, d: compare.call_differences(table(s, d, "calls_a"), table(s, d, "calls_b")),
        "p5_found": lambda s, d: quarantine.rejected(table(s, d, "vcf_raw")),
    }


def oracle_sql() -> dict[str, str]:
    return catalog.SQL | {"p2_found": P2_SQL, "p3_found": P3_SQL, "p4_found": P4_SQL, "p5_found": P5_SQL}
