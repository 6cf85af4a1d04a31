"""Queries that run the commands with haplotypes and alignments, over contigs laid out from a table.

The tables hold no reference bases for their calls. So every long enough ALT of ``svcalls`` serves as
a contig here, and one piece of SQL that both engines read (_LAID) puts eight calls on it, four of a
test file and four of a truth file: deletions, tandem duplications and insertions of other bases, the
truth's moved and resized by a few bases. DuckDB's ``levenshtein`` gives the edit distance; it has no
shift, so these queries leave the shift's threshold open (``OPEN``), and tests compare the commands
with their defaults to nested loops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import distances as D
from strandline.plans import commands
from strandline.plans.catalog import add
from strandline.session import durable, table
from strandline.sources import fasta
from strandline.sources.fasta import Slices

LONG = 450  # bases of a contig at least: all calls fit on it
OPEN = 1e9  # a threshold that nothing reaches
_CONTIGS = f"SELECT row_id, upper(trim(alt_allele)) AS s FROM svcalls WHERE length(trim(alt_allele)) >= {LONG}"
_LAID = """SELECT concat('a', CAST(row_id AS {text})) AS chrom, s, length(s) AS contig_len, row_id * 8 + n AS line_no, concat('c', CAST(row_id * 8 + n AS {text})) AS id, n % 2 AS side, p AS pos,
  CASE WHEN kind = 0 THEN substr(s, p, z + 1) ELSE substr(s, p, 1) END AS ref,
  CASE WHEN kind = 0 THEN substr(s, p, 1) WHEN kind = 1 THEN substr(s, p, z + 1) ELSE concat(substr(s, p, 1), reverse(substr(s, 1, z))) END AS alt FROM (
  SELECT row_id, s, n, (row_id + k) % 3 AS kind, CAST(101 + k * 70 + (row_id * 13 + k * 29) % 23 + (n % 2) * ((row_id + k) % 6) AS INT) AS p, CAST(20 + (row_id * 7 + k * 11) % 40 + (n % 2) * ((row_id * 3 + k) % 12) AS INT) AS z FROM (
    SELECT *, CAST((n - n % 2) / 2 AS INT) AS k FROM (SELECT row_id, s, {each} AS n FROM ({contigs}) c) e) f) g"""
LAID = "(" + _LAID.format(text="VARCHAR", each="unnest([0, 1, 2, 3, 4, 5, 6, 7])", contigs=_CONTIGS + " AND regexp_full_match(upper(trim(alt_allele)), '[ACGT]+')") + ")"


def laid(s: SparkSession, d: str) -> DataFrame:
    table(s, d, "svcalls").createOrReplaceTempView("strandline_svcalls")
    contigs = _CONTIGS.replace("FROM svcalls", "FROM strandline_svcalls") + r" AND upper(trim(alt_allele)) RLIKE '^[ACGT]+\\z'"
    return s.sql(_LAID.format(text="STRING", each="explode(array(0, 1, 2, 3, 4, 5, 6, 7))", contigs=contigs))


def records(s: SparkSession, d: str) -> DataFrame:
    """The calls in the columns of a VCF scan; ``file`` is test or truth."""
    none = F.lit(None).cast("string")
    rows = laid(s, d).select(
        F.when(F.col("side") == 0, "test.vcf").otherwise("truth.vcf").alias("file"), "line_no", "side", "chrom", F.col("pos").cast("bigint").alias("pos"), "id", "ref", "alt",
        none.alias("qual"), F.lit("PASS").alias("filter"), F.lit(".").alias("info"), none.alias("format"), F.array().cast("array<string>").alias("samples"),
    )
    return durable(rows, "laid")


def contigs(s: SparkSession, d: str) -> DataFrame:
    return laid(s, d).select("chrom", F.col("contig_len").cast("bigint").alias("contig_len"), "s").distinct()


def slices(s: SparkSession, d: str) -> Slices:
    return fasta.slicer(durable(fasta.chunk_text(contigs(s, d), "chrom", "s", 128), "chunks"), 128)


_SIDED = f'(SELECT *, length(ref) AS rl, length(alt) AS al, pos + length(ref) - 1 AS "end" FROM {LAID} l)'
_PAIRED = """(SELECT *, levenshtein(hap_a, hap_b) AS edits, abs(size_a - size_b) / shared AS relsizediff, levenshtein(hap_a, hap_b) / shared AS reldist FROM (
  SELECT a.id AS id1, b.id AS id2, a.line_no AS n1, b.line_no AS n2, a.pos - b.pos AS posdiff, a.al - a.rl AS size_a, b.al - b.rl AS size_b, (a.al + b.al) / 2 AS avgaltlength, a.al - b.al AS altlengthdiff,
    (greatest(a.rl, a.al) + greatest(b.rl, b.al)) / 2.0 AS shared, greatest(a."end", b."end") - least(a.pos, b.pos) + 1 AS span,
    substr(a.s, least(a.pos, b.pos), a.pos - least(a.pos, b.pos)) || a.alt || substr(a.s, a."end" + 1, greatest(a."end", b."end") - a."end") AS hap_a,
    substr(a.s, least(a.pos, b.pos), b.pos - least(a.pos, b.pos)) || b.alt || substr(a.s, b."end" + 1, greatest(a."end", b."end") - b."end") AS hap_b
  FROM {sides} a JOIN {sides} b ON a.chrom = b.chrom AND {on}) WHERE abs(size_a - size_b) <= {size} * shared)"""
_TEST_TRUTH = _PAIRED.format(sides=_SIDED, on="a.side = 0 AND b.side = 1", size=1.0)
_MATCHED = f"(SELECT n1, n2 FROM {_TEST_TRUTH} p WHERE relsizediff <= 0.2 AND reldist <= 0.2)"


def _benchmark(s: SparkSession, d: str) -> commands.Benchmark:
    rows = records(s, d)
    return commands.benchmark(rows.where("side = 0"), rows.where("side = 1"), slices(s, d), commands.BenchmarkParams(shift=OPEN))


add(
    "benchmark_command",
    f"""WITH m AS MATERIALIZED {_MATCHED}, c AS (SELECT count(*) FILTER (WHERE side = 0 AND line_no IN (SELECT n1 FROM m)) AS ptp, count(*) FILTER (WHERE side = 0 AND line_no NOT IN (SELECT n1 FROM m)) AS fp,
      count(*) FILTER (WHERE side = 1 AND line_no IN (SELECT n2 FROM m)) AS dtp, count(*) FILTER (WHERE side = 1 AND line_no NOT IN (SELECT n2 FROM m)) AS fn FROM {LAID} l)
    SELECT ptp, fp, dtp, fn, round(p, 9) AS "precision", round(r, 9) AS recall, round(2 * p * r / (p + r), 9) AS f1 FROM (SELECT *, ptp / (ptp + fp) AS p, dtp / (dtp + fn) AS r FROM c)""",
)(lambda s, d: _benchmark(s, d).metrics.select("ptp", "fp", "dtp", "fn", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1"))))
add("benchmark_command_fp", f"SELECT chrom, pos, id, alt FROM {LAID} l WHERE side = 0 AND line_no NOT IN (SELECT n1 FROM {_MATCHED} m)")(lambda s, d: _benchmark(s, d).false_positives.select("chrom", F.col("pos").cast("int"), "id", "alt"))
add("benchmark_command_fn", f"SELECT chrom, pos, id, alt FROM {LAID} l WHERE side = 1 AND line_no NOT IN (SELECT n2 FROM {_MATCHED} m)")(lambda s, d: _benchmark(s, d).false_negatives.select("chrom", F.col("pos").cast("int"), "id", "alt"))
_RECORD = "id1, id2, avgaltlength, CAST(altlengthdiff AS BIGINT) AS altlengthdiff, (size_a + size_b) / 2 AS avgsize, CAST(size_a - size_b AS BIGINT) AS sizediff, CAST(edits AS BIGINT) AS edit_distance, CAST(edits AS BIGINT) AS subs_and_indels, CAST(posdiff AS BIGINT) AS posdiff, round(relsizediff, 9) AS relsizediff, round(reldist, 9) AS reldist, CAST(greatest(span, span + size_a, span + size_b) AS BIGINT) AS marlength, hap_a = hap_b AS exact"


def _record(rows: DataFrame) -> DataFrame:
    return rows.select(
        "id1", "id2", "avgaltlength", "altlengthdiff", "avgsize", "sizediff", "edit_distance", (F.col("numsubs") + F.col("numindels")).alias("subs_and_indels"), "posdiff",
        F.round("relsizediff", 9).alias("relsizediff"), F.round("reldist", 9).alias("reldist"), "marlength", (F.col("match_type") == "EXACTMATCH").alias("exact"),
    )


add("distance_records", f"SELECT {_RECORD} FROM {_TEST_TRUTH} p")(lambda s, d: _record(_benchmark(s, d).distances))
add("haplotype_build", f"SELECT id1, id2, hap_a, hap_b FROM {_TEST_TRUTH} p")(lambda s, d: _haplotypes(s, d))


def _haplotypes(s: SparkSession, d: str) -> DataFrame:
    from strandline.sources import vcf

    rows = vcf.normalized(records(s, d))
    side = lambda k, n: rows.where(F.col("side") == k).select("chrom", F.col("chrom").alias(f"{n}_chrom"), *(F.col(c).alias(f"{n}_{c}") for c in ("id", "pos", "end", "alt", "reflength", "altlength")))
    pairs = side(0, "a").join(side(1, "b"), "chrom").where(D.potential_match())
    return D.haplotypes(pairs, slices(s, d)).select(F.col("a_id").alias("id1"), F.col("b_id").alias("id2"), "hap_a", "hap_b")


_NTH = _PAIRED.format(sides=_SIDED, on="a.side = 0 AND b.side = 1 AND a.line_no + 1 = b.line_no", size=1e9)
add("comp_command", f"SELECT {_RECORD} FROM {_NTH} p")(
    lambda s, d: (lambda r: _record(commands.compare_in_order(r.where("side = 0"), r.where("side = 1"), slices(s, d))))(records(s, d))
)
_MERGE = commands.MergeParams(shift=OPEN)
_SELF = _PAIRED.format(sides=_SIDED, on=f"abs(a.pos - b.pos) <= {_MERGE.max_dist} AND (a.pos < b.pos OR (a.pos = b.pos AND a.id < b.id))", size=0.2)
add(
    "merge_command",
    f"""WITH RECURSIVE good AS MATERIALIZED (SELECT id1, id2, relsizediff, reldist, hap_a = hap_b AS same FROM {_SELF} p WHERE reldist <= 0.2),
      e AS (SELECT id1 AS u, id2 AS v FROM good UNION SELECT id2, id1 FROM good), x AS (SELECT id1 AS u, id2 AS v FROM good WHERE same UNION SELECT id2, id1 FROM good WHERE same),
      r1(id, other) AS (SELECT id, id FROM {LAID} l UNION SELECT r1.id, e.v FROM r1 JOIN e ON e.u = r1.other), r2(id, other) AS (SELECT id, id FROM {LAID} l UNION SELECT r2.id, x.v FROM r2 JOIN x ON x.u = r2.other),
      members AS (SELECT a.id, a.cluster, b.exact FROM (SELECT id, min(other) AS cluster FROM r1 GROUP BY id) a JOIN (SELECT id, min(other) AS exact FROM r2 GROUP BY id) b USING (id)),
      n AS (SELECT cluster, exact, count(*) AS k FROM members GROUP BY ALL), rep AS (SELECT cluster, arg_min(exact, (-k, exact)) AS rep, CAST(sum(k) AS BIGINT) AS n_calls, max(k) AS n_exact FROM n GROUP BY cluster),
      m AS (SELECT cluster, max(relsizediff) AS max_size, max(reldist) AS max_edit FROM good JOIN members ON id = id1 GROUP BY cluster)
    SELECT rep AS id, pos, n_calls, n_exact, member_ids, exact_ids, round(coalesce(max_size, 0), 9) AS max_size, round(coalesce(max_edit, 0), 9) AS max_edit FROM (
      SELECT cluster, rep, n_calls, n_exact, string_agg(id, ':' ORDER BY id) AS member_ids, string_agg(CASE WHEN exact = rep THEN id END, ':' ORDER BY id) AS exact_ids FROM members JOIN rep USING (cluster) GROUP BY ALL)
      JOIN {LAID} l ON l.id = rep LEFT JOIN m USING (cluster)""",
)(lambda s, d: commands.merge(records(s, d), slices(s, d), _MERGE).clusters.select("id", F.col("pos").cast("int").alias("pos"), "n_calls", "n_exact", "member_ids", "exact_ids", F.round("max_size", 9).alias("max_size"), F.round("max_edit", 9).alias("max_edit")))

BUFFER, TOO_LONG = 50, 160  # small windows, so that the limit shows too
_COMMON = "coalesce(list_min(list_filter(range(1, length({y}) + 1), lambda i: ({x})[i] <> ({y})[i])) - 1, length({y}))"
_FLANKS = f"""(SELECT *, greatest(pos - {BUFFER}, 1) AS l, least("end" + {BUFFER}, contig_len) AS r, CASE WHEN rl > al THEN ref[2:] ELSE alt[2:] END AS free FROM {_SIDED} x)"""
_WIDE = f"""(SELECT *, {_COMMON.format(x='free || behind', y='behind')} AS right_bases, {_COMMON.format(x='reverse(free) || reverse(ahead)', y='reverse(ahead)')} AS left_bases FROM (
  SELECT *, r - l + 1 + greatest(al - rl, 0) > {TOO_LONG} AS long, s[l:pos] AS ahead, s["end" + 1:r] AS behind FROM {_FLANKS} f))"""
add(
    "widen_command",
    f"""SELECT id, CASE WHEN long THEN 'TOOLONG' ELSE 'ok' END AS status, CASE WHEN NOT long THEN CAST(pos - left_bases AS BIGINT) END AS wide_start, CASE WHEN NOT long THEN CAST("end" + 1 + right_bases AS BIGINT) END AS wide_end,
      CASE WHEN NOT long THEN CAST(left_bases + right_bases AS INT) END AS break_length, CASE WHEN long THEN NULL WHEN al > rl THEN CASE WHEN left_bases + right_bases >= al - rl THEN 'DUP' ELSE 'SIMPLEINS' END ELSE CASE WHEN left_bases + right_bases >= rl - al THEN 'CONTRAC' ELSE 'SIMPLEDEL' END END AS rep_type FROM {_WIDE} w""",
)(lambda s, d: commands.widen(records(s, d), slices(s, d), contigs(s, d), BUFFER, TOO_LONG, bridging=False).select("id", "status", F.col("wide_start").cast("bigint"), F.col("wide_end").cast("bigint"), F.col("break_length").cast("int"), "rep_type"))
