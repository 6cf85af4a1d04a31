"""Queries of the variant operators over the whole tables, each beside the SQL that gives the same rows.

Calls are ``svcalls``, distances ``dist_pairs``, homozygous-reference stretches ``hr_regions``, raw
lines ``vcf_raw``, contigs ``ref_contigs``. The tables hold no alignments of contigs, so these are
laid out from ``lineitem`` by one piece of SQL that both engines read (ALIGNMENTS).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import cigar as C
from strandline.functions import dates as T
from strandline.functions import info as I
from strandline.functions import sequence as S
from strandline.operators import alignments as A
from strandline.operators import clusters as K
from strandline.operators import distances as D
from strandline.operators import genotype as G
from strandline.operators import graph
from strandline.operators import intervals as V
from strandline.operators import scoring
from strandline.operators.bandjoin import band_join, band_self_pairs
from strandline.plans import commands
from strandline.session import durable, table
from strandline.sources import fasta, sinks, tabular, vcf

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
NEAR, MERGE, FIND, BACK = commands.BenchmarkParams.max_dist, commands.MergeParams.max_dist, 100_000, commands.BACK_DIST  # the commands' own windows

CALLS = "(SELECT row_id, callset AS file, line_no, regexp_replace(chrom, '^chr', '') AS chrom, pos, call_id AS id, trim(ref_allele) AS ref, trim(alt_allele) AS alt, filter_tag AS filter, info, format_keys AS format, genotype, CAST(substr(callset, 3, 4) AS INT) % 2 AS side FROM svcalls)"
_SVTYPE = "nullif(regexp_extract(info, 'SVTYPE=([^;\\s]+)', 1), '')"
_END = "TRY_CAST(nullif(regexp_extract(info, '(?:^|;)\\s*END=(\\d+)', 1), '') AS BIGINT)"
_SVLEN = "TRY_CAST(nullif(regexp_extract(info, 'SVLEN=(-?\\d+)', 1), '') AS BIGINT)"
_SEQ = "upper(nullif(regexp_extract(info, '(?:^|;)\\s*SEQ=([ACGTNacgtn]+)', 1), ''))"
_SPELLED = "coalesce(regexp_full_match(upper(ref), '[ACGTN]+') AND regexp_full_match(upper(alt), '[ACGTN]+'), false)"
SVS = f"""(SELECT *, CASE WHEN status0 = 'ok' AND abs(altlength - reflength) < 0 THEN 'small' ELSE status0 END AS status,
  pos AS "start", CASE WHEN deleted_to IS NOT NULL THEN deleted_to ELSE pos + reflength - 1 END AS "end" FROM (
  SELECT *, CASE WHEN as_del AND NOT spelled THEN e - pos + 2 ELSE length(ref) END AS reflength,
    CASE WHEN spelled THEN length(alt) WHEN as_ins THEN length(seq) WHEN as_del THEN 1 END AS altlength,
    CASE WHEN spelled THEN 'ok' WHEN kind IN ('BND', 'UNK') THEN 'bnd' WHEN as_ins OR as_del THEN 'ok' ELSE 'symbolic' END AS status0,
    CASE WHEN as_del AND NOT spelled THEN e END AS deleted_to FROM (
    SELECT *, {_SPELLED} AS spelled, {_SVTYPE} AS kind, {_END} AS e, {_SEQ} AS seq,
      upper(alt) = '<INS>' AND {_SEQ} IS NOT NULL AS as_ins, upper(alt) = '<DEL>' AND {_END} IS NOT NULL AS as_del FROM {CALLS} c)))"""

_AL = """SELECT l_orderkey * 8 + l_linenumber AS align_no, concat('s', CAST(l_suppkey AS {text})) AS ref_entry, concat('q', CAST(l_partkey AS {text})) AS query_entry,
  (l_orderkey % 20000) * 10 + l_linenumber AS ref_start, (l_orderkey % 20000) * 10 + l_linenumber + CAST(l_quantity AS BIGINT) * 40 AS ref_end,
  CASE WHEN l_returnflag = 'R' THEN 230000 - ((l_orderkey % 20000) * 10 + (l_linenumber * 7) % 20) ELSE (l_orderkey % 20000) * 10 + (l_linenumber * 7) % 20 END AS query_start,
  CASE WHEN l_returnflag = 'R' THEN 230000 - ((l_orderkey % 20000) * 10 + (l_linenumber * 7) % 20 + CAST(l_quantity AS BIGINT) * 40 + (l_linenumber * 5) % 11 - 5) ELSE (l_orderkey % 20000) * 10 + (l_linenumber * 7) % 20 + CAST(l_quantity AS BIGINT) * 40 + (l_linenumber * 5) % 11 - 5 END AS query_end,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS comp, CAST(round(l_discount * 100) AS BIGINT) AS mismatches, CAST(220000 AS BIGINT) AS ref_len, CAST(230000 AS BIGINT) AS query_len,
  concat(CAST(CAST(l_quantity AS BIGINT) * 30 AS {text}), 'M', CAST(1 + l_linenumber AS {text}), CASE WHEN l_linenumber % 2 = 0 THEN 'I' ELSE 'D' END, CAST(CAST(l_quantity AS BIGINT) * 10 AS {text}), 'M') AS cigar FROM lineitem"""
ALIGNMENTS = f"({_AL.format(text='VARCHAR')})"


def add(name: str, sql: str | None = None):
    def keep(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            SQL[name] = sql
        return query

    return keep


def calls(s: SparkSession, d: str) -> DataFrame:
    return vcf.from_calls(table(s, d, "svcalls")).withColumn("side", F.substring("file", 3, 4).cast("int") % 2)


def svs(s: SparkSession, d: str) -> DataFrame:
    return vcf.normalized(calls(s, d)).where("status = 'ok' and pos > 0")


def alignments(s: SparkSession, d: str) -> DataFrame:
    table(s, d, "lineitem").createOrReplaceTempView("strandline_lineitem")
    return s.sql(_AL.format(text="STRING").replace("FROM lineitem", "FROM strandline_lineitem"))


def lines(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "vcf_raw").select(F.col("callset").alias("file"), "line_no", F.col("raw_line").alias("line"))


def distances(s: SparkSession, d: str) -> DataFrame:
    there = lambda c: F.col(c).isNotNull() & ~F.col(c).isin("", ".", "NA")
    return D.usable(table(s, d, "dist_pairs").where(there("id1") & there("id2")))


GOOD_PAIRS = "(SELECT * FROM dist_pairs WHERE id1 IS NOT NULL AND id2 IS NOT NULL AND id1 NOT IN ('', '.', 'NA') AND id2 NOT IN ('', '.', 'NA') AND edit_distance >= 0)"
CLASSIC = "abs(relshift) <= 0.2 AND abs(relsizediff) <= 0.2 AND abs(reldist) <= 0.2"

# ---------------------------------------------------------------- scans, filters, predicates

add("vcf_normalize", f'SELECT row_id, chrom, "start", "end", CAST(reflength AS BIGINT) AS reflength, CAST(altlength AS BIGINT) AS altlength, status FROM {SVS} x')(
    lambda s, d: vcf.normalized(calls(s, d)).select("row_id", "chrom", "start", "end", "reflength", "altlength", "status")
)
add(
    "vcf_split",
    r"""SELECT file, line_no, c[1] AS chrom, CASE WHEN regexp_full_match(c[2], '\d+') THEN TRY_CAST(c[2] AS BIGINT) END AS pos, c[3] AS id, c[8] AS info,
      CASE WHEN len(c) < 8 THEN 'short' WHEN NOT coalesce(regexp_full_match(c[2], '\d+'), false) THEN 'pos' ELSE 'ok' END AS status
    FROM (SELECT callset AS file, line_no, string_split(regexp_replace(raw_line, '\r\z', ''), chr(9)) AS c, raw_line FROM vcf_raw) WHERE NOT starts_with(raw_line, '#') AND trim(raw_line) <> ''""",
)(lambda s, d: vcf.split_records(lines(s, d)).select("file", "line_no", "chrom", "pos", "id", "info", "status"))
add("vcf_headers", "SELECT callset AS file, line_no, regexp_extract(raw_line, '^##([^=]+)=', 1) AS key, regexp_extract(raw_line, '^##[^=]+=<ID=([^,>]+)', 1) AS id FROM vcf_raw WHERE starts_with(raw_line, '#')")(
    lambda s, d: vcf.headers(lines(s, d)).select("file", "line_no", "key", "id")
)
add("first_file_header", "SELECT line_no, raw_line AS line FROM vcf_raw WHERE starts_with(raw_line, '#') AND callset = 'cs0000_raw.vcf'")(
    lambda s, d: vcf.first_file_header(lines(s, d), "cs0000_raw.vcf").select("line_no", "line")
)
add("multi_vcf_union", "SELECT callset AS file, line_no FROM svcalls UNION ALL SELECT callset, line_no FROM vcf_raw WHERE NOT starts_with(raw_line, '#') AND trim(raw_line) <> ''")(
    lambda s, d: calls(s, d).select("file", "line_no").unionByName(vcf.split_records(lines(s, d)).select("file", "line_no"))
)
add("info_extract", f"SELECT row_id, {_END} AS end_pos, TRY_CAST(nullif(regexp_extract(info, 'END=(\\d+)', 1), '') AS BIGINT) AS end_loose, {_SVLEN} AS svlen, {_SVTYPE} AS svtype, {_SEQ} AS seq FROM svcalls")(
    lambda s, d: table(s, d, "svcalls").select(
        "row_id", I.end_tag(F.col("info")).alias("end_pos"), I.end_tag(F.col("info"), False).alias("end_loose"), I.svlen_tag(F.col("info")).alias("svlen"), I.svtype_tag(F.col("info")).alias("svtype"), I.seq_tag(F.col("info")).alias("seq")
    )
)
add("info_keys", "SELECT DISTINCT string_split(trim(x), '=')[1] AS info_key FROM (SELECT unnest(string_split(info, ';')) AS x FROM svcalls) WHERE len(string_split(trim(x), '=')) = 2")(lambda s, d: vcf.info_keys(calls(s, d)))
add(
    "widened_tags",
    r"SELECT row_id, regexp_extract(info, p, 1) AS wide_chrom, CAST(regexp_extract(info, p, 2) AS BIGINT) AS wide_start, CAST(regexp_extract(info, p, 3) AS BIGINT) AS wide_end FROM (SELECT *, 'REFWIDENED=([^:;]+):(\d+)-(\d+)' AS p FROM svcalls) WHERE regexp_matches(info, 'REFWIDENED=([^:;]+):(\d+)-(\d+)')",
)(lambda s, d: table(s, d, "svcalls").select("row_id", I.widened_tag(F.col("info"), "REFWIDENED").alias("w")).where("w is not null").select("row_id", F.col("w.chrom").alias("wide_chrom"), F.col("w.start").alias("wide_start"), F.col("w.end").alias("wide_end")))
_FMT = "TRY_CAST(nullif(string_split(genotype, ':')[list_position(string_split(format, ':'), '{}')], '.') AS BIGINT)"
add("format_readcounts", f"SELECT row_id, {_FMT.format('DR')} AS dr, {_FMT.format('DV')} AS dv FROM {CALLS} c")(
    lambda s, d: calls(s, d).select("row_id", *(I.format_value(F.col("format"), F.get("samples", F.lit(0)), k).try_cast("bigint").alias(k.lower()) for k in ("DR", "DV")))
)
add("read_support", f"SELECT row_id FROM {CALLS} c WHERE {_FMT.format('DV')} >= 10")(lambda s, d: scoring.read_support(calls(s, d), 10).select("row_id"))
add("read_fraction", f"SELECT row_id FROM (SELECT row_id, coalesce({_FMT.format('DR')}, 0) AS dr, coalesce({_FMT.format('DV')}, 0) AS dv FROM {CALLS} c) WHERE NOT (dr > 0 AND dv > 0 AND dv < dr * 0.5)")(
    lambda s, d: scoring.read_fraction(calls(s, d), 0.5).select("row_id")
)
add("filter_eq", f"SELECT row_id, status, deleted FROM (SELECT row_id, status, deleted_to AS deleted, filter FROM {SVS} x) WHERE filter = 'PASS' AND status = 'ok'")(
    lambda s, d: vcf.normalized(commands.filtered(calls(s, d), "PASS")).where("status = 'ok'").select("row_id", "status", F.col("deleted_to").alias("deleted"))
)
_SIZE = f"coalesce(abs({_SVLEN}), CASE WHEN regexp_full_match(ref, '[A-Za-z]+') AND regexp_full_match(alt, '[A-Za-z]+') THEN abs(length(ref) - length(alt)) END, 0)"
add("variant_size", f"SELECT row_id, {_SIZE} AS size FROM {CALLS} c")(lambda s, d: calls(s, d).select("row_id", I.variant_size(F.col("info"), F.col("ref"), F.col("alt")).alias("size")))
add("min_size", f"SELECT row_id, side FROM (SELECT row_id, side, {_SIZE} AS size FROM {CALLS} c) WHERE (side = 0 AND size > 50) OR (side = 1 AND size >= 50)")(
    lambda s, d: calls(s, d)
    .withColumn("size", I.variant_size(F.col("info"), F.col("ref"), F.col("alt")))
    .where(((F.col("side") == 0) & scoring.size_passes(F.col("size"), 50, False)) | ((F.col("side") == 1) & scoring.size_passes(F.col("size"), 50, True)))
    .select("row_id", "side")
)
add("min_size_merge", f"SELECT row_id, status FROM {SVS.replace('abs(altlength - reflength) < 0', 'abs(altlength - reflength) < 50')} x")(lambda s, d: vcf.normalized(calls(s, d), 50).select("row_id", "status"))
add("svlen_svtype_filter", f"SELECT row_id FROM {CALLS} c WHERE coalesce({_SVLEN} >= -300, true) AND coalesce({_SVLEN} <= 300, true) AND coalesce({_SVTYPE} = 'INS', true)")(
    lambda s, d: commands.filter_vcf(calls(s, d), None, -300, 300, "INS").select("row_id")
)
add("region_scan", f"SELECT row_id FROM {CALLS} c WHERE chrom = '1' AND pos <= 5000000 AND greatest(coalesce({_END}, pos + length(ref) - 1), pos) >= 100000")(
    lambda s, d: vcf.in_region(calls(s, d), "1", 100_000, 5_000_000).select("row_id")
)
add("skip_long_n", f"SELECT row_id FROM {CALLS} c WHERE NOT (contains(upper(ref), 'NNNNNN') OR contains(upper(alt), 'NNNNNN'))")(lambda s, d: commands.without_long_n(vcf.normalized(calls(s, d))).select("row_id"))
add("info_declared", "SELECT row_id, array_to_string(list_filter(string_split(info, ';'), lambda x: string_split(trim(x), '=')[1] IN ('SVTYPE', 'SVLEN', 'END')), ';') AS info FROM svcalls WHERE info IS NOT NULL")(
    lambda s, d: table(s, d, "svcalls").where("info is not null").select("row_id", I.keep_declared(F.col("info"), F.array(F.lit("SVTYPE"), F.lit("SVLEN"), F.lit("END"))).alias("info"))
)
add("running_ids", f"SELECT row_id, CASE WHEN lacks THEN 'testsv_' || CAST(sum(lacks::INT) OVER (ORDER BY chrom NULLS FIRST, pos NULLS FIRST, row_id ROWS UNBOUNDED PRECEDING) AS VARCHAR) ELSE id END AS id FROM (SELECT *, id IS NULL OR id = '.' AS lacks FROM {CALLS} c)")(
    lambda s, d: vcf.with_running_ids(calls(s, d), "testsv", ["chrom", "pos", "row_id"]).select("row_id", "id")
)
add("comparable_calls", f"SELECT row_id, CASE WHEN spelled THEN 'ok' WHEN e IS NULL THEN 'no_end' WHEN NOT coalesce(spelled, false) AND length(ref) <> e - pos + 1 THEN 'length' ELSE 'ok' END AS status FROM (SELECT *, regexp_full_match(upper(ref), '[ACGT]+') AND regexp_full_match(upper(alt), '[ACGT]+') AS spelled, TRY_CAST(nullif(regexp_extract(info, 'END=(\\d+)', 1), '') AS BIGINT) AS e FROM {CALLS} c)")(
    lambda s, d: vcf.comparable(calls(s, d)).select("row_id", "status")
)
add("widenable_calls", f"SELECT row_id, CASE WHEN coalesce(regexp_full_match(upper(ref), '[ACGTMRWSYKVHDBNU]+') AND regexp_full_match(upper(regexp_replace(alt, ',.*', '')), '[ACGTMRWSYKVHDBNU]+'), false) THEN 'ok' ELSE 'symbolic' END AS status FROM {CALLS} c")(
    lambda s, d: vcf.widenable(calls(s, d)).select("row_id", "status")
)
add("genotypable_calls", f"SELECT row_id, CASE WHEN regexp_matches(info, 'REFWIDENED=([^:;]+):(\\d+)-(\\d+)(_comp)?') AND {_SVTYPE} IS NOT NULL AND {_SVLEN} IS NOT NULL THEN 'ok' ELSE 'untagged' END AS status FROM {CALLS} c")(
    lambda s, d: vcf.genotypable(calls(s, d)).select("row_id", "status")
)
add(
    "distance_scan",
    "SELECT id1, id2, edit_distance, maxshift, marlength, round(relshift, 9) AS relshift FROM dist_pairs WHERE id1 IS NOT NULL AND id2 IS NOT NULL AND edit_distance IS NOT NULL",
)(
    lambda s, d: tabular.distances(sinks.distance_lines(table(s, d, "dist_pairs").where("id1 is not null and id2 is not null and edit_distance is not null")))
    .select("id1", "id2", "edit_distance", "maxshift", "marlength", F.round("relshift", 9).alias("relshift"))
)
add("bed_scan", 'SELECT chrom, hr_start + 1 AS "start", hr_end AS "end", CASE WHEN hr_end < hr_start + 1 THEN \'reversed\' ELSE \'ok\' END AS status FROM hr_regions WHERE chrom IS NOT NULL AND hr_start >= 0 AND hr_end >= 0')(
    lambda s, d: tabular.bed(table(s, d, "hr_regions").where("chrom is not null and hr_start >= 0 and hr_end >= 0").select(F.concat_ws("\t", "chrom", F.col("hr_start").cast("string"), F.col("hr_end").cast("string")).alias("line")))
)
add("coverage_scan", 'SELECT DISTINCT chrom, hr_start AS "start", hr_end AS "end", contig FROM hr_regions WHERE chrom IS NOT NULL AND hr_start IS NOT NULL AND hr_end IS NOT NULL AND contig IS NOT NULL')(
    lambda s, d: tabular.coverage(table(s, d, "hr_regions").where("chrom is not null and hr_start is not null and hr_end is not null and contig is not null").select(F.concat_ws("\t", "chrom", F.col("hr_start").cast("string"), F.col("hr_end").cast("string"), "contig").alias("line")))
)

# ---------------------------------------------------------------- pairs of calls, distances, benchmark

_PAIR = f'SELECT a.row_id AS test_key, b.row_id AS truth_key, a.pos AS a_pos, b.pos AS b_pos, a.reflength AS a_reflength, b.reflength AS b_reflength, a.altlength AS a_altlength, b.altlength AS b_altlength, a."end" AS a_end, b."end" AS b_end FROM {SVS} a JOIN {SVS} b ON a.chrom = b.chrom AND a.status = \'ok\' AND b.status = \'ok\' AND a.pos > 0 AND b.pos > 0 AND a.side = 0 AND b.side = 1 AND abs(a.pos - b.pos) <= {NEAR}'
_DENOM = "((greatest(a_reflength, a_altlength) + greatest(b_reflength, b_altlength)) / 2.0)"
_GAP = "abs((a_altlength - a_reflength) - (b_altlength - b_reflength))"
_MAR = "greatest(greatest(a_end, b_end) - least(a_pos, b_pos) + 1, greatest(a_end, b_end) - least(a_pos, b_pos) + 1 + a_altlength - a_reflength, greatest(a_end, b_end) - least(a_pos, b_pos) + 1 + b_altlength - b_reflength)"
MATCHES = f"(SELECT test_key, truth_key FROM ({_PAIR}) WHERE {_GAP} <= 0.2 * {_DENOM})"


def call_pairs(rows: DataFrame, width: int = NEAR) -> DataFrame:
    side = lambda k, n, key: rows.where(F.col("side") == k).select("chrom", F.col("row_id").alias(key), *(F.col(c).alias(f"{n}_{c}") for c in ("pos", "end", "reflength", "altlength")), F.col("chrom").alias(f"{n}_chrom"))
    return band_join(side(0, "a", "test_key"), side(1, "b", "truth_key"), ["chrom"], "a_pos", "b_pos", width)


def call_matches(rows: DataFrame) -> DataFrame:
    return call_pairs(rows).where(D.potential_match(0.2, 1.0)).select("test_key", "truth_key")


def benchmarked(s: SparkSession, d: str) -> scoring.Benchmark:
    """The calls are normalized once; a match is one by size here, as the tables have no reference bases (see plans/genome.py for the whole rule)."""
    rows = durable(svs(s, d).select("row_id", "side", "chrom", "pos", "end", "reflength", "altlength"), "records")
    return scoring.score(rows.where("side = 0"), rows.where("side = 1"), durable(call_matches(rows), "matches"), "row_id")


add("band_join_pairs", f"SELECT test_key, truth_key FROM ({_PAIR})")(lambda s, d: call_pairs(svs(s, d)).select("test_key", "truth_key"))
add("band_self_pairs", f"SELECT a.row_id AS a_row_id, b.row_id AS b_row_id FROM {SVS} a JOIN {SVS} b ON a.chrom = b.chrom AND a.status = 'ok' AND b.status = 'ok' AND a.pos > 0 AND b.pos > 0 AND abs(a.pos - b.pos) <= {MERGE} AND (a.pos < b.pos OR (a.pos = b.pos AND a.row_id < b.row_id))")(
    lambda s, d: band_self_pairs(svs(s, d), ["chrom"], "pos", ["row_id"], [], MERGE).select("a_row_id", "b_row_id")
)
add("find_matches", f"SELECT a.row_id AS a_row_id, b.row_id AS b_row_id, a.pos - b.pos AS gap FROM {CALLS} a JOIN {CALLS} b ON a.chrom = b.chrom AND a.side = 0 AND b.side = 1 AND abs(a.pos - b.pos) < {FIND}")(
    lambda s, d: commands.find_matches(calls(s, d).where("side = 0"), calls(s, d).where("side = 1"), FIND, ("row_id",)).select("a_row_id", "b_row_id", (F.col("a_pos") - F.col("b_pos")).alias("gap"))
)


def _compared(s: SparkSession, d: str) -> DataFrame:
    """Every even callset beside the next odd one."""
    rows = calls(s, d).withColumn("pair", F.floor(F.substring("file", 3, 4).cast("int") / 2))
    both = commands.compare_in_order(rows.where("side = 0"), rows.where("side = 1"), pair=("pair",), order=("line_no", "row_id"), keep=("row_id",))
    return both.select("pair", F.col("n").cast("bigint").alias("n"), "a_row_id", "b_row_id", "status", "avgsize", "sizediff", "posdiff", "marlength")


_FORM = f"""(SELECT *, CASE WHEN spelled THEN 'ok' WHEN e IS NULL THEN 'no_end' WHEN length(ref) <> e - pos + 1 THEN 'length' ELSE 'ok' END AS status, CASE WHEN spelled THEN pos + length(ref) - 1 ELSE e END AS "end",
  row_number() OVER (PARTITION BY file ORDER BY line_no, row_id) AS n, CAST(floor(CAST(substr(file, 3, 4) AS INT) / 2) AS BIGINT) AS pair FROM (
  SELECT *, coalesce(regexp_full_match(upper(ref), '[ACGT]+') AND regexp_full_match(upper(alt), '[ACGT]+'), false) AS spelled, TRY_CAST(nullif(regexp_extract(info, 'END=(\\d+)', 1), '') AS BIGINT) AS e FROM {CALLS} c))"""
_SIZES = "(length(a.alt) - length(a.ref)) AS sa, (length(b.alt) - length(b.ref)) AS sb"
add(
    "zip_records",
    f"""WITH r AS {_FORM}, z AS (SELECT coalesce(a.pair, b.pair) AS pair, coalesce(a.n, b.n) AS n, a.row_id AS a_row_id, b.row_id AS b_row_id, a.status AS s1, b.status AS s2, a.chrom AS c1, b.chrom AS c2, a.pos AS p1, b.pos AS p2, a."end" AS e1, b."end" AS e2, {_SIZES}
      FROM (SELECT * FROM r WHERE side = 0) a FULL JOIN (SELECT * FROM r WHERE side = 1) b ON a.pair = b.pair AND a.n = b.n)
    SELECT pair, n, a_row_id, b_row_id, CASE WHEN s1 IS NULL OR s2 IS NULL THEN 'missing' WHEN c1 IS DISTINCT FROM c2 THEN 'DIFFCHROMS' WHEN s1 <> 'ok' THEN s1 WHEN s2 <> 'ok' THEN s2 ELSE 'ok' END AS status,
      (sa + sb) / 2 AS avgsize, CAST(sa - sb AS BIGINT) AS sizediff, p1 - p2 AS posdiff,
      CASE WHEN c1 = c2 THEN CAST(greatest(w, w + sa, w + sb) AS BIGINT) ELSE 0 END AS marlength FROM (SELECT *, greatest(e1, e2) - least(p1, p2) + 1 AS w FROM z)""",
)(_compared)
add("potential_match", f"SELECT test_key, truth_key, {_GAP} <= {_DENOM} * 0.2 AS close_size, CAST({_MAR} AS BIGINT) AS marlength, abs(a_altlength - b_altlength) > 0.2 * {_MAR} AS prohibitive FROM ({_PAIR})")(
    lambda s, d: call_pairs(svs(s, d)).select("test_key", "truth_key", D.potential_match(0.2, 1.0).alias("close_size"), D.affected_length().alias("marlength"), D.prohibitive_shift(0.2).alias("prohibitive"))
)
_COUNTS = f"""WITH s AS (SELECT row_id, side FROM {SVS} x WHERE status = 'ok' AND pos > 0), m AS {MATCHES},
  t AS (SELECT count(*) FILTER (WHERE row_id IN (SELECT test_key FROM m)) AS ptp, count(*) FILTER (WHERE row_id NOT IN (SELECT test_key FROM m)) AS fp FROM s WHERE side = 0),
  u AS (SELECT count(*) FILTER (WHERE row_id IN (SELECT truth_key FROM m)) AS dtp, count(*) FILTER (WHERE row_id NOT IN (SELECT truth_key FROM m)) AS fn FROM s WHERE side = 1)"""
add("benchmark_metrics", _COUNTS + " SELECT ptp, fp, dtp, fn, round(precision_, 9) AS \"precision\", round(recall_, 9) AS recall, round(2 * precision_ * recall_ / (precision_ + recall_), 9) AS f1 FROM (SELECT *, ptp / (ptp + fp) AS precision_, dtp / (dtp + fn) AS recall_ FROM t, u)")(
    lambda s, d: benchmarked(s, d).metrics.select("ptp", "fp", "dtp", "fn", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))
)
add("false_positives", f"SELECT row_id FROM {SVS} x WHERE status = 'ok' AND pos > 0 AND side = 0 AND row_id NOT IN (SELECT test_key FROM {MATCHES})")(lambda s, d: benchmarked(s, d).false_positives.select("row_id"))
add("false_negatives", f"SELECT row_id FROM {SVS} x WHERE status = 'ok' AND pos > 0 AND side = 1 AND row_id NOT IN (SELECT truth_key FROM {MATCHES})")(lambda s, d: benchmarked(s, d).false_negatives.select("row_id"))
add("multiple_matches", f"SELECT test_key, count(*) AS n_matches, string_agg(CAST(truth_key AS VARCHAR), ',' ORDER BY truth_key) AS ids FROM {MATCHES} GROUP BY test_key HAVING count(*) > 1")(
    lambda s, d: scoring.multiple_matches(call_matches(svs(s, d)), "test_key", "truth_key")
)
add("classic_match", f"SELECT pair_id FROM {GOOD_PAIRS} p WHERE {CLASSIC}")(lambda s, d: distances(s, d).where(D.classic_match()).select("pair_id"))
add("rate_match", f"SELECT pair_id FROM {GOOD_PAIRS} p WHERE subsdist <= 0.01 AND indeldist <= 0.1")(lambda s, d: distances(s, d).where(D.rate_match(0.01, 0.1)).select("pair_id"))

_ACGT = "regexp_replace(upper(text), '[^ACGT]', '', 'g')"
_LAG = f"(SELECT b.doc_id, b.h, a.h AS g FROM (SELECT doc_id, {_ACGT} AS h FROM documents WHERE text IS NOT NULL) a JOIN (SELECT doc_id, {_ACGT} AS h FROM documents WHERE text IS NOT NULL) b ON b.doc_id = a.doc_id + 1)"


def _neighbour_texts(s: SparkSession, d: str) -> DataFrame:
    """Each text's bases as ``h`` and those of the one numbered before it as ``g``."""
    h = F.regexp_replace(F.upper("text"), "[^ACGT]", "")
    rows = table(s, d, "documents").where("text is not null")
    return rows.select("doc_id", h.alias("h")).join(rows.select((F.col("doc_id") + 1).alias("doc_id"), h.alias("g")), "doc_id")


def _aligned_texts(texts: DataFrame) -> DataFrame:
    return D.aligned(texts.select("doc_id", F.col("h").alias("hap_a"), F.col("g").alias("hap_b")))


add("aligned_distance", f"SELECT doc_id, CAST(levenshtein(h, g) AS BIGINT) AS edit_distance, subs_and_indels FROM (SELECT *, CAST(levenshtein(h, g) AS BIGINT) AS subs_and_indels FROM {_LAG}) WHERE g IS NOT NULL")(
    lambda s, d: _aligned_texts(_neighbour_texts(s, d)).select("doc_id", "edit_distance", (F.col("subs") + F.col("indels")).alias("subs_and_indels"))
)
add("alignment_path")(lambda s, d: _aligned_texts(_neighbour_texts(s, d)).select("doc_id", "edit_distance", "max_shift", "subs", "indels"))

# ---------------------------------------------------------------- graph and clusters

_REACH = f"""WITH RECURSIVE good AS (SELECT id1, id2, {CLASSIC} AS linked, relshift = 0 AND relsizediff = 0 AND reldist = 0 AS same, relshift, relsizediff, reldist FROM {GOOD_PAIRS} p),
  ids AS (SELECT id1 AS id FROM good UNION SELECT id2 FROM good),
  e AS (SELECT id1 AS u, id2 AS v FROM good WHERE linked UNION SELECT id2, id1 FROM good WHERE linked),
  x AS (SELECT id1 AS u, id2 AS v FROM good WHERE linked AND same UNION SELECT id2, id1 FROM good WHERE linked AND same),
  r1(id, other) AS (SELECT id, id FROM ids UNION SELECT r1.id, e.v FROM r1 JOIN e ON e.u = r1.other),
  r2(id, other) AS (SELECT id, id FROM ids UNION SELECT r2.id, x.v FROM r2 JOIN x ON x.u = r2.other),
  members AS (SELECT a.id, a.cluster, b.exact FROM (SELECT id, min(other) AS cluster FROM r1 GROUP BY id) a JOIN (SELECT id, min(other) AS exact FROM r2 GROUP BY id) b USING (id))"""


def _members(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = distances(s, d).where("edit_distance >= 0")
    ids = rows.select(F.explode(F.array("id1", "id2")).alias("id")).distinct()
    return K.cluster_calls(ids, rows, D.classic_match()), rows


add("connected_components", _REACH + " SELECT id, cluster AS component FROM members")(
    lambda s, d: graph.components(
        distances(s, d).where("edit_distance >= 0").select(F.explode(F.array("id1", "id2")).alias("id")).distinct(),
        distances(s, d).where(D.classic_match()).select(F.col("id1").alias("src"), F.col("id2").alias("dst")),
    )
)
add("exact_subclusters", _REACH + " SELECT id, exact FROM members")(lambda s, d: _members(s, d)[0].select("id", "exact"))
add("cluster_sizes", _REACH + ", n AS (SELECT cluster, exact, count(*) AS k FROM members GROUP BY ALL) SELECT cluster, CAST(sum(k) AS BIGINT) AS n_calls, max(k) AS n_exact, arg_min(exact, (-k, exact)) AS representative FROM n GROUP BY cluster")(
    lambda s, d: K.cluster_sizes(_members(s, d)[0])
)
add("cluster_distances", _REACH + " SELECT cluster, round(max(abs(relshift)), 9) AS max_shift, round(max(abs(relsizediff)), 9) AS max_size, round(max(abs(reldist)), 9) AS max_edit FROM good JOIN members ON id = id1 WHERE linked GROUP BY cluster")(
    lambda s, d: (lambda m: K.cluster_distances(m[0], m[1], D.classic_match()).select("cluster", *(F.round(c, 9).alias(c) for c in ("max_shift", "max_size", "max_edit"))))(_members(s, d))
)
add("cluster_lists", _REACH + ", n AS (SELECT cluster, exact, count(*) AS k FROM members GROUP BY ALL), rep AS (SELECT cluster, arg_min(exact, (-k, exact)) AS rep FROM n GROUP BY cluster) SELECT cluster, string_agg(id, ':' ORDER BY id) AS member_ids, coalesce(string_agg(CASE WHEN exact = rep THEN id END, ':' ORDER BY id), '') AS exact_ids FROM members JOIN rep USING (cluster) GROUP BY cluster")(
    lambda s, d: K.cluster_lists(_members(s, d)[0])
)
add("unclustered_calls", f"SELECT row_id FROM {CALLS} c WHERE id IS NULL OR id NOT IN (SELECT id1 FROM {GOOD_PAIRS} p UNION SELECT id2 FROM {GOOD_PAIRS} q)")(
    lambda s, d: K.unclustered(calls(s, d), distances(s, d).where("edit_distance >= 0").select(F.explode(F.array("id1", "id2")).alias("id"))).where("not in_graph").select("row_id")
)

# ---------------------------------------------------------------- alignments and regions

add("region_discovery", f'SELECT ref_entry, CASE WHEN ref_start < before THEN \'OVERLAP\' ELSE \'GAP\' END AS kind, least(ref_start, before) AS "start", greatest(ref_start, before) AS "end" FROM (SELECT *, lag(ref_end) OVER (PARTITION BY ref_entry, query_entry ORDER BY ref_start, ref_end, align_no) AS before FROM {ALIGNMENTS} a) WHERE before IS NOT NULL')(
    lambda s, d: V.regions_between(alignments(s, d), ["align_no"])
)
_REGIONS = f"(SELECT ref_entry, least(ref_start, before) AS s, greatest(ref_start, before) AS e FROM (SELECT *, lag(ref_end) OVER (PARTITION BY ref_entry, query_entry ORDER BY ref_start, ref_end, align_no) AS before FROM {ALIGNMENTS} a) WHERE before IS NOT NULL)"
_ISLANDS = f"(SELECT ref_entry AS chrom, min(s) AS a, max(e) AS z FROM (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY ref_entry ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS n FROM (SELECT *, max(e) OVER (PARTITION BY ref_entry ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {_REGIONS} r)) GROUP BY ref_entry, n)"
add("region_merge", f'SELECT chrom, a AS "start", z AS "end" FROM {_ISLANDS} i')(lambda s, d: commands.discover_regions(alignments(s, d)).select("chrom", "start", "end"))


def windows(s: SparkSession, d: str) -> DataFrame:
    """One region for each order: 200 bases on the contig that its key names."""
    o = table(s, d, "orders")
    return o.select(F.concat(F.lit("s"), (F.col("o_orderkey") % 97 + 1).cast("string")).alias("chrom"), F.col("o_orderkey").alias("region_id"), (F.col("o_orderkey") % 190000 + 300).alias("start"), (F.col("o_orderkey") % 190000 + 500).alias("end"))


WINDOWS = '(SELECT concat(\'s\', CAST(o_orderkey % 97 + 1 AS VARCHAR)) AS chrom, o_orderkey AS region_id, o_orderkey % 190000 + 300 AS "start", o_orderkey % 190000 + 500 AS "end" FROM orders)'
_SPAN = f'(SELECT region_id, w.chrom, w."start", w."end", query_entry, min(comp) AS comp FROM (SELECT w.*, query_entry, comp, bool_or(ref_start < w."start" - 20 AND ref_end > w."start" - 20 + 29) AS l, bool_or(ref_start < w."end" + 20 - 29 AND ref_end > w."end" + 20) AS r FROM {WINDOWS} w JOIN {ALIGNMENTS} a ON a.ref_entry = w.chrom GROUP BY ALL) w WHERE l AND r GROUP BY ALL)'
add("spanning_pairs", f"SELECT region_id, query_entry, comp FROM {_SPAN} x")(lambda s, d: V.spanning_pairs(windows(s, d), alignments(s, d), 20, 30, 1 << 11).select("region_id", "query_entry", "comp"))
add("uncovered_regions", f"SELECT region_id FROM {WINDOWS} w WHERE region_id NOT IN (SELECT region_id FROM {_SPAN} x)")(lambda s, d: V.uncovered(windows(s, d), V.spanning_pairs(windows(s, d), alignments(s, d), 20, 30, 1 << 11)).select("region_id"))
add("away_from_edges", 'SELECT region_id, CASE WHEN contig_len IS NULL OR hr_start - 1000 <= 0 OR hr_end + 1000 > contig_len THEN \'chromend\' ELSE \'ok\' END AS status FROM (SELECT *, regexp_replace(chrom, \'^chr\', \'\') AS c FROM hr_regions) h LEFT JOIN ref_contigs r ON r.chrom = h.c WHERE hr_start IS NOT NULL AND hr_end IS NOT NULL')(
    lambda s, d: V.away_from_edges(table(s, d, "hr_regions").where("hr_start is not null and hr_end is not null").select("region_id", F.regexp_replace("chrom", "^chr", "").alias("chrom"), F.col("hr_start").alias("start"), F.col("hr_end").alias("end")), table(s, d, "ref_contigs"), 1000).select("region_id", "status")
)
_STRETCH = "(SELECT sample_name AS sample, regexp_replace(chrom, '^chr', '') AS chrom, hr_start, hr_end, contig FROM hr_regions WHERE chrom IS NOT NULL AND hr_start >= 1 AND hr_end >= hr_start)"


def stretches(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "hr_regions").where("chrom is not null and hr_start >= 1 and hr_end >= hr_start").select(F.col("sample_name").alias("sample"), F.regexp_replace("chrom", "^chr", "").alias("chrom"), "hr_start", "hr_end", "contig", "region_id")


add("calls_in_regions", f'SELECT row_id FROM {SVS} c WHERE status = \'ok\' AND pos > 0 AND EXISTS (SELECT 1 FROM {_STRETCH} h WHERE h.chrom = c.chrom AND h.hr_start <= c."end" AND h.hr_end >= c.pos)')(
    lambda s, d: V.touching(svs(s, d), stretches(s, d).select("chrom", F.col("hr_start").alias("r_start"), F.col("hr_end").alias("r_end")), ["row_id"], "pos", "end").select("row_id")
)
add("covered_calls", f'SELECT row_id, EXISTS (SELECT 1 FROM {_STRETCH} h WHERE h.chrom = c.chrom AND h.hr_start <= c.pos AND h.hr_end >= c."end") AS covered FROM {SVS} c WHERE status = \'ok\' AND pos > 0')(
    lambda s, d: V.covered_flags(svs(s, d), stretches(s, d).select("chrom", F.col("hr_start").alias("r_start"), F.col("hr_end").alias("r_end")), ["row_id"], "pos", "end").select("row_id", "covered")
)
def _lift_sql(x: str, p: str, to_ref: bool, side: str = "") -> str:
    """Lifting through a CIGAR of two M runs with one I or D between them, as all of the laid-out alignments have it."""
    m1, op, k, m2 = (f"regexp_extract({side}cigar, '^(\\d+)M(\\d+)([ID])(\\d+)M$', {i})" for i in (1, 3, 2, 4))
    m1, k, m2 = (f"CAST({v} AS BIGINT)" for v in (m1, k, m2))
    sign = f"CASE WHEN {side}query_start > {side}query_end THEN -1 ELSE 1 END"
    here, there = ("I", "D") if to_ref else ("D", "I")
    off = f"(({p}) - {side}query_start) * {sign} + 1" if to_ref else f"({p}) - {side}ref_start + 1"
    out = (lambda n: f"{side}ref_start - 1 + {n}") if to_ref else (lambda n: f"{side}query_start + ({sign}) * ({n} - 1)")
    skip, jump = f"CASE WHEN {op} = '{here}' THEN {k} ELSE 0 END", f"CASE WHEN {op} = '{there}' THEN {k} ELSE 0 END"
    return f"CASE WHEN {off} <= 0 OR {off} > {m1} + {m2} + {skip} THEN NULL WHEN {off} <= {m1} THEN {out(off)} WHEN {off} <= {m1} + {skip} THEN {out(m1)} ELSE {out(f'({off} - {skip} + {jump})')} END"



_JUMPS = """*, ref_end AS ref1, query_end AS query1, r_ref_start AS ref2, r_query_start AS query2, r_ref_start - ref_end - 1 AS ref_gap, CASE WHEN comp = 1 THEN query_end - r_query_start - 1 ELSE r_query_start - query_end - 1 END AS query_gap"""
_KIND = "CASE WHEN size = 0 THEN 'ARTIFACT' WHEN size < 0 AND ref_gap > 0 THEN 'SUBSINS' WHEN size > 0 AND query_gap > 0 THEN 'SUBSDEL' WHEN ref_gap < 0 AND query_gap < 0 THEN CASE WHEN size < 0 THEN 'DUP' ELSE 'CONTRAC' END WHEN size < 0 THEN 'SIMPLEINS' ELSE 'SIMPLEDEL' END"


def _breaks_sql(source: str, keys: str) -> str:
    leads = ", ".join(f"lead({c}) OVER w AS r_{c}" for c in ("ref_start", "ref_end", "query_start", "query_end", "comp", "cigar"))
    return f"""(SELECT {_JUMPS} FROM (SELECT *, {leads} FROM {source} a WINDOW w AS (PARTITION BY {keys} ORDER BY ref_start, ref_end, align_no))
  WHERE r_ref_start IS NOT NULL AND comp = r_comp AND ref_end < r_ref_end AND ((comp = 0 AND query_start < r_query_start AND query_end < r_query_end) OR (comp = 1 AND query_start > r_query_start AND query_end > r_query_end)))"""


def _typed_sql(source: str) -> str:
    return f"(SELECT *, CASE WHEN svkind IN ('SIMPLEINS', 'DUP') THEN -ref_gap WHEN svkind IN ('SIMPLEDEL', 'CONTRAC') THEN -query_gap ELSE 0 END AS repeat_bases FROM (SELECT *, abs(size) AS svsize, {_KIND} AS svkind FROM (SELECT *, ref_gap - query_gap AS size FROM {source} b)))"


def _placed_sql(source: str) -> str:
    """Lifted ends and output coordinates of typed breaks."""
    ins, dele = "svkind IN ('SIMPLEINS', 'DUP')", "svkind IN ('SIMPLEDEL', 'CONTRAC')"
    lifts = f"""(SELECT *, CASE WHEN comp = 1 THEN 1 ELSE -1 END AS back, {ins} AS ins, {dele} AS del, CASE WHEN {dele} AND repeat_bases = 0 THEN 1 ELSE 0 END AS bare,
      CASE WHEN {ins} THEN coalesce({_lift_sql('', 'ref1', False, 'r_')}, query2 - 1) END AS query1p, CASE WHEN {ins} THEN coalesce({_lift_sql('', 'ref2', False)}, query1 - 1) END AS query2p,
      CASE WHEN {dele} THEN coalesce({_lift_sql('', 'query1', True, 'r_')}, ref2 - 1) END AS ref1p, CASE WHEN {dele} THEN coalesce({_lift_sql('', 'query2', True)}, ref1 + 1) END AS ref2p FROM {source} t)"""
    spots = f"""(SELECT *, CASE WHEN ins THEN ref2 - 1 WHEN del THEN ref2p - 1 ELSE ref1 + 1 END AS pos, ref2 - 1 AS sv_end, CASE WHEN ins THEN query2p + back WHEN del THEN query2 + back ELSE query1 - back END AS altpos, query2 + back AS altend FROM {lifts})"""
    return f"""(SELECT *, CASE WHEN del THEN sv_end - pos ELSE altend - altpos - (sv_end - pos) END AS svlen, CASE WHEN ins THEN ref2 WHEN del THEN ref2p + bare ELSE ref1 END AS wide_from, CASE WHEN ins THEN ref1 WHEN del THEN ref1p ELSE ref2 END AS wide_to,
      CASE WHEN ins THEN query2p WHEN del THEN query2 + bare * back ELSE query1 END AS altwide_from, CASE WHEN ins THEN query1p WHEN del THEN query1 ELSE query2 END AS altwide_to, CASE WHEN del AND pos > sv_end THEN 'POSITION' ELSE 'ok' END AS placed FROM {spots})"""


_BREAKS = _breaks_sql(ALIGNMENTS, "ref_entry, query_entry")
_TYPED = _typed_sql(_BREAKS)


def breaks(s: SparkSession, d: str) -> DataFrame:
    return A.classified(A.consecutive_breaks(alignments(s, d), ["ref_entry", "query_entry"], ["ref_start", "ref_end", "align_no"]))


add("break_detection", f"SELECT align_no, ref_gap, query_gap FROM {_BREAKS} b")(lambda s, d: breaks(s, d).select("align_no", "ref_gap", "query_gap"))
add("break_types", f"SELECT align_no, svkind, svsize, repeat_bases, CASE WHEN svsize = 0 OR repeat_bases > 10 * svsize THEN 'ARTIFACT' WHEN svsize > 500 THEN 'MAXSIZE' ELSE 'ok' END AS status FROM {_TYPED} t")(
    lambda s, d: breaks(s, d).select("align_no", "svkind", "svsize", "repeat_bases", A.break_status(500).alias("status"))
)
add("substitution_coordinates", f"SELECT align_no, ref1 + 1 AS pos, ref2 - 1 AS sv_end, CASE WHEN comp = 1 THEN query1 - 1 ELSE query1 + 1 END AS altpos, CASE WHEN comp = 1 THEN query2 + 1 ELSE query2 - 1 END AS altend FROM {_TYPED} t WHERE svkind IN ('SUBSINS', 'SUBSDEL')")(
    lambda s, d: A.output_coordinates(breaks(s, d).where("svkind in ('SUBSINS', 'SUBSDEL')").withColumns({c: F.lit(None).cast("bigint") for c in ("ref1p", "ref2p", "query1p", "query2p")})).select("align_no", "pos", "sv_end", "altpos", "altend")
)
add("widened_breaks", f"SELECT align_no, svkind, placed AS status, pos, sv_end, altpos, altend, svlen, wide_from, wide_to, altwide_from, altwide_to FROM {_placed_sql(_TYPED)} p")(lambda s, d: A.output_coordinates(A.widened(breaks(s, d))).select("align_no", "svkind", "status", "pos", "sv_end", "altpos", "altend", "svlen", "wide_from", "wide_to", "altwide_from", "altwide_to"))
_INV = f"(SELECT * FROM (SELECT *, lead(ref_start) OVER w AS rs1, lead(ref_end) OVER w AS re1, lead(comp) OVER w AS c1, lead(ref_start, 2) OVER w AS rs2, lead(query_start, 2) OVER w AS qs2, lead(comp, 2) OVER w AS c2 FROM {ALIGNMENTS} a WINDOW w AS (PARTITION BY ref_entry, query_entry ORDER BY ref_start, ref_end, align_no)) WHERE comp <> c1 AND c1 <> c2)"
add("inversions", f"SELECT align_no, ref_end AS pos, rs2 - 1 AS sv_end, svlen, ref_end - rs1 AS repeat_bases, CASE WHEN span > 0 AND 2 * abs(svlen) / span >= 0.1 THEN 'ASYMMETRIC' WHEN span > 0 AND 2 * abs(ref_end - rs1) / span >= 5.0 THEN 'REPEAT' ELSE 'ok' END AS status FROM (SELECT *, abs(rs2 - 1 - ref_end) - abs(qs2 - 1 - query_end) AS svlen, abs(rs2 - 1 - ref_end) + abs(qs2 - 1 - query_end) AS span FROM {_INV} i)")(
    lambda s, d: A.inversions(alignments(s, d), ["ref_entry", "query_entry"], ["ref_start", "ref_end", "align_no"]).select("align_no", "pos", "sv_end", "svlen", "repeat_bases", "status")
)


def refined(s: SparkSession, d: str) -> commands.Refined:
    edges = alignments(s, d).select(F.col("ref_entry").alias("chrom")).distinct().withColumn("contig_len", F.lit(220_000).cast("bigint"))
    return commands.refine(alignments(s, d), windows(s, d), edges, 20, 30, bin_size=1 << 12)


_EDGE = "(chrom IS NOT NULL AND \"start\" - 20 > 0 AND \"end\" + 20 <= 220000)"
_SLICED = f"""pairs AS MATERIALIZED (SELECT * FROM {_SPAN} x WHERE {_EDGE}),
  numbered AS (SELECT p.region_id, p.chrom, p."start", p."end", a.*, row_number() OVER (PARTITION BY region_id, a.query_entry ORDER BY ref_start, ref_end, align_no) AS rn FROM pairs p JOIN {ALIGNMENTS} a USING (query_entry)),
  entered AS (SELECT *, min(CASE WHEN ref_entry = chrom AND ref_end > "start" - 20 + 29 THEN rn END) OVER (PARTITION BY region_id, query_entry) AS enter FROM numbered),
  stopped AS (SELECT *, min(CASE WHEN ref_entry = chrom AND ref_start > "end" + 20 - 29 AND rn > enter THEN rn END) OVER (PARTITION BY region_id, query_entry) AS stop FROM entered),
  slices AS (SELECT *, rn - enter + 1 AS n, ref_entry = chrom AND ref_start < "start" - 20 AND ref_end > "end" + 20 AS spans FROM stopped WHERE rn >= enter AND (stop IS NULL OR rn < stop OR (rn = stop AND stop - enter = 2))),
  status AS (SELECT region_id, query_entry, n_ref, CASE WHEN broken = 0 THEN 'NOVARFOUND' WHEN n_ref > 3 THEN 'MULTIALIGNS' WHEN strands IN ('00', '11', '000', '111') THEN 'SIMPLE' WHEN strands IN ('010', '101') THEN 'INVERSION' ELSE 'OTHER' END AS status FROM (
    SELECT region_id, query_entry, count(*) FILTER (WHERE ref_entry = chrom) AS n_ref, count(*) FILTER (WHERE ref_entry = chrom AND NOT spans) AS broken, coalesce(string_agg(CAST(comp AS VARCHAR), '' ORDER BY n) FILTER (WHERE ref_entry = chrom), '') AS strands FROM slices GROUP BY ALL)),
  covers AS (SELECT DISTINCT chrom, ref_start AS r_start, ref_end AS r_end, query_entry, query_start, query_end FROM slices WHERE spans),
  simple AS (SELECT s.* FROM slices s JOIN status t USING (region_id, query_entry) WHERE t.status = 'SIMPLE' AND ref_entry = chrom)"""
_CALLED = f"(SELECT * FROM {_placed_sql('(SELECT * FROM ' + _typed_sql(_breaks_sql('simple', 'region_id, query_entry')) + ' WHERE NOT (svsize = 0 OR repeat_bases > 10 * svsize))')} WHERE placed = 'ok')"
add("refine_status", f"WITH {_SLICED} SELECT region_id, query_entry, n_ref, status FROM status UNION ALL SELECT region_id, NULL, 0, 'CHROMEND' FROM {WINDOWS} w WHERE NOT {_EDGE} OR chrom NOT IN (SELECT ref_entry FROM {ALIGNMENTS} a)")(lambda s, d: refined(s, d).status)
add("refine_variants", f"WITH {_SLICED} SELECT region_id, query_entry, svkind, pos, sv_end, svlen, wide_from, wide_to, altwide_from, altwide_to, EXISTS (SELECT 1 FROM covers v WHERE v.chrom = c.chrom AND r_start <= pos AND r_end >= sv_end) AS covered FROM {_CALLED} c")(
    lambda s, d: refined(s, d).variants.select("region_id", "query_entry", "svkind", "pos", "sv_end", "svlen", "wide_from", "wide_to", "altwide_from", "altwide_to", "covered")
)
add("refine_coverage", f"WITH {_SLICED} SELECT * FROM covers")(lambda s, d: refined(s, d).spanning.drop("regions").distinct())
_GROUPED = f"(SELECT * FROM {ALIGNMENTS} a)"
add("longest_alignments", f"WITH a AS {_GROUPED}, p AS (SELECT DISTINCT query_entry, unnest([least(query_start, query_end), greatest(query_start, query_end)]) AS p FROM a), best AS (SELECT DISTINCT arg_min(align_no, (lo - hi, align_no)) AS align_no FROM p JOIN (SELECT query_entry, align_no, least(query_start, query_end) AS lo, greatest(query_start, query_end) AS hi FROM a) x ON x.query_entry = p.query_entry AND lo <= p AND p <= hi GROUP BY p.query_entry, p) SELECT align_no, align_no NOT IN (SELECT align_no FROM best) AS redundant FROM a")(
    lambda s, d: V.longest_at_endpoints(alignments(s, d), "query_entry", "query_start", "query_end", "align_no", 1 << 11).select("align_no", "redundant")
)
add("end_alignments", f"WITH a AS (SELECT *, ref_start = 1 AND query_start = 1 AS l, ref_end = ref_len AND query_end = query_len AS r, mismatches / list_sum(list_transform(regexp_extract_all(cigar, '(\\d+)[MID]', 1), lambda x: CAST(x AS BIGINT))) AS rate FROM {ALIGNMENTS} a) SELECT ref_entry, query_entry, arg_max(align_no, (rate, align_no)) FILTER (WHERE l) AS left_align, arg_max(align_no, (rate, align_no)) FILTER (WHERE r) AS right_align, bool_or(l AND r) AS end_to_end FROM a GROUP BY ALL")(lambda s, d: commands.end_alignments(alignments(s, d)))




_SPOTS = ("ref_start", "ref_start + CAST(l AS BIGINT) * 30 + 2", "ref_end", "ref_end + 9")
add("liftover", f"SELECT align_no, {', '.join(f'{_lift_sql(str(i), p, False)} AS q{i}' for i, p in enumerate(_SPOTS))}, {_lift_sql('r', 'query_end', True)} AS r0, {_lift_sql('r', 'query_start', True)} AS r1 FROM (SELECT *, CAST(regexp_extract(cigar, '^(\\d+)M', 1) AS BIGINT) / 30 AS l FROM {ALIGNMENTS} a)")(lambda s, d: _lifted(alignments(s, d)))


def _lifted(rows: DataFrame) -> DataFrame:
    """Four places of the reference on the query, the gap and one beyond the end among them, and both ends of the query on the reference."""
    parsed = rows.withColumn("ops", C.parse(F.col("cigar")))
    gap = F.col("ref_start") + F.element_at("ops", 1)["n"] + 2
    spots = (F.col("ref_start"), gap, F.col("ref_end"), F.col("ref_end") + 9)
    place = ("ops", "ref_start", "query_start", "query_end")
    return parsed.select("align_no", *(C.lift_to_query(*place, p).alias(f"q{i}") for i, p in enumerate(spots)), *(C.lift_to_ref(*place, F.col(c)).alias(f"r{i}") for i, c in enumerate(("query_end", "query_start"))))


add("cigar_stats", f"SELECT align_no, CAST(list_sum(list_transform(regexp_extract_all(cigar, '(\\d+)[MID]', 1), lambda x: CAST(x AS BIGINT))) AS BIGINT) AS columns_, CAST(coalesce(list_max(list_transform(regexp_extract_all(cigar, '(\\d+)M', 1), lambda x: CAST(x AS INT))), 0) AS INT) AS longest_m, round(mismatches / list_sum(list_transform(regexp_extract_all(cigar, '(\\d+)[MID]', 1), lambda x: CAST(x AS BIGINT))), 9) AS rate FROM {ALIGNMENTS} a")(
    lambda s, d: alignments(s, d).withColumn("ops", C.parse(F.col("cigar"))).select("align_no", C.total(F.col("ops"), "MID").alias("columns_"), C.longest(F.col("ops"), "M").alias("longest_m"), F.round(C.mismatch_rate(F.col("mismatches"), F.col("ops")), 9).alias("rate"))
)
add("cigar_endpoints", f"SELECT align_no, ref_start + m + dd - 1 AS ref_end, CASE WHEN comp = 1 THEN m + ii ELSE 1 END AS query_start, CASE WHEN comp = 1 THEN 1 ELSE m + ii END AS query_end FROM (SELECT align_no, ref_start, comp, CAST(list_sum(list_transform(regexp_extract_all(cigar, '(\\d+)M', 1), lambda x: CAST(x AS BIGINT))) AS BIGINT) AS m, CAST(coalesce(list_sum(list_transform(regexp_extract_all(cigar, '(\\d+)D', 1), lambda x: CAST(x AS BIGINT))), 0) AS BIGINT) AS dd, CAST(coalesce(list_sum(list_transform(regexp_extract_all(cigar, '(\\d+)I', 1), lambda x: CAST(x AS BIGINT))), 0) AS BIGINT) AS ii FROM {ALIGNMENTS} a)")(
    lambda s, d: alignments(s, d).select("align_no", C.endpoints(F.col("ref_start"), C.parse(F.col("cigar")), F.col("comp") == 1).alias("e")).select("align_no", "e.ref_end", "e.query_start", "e.query_end")
)
add("delta_bed", f"SELECT ref_entry AS chrom, ref_start - 1 AS \"start\", ref_end AS \"end\", query_entry AS name, CASE WHEN comp = 1 THEN '+' ELSE '-' END AS strand FROM {ALIGNMENTS} a")(lambda s, d: sinks.delta_bed(alignments(s, d)).drop("score"))
add("sam_rows", f"SELECT query_entry, CASE WHEN comp = 1 THEN 16 ELSE 0 END AS flag, ref_entry, ref_start AS pos, 40 AS mapq, concat(CASE WHEN h > 0 THEN CAST(h AS VARCHAR) || 'H' ELSE '' END, cigar, CASE WHEN t > 0 THEN CAST(t AS VARCHAR) || 'H' ELSE '' END) AS cigar FROM (SELECT *, CASE WHEN comp = 1 THEN query_len - query_start ELSE query_start - 1 END AS h, CASE WHEN comp = 1 THEN query_end - 1 ELSE query_len - query_end END AS t FROM {ALIGNMENTS} a)")(
    lambda s, d: sinks.sam_rows(alignments(s, d))
)
add("plot_segments", f"SELECT align_no FROM {ALIGNMENTS} a WHERE ref_entry = 's7' AND ref_start < ref_end AND ref_start <= 90000 AND 20000 <= ref_end")(lambda s, d: commands.plot_segments(alignments(s, d), ("s7", 20000, 90000)).select("align_no"))
add("axis_extents", f"WITH a AS {_GROUPED}, r AS (SELECT *, count(*) OVER (PARTITION BY ref_entry, query_entry) AS n, row_number() OVER (PARTITION BY ref_entry, query_entry ORDER BY ref_start, align_no) AS up, row_number() OVER (PARTITION BY ref_entry, query_entry ORDER BY ref_end DESC, align_no) AS down FROM a) SELECT ref_entry, query_entry, min(CASE WHEN n <= 4 OR up > 1 THEN ref_start END) AS ref_from, max(CASE WHEN n <= 4 OR down > 1 THEN ref_end END) AS ref_to, min(least(query_start, query_end)) AS query_from, max(greatest(query_start, query_end)) AS query_to FROM r GROUP BY ALL")(
    lambda s, d: commands.axis_extents(alignments(s, d), True)
)
add("interpolate_position", f"SELECT align_no, CAST(trunc(query_start + (ref_start + 17 - ref_start) / (ref_end - ref_start) * (query_end - query_start)) AS BIGINT) AS place FROM {ALIGNMENTS} a")(
    lambda s, d: alignments(s, d).select("align_no", V.interpolate(F.col("ref_start") + 17, F.col("ref_start"), F.col("ref_end"), F.col("query_start"), F.col("query_end")).alias("place"))
)

# ---------------------------------------------------------------- sequences, dates, order

add("reverse_complement", "SELECT row_id, reverse(translate(trim(alt_allele), 'ACGTNacgtn', 'TGCANtgcan')) AS rc FROM svcalls WHERE regexp_full_match(trim(alt_allele), '[ACGTNacgtn]+')")(
    lambda s, d: table(s, d, "svcalls").where(F.trim("alt_allele").rlike(r"^[ACGTNacgtn]+\z")).select("row_id", S.reverse_complement(F.trim("alt_allele")).alias("rc"))
)
add("iupac_codes", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'M' WHEN 1 THEN 'K' WHEN 2 THEN 'B' ELSE 'N' END AS code FROM events")(
    lambda s, d: table(s, d, "events").select("event_id", S.iupac_code(F.element_at(F.array(*(F.lit(x) for x in ("CA", "tg", "TCG", "AX"))), (F.col("event_id") % 4 + 1).cast("int"))).alias("code"))
)
add("fasta_wrap", "SELECT row_id, regexp_replace(regexp_replace(trim(alt_allele), '(.{50})', '\\1' || chr(10), 'g'), chr(10) || '\\z', '') AS seq FROM svcalls WHERE length(alt_allele) > 50")(
    lambda s, d: table(s, d, "svcalls").where(F.length("alt_allele") > 50).select("row_id", S.wrap(F.trim("alt_allele")).alias("seq"))
)


def _slices(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").where("length(text) > 0").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("chrom"), "text", "doc_id")
    return fasta.slicer(fasta.chunk_text(docs, "chrom", "text", 16), 16)(docs, "chrom", F.lit(3), F.lit(40), "part").select("doc_id", "part")


add("fasta_slice", "SELECT doc_id, substr(text, 3, 38) AS part FROM documents WHERE length(text) > 0")(_slices)
_ALT = "(SELECT row_id, upper(trim(alt_allele)) AS a FROM svcalls WHERE regexp_full_match(trim(alt_allele), '[ACGTNacgtn]+'))"
add("repeat_alias", f"SELECT row_id, CASE WHEN length(a) // p = 1 THEN a ELSE (length(a) // p) || '(' || a[1:p] || ')' || a[p * (length(a) // p) + 1:] END AS alias FROM (SELECT row_id, a, list_filter(range(1, length(a) + 1), lambda k: k = length(a) OR a[k + 1:] = a[1:length(a) - k])[1] AS p FROM {_ALT} x)")(
    lambda s, d: table(s, d, "svcalls").where(F.trim("alt_allele").rlike(r"^[ACGTNacgtn]+\z")).select("row_id", S.repeat_alias_udf(F.upper(F.trim("alt_allele"))).alias("alias"))
)
add("natural_chrom_order", "SELECT chrom, ord, row_number() OVER (ORDER BY TRY_CAST(chrom AS INT) IS NULL, TRY_CAST(chrom AS INT), chrom) AS natural_rank FROM ref_contigs")(
    lambda s, d: _ranked(table(s, d, "ref_contigs").select("chrom", "ord"))
)


def _ranked(rows: DataFrame) -> DataFrame:
    """Ranks of chromosome names, of which there are few."""
    from pyspark.sql import Window

    return rows.withColumn("natural_rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*vcf.natural_order("chrom"))).cast("bigint"))


add("calls_in_contig_order", f"SELECT row_id, ord FROM {CALLS} c JOIN ref_contigs r USING (chrom)")(lambda s, d: calls(s, d).join(table(s, d, "ref_contigs").select("chrom", "ord"), "chrom").select("row_id", "ord"))
add(
    "date_rendering",
    "SELECT event_id, strftime(ts, '%b %d %Y') AS short, strftime(ts, '%B %d, %Y') AS long, strftime(ts, '%y%m%d') AS yymmdd, strftime(ts, '%m%d%y') AS mmddyy, strftime(ts, '%Y%m%d') AS yyyymmdd, strftime(ts, '%Y-%m-%d') AS dashed, upper(strftime(ts, '%-d-%b-%Y')) AS oracle, strftime(ts, '%-m/%-d/%Y') AS slashed, strftime(ts, '%d/%b/%Y') AS barcode FROM events",
)(lambda s, d: table(s, d, "events").select("event_id", *(T.RENDERED[n](F.col("ts")).alias(n) for n in ("short", "long", "yymmdd", "mmddyy", "yyyymmdd", "dashed", "oracle", "slashed", "barcode"))))
add("date_parsing", "SELECT event_id, CAST(ts AS DATE) AS a, CAST(ts AS DATE) AS b, CAST(ts AS DATE) AS c, CAST(ts AS DATE) AS d, CAST(ts AS DATE) AS e FROM events")(
    lambda s, d: table(s, d, "events").select("event_id", *(T.parse_date(T.RENDERED[n](F.col("ts"))).alias(x) for x, n in zip("abcde", ("yymmdd", "oracle", "slashed", "barcode", "long"))))
)
add("date_ordinals", "SELECT event_id, CAST(date_diff('day', DATE '1997-01-07', CAST(ts AS DATE)) + 1 AS INT) AS day_no, CAST(floor(date_diff('day', DATE '1997-01-07', CAST(ts AS DATE)) / 7) AS BIGINT) AS week_no, CAST(12 * (year(ts) - 1997) + month(ts) AS INT) AS month_no, concat(CAST(month(ts) AS VARCHAR), '/', strftime(ts, '%y')) AS month_label, CAST(ts AS DATE) AS back FROM events")(
    lambda s, d: table(s, d, "events").select("event_id", T.day_number(F.col("ts")).alias("day_no"), T.week_number(F.col("ts")).alias("week_no"), T.month_ordinal(F.col("ts")).alias("month_no"), T.month_label(T.month_ordinal(F.col("ts"))).alias("month_label"), T.day_of_number(T.day_number(F.col("ts"))).alias("back"))
)

# ---------------------------------------------------------------- genotypes

_WIDE = f"(SELECT row_id, line_no, file AS sample, regexp_extract(info, 'REFWIDENED=([^:;]+):(\\d+)-(\\d+)', 1) AS chrom, CAST(regexp_extract(info, 'REFWIDENED=([^:;]+):(\\d+)-(\\d+)', 2) AS BIGINT) AS wide_start, CAST(regexp_extract(info, 'REFWIDENED=([^:;]+):(\\d+)-(\\d+)', 3) AS BIGINT) AS wide_end, {_SVTYPE} AS svtype, {_SVLEN} AS svlen, side FROM {CALLS} c WHERE regexp_matches(info, 'REFWIDENED=([^:;]+):(\\d+)-(\\d+)') AND {_SVTYPE} IS NOT NULL AND {_SVLEN} IS NOT NULL)"


_SIZED = f"(SELECT w.*, v.reflength, v.altlength FROM {_WIDE} w JOIN {SVS} v USING (row_id))"


def wide_calls(s: SparkSession, d: str) -> DataFrame:
    rows = vcf.genotypable(vcf.normalized(calls(s, d))).where("status = 'ok'")
    return rows.select(F.col("row_id").alias("target_id"), F.col("row_id").cast("string").alias("contig"), "line_no", F.col("file").alias("sample"), F.col("widened.chrom").alias("chrom"), F.col("widened.start").alias("wide_start"), F.col("widened.end").alias("wide_end"), F.col("widemean").alias("wide_mean"), "svtype", "svlen", "side", "pos", "end", "ref", "alt", "reflength", "altlength", "deleted_to")


add("genotype_exact", f"SELECT DISTINCT a.row_id AS target_id, b.sample, CAST(b.row_id AS VARCHAR) AS contig FROM {_WIDE} a JOIN {_WIDE} b USING (chrom, wide_start, wide_end, svtype, svlen)")(
    lambda s, d: G.exact_genotypes(wide_calls(s, d), wide_calls(s, d)).select("target_id", "sample", "contig")
)
_NEAR_MATCH = f"""(SELECT target_id, sample, arg_min(contig, (line_no, contig)) AS contig FROM (
  SELECT a.row_id AS target_id, b.sample, b.line_no, CAST(b.row_id AS VARCHAR) AS contig, abs((a.altlength - a.reflength) - (b.altlength - b.reflength)) AS gap, (greatest(a.reflength, a.altlength) + greatest(b.reflength, b.altlength)) / 2.0 AS shared
  FROM (SELECT * FROM {_SIZED} x WHERE side = 0) a JOIN (SELECT * FROM {_SIZED} y WHERE side = 1) b ON a.chrom = b.chrom AND abs((a.wide_start + a.wide_end) / 2 - (b.wide_start + b.wide_end) / 2) < {BACK}
  WHERE NOT EXISTS (SELECT 1 FROM {_WIDE} e WHERE e.side = 1 AND e.sample = b.sample AND e.chrom = a.chrom AND e.wide_start = a.wide_start AND e.wide_end = a.wide_end AND e.svtype = a.svtype AND e.svlen = a.svlen))
  WHERE gap <= shared GROUP BY target_id, sample)"""
add("genotype_nearby", f"SELECT target_id, sample, contig FROM {_NEAR_MATCH} n")(
    lambda s, d: (lambda a, b: G.nearby_genotypes(a, b, BACK, G.exact_genotypes(a, b)).select("target_id", "sample", "contig"))(wide_calls(s, d).where("side = 0"), wide_calls(s, d).where("side = 1"))
)
add("genotype_reference", f"SELECT target_id, sample, contig FROM (SELECT DISTINCT row_id AS target_id, h.sample, contig, hr_start, hr_end FROM {_WIDE} a JOIN {_STRETCH} h ON a.chrom = h.chrom AND h.hr_start < wide_start AND h.hr_end > wide_end)")(
    lambda s, d: G.reference_alleles(wide_calls(s, d), stretches(s, d)).select("target_id", "sample", "contig")
)
_REF = f"(SELECT DISTINCT a.row_id AS target_id, side, h.sample, contig, hr_start, hr_end FROM {_WIDE} a JOIN {_STRETCH} h ON a.chrom = h.chrom AND h.hr_start < wide_start AND h.hr_end > wide_end)"
_STRINGS = f"(SELECT target_id, sample, string_agg('0', '/') AS genotype, string_agg('H', ',') AS kinds FROM {_REF} r GROUP BY ALL)"
add("genotype_strings", f"SELECT target_id, sample, genotype, kinds FROM {_STRINGS} g")(lambda s, d: G.genotype_strings(G.reference_alleles(wide_calls(s, d), stretches(s, d))))
_BACK = f"""WITH own AS (SELECT row_id AS target_id, sample FROM {_WIDE} x WHERE side = 0),
  exact AS (SELECT DISTINCT a.row_id AS target_id, b.sample, b.row_id AS contig FROM {_WIDE} a JOIN {_WIDE} b USING (chrom, wide_start, wide_end, svtype, svlen) WHERE a.side = 0 AND b.side = 1),
  alleles AS (SELECT target_id, sample, '1' AS allele, 'H' AS kind FROM own UNION ALL SELECT target_id, sample, '1', 'H' FROM exact UNION ALL SELECT target_id, sample, '1', 'L' FROM {_NEAR_MATCH} n UNION ALL SELECT target_id, sample, '0', 'H' FROM {_REF} r WHERE side = 0)
  SELECT target_id, sample, string_agg(allele, '/' ORDER BY allele, kind) AS genotype, string_agg(kind, ',' ORDER BY allele, kind) AS kinds FROM alleles GROUP BY ALL"""
add("back_genotype", _BACK)(lambda s, d: commands.back_genotype(wide_calls(s, d).where("side = 0"), wide_calls(s, d).where("side = 1"), stretches(s, d), None))
_GENO = "(SELECT CAST(user_id AS BIGINT) AS locus, event_type AS source, CAST(event_id AS VARCHAR) AS read_name, CASE WHEN event_id % 3 = 0 THEN 'A' ELSE 'C' END AS allele1, CASE WHEN event_id % 4 = 0 THEN 'A' ELSE 'C' END AS allele2, event_id % 50 AS score FROM events)"


def genotypes(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    return e.select(F.col("user_id").cast("bigint").alias("locus"), F.col("event_type").alias("source"), F.col("event_id").cast("string").alias("read_name"), F.when(F.col("event_id") % 3 == 0, "A").otherwise("C").alias("allele1"), F.when(F.col("event_id") % 4 == 0, "A").otherwise("C").alias("allele2"), (F.col("event_id") % 50).alias("score"))


add("reconcile_genotypes", f"WITH g AS {_GENO}, b AS (SELECT *, row_number() OVER (PARTITION BY locus, source ORDER BY score DESC, read_name) AS k FROM g), t AS (SELECT locus, source, read_name AS br, allele1 AS b1, allele2 AS b2, score AS bs FROM b WHERE k = 1), d AS (SELECT locus, source, sum(CASE WHEN read_name = br THEN 0.0 WHEN allele1 = b1 AND allele2 = b2 THEN 0.25 * score ELSE -1.0 * score END) AS d FROM g JOIN t USING (locus, source) GROUP BY ALL) SELECT locus, source, read_name, b1 AS allele1, b2 AS allele2, CAST(bs + d AS DOUBLE) AS score FROM g JOIN t USING (locus, source) JOIN d USING (locus, source)")(
    lambda s, d: G.reconcile(genotypes(s, d)).withColumn("score", F.col("score").cast("double"))
)
add("polymorphism_scores", f"SELECT locus, max(CASE WHEN NOT (allele1 = 'A' AND allele2 = 'A') THEN score END) AS score FROM {_GENO} g GROUP BY locus")(
    lambda s, d: G.polymorphism_scores(genotypes(s, d), genotypes(s, d).select("locus", F.lit("A").alias("ref_allele")).distinct())
)
add("alleles_seen", f"SELECT locus, string_agg(DISTINCT a, '' ORDER BY a) AS alleles FROM (SELECT locus, unnest([allele1, allele2]) AS a FROM {_GENO} g) GROUP BY locus")(
    lambda s, d: G.alleles_seen(genotypes(s, d)).select("locus", F.array_join("alleles", "").alias("alleles"))
)
add("relational_polymorphisms", "SELECT o_orderkey, l_linenumber, c_name, n_name, r_name, p_name, s_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")(
    lambda s, d: _relational(s, d)
)


def _relational(s: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(s, d, n)
    rich = t("customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return (
        t("orders").join(rich, "o_custkey", "left_semi")
        .join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(t("region"), F.col("r_regionkey") == F.col("n_regionkey"))
        .join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("part"), F.col("p_partkey") == F.col("l_partkey")).join(t("supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
        .select("o_orderkey", "l_linenumber", "c_name", "n_name", "r_name", "p_name", "s_name")
    )


# ---------------------------------------------------------------- sinks

add("flat_table", f"SELECT row_id, chrom, pos, length(ref) AS ref, length(alt) AS alt, list_filter(list_transform(string_split(info, ';'), lambda x: trim(x)), lambda x: starts_with(x, 'SVTYPE=') AND len(string_split(x, '=')) = 2)[-1][8:] AS svtype FROM {CALLS} c")(
    lambda s, d: sinks.flat_table(calls(s, d), ["SVTYPE"], keep=["row_id"]).select("row_id", "chrom", "pos", "ref", "alt", F.col("SVTYPE").alias("svtype"))
)
def _pivot(s: SparkSession, d: str) -> DataFrame:
    """A row for each target and a column for each sample that has stretches; ``.`` where nothing is known."""
    rows, known = wide_calls(s, d), stretches(s, d)
    samples = sorted(r["sample"] for r in known.select("sample").where("sample is not null").distinct().collect())  # samples are few
    found = G.genotype_table(G.genotype_strings(G.reference_alleles(rows, known)), samples)
    return rows.select("target_id").join(found, "target_id", "left").na.fill(".", samples)


add("genotype_pivot", f"SELECT * REPLACE (CAST(target_id AS BIGINT) AS target_id) FROM (PIVOT (SELECT w.row_id AS target_id, coalesce(s.sample, h.sample) AS sample, coalesce(s.genotype, '.') AS genotype FROM (SELECT row_id FROM {_WIDE} w) w JOIN (SELECT DISTINCT sample FROM {_STRETCH} t WHERE sample IS NOT NULL) h ON true LEFT JOIN {_STRINGS} s ON s.target_id = w.row_id AND s.sample = h.sample) ON sample USING first(genotype) GROUP BY target_id)")(_pivot)
add("last_genotypes", f"SELECT locus, source AS read_name, max(score) AS score FROM {_GENO} g WHERE (locus, source, CAST(read_name AS BIGINT)) IN (SELECT (locus, source, max(CAST(read_name AS BIGINT))) FROM {_GENO} h GROUP BY locus, source) GROUP BY ALL")(
    lambda s, d: G.last_genotypes(genotypes(s, d).withColumns({"order": F.col("read_name").cast("bigint"), "read_name": F.col("source")}), "order").select("locus", "read_name", "score")
)
add("vcf_text", f"SELECT row_id, concat_ws(chr(9), coalesce(chrom, '.'), coalesce(CAST(pos AS VARCHAR), '.'), coalesce(id, '.'), coalesce(ref, '.'), coalesce(alt, '.'), '.', coalesce(filter, '.'), coalesce(info, '.'), format, genotype) AS line FROM {CALLS} c")(
    lambda s, d: sinks.vcf_lines(calls(s, d).withColumns({"qual": F.lit(None).cast("string"), "samples": F.filter("samples", lambda x: x.isNotNull())}), ["row_id"])
)
_G = lambda c: f"CASE WHEN {c} IS NULL THEN 'NA' ELSE printf('%.15g', CAST({c} AS DOUBLE)) END"
_USABLE = lambda c: f"CASE WHEN edit_distance >= 0 THEN {c} END"
_SHOWN = [_G(_USABLE(c) if c in ("relshift", "relsizediff", "reldist", "subsdist", "indeldist") else c) for c in tabular.DISTANCE_NAMES[2:]]
add("distance_text", f"SELECT concat_ws(chr(9), 'DIST', id1, id2, {', '.join(_SHOWN)}) AS line FROM dist_pairs WHERE id1 IS NOT NULL AND id2 IS NOT NULL AND id1 NOT IN ('', '.', 'NA') AND id2 NOT IN ('', '.', 'NA')")(lambda s, d: sinks.distance_lines(distances(s, d)))
add(
    "report_text",
    _COUNTS + """ SELECT concat_ws(chr(10), 'Number of true variants found: ' || dtp, 'Number of true variants missed: ' || fn, 'Number of test variants that match: ' || ptp, 'Number of test variants that don''t: ' || fp,
      'Recall: ' || printf('%5.2f', 100 * recall_) || '%', 'Precision: ' || printf('%5.2f', 100 * precision_) || '%', 'F1: ' || printf('%.15g', 2 * precision_ * recall_ / (precision_ + recall_))) AS report
      FROM (SELECT *, ptp / (ptp + fp) AS precision_, dtp / (dtp + fn) AS recall_ FROM t, u)""",
)(lambda s, d: s.createDataFrame([("\n".join(scoring.report_lines(benchmarked(s, d).metrics.first())),)], "report string"))
add(
    "merged_info",
    _REACH + f""", n AS (SELECT cluster, exact, count(*) AS k FROM members GROUP BY ALL), rep AS (SELECT cluster, arg_min(exact, (-k, exact)) AS rep, CAST(sum(k) AS BIGINT) AS n_calls, max(k) AS n_exact FROM n GROUP BY cluster),
      l AS (SELECT cluster, rep, n_calls, n_exact, string_agg(id, ':' ORDER BY id) AS member_ids, string_agg(CASE WHEN exact = rep THEN id END, ':' ORDER BY id) AS exact_ids FROM members JOIN rep USING (cluster) GROUP BY ALL),
      m AS (SELECT cluster, max(abs(relshift)) AS a, max(abs(relsizediff)) AS b, max(abs(reldist)) AS c FROM good JOIN members ON id = id1 WHERE linked GROUP BY cluster),
      f AS (SELECT id, arg_min(list_filter(string_split(info, ';'), lambda x: string_split(trim(x), '=')[1] IN ('SVTYPE', 'SVLEN', 'END')), row_id) AS kept, min(row_id) AS first_row FROM (SELECT id, row_id, coalesce(info, '') AS info FROM {CALLS} c WHERE id IS NOT NULL) GROUP BY id)
      SELECT f.id, array_to_string(list_concat(kept, ['ClusterIDs=' || member_ids, 'NumClusterSVs=' || n_calls, 'ExactMatchIDs=' || exact_ids, 'NumExactMatchSVs=' || n_exact,
        'ClusterMaxShiftDist=' || printf('%.15g', coalesce(a, 0)), 'ClusterMaxSizeDiff=' || printf('%.15g', coalesce(b, 0)), 'ClusterMaxEditDist=' || printf('%.15g', coalesce(c, 0))]), ';') AS info
      FROM l JOIN f ON f.id = l.rep LEFT JOIN m USING (cluster)""",
)(lambda s, d: _merged(s, d))


def _merged(s: SparkSession, d: str) -> DataFrame:
    members, rows = _members(s, d)
    chosen = K.cluster_sizes(members).join(K.cluster_lists(members), "cluster").join(K.cluster_distances(members, rows, D.classic_match()), "cluster", "left").na.fill(0.0, list(K.MAXIMA))
    keys = F.array(F.lit("SVTYPE"), F.lit("SVLEN"), F.lit("END"))
    found = chosen.join(K.first_by(calls(s, d), ["id"], ["row_id"]).select("id", "info"), F.col("id") == F.col("representative"))
    return found.select("id", sinks.merged_info(F.col("info"), keys).alias("info"))
