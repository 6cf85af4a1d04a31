"""Lines that do not load, with the reason (problem 5).

A strict load keeps the offsets (``line_id``) of the lines that conform in every point; subtracting
them from the offsets of all data lines leaves those of the lines that fail, and only these lines are
fetched and diagnosed, point by point; only offsets are shuffled for that unless most lines fail. Quotation is judged on the pieces between the marks ``"``: pieces with odd numbers are
quoted, so tabs and semicolons are looked for in the even ones only.

Defined results: null lines, blank lines and lines that begin with ``#`` are no data; one carriage
return at the end is dropped; a repeated line fails as often as it comes; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.session import durable

COLUMNS = 10
MOST_POS = 400_000_000
_HOLE = "\x1a"  # stands for a tab or semicolon inside a quotation

VCF_COLUMNS = ("chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", "format", "sample")


def data_lines(raw: DataFrame) -> DataFrame:
    """The table with ``line``, the text without its carriage return, for its data lines."""
    line = F.regexp_replace("raw_line", r"\r\z", "")
    return raw.withColumn("line", line).where((F.trim(F.translate("line", "\t\r\n\x0b\x0c", "     ")) != "") & ~F.col("line").startswith("#"))


def _quoting_holds(line: Column) -> Column:
    pieces = F.split(line, '"')
    last = F.size(pieces) - 1
    spots = F.transform(
        pieces,
        lambda piece, i: (i % 2 == 1)
        | (((i == last) | piece.endswith("=")) & ((i == 0) | piece.rlike("^[;\t]") | ((i == last) & (piece == "")))),
    )
    return ~line.contains('"') | ((F.size(pieces) % 2 == 1) & F.forall(spots, lambda ok: ok))


def _masked(line: Column) -> Column:
    """The line with the separators inside quotations covered up."""
    parts = F.transform(F.split(line, '"'), lambda piece, i: F.when(i % 2 == 1, F.translate(piece, "\t;", _HOLE * 2)).otherwise(piece))
    return F.when(line.contains('"'), F.array_join(parts, '"')).otherwise(line)


def _pos_holds(pos: Column) -> Column:
    digits = F.regexp_replace(pos, "^0+(?=.)", "")
    return pos.rlike(r"^[0-9]+\z") & (F.length(digits) <= 9) & (F.when(F.length(digits) <= 9, digits).try_cast("bigint") <= MOST_POS)


def _info_entries(info: Column) -> Column:
    entries = F.split(info, ";")
    return F.when((F.size(entries) > 1) & (F.element_at(entries, -1) == ""), F.slice(entries, 1, F.size(entries) - 1)).otherwise(entries)


def _info_holds(info: Column, pos: Column) -> Column:
    entries = _info_entries(info)
    shaped = F.forall(entries, lambda x: x.rlike(r"(?s)^[A-Za-z_][A-Za-z0-9_.]*(=.+)?\z"))
    whole = F.forall(entries, lambda x: ~x.rlike(r"^(END|SVLEN)(=|\z)") | x.rlike(r"^(END|SVLEN)=-?[0-9]+\z"))
    digits = lambda x: F.regexp_replace(x, "^END=-?0*", "")
    below = lambda x: F.when(x.startswith("END=-") & (digits(x) != ""), F.lit(True)).otherwise(
        (F.length(digits(x)) <= 9) & (F.coalesce(F.when(F.length(digits(x)) <= 9, digits(x)).try_cast("bigint"), F.lit(0)) < pos.try_cast("bigint"))
    )
    after = F.forall(entries, lambda x: ~x.startswith("END=") | ~below(x))
    return (info == ".") | (shaped & whole & after)


def parsed(lines: DataFrame) -> DataFrame:
    """Adds ``quoting_ok`` and ``cells``, the columns of the line with quoted separators covered up."""
    return lines.withColumn("quoting_ok", _quoting_holds(F.col("line"))).withColumn("cells", F.split(_masked(F.col("line")), "\t"))


def strict_load(raw: DataFrame) -> DataFrame:
    """The lines that conform: the ten VCF columns (text as delivered, POS a number) as ``vcf_*`` beside the table's own, of which those with such a name are left out."""
    own = [c for c in raw.columns if c not in {f"vcf_{n}" for n in VCF_COLUMNS}]
    lines = parsed(data_lines(raw.select("raw_line", F.struct(*own).alias("_row"))))
    cells = lines.where(F.col("quoting_ok") & (F.size("cells") == COLUMNS))
    good = cells.where(_pos_holds(F.get("cells", F.lit(1)))).where(_info_holds(F.get("cells", F.lit(7)), F.get("cells", F.lit(1))))
    # The cover-up is undone from the line itself, whose characters are at the same places.
    lengths = F.transform("cells", lambda c: F.length(c) + 1)
    begins = F.transform(F.sequence(F.lit(0), F.lit(COLUMNS - 1)), lambda i: F.aggregate(F.slice(lengths, 1, i), F.lit(1), lambda a, b: a + b))
    text = [F.col("line").substr(F.get(begins, F.lit(i)), F.length(F.get("cells", F.lit(i)))) for i in range(COLUMNS)]
    loaded = F.struct(*(t.cast("bigint").alias(f"vcf_{n}") if n == "pos" else t.alias(f"vcf_{n}") for n, t in zip(VCF_COLUMNS, text)))
    return good.select("_row", loaded.alias("_vcf")).select("_row.*", "_vcf.*")


def rejected(raw: DataFrame) -> DataFrame:
    """``line_id, reason`` of the data lines that the strict load leaves out."""
    lines = data_lines(raw.select("line_id", "raw_line")).select("line_id", "line")
    loaded = strict_load(raw.select("line_id", "raw_line")).select(F.col("line_id").alias("loaded_id"))
    # Offsets are subtracted from offsets; the table of the rest is stored, so that its size is known when the lines are fetched.
    rest = lines.select("line_id").join(loaded, F.col("line_id").eqNullSafe(F.col("loaded_id")), "left_anti").select(F.col("line_id").alias("rest_id"))
    rest = durable(rest.distinct(), "rejected")
    rest = parsed(lines.join(rest, F.col("line_id").eqNullSafe(F.col("rest_id")), "left_semi"))
    reason = (
        F.when(~F.col("quoting_ok"), F.lit("quoting"))
        .when(F.size("cells") != COLUMNS, F.lit("columns"))
        .when(~F.coalesce(_pos_holds(F.get("cells", F.lit(1))), F.lit(False)), F.lit("pos"))
        .otherwise(F.lit("info"))
    )
    return rest.select("line_id", reason.alias("reason"))
