"""Several values packed in one field, one row each (problem 3).

A field is cut at its quotations: what lies between them are the even pieces, their contents the odd
ones. Odd pieces are literals; a literal that follows the one before it at once, with the same mark,
goes on with one mark in between (a doubled mark). Even pieces are split on their delimiters. Array
functions then put the values together in order, and ordinals follow from the position in the
assembled array. Two kinds of marks may quote, and either is plain text inside the other, so a
quotation is looked for as a whole and not by counting marks. Every step is linear in the field.

Defined results: null and empty fields give no row; fields with fewer than two items give none;
empty quotations are no items; a quotation that never closes reaches to the end of the field; of a
tag that comes twice in one INFO the first counts; repeated rows repeat their items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What counts as an unquoted item of ALT: symbols, the overlapping deletion, breakends, base strings.
ALT_ITEMS = r"<[^<>]*>|\*|[A-Za-z]*[\[\]][^\[\]\s]+[\[\]][A-Za-z]*|[A-Za-z]+"
ID_ITEMS = r"[A-Za-z0-9_.\-]+"
ID_TAGS = ("ClusterIDs", "ExactMatchIDs")
_QUOTATION = r"""(?s)"[^"]*+(?:"|\z)|'[^']*+(?:'|\z)"""
_ESCAPE, _CUT = "\x1a", "\x1f"


def even_pieces(field: Column) -> Column:
    """What lies before, between and after the quotations, one more than there are of them."""
    return F.split(field, _QUOTATION)


def odd_pieces(field: Column) -> Column:
    """The quotations, with their marks."""
    return F.regexp_extract_all(field, F.lit(_QUOTATION), F.lit(0))


def _once(value: Column, body) -> Column:
    """``body`` of a value that is worked out once: inside a lambda an expression would be evaluated anew at each element, a variable isn't."""
    return F.element_at(F.transform(F.array(value), body), 1)


def literals(even: Column, odd: Column) -> Column:
    """Array of ``(at, text)``: the contents of the quotations, doubled marks joined; ``at`` is the number of the even piece before it. Both arguments must be variables (see :func:`_once`)."""
    mark = lambda x: F.substring(x, 1, 1)
    content = F.transform(odd, lambda x: F.regexp_replace(F.regexp_replace(x, "^[\"']", ""), F.concat(mark(x), F.lit(r"\z")), ""))
    opens = lambda i: (i == 0) | (F.get(even, i) != "") | (mark(F.get(odd, i)) != mark(F.get(odd, i - 1)))
    numbers = F.when(F.size(odd) > 0, F.sequence(F.lit(0), F.size(odd) - 1)).otherwise(F.array().cast("array<int>"))

    def joined(x: Column) -> Column:
        upto = lambda k: F.coalesce(F.get(x["starts"], k + 1), F.size(odd))
        run = lambda i, k: F.slice(x["content"], i + 1, upto(k) - i)
        text = lambda i, k: F.when(mark(F.get(odd, i)) == '"', F.array_join(run(i, k), '"')).otherwise(F.array_join(run(i, k), "'"))
        return F.transform(x["starts"], lambda i, k: F.struct(i.alias("at"), text(i, k).alias("text")))

    return _once(F.struct(content.alias("content"), F.filter(numbers, opens).alias("starts")), joined)


def split_items(piece: Column, item_pattern: str) -> Column:
    """An even piece split on its delimiters, which are whatever is no item; empty strings may come along."""
    return F.split(F.regexp_replace(piece, f"(?s)({item_pattern})|.", f"$1{_CUT}"), f"{_CUT}+")


def packed_items(field: Column, item_pattern: str) -> Column:
    """Array of the items of a field."""
    even, odd = even_pieces(field), odd_pieces(field)

    def assembled(parts: Column) -> Column:
        found = literals(parts["even"], parts["odd"])
        # A literal comes after the even piece of its number; even pieces inside a joined literal are empty.
        plain = F.transform(parts["even"], lambda x, i: F.struct((i * 2).alias("at"), split_items(x, item_pattern).alias("items")))
        quoted = F.transform(found, lambda x: F.struct((x["at"] * 2 + 1).alias("at"), F.array(x["text"]).alias("items")))
        return F.filter(F.flatten(F.transform(F.array_sort(F.concat(plain, quoted)), lambda x: x["items"])), lambda x: x != "")

    return _once(F.struct(even.alias("even"), odd.alias("odd")), assembled)


def info_entries(info: Column) -> Column:
    """Array of the entries of INFO, parted by semicolons outside quotations, quotation marks kept.

    Semicolons inside quotations are escaped before the split and come back after it.
    """
    escaped = F.replace(info, F.lit(_ESCAPE), F.lit(f"{_ESCAPE}0"))
    covered = F.transform(odd_pieces(escaped), lambda x: F.replace(x, F.lit(";"), F.lit(f"{_ESCAPE}1")))
    joined = F.array_join(F.flatten(F.zip_with(even_pieces(escaped), covered, lambda e, q: F.array(e, F.coalesce(q, F.lit(""))))), "")
    return F.transform(F.split(joined, ";"), lambda x: F.replace(F.replace(x, F.lit(f"{_ESCAPE}1"), F.lit(";")), F.lit(f"{_ESCAPE}0"), F.lit(_ESCAPE)))


def tag_value(info: Column, tag: str) -> Column:
    """The value of the first entry ``tag=value``, blanks around the entry dropped; null without one."""
    hits = F.filter(F.transform(info_entries(info), lambda x: F.trim(x)), lambda x: x.startswith(f"{tag}="))
    return F.substring(F.get(hits, F.lit(0)), len(tag) + 2, 1 << 30)


def split_packed(calls: DataFrame) -> DataFrame:
    """``row_id, packed_field, idx, item`` of ALT and the id lists in INFO.

    One value of letters alone is one item, and without its tag an INFO has no list: such fields
    are known to give no row before anything is cut.
    """
    several = ~F.col("alt_allele").rlike(r"^\s*[A-Za-z]*\s*$")
    fields = [("ALT", F.when(several, packed_items(F.col("alt_allele"), ALT_ITEMS)))]
    for tag in ID_TAGS:
        fields.append((tag, F.when(F.col("info").contains(f"{tag}="), packed_items(tag_value(F.col("info"), tag), ID_ITEMS))))
    packed = F.filter(F.array(*(F.struct(F.lit(name).alias("packed_field"), items.alias("items")) for name, items in fields)), lambda x: F.size(x["items"]) >= 2)
    few = calls.where(several | F.col("info").rlike("ClusterIDs=|ExactMatchIDs=")).select("row_id", "alt_allele", "info")
    return (
        few.select("row_id", F.explode(packed).alias("f"))
        .select("row_id", F.col("f.packed_field").alias("packed_field"), F.posexplode("f.items").alias("at", "item"))
        .select("row_id", "packed_field", (F.col("at") + 1).cast("bigint").alias("idx"), "item")
    )
