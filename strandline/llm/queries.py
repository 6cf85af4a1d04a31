"""The queries of this subpackage, p1, p6, p7, p8 and p9, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandline.llm import bpe, components, minmax, mixing, sentences
from strandline.session import table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": lambda s, d: minmax.near_duplicate_calls(table(s, d, "svcalls")),
        "p1_groups": lambda s, d: minmax.near_duplicate_groups(table(s, d, "svcalls")),
        "p6_found": lambda s, d: components.call_groups(table(s, d, "dist_pairs")),
        "p7_ids": lambda s, d: bpe.token_ids(table(s, d, "documents")),
        "p7_offsets": lambda s, d: bpe.token_ids(table(s, d, "documents"), with_offsets=True),
        "p8_mix": lambda s, d: mixing.mix(table(s, d, "documents"), table(s, d, "mix_targets")),
        "p8_shares": lambda s, d: mixing.mix_shares(table(s, d, "documents"), table(s, d, "mix_targets")),
        "p9_found": lambda s, d: sentences.sentence_spans(table(s, d, "documents")),
    }


P6_SQL = """
WITH RECURSIVE good AS (
  SELECT id1, id2, edit_distance BETWEEN 0 AND 20 AS linked FROM dist_pairs
  WHERE id1 IS NOT NULL AND id2 IS NOT NULL AND id1 NOT IN ('', '.', 'NA') AND id2 NOT IN ('', '.', 'NA')
), ids AS (SELECT id1 AS call_id FROM good UNION SELECT id2 FROM good),
edges AS (SELECT id1 AS u, id2 AS v FROM good WHERE linked UNION SELECT id2, id1 FROM good WHERE linked),
reach(call_id, other) AS (
  SELECT call_id, call_id FROM ids
  UNION
  SELECT r.call_id, e.v FROM reach r JOIN edges e ON e.u = r.other
)
SELECT call_id, min(other) AS group_id FROM reach GROUP BY call_id
"""


def oracle_sql() -> dict[str, str]:
    return {"p6_found": P6_SQL}
