"""Sets of row ids as bits, so that rows are told apart where they are instead of meeting the set by a shuffle.

A set is a table of words: the upper bits of 64 ids and which of them it holds. Ids of monotonically_increasing_id are dense
within a partition, so a set takes a bit or two for each row of the table it belongs to; any other longs are right too, in more words.
A set of at most MOST_WORDS words is broadcast; beyond that rows and words meet by key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostra.llm.staging import stage
from rostra.plans.size import if_small

#: Words that may be broadcast, 16 bytes each: dense ids of 33 million rows.
MOST_WORDS = 1 << 19


def members(ids: DataFrame, column: str) -> DataFrame:
    """(__member_word, __member_bits): the ids of a column (nulls aside) as a set, staged."""
    words = ids.where(F.col(column).isNotNull()).groupBy(F.shiftright(column, 6).alias("__member_word"))
    return stage(words.agg(F.bit_or(F.expr(f"shiftleft(1L, cast({column} & 63 AS int))")).alias("__member_bits")), "members")


def among(rows: DataFrame, column: str, ids: DataFrame, inside: bool = True) -> DataFrame:
    """rows whose id is in the set, or else those whose id is not; columns may have any names but the set's."""
    found = rows.join(if_small(ids, MOST_WORDS), F.shiftright(column, 6) == F.col("__member_word"), "left")
    own = F.coalesce(F.expr(f"shiftright(__member_bits, cast({column} & 63 AS int)) & 1"), F.lit(0)) == F.lit(1 if inside else 0)
    return found.where(own).drop("__member_word", "__member_bits")
