"""The difference of two snapshots of a table, with rows whose key has changed.

Both snapshots are tagged and become one table, in which a row is its key and the SHA-256 of each compared column; texts
aren't moved.  One groupBy on the key takes the row of either side by a conditional aggregate of structs.  What has no
partner by key is ranked within (content, side) by key, and a second groupBy on (content, rank) pairs the i-th smallest
earlier key with the i-th smallest later one.  There is no join.  A content that many rows share is ranked
in ranges (``common.ranked``), so no task gathers it.

Cases: nulls equal nulls only, in keys and in columns; an empty text differs from a null one; extra columns are ignored, and no
column name can clash, as rows are renamed at once; an empty snapshot leaves inserts or deletes only; texts of any length count by their digest.
Where a key is repeated in a snapshot, its rows that are equal pair first, as often as both sides have them; then, in
order of content, the i-th earlier pairs with the i-th later row of the key; what is left may pair by content, in order of key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, ranked

EARLIER, LATER = 0, 1
#: Copies of one row that are written out by one task, where equal rows are repeated.
COPIES = 10_000


def _tagged(rows: DataFrame, key: str, columns: Sequence[str], side: int) -> DataFrame:
    text = [F.col(c).cast("string") for c in columns]
    parts = [F.unhex(F.sha2(c.cast("binary"), 256)).alias(f"p{i}") for i, c in enumerate(text)]
    row = F.concat_ws("\n", *(F.coalesce(c, F.lit("~")) for c in text))
    return rows.select(F.col(key).alias("key"), *parts, F.unhex(F.sha2(row.cast("binary"), 256)).alias("row"), F.lit(side).alias("side"))


def _of(side: int, what: Column) -> Column:
    return F.max(F.when(F.col("side") == side, what))


def difference(earlier: DataFrame, later: DataFrame, *, key: str, columns: Sequence[str]) -> DataFrame:
    """key, old_key, op (same, update, rekey, insert, delete), changed, row_sha256: a row per pair or unpaired row.

    ``columns`` are compared as strings; ``changed`` names those that differ in a pair.  row_sha256 is that of the later row, its
    columns joined by line feeds with ``~`` for null.
    """
    parts = [f"p{i}" for i in range(len(columns))]
    both = _tagged(earlier, key, columns, EARLIER).union(_tagged(later, key, columns, LATER))
    kept = F.struct("key", *parts, "row", F.lit(0).cast("bigint").alias("copy"))
    counts = [F.count_if(F.col("side") == s).alias(n) for s, n in ((EARLIER, "n_old"), (LATER, "n_new"))]
    keyed = cut(both.groupBy("key").agg(_of(EARLIER, kept).alias("old"), _of(LATER, kept).alias("new"), *counts))
    most = keyed.agg(F.max(F.greatest("n_old", "n_new"))).first()[0] or 0
    if most > 1:
        keyed = _repeated(both, parts)
    paired = keyed.where("old IS NOT NULL AND new IS NOT NULL").select("old", "new", F.lit(False).alias("moved"))
    moved = _paired(_single(keyed, parts), [F.unhex(F.sha2(F.concat_ws(",", *(F.coalesce(F.hex(p), F.lit("-")) for p in parts)), 256))], ["key", "copy"], parts)
    found = paired.union(moved.select("old", "new", F.lit(True)))
    differs = [~F.col(f"old.{p}").eqNullSafe(F.col(f"new.{p}")) for p in parts]
    changed = F.concat_ws(",", *(F.when(d, F.lit(c)) for d, c in zip(differs, columns, strict=True)))
    op = (
        F.when(F.col("new").isNull(), "delete")
        .when(F.col("old").isNull(), "insert")
        .when(F.col("moved"), "rekey")
        .when(changed == "", "same")
        .otherwise("update")
    )
    return found.select(
        F.when(F.col("new").isNotNull(), F.col("new.key")).otherwise(F.col("old.key")).alias("key"),
        F.col("old.key").alias("old_key"),
        op.alias("op"),
        F.when(F.col("new").isNull() | F.col("old").isNull(), "").otherwise(changed).alias("changed"),
        F.lower(F.hex("new.row")).alias("row_sha256"),
    )


def _single(pairs: DataFrame, parts: list[str]) -> DataFrame:
    """The rows that have no partner, with their side."""
    one = F.coalesce("old", "new")
    columns = [one[c].alias(c) for c in ("key", *parts, "row", "copy")]
    return pairs.where("old IS NULL OR new IS NULL").select(*columns, F.when(F.col("old").isNull(), LATER).otherwise(EARLIER).alias("side"))


def _paired(rows: DataFrame, group: list[Column], order: list[str], parts: list[str]) -> DataFrame:
    """old, new: of each group the i-th row of either side in ``order``, one of them null where a side has fewer."""
    names = [f"group{i}" for i in range(len(group))]
    dealt = ranked(rows.withColumns(dict(zip(names, group, strict=True))), [*names, "side"], order, "rank")
    held = F.struct("key", *parts, "row", "copy")
    return dealt.groupBy(*names, "rank").agg(_of(EARLIER, held).alias("old"), _of(LATER, held).alias("new")).select("old", "new")


def _repeated(both: DataFrame, parts: list[str]) -> DataFrame:
    """old, new of rows paired by key where keys repeat: equal rows as often as both sides have them, then by order of content."""
    same = cut(both.groupBy("key", *parts, "row").agg(*(F.count_if(F.col("side") == s).alias(n) for s, n in ((EARLIER, "n_old"), (LATER, "n_new")))))

    def copies(n: Column) -> DataFrame:
        """Every row n times, numbered."""
        chunks = same.withColumn("n", n).where("n > 0").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / COPIES))))
        chunks = chunks.repartition("key", *parts, "chunk")
        return chunks.withColumn("copy", F.explode(F.sequence(F.col("chunk") * COPIES, F.least((F.col("chunk") + 1) * COPIES, "n") - 1)))

    row = F.struct("key", *parts, "row", "copy")
    equal = copies(F.least("n_old", "n_new")).select(row.alias("old"), row.alias("new"))
    left = copies(F.abs(F.col("n_old") - F.col("n_new"))).select("key", *parts, "row", "copy", F.when(F.col("n_old") > F.col("n_new"), EARLIER).otherwise(LATER).alias("side"))
    return cut(equal.union(_paired(left, [F.col("key")], [*parts, "copy"], parts)))
