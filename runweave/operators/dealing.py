"""How many tasks the rows of a plan are dealt to.

Spark takes a fixed number of partitions, or merges them up to a size in shuffled bytes, of which runs take few: tasks grow with
the input, to millions of rows.  Here the bytes of the tables that a plan reads give the number."""

from __future__ import annotations

from pyspark.sql import DataFrame

PART_BYTES = 8 << 20  # of the tables' files: some 400,000 to 1,000,000 rows of the driver's tables
MOST = 20_000
#: What keeps rows where they are; of a join, its left side's.
_KEEPS = ("Project", "Filter", "Window", "Generate", "SubqueryAlias", "Join")


def table_bytes(df: DataFrame) -> int:
    """Of the files and local tables that the plan reads, each as often as it occurs; 0 if one's size isn't known."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    return 0 if max(sizes, default=0) >> 50 else sum(sizes)


def partitions(df: DataFrame, rows: int = 1) -> int:
    """1: the input is small, or its size unknown, and the number is left to Spark.  rows: how many rows one of a table is cut
    into."""
    if df.isStreaming:
        return 1
    n = -(-table_bytes(df) * rows // PART_BYTES)
    return max(1, min(MOST, max(n, min(8 * n, df.sparkSession.sparkContext.defaultParallelism)))) if n > 1 else 1


def is_dealt(df: DataFrame, keys: tuple[str, ...]) -> bool:
    """Whether rows with equal keys already are in one of a given number of partitions."""
    node = df._jdf.queryExecution().analyzed()
    ids = {a.exprId().id() for a in map(node.output().apply, range(node.output().size())) if a.name() in keys}
    while node.nodeName() in _KEEPS:
        if node.nodeName() == "Join" and node.joinType().sql() not in ("INNER", "LEFT OUTER", "LEFT SEMI"):
            return False
        node = node.children().head()
    if node.nodeName() != "RepartitionByExpression" or node.optNumPartitions().isEmpty():
        return False
    by = [node.partitionExpressions().apply(k) for k in range(node.partitionExpressions().size())]
    return bool(by) and all(e.nodeName() == "AttributeReference" and e.exprId().id() in ids for e in by)


def deal(df: DataFrame, *keys: str, rows: int = 1, always: bool = False) -> DataFrame:
    """The same rows, those with equal keys together, in as many partitions as their tables' size asks for.

    A small input stays as it is, for an operator's own need of its keys to deal it (always: is dealt here); so does one that
    is dealt by some of the keys already."""
    n = partitions(df, rows)
    if n > 1:
        return df if is_dealt(df, keys) else df.repartition(n, *keys)
    return df.repartition(*keys) if always else df


def deal_both(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """For a join by the key.  The right side is dealt like the left; else the planner gives the left side's exchange the number
    that the right one happens to have."""
    n = partitions(left)
    return (deal(left, key), right.repartition(n, key)) if n > 1 else (left, right)
