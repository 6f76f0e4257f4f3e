"""Exact deduplication by content-defined chunk recipes, in DataFrame code only.

A text becomes an ordered list of chunks cut where its own content says so: at the first sentence or line end after
`least` characters, at `most` characters otherwise.  Chunks are deduplicated by content over the whole corpus, and a
chunk's hash is its identifier; identifiers are verified, for two contents under one hash are found by comparing the
contents and told apart by a number.  Documents are then equal when their ordered identifier lists are, so each
distinct chunk moves once, and documents are represented by short lists from there on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runweave.llm.common import documents, lower_ascii, stage_table

LEAST, MOST = 256, 2048
SALTS = 32


def chunks_of(text: Column, least: int = LEAST, most: int = MOST) -> Column:
    """The chunks, whose concatenation is the text; none for an empty text."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{{least},{most - 1}}}?[.!?\n]|.{{1,{most}}}"), F.lit(0))


def _hash(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def recipes(df: DataFrame, key: str, text: str, hash_of=_hash, least: int = LEAST, most: int = MOST) -> DataFrame:
    """key, text_sha256, ids (identifier per chunk) and fix (place and number of chunks whose hash belongs to several contents)."""
    normal = lower_ascii(F.coalesce(F.col(text), F.lit("")))
    cut = df.select(F.col(key), normal.alias("t")).withColumn("chunks", chunks_of(F.col("t"), least, most))
    listed = stage_table(cut.select(key, F.sha2("t", 256).alias("text_sha256"), F.transform("chunks", hash_of).alias("ids")), "recipes")
    contents = cut.select(F.explode("chunks").alias("chunk")).withColumn("h", hash_of(F.col("chunk"))).groupBy("h", "chunk").agg(F.lit(1).alias("one"))
    shared = contents.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")
    none = F.array().cast("array<struct<pos:int,no:int>>")
    shared = stage_table(shared, "shared-hashes")
    if shared.isEmpty():
        return listed.withColumn("fix", none)
    numbered = cut.select(F.explode("chunks").alias("chunk")).distinct().withColumn("h", hash_of(F.col("chunk"))).join(shared, "h", "left_semi")
    numbered = numbered.withColumn("no", F.row_number().over(Window.partitionBy("h").orderBy("chunk"))).filter("no > 1").select("chunk", "no")
    placed = cut.select(key, "t", F.posexplode("chunks").alias("pos", "chunk")).join(numbered, "chunk")
    fixes = placed.groupBy(F.sha2("t", 256).alias("text_sha256")).agg(F.sort_array(F.collect_set(F.struct("pos", "no"))).alias("fix"))
    return listed.join(fixes, "text_sha256", "left").withColumn("fix", F.coalesce("fix", none))


def exact_groups(df: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "max", hash_of=_hash, least: int = LEAST, most: int = MOST) -> DataFrame:
    """One row per row of `df`: key, keep_id, group_size, kept, text_sha256 of the text with A-Z in lower case.

    Null counts as the empty text.  Of equal texts the row with the largest (keep="max") or smallest key stays; a null key
    stays only in a group of null keys, and of rows that share the kept key all count as kept.  An empty table gives an
    empty result.  Other columns are not looked at.

    A large group's rows meet in no single task: they are counted before the shuffle, and its result is joined back
    under SALTS salts."""
    listed = recipes(df, key, text, hash_of, least, most).withColumn("rk", F.xxhash64("ids", "fix.no", F.size("ids")))
    best = (F.max if keep == "max" else F.min)(key)
    groups = listed.groupBy("rk", "ids", "fix").agg(best.alias("keep_id"), F.count("*").alias("group_size")).filter("group_size > 1")
    groups = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = listed.withColumn("salt", F.pmod(F.xxhash64(key, F.lit(1)), F.lit(SALTS)).cast("int"))
    out = salted.join(groups, ["rk", "ids", "fix", "salt"], "left")
    alone = F.col("group_size").isNull()
    out = out.withColumn("keep_id", F.when(alone, F.col(key)).otherwise(F.col("keep_id"))).withColumn("group_size", F.when(alone, F.lit(1)).otherwise(F.col("group_size")).cast("long"))
    return out.select(key, "keep_id", "group_size", F.col(key).eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_first(df: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "max") -> DataFrame:
    """df's rows, one of each group of equal texts, with all their columns; of rows that also share the key, any one.

    Null counts as the empty text, a null key stays only in a group of null keys, an empty table gives an empty one.

    What goes is found on keys and hashes alone, and rows leave by an anti-join with that narrow table: texts don't move where it is
    small.  Only what shares its key, too, is told apart by a number that is written down with the rows."""
    groups = stage_table(exact_groups(df.select(key, text), key, text, keep), "exact-groups")
    sha = F.sha2(lower_ascii(F.coalesce(F.col(text), F.lit(""))), 256)
    gone = groups.filter("NOT kept").select(F.col(key).alias("_rw_key"), F.col("text_sha256").alias("_rw_gone")).distinct()
    own = df.withColumn("_rw_sha", sha)
    own = own.join(gone, own[key].eqNullSafe(gone["_rw_key"]) & (F.col("_rw_sha") == F.col("_rw_gone")), "left_anti")
    twice = groups.filter("kept").groupBy(key, "text_sha256").count().filter("count > 1").select(F.col(key).alias("_rw_key"), F.col("text_sha256").alias("_rw_twice"))
    twice = stage_table(twice, "repeated-rows")
    if twice.isEmpty():
        return own.drop("_rw_sha")
    again = own[key].eqNullSafe(twice["_rw_key"]) & (F.col("_rw_sha") == F.col("_rw_twice"))
    single = own.join(twice, again, "left_anti").drop("_rw_sha")
    some = own.join(twice, again, "left_semi").groupBy("_rw_sha", key).agg(F.first(F.struct(*(F.col(f"`{c}`") for c in df.columns))).alias("_rw_row"))
    return single.unionByName(some.select("_rw_row.*"))


def op8_exact_dedup(spark, sf_dir):
    """Groups of documents equal but for the case of A-Z; the largest doc_id stays."""
    return exact_groups(documents(spark, sf_dir))


SQL = {
    "op8_exact_dedup": """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, CAST(count(*) OVER w AS BIGINT) AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(x) AS text_sha256
FROM t WINDOW w AS (PARTITION BY x)"""
}
