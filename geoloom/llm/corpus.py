"""Reading the corpus tables as the operators want them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from geoloom.sources.shared import materialise


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` (long), ``text`` (null as empty) and further columns, whatever else the table holds."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def unused(docs: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where ``docs`` has such a column, in any case."""
    own = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in own:
            name += "_"
        own.add(name.lower())
        out.append(name)
    return out


def fold(modulus: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string")) % modulus


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learnable: Column, most: dict[int, int], most_bytes: int) -> DataFrame:
    """At most ``most[y]`` labelled documents of each class y, 0 and 1, as ``text, y``, of ``most_bytes`` characters in all.

    The choice follows a hash of the id, so it is the same on every run; texts of
    any length are learned from, as long as they fit into what their class has left
    of its half of ``most_bytes`` when it is their turn. Only ids are ranked; texts
    are fetched by a join with that bounded list.
    Rows with a null id or label are left out, repeated labels count once and so
    do documents of one id (the least text, the greater label).
    """
    y = F.col(label).cast("int")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), y.alias("y")).where(learnable & F.col("y").isNotNull()).distinct()
    some = [known.where(F.col("y") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most[c]) for c in (0, 1)]
    picked = some[0].unionByName(some[1])
    rows = texts(docs).where(F.length("text") <= most_bytes // 2).join(F.broadcast(picked), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    # a window over the bounded list
    so_far = F.sum(F.length("text")).over(Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id"))
    return rows.withColumn("so_far", so_far).where(F.col("so_far") <= most_bytes // 2).select("text", "y")


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows``, written, with ``place``: their position from 0 in the order of the columns, nulls first.

    Rows are dealt by ranges and counted by range, so no task holds them all; only
    one count a range comes together. Rows that tie in all columns of the order get
    places of their own. An empty table stays empty.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    dealt = materialise(dealt, "ordered").withColumns({"_range": F.shiftright("_at", 33), "_in": F.col("_at").bitwiseAND((1 << 33) - 1)})
    # one row a range
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return dealt.join(F.broadcast(starts), "_range").withColumn("place", F.col("_start") + F.col("_in")).drop("_range", "_in", "_at", "_start")


def looked_up(rows: DataFrame, keyed: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """``rows`` joined with ``keyed``, which has each ``key`` once and in ``n`` how many rows have it (dropped).

    Keys of over a thousandth of ``total`` rows, fewer than a thousand, are
    broadcast; the rest is joined by a shuffle in which no key is frequent.
    ``rows`` is read twice, so it should be a written table.
    """
    often = F.col(n) * 1000 > total
    hot = F.broadcast(keyed.where(often).drop(n))
    rest = rows.join(F.broadcast(keyed.where(often).select(key)), key, "left_anti").join(keyed.where(~often).drop(n), key)
    return rows.join(hot, key).unionByName(rest)
