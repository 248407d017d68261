"""Which texts contain which others, by equality joins on a part and then a look at the whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tessera.session import MOST_BROADCAST, settle, sized

def holders(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, file_stem) of documents (file_stem, text) that contain a query's text, character for character.

    The query's words but the first and last stand in such a document as they are, so the one of these that fewest documents have is looked up, and what it
    finds is confirmed. Queries of fewer than three words have no such word and are compared with every document.
    """
    words = F.split("query", " ")
    inner = F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0)))
    asked = settle(queries.select("query_id", "query", F.array_distinct(inner).alias("inner")).filter("query IS NOT NULL"))
    own = settle(asked.select("query_id", F.explode("inner").alias("word")))
    held = docs.select("file_stem", F.explode(F.array_distinct(F.split("text", " "))).alias("word"))
    counts = held.join(sized(own.select("word").distinct()), "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
    rarest = own.join(counts, "word", "left").groupBy("query_id").agg(F.min_by("word", F.struct(F.coalesce("n", F.lit(0)), "word")).alias("word"))
    found = sized(held.join(sized(rarest), "word").select("query_id", "file_stem").join(asked.select("query_id", "query"), "query_id"))
    long_ = docs.join(found, "file_stem").filter(F.contains("text", "query")).select("query_id", "file_stem")
    short = asked.filter("size(inner) = 0").select("query_id", "query")
    if short.isEmpty():
        return long_.distinct()
    return long_.unionAll(docs.join(short, F.contains("text", "query")).select("query_id", "file_stem")).distinct()


#: Characters of the part by which ``containing`` finds a text.
GRAM = 8


def _grams(text: Column, lengths: Column) -> Column:
    """Distinct runs of characters, of as many as the array ``lengths`` names."""
    n = F.length(text)
    runs = F.transform(F.filter(lengths, lambda k: k <= n), lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(text, i, k)))
    return F.array_distinct(F.flatten(runs))


def containing(texts: DataFrame, needles: DataFrame, text: str, needle: str) -> DataFrame:
    """All columns of a text and a needle, for every text that contains the needle as it is. For short texts, as titles and queries are.

    A needle is looked up by the run of ``GRAM`` of its characters that fewest needles have (itself where it is shorter). Empty and null needles are in no text.
    """
    n = needles.filter(F.length(needle) > 0)
    size = F.least(F.length(needle), F.lit(GRAM))
    runs = n.select(F.col(needle).alias("whole_needle"), F.explode(_grams(F.col(needle), F.array(size))).alias("gram")).distinct()
    rare = runs.join(runs.groupBy("gram").agg(F.count("*").alias("n")), "gram").groupBy("whole_needle").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    lengths = n.agg(F.collect_set(size).alias("lengths"))  # one row of at most GRAM numbers
    asked = texts.crossJoin(F.broadcast(lengths)).select(*texts.columns, F.explode(_grams(F.col(text), F.col("lengths"))).alias("gram"))
    keyed = n.join(rare, F.col(needle) == F.col("whole_needle")).drop("whole_needle")
    return asked.join(keyed, "gram").filter(F.contains(F.col(text), F.col(needle))).drop("gram")


def with_once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """``rows`` with one more column, worked out once: a generated value is not put into the expressions and filters that use it, as that of ``withColumn`` may be."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


#: Values about which ``packed`` puts into a row. Rows are brought to each piece of their group: longer pieces are fewer copies, shorter ones more even tasks.
PIECE = 1024
#: Bytes up to which numbers are broadcast by ``expanded``.
MOST_BYTES = 8_000_000


def packed(rows: DataFrame, by: str, value: Column, size: int = PIECE) -> DataFrame:
    """(by, piece, values): the values of each group in arrays of about ``size``, dealt by hash, so that no row grows with a group. A value that occurs twice stays twice."""
    n = rows.groupBy(by).agg(F.ceil(F.count("*") / size).alias("pieces"))
    dealt = rows.select(by, value.alias("one_value")).join(n, by).withColumn("piece", F.pmod(F.xxhash64("one_value"), F.col("pieces")))
    return dealt.groupBy(by, "piece").agg(F.collect_list("one_value").alias("values"))


def expanded(rows: DataFrame, packs: DataFrame, by: str, value: str) -> DataFrame:
    """Every row with every value of its group, one at a time: the last step of a pair query whose groups were matched before. What is shuffled is a row and piece each, not the pairs; few values are broadcast.

    Pairs are made in their tasks and stay there, so they need no shuffle; if rows and values are distinct, so are the pairs. Joins on null groups give nothing.
    """
    packs = settle(packs)
    kept = [c for c in rows.columns if c != by]
    narrow = isinstance(packs.schema["values"].dataType.elementType, (T.IntegerType, T.LongType))
    if (packs.agg(F.sum(F.size("values"))).first()[0] or 0) <= (MOST_BYTES // 8 if narrow else MOST_BROADCAST):
        return rows.join(F.broadcast(packs.drop("piece")), by).select(*kept, F.explode("values").alias(value))
    # as many tasks as the session has for shuffles: rows are few before they are expanded, so their size says nothing of the work
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = rows.join(packs.groupBy(by).agg(F.collect_list("piece").alias("pieces")), by).select(*kept, by, F.explode("pieces").alias("piece"))
    return asked.repartition(n, by, "piece").join(packs.repartition(n, by, "piece"), [by, "piece"]).select(*kept, F.explode("values").alias(value))
