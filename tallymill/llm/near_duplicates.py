"""One document of each group of near copies, by the components of the n-gram Jaccard join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.llm.common import kept, likely_and_not
from tallymill.llm.jaccard import link_documents


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The row with the smallest id of every component, and all rows that link with none.

    A row is known by its id and text: rows equal in both are copies also where the text is null or without words, and one of
    them stays. Null ids come last among their component. Only rows that may go are shuffled; the others stay where they are.
    """
    # Under numbers, so that no column of the table can clash with those added here.
    names = [str(i) for i in range(len(docs.columns))]
    own, text = (F.col(str(docs.columns.index(c))) for c in (id_column, text_column))
    rows = docs.toDF(*names).withColumns({"key": F.xxhash64(own, text), "check": F.crc32(F.coalesce(text, F.lit("")))})
    known = F.struct(own.isNull().alias("no_id"), own.alias("own"), F.col("key"), F.col("check"))
    linked = kept(link_documents(rows.select(known.alias("known"), text.alias("text")), "known", "text"), "linked")
    told = linked.groupBy("doc_id").agg(F.count("*").alias("rows"), F.min("component_id").alias("stays"))
    told = told.where("rows > 1 or doc_id <> stays").select(
        F.col("doc_id.key").alias("key"), F.col("doc_id.check").alias("check"), (F.col("doc_id") != F.col("stays")).alias("goes")
    )
    told = kept(told.groupBy("key", "check").agg(F.max("goes").alias("goes")), "told")
    likely, rest = likely_and_not(rows, "key", told, "key")
    once = likely.dropDuplicates(["key", "check"]).join(told.where("goes"), ["key", "check"], "left_anti")
    return rest.select(*names).unionByName(once.select(*names)).toDF(*docs.columns)
