"""The queries of problems 1 and 3 to 8, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.sizes import spread
from ..scratch import staged
from .history import refused_files
from .leaks import LeakSearch
from .neardup import NearDuplicates
from .packing import packed_documents, waste
from .spans import SharedSpans
from .spam import list_pages, page_curves, suspects
from .split import split_oversized

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SharedSpans(table(spark, sf_dir, "chunks")).spans()


def p1_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SharedSpans(table(spark, sf_dir, "chunks")).passages().drop("equal")


def p1_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SharedSpans(table(spark, sf_dir, "chunks")).members()


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SharedSpans(table(spark, sf_dir, "chunks")).report()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_pieces(spark, sf_dir).groupBy("id").agg(F.max(F.col("had_to_force").cast("long")).alias("forced"))


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "run_identity"))


def p3_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oversized texts put together again from their pieces, and how many pieces break a rule."""
    limits = table(spark, sf_dir, "run_identity").groupBy("collection").agg(F.min("max_chars").alias("max_chars"))
    end = F.col("start") + F.length("text")
    before = F.max(end).over(Window.partitionBy("id").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, -1))
    pieces = p3_pieces(spark, sf_dir).join(F.broadcast(limits), "collection").withColumn("before", F.coalesce(before, F.lit(0)))
    new = F.substring("text", (F.col("before") - F.col("start") + 1).cast("int"), F.length("text"))
    wrong = (F.length("text") > F.col("max_chars")) | (F.col("start") > F.col("before")) | ((F.col("cut") == "forced") & ~F.col("had_to_force"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", new.alias("t")))), lambda x: x["t"]), "")
    out = pieces.groupBy("id").agg(F.md5(whole.cast("binary")).alias("text_md5"), F.count_if(wrong).alias("wrong"), F.countDistinct("heading").alias("headings"))
    return out


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NearDuplicates(table(spark, sf_dir, "chunks")).pairs()


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NearDuplicates(table(spark, sf_dir, "chunks")).groups()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = refused_files(table(spark, sf_dir, "files"), table(spark, sf_dir, "manifest"))
    return found.select(
        F.least("file_no", "other_no").alias("file_no_a"), F.greatest("file_no", "other_no").alias("file_no_b")
    ).distinct()


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "containers"))


def p6_waste(spark: SparkSession, sf_dir: str) -> DataFrame:
    return waste(p6_packed(spark, sf_dir))


def p6_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each container the documents placed, and how many bins or documents break a rule: bins over their capacity,
    documents divided that would have fitted, and documents not placed exactly once from end to end."""
    packed = staged(p6_packed(spark, sf_dir), "packed")
    bins = packed.groupBy("container", "capacity", "bin_id").agg(F.sum("n_tokens").alias("n")).groupBy("container", "capacity").agg(F.count_if(F.col("n") > F.col("capacity")).alias("overfull"))
    docs = packed.groupBy("container", "capacity", "doc_id").agg(
        F.sum("n_tokens").alias("n"), F.max(F.col("start") + F.col("n_tokens")).alias("end"), F.min("start").alias("first"), F.count("*").alias("pieces"), F.countDistinct("start").alias("starts")
    )
    cut, broken = (F.col("pieces") > 1) & (F.col("n") <= F.col("capacity")), (F.col("n") != F.col("end")) | (F.col("first") != 0) | (F.col("pieces") != F.col("starts"))
    docs = docs.groupBy("container", "capacity").agg(F.count("*").alias("docs"), F.count_if(cut).alias("cut"), F.count_if(broken).alias("broken"))
    return docs.join(bins, ["container", "capacity"])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    search = LeakSearch(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return search.exact().select("doc_id", "item_id").distinct()


def p7_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return LeakSearch(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).near()


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return list_pages(table(spark, sf_dir, "documents"))


def p8_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suspects(page_curves(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Query]:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1:2].isdigit() and callable(v)}
