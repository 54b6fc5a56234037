"""Sources and sinks: text folders, JSON, Parquet with a schema, upserts, caches and result files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.errors import AnalysisException


def text_files(spark: SparkSession, folder: str) -> DataFrame:
    """name, stem, content of every .txt and .md file, read whole."""
    d = spark.read.option("pathGlobFilter", "*.{txt,md}").text(folder, wholetext=True)
    d = d.select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("content"))
    return d.select("name", F.regexp_replace("name", r"\.[^.]+$", "").alias("stem"), "content")


def sampled_files(files: DataFrame, docs: DataFrame) -> DataFrame:
    """Files of documents that are listed, by their stem or the stem before _page_."""
    listed = docs.select(F.col("doc").alias("k")).distinct()
    both = F.array_distinct(F.array("stem", F.regexp_replace("stem", "_page_[^_]*$", "")))
    keep = files.select("name", F.explode(both).alias("k")).join(listed, "k", "left_semi").select("name").distinct()
    return files.join(keep, "name", "left_semi")


def json_lines(spark: SparkSession, path: str, schema: StructType | str, strict: bool = False) -> DataFrame:
    """JSON lines without blank ones (S3). A broken line is left out (see broken_lines), or with strict an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def broken_lines(spark: SparkSession, path: str) -> DataFrame:
    """line: what json_lines leaves out for not being JSON."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    return lines.where(F.try_parse_json("value").isNull()).select(F.col("value").alias("line"))


def json_array(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def parquet_or_empty(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A table, or an empty one where nothing is stored."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], schema)


def corpus_pages(questions: DataFrame) -> DataFrame:
    """doc, page, text: each page of evidence once."""
    return questions.select(F.explode("evidence").alias("e")).select(F.col("e.doc_name").alias("doc"), F.col("e.page").alias("page"), F.col("e.text").alias("text")).groupBy("doc", "page").agg(F.min("text").alias("text"))


def query_table(questions: DataFrame) -> DataFrame:
    """One row a question with its first evidence."""
    e = F.try_element_at("evidence", F.lit(1))
    return questions.select("id", F.col("question").alias("query"), F.col("answer").alias("ground_truth"), F.coalesce(e["doc_name"], F.lit("")).alias("evidence_doc"), e["page"].alias("evidence_page"), F.coalesce("company", F.lit("")).alias("company"))


def upserted(old: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """old with rows of new in place of those with their key.

    Of new rows that repeat a key the last by `order` stays, and of equals, or without one, the greatest by its
    columns from the left.
    """
    last = F.max(F.struct(*([F.col(order).alias("_order")] if order else []), F.struct(*new.columns).alias("_row"))).alias("_last")
    new = new.groupBy(F.col(key).alias("_key")).agg(last).select("_last._row.*")
    return old.join(new.select(key), key, "left_anti").select(*new.columns).unionByName(new)


def not_cached(docs: DataFrame, cache: DataFrame, content: str, signature: str) -> DataFrame:
    """Documents whose content under a signature has not been worked on."""
    keyed = docs.withColumn("content_key", F.left(F.sha2(content, 256), F.lit(16))).withColumn("signature", F.lit(signature))
    return keyed.join(cache.select("content_key", "signature").distinct(), ["content_key", "signature"], "left_anti")


def with_row_ids(rows: DataFrame, *columns: str) -> DataFrame:
    """Ids from the content in place of ids that a store hands out."""
    return rows.withColumn("id", F.md5(F.to_json(F.struct(*columns))))


def catalog_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """kind, name, n of labels and relationship types."""
    a = nodes.groupBy("label").agg(F.count("*").alias("n")).select(F.lit("node").alias("kind"), F.col("label").alias("name"), "n")
    return a.unionByName(edges.groupBy("type").agg(F.count("*").alias("n")).select(F.lit("edge").alias("kind"), F.col("type").alias("name"), "n"))


def cleanup_plan(names: DataFrame, keep: list[str], drop: list[str]) -> DataFrame:
    """name, action: keep, drop or ignore by prefix, keep before drop."""
    by = lambda prefixes: F.greatest(F.lit(False), F.lit(False), *(F.startswith("name", F.lit(p)) for p in prefixes))
    return names.select("name", F.when(by(keep), "keep").when(by(drop), "drop").otherwise("ignore").alias("action"))


def newest_results(files: DataFrame) -> DataFrame:
    """key, path of the newest result file of each key (S24): key, path, modified."""
    kept = files.where(~F.col("path").rlike(r"(?:^|/)(?:run_[^/]*|[^/]*(?:summary|stage_diagnostics)[^/]*)$"))
    return kept.groupBy("key").agg(F.max_by("path", F.struct("modified", "path")).alias("path"))


def write_results(details: DataFrame, traces: DataFrame, folder: str) -> None:
    """Details and traces as JSON lines below a folder."""
    details.write.mode("overwrite").json(f"{folder}/details")
    traces.write.mode("overwrite").json(f"{folder}/traces")


def markdown_row(*columns: str) -> F.Column:
    """A line of a Markdown table; pipes escaped, line ends as spaces."""
    clean = [F.regexp_replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), r"\s*\n\s*", " ") for c in columns]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *clean), F.lit(" |"))
