"""Files in and out: transcripts as CSV, documents as JSON, records as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from parley.functions.scalars import plain_punctuation


def read_transcripts(spark: SparkSession, path: str, schema: str | StructType, required: str = "utterance_text") -> DataFrame:
    """CSV transcripts below a path or glob, with a header each; the file's name without its ending is `conversation_id`.

    A schema without the required column is refused before anything is read. Quoted line breaks belong to their field.
    """
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if required not in schema.fieldNames():
        raise ValueError(f"transcripts need the column {required}")
    rows = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return rows.select("*", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1).alias("conversation_id"))


def read_documents(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """JSON documents, one or an array of them a file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def first_existing(spark: SparkSession, *paths: str) -> str:
    """The first path that exists, in any store Spark reads."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(conf).exists(at):
            return path
    raise FileNotFoundError(", ".join(paths))


def first_by(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The first row of each key in a declared order; null keys are a key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def write_records(rows: DataFrame, path: str, keys: list[str], *order: str) -> None:
    """JSON lines with one record a key."""
    first_by(rows, keys, *order).write.mode("overwrite").json(path)


def write_conversations(rows: DataFrame, path: str, key: str = "conversation_id") -> None:
    """Parquet with a folder a conversation; each is gathered first, so it gets few files."""
    rows.repartition(key).write.mode("overwrite").partitionBy(key).parquet(path)


def without_field(rows: DataFrame, array: str, field: str) -> DataFrame:
    """The rows with a field dropped from every struct of an array column."""
    return rows.withColumn(array, F.transform(array, lambda x: x.dropFields(field)))


def write_csv(rows: DataFrame, path: str, key: str = "conversation_id") -> None:
    """CSV with a header, a folder a conversation."""
    rows.repartition(key).write.mode("overwrite").option("header", True).option("escape", '"').partitionBy(key).csv(path)


def write_idf_maps(idf: DataFrame, path: str) -> None:
    """A JSON line for each conversation: its terms with their idf, from (conversation_id, term, idf)."""
    idf.groupBy("conversation_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("term", "idf")))).alias("idf")).write.mode("overwrite").json(path)


def write_summary(rows: DataFrame, path: str, column: str = "label_source") -> None:
    """One JSON line: the number of rows and of those of each value of a column; nulls are counted as `null`."""
    counts = rows.groupBy(F.coalesce(column, F.lit("null")).alias("key")).agg(F.count("*").alias("n"))
    counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "n")))).alias(f"{column}_counts")).write.mode("overwrite").json(path)


def read_snapshot(spark: SparkSession, path: str, schema: str | StructType | None = None, **equal) -> DataFrame:
    """A collection exported as JSON lines (with a schema) or Parquet (without), its rows filtered by equality; None is null.

    On Parquet the filters reach the scan.
    """
    rows = spark.read.schema(schema).json(path) if schema else spark.read.parquet(path)
    for column, value in equal.items():
        rows = rows.where(F.col(column).eqNullSafe(value))
    return rows


def read_acts(spark: SparkSession, path: str, schema: str, aliases: list[str]) -> DataFrame:
    """Moderators' acts as CSV, a file a conversation, of the conversations whose id ends a file's name."""
    conv = F.regexp_extract("_metadata.file_name", r"([^_]*?)(\.[^.]*)?$", 1)
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path).select("*", conv.alias("conversation_id")).where(F.col("conversation_id").isin(*aliases))


def read_vectors(spark: SparkSession, path: str, ids: list[str]) -> DataFrame:
    """(memory, embedding) of JSON lines of some conversations; of a memory's text the last by id counts, empty ones go."""
    rows = spark.read.schema("conversation_id string, memory_id string, memory string, embedding array<double>").json(path)
    known = rows.where(F.col("conversation_id").isin(*ids) & (F.coalesce("memory", F.lit("")) != "") & (F.size(F.coalesce("embedding", F.array().cast("array<double>"))) > 0))
    return known.groupBy("memory").agg(F.max_by("embedding", F.coalesce("memory_id", F.lit(""))).alias("embedding"))


def memory_vectors(metas: DataFrame) -> DataFrame:
    """A row for each prior memory that has an embedding, from (conversation_id, file_name, prior_memory); the id has the prefix that its file has."""
    rows = metas.select(F.when(F.col("file_name").startswith("insq_") & ~F.col("conversation_id").startswith("insq_"), F.concat(F.lit("insq_"), "conversation_id")).otherwise(F.col("conversation_id")).alias("conversation_id"), F.explode("prior_memory").alias("m"))
    return rows.where("m.embedding is not null").select("conversation_id", F.col("m.id").alias("memory_id"), F.col("m.memory").alias("memory"), F.col("m.embedding").alias("embedding"))


#: An utterance of a corpus, one a line; only these fields are parsed.
CORPUS_LINE = "id string, conversation_id string, root string, speaker string, user string, timestamp double, text string, meta struct<segment:string,speakertype:string,nontext:string>"


def read_corpus(spark: SparkSession, folder: str, ids: list[str] | None = None) -> DataFrame:
    """Transcript rows of a conversation corpus: `utterances.jsonl`, a line an utterance, and `conversations.json`, one object by id.

    (title, conversation_id, phase, utterance_id, utterance_index, utterance_speaker, role, nontext, utterance_text, segment) with
    plain quotes and dashes, and without dashes at a text's start. Utterances without a text are left out before they are
    numbered, by time and then by the number in their id; a text of dashes alone stays and is empty. Older corpora say `root`
    and `user` for the conversation and the speaker. ids: only these conversations, which the scan leaves out of what it keeps.
    A conversation that the second file lacks has no title. Lines are split over tasks; the second file is one task's.
    """
    lines = spark.read.schema(CORPUS_LINE).json(f"{folder}/utterances.jsonl")
    rows = lines.select(F.coalesce("conversation_id", "root").alias("conversation_id"), F.col("meta.segment").alias("phase"), F.col("id").alias("utterance_id"), F.coalesce("speaker", "user").alias("utterance_speaker"), F.col("meta.speakertype").alias("role"), F.col("meta.nontext").alias("nontext"), "text", "timestamp").where(F.length("text") > 0)
    rows = rows if ids is None else rows.where(F.col("conversation_id").isin(*ids))
    order = Window.partitionBy("conversation_id").orderBy("timestamp", F.regexp_extract("utterance_id", r"(\d+)\D*$", 1).try_cast("long"), "utterance_id")
    clean = plain_punctuation(F.col("text"))
    whole = spark.read.text(f"{folder}/conversations.json", wholetext=True)
    titles = whole.select(F.explode(F.from_json("value", "map<string,struct<meta:struct<title:string>,title:string>>")).alias("conversation_id", "v")).select("conversation_id", F.coalesce("v.meta.title", "v.title").alias("title"))
    out = rows.withColumn("utterance_index", F.row_number().over(order) - 1).join(titles, "conversation_id", "left")
    return out.select("title", "conversation_id", "phase", "utterance_id", "utterance_index", "utterance_speaker", "role", "nontext", clean.alias("utterance_text"), F.lit(-1).alias("segment"))
