"""Sources and sinks of knowledge: text files, cases, tables of thresholds, connectors."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow import schema
from tarnflow.functions.rules import chemical_type
from tarnflow.functions.text import chunks, trim

#: The categories of the knowledge base and their priorities.
CATEGORIES = {"国标": "高", "园区规则": "中", "历史案例": "低"}


def files(spark: SparkSession, root: str) -> DataFrame:
    """(content, regulation_type, priority, source_file) of the *.txt files in the folders named like a category.

    A file that can't be read, or is gone when its turn comes, is left out and the rest goes on.
    """
    reader = spark.read.option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
    raw = reader.text(root, wholetext=True, pathGlobFilter="*.txt", recursiveFileLookup=True)
    path = F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B"))
    df = raw.select(F.col("value").alias("content"), F.regexp_extract(path, "([^/]+)/[^/]+$", 1).alias("regulation_type"), F.regexp_extract(path, "([^/]+)$", 1).alias("source_file"))
    priority = F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in kv])
    return df.where(F.col("regulation_type").isin(*CATEGORIES)).withColumn("priority", F.element_at(priority, F.col("regulation_type")))


def whole_files(spark: SparkSession, root: str) -> DataFrame:
    """Files as documents; national standards get a chemical type by their name, the others the wildcard."""
    df = files(spark, root)
    return df.withColumn("chemical_type", F.when(F.col("regulation_type") == "国标", chemical_type(F.col("source_file"))).otherwise("通用"))


def chunked(df: DataFrame, content: str = "content", limit: int = 500) -> DataFrame:
    """A row per chunk, with its number `chunk`."""
    rest = [c for c in df.columns if c != content]
    return df.select(*rest, F.posexplode_outer(chunks(F.col(content), limit)).alias("chunk", content)).where(F.col(content).isNotNull())


def cases(text: Column) -> Column:
    """Cases of a text: what stands between the marks, each with the mark again, on one line."""
    found = F.filter(F.split(text, "案例"), lambda x: x != "")
    return F.transform(found, lambda x: F.concat(F.lit("案例"), trim(F.regexp_replace(x, "\r?\n", " "))))


def threshold_sentence(line: Column) -> Column:
    """Sentence of a line with three fields or more, else null."""
    f = F.split(line, ",")
    return F.when(F.size(f) >= 3, F.format_string("型号%s：安全阈值%s，异常阈值%s", F.get(f, F.lit(0)), F.get(f, F.lit(1)), F.get(f, F.lit(2))))


def thresholds(spark: SparkSession, path: str) -> DataFrame:
    """(content) of a comma-separated file with a header line, read line by line; fields are not quoted."""
    columns = "a string, b string, c string"
    rows = spark.read.schema(columns).csv(path, header=True, quote="", nullValue="\0", mode="PERMISSIVE")
    full = rows.where(F.col("c").isNotNull())
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return full.select(threshold_sentence(F.concat_ws(",", *map(blank, "abc"))).alias("content"))


def knowledge(cases_text: DataFrame, lines: DataFrame) -> DataFrame:
    """(content) of the cases in `cases_text` (text) and of the sentences of the threshold lines in `lines` (line)."""
    told = cases_text.select(F.explode(cases(F.col("text"))).alias("content"))
    sentences = lines.select(threshold_sentence(F.col("line")).alias("content")).where("content IS NOT NULL")
    return told.unionByName(sentences)


def with_defaults(df: DataFrame) -> DataFrame:
    """Metadata as the database has it: the wildcard and the middle priority where none is given."""
    return df.withColumns({"chemical_type": F.coalesce("chemical_type", F.lit("通用")), "priority": F.coalesce("priority", F.lit("中"))})


def write_documents(df: DataFrame, path: str, now: Column, embed=None) -> DataFrame:
    """Append documents (content and any metadata) to the table at path, in one write; what was written.

    Defaults are filled in, `embed` maps the content's column to its vector (none: null), and `now` is the time of writing.
    """
    for c in ("regulation_type", "priority", "chemical_type", "source_file"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    rows = with_defaults(df).withColumn("regulation_type", F.coalesce("regulation_type", F.lit("通用")))
    vector = (embed(F.col("content")) if embed else F.lit(None)).cast("array<float>")
    rows = rows.select("content", "regulation_type", "priority", "chemical_type", "source_file", vector.alias("embedding"), now.cast("timestamp").alias("created_at"))
    rows.write.mode("append").parquet(path)
    return rows


def warehouse(records: DataFrame, chemical_name: str | None = None) -> DataFrame:
    """Warehouse records of a chemical, or all."""
    return records if chemical_name is None else records.where(F.col("chemical_name") == chemical_name)


def tickets(records: DataFrame, is_completed: bool | None = None) -> DataFrame:
    """Tickets that are completed, or not, or all."""
    return records if is_completed is None else records.where(F.col("is_completed") == is_completed)


def metadata(df: DataFrame, names: tuple[str, ...] = ("regulation_type", "priority", "chemical_type", "source_file")) -> Column:
    """Metadata as a map, without what is empty."""
    full = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*map(F.col, names)))
    return F.map_filter(full, lambda k, v: v.isNotNull() & (v != ""))


def connector(spark: SparkSession, kind: str, path: str | None = None) -> DataFrame:
    """Warehouse or ticket table; empty where no path is given."""
    spec = {"warehouse": schema.WAREHOUSE, "ehs": schema.EHS}[kind]
    return spark.read.schema(spec).parquet(path) if path else spark.createDataFrame([], spec)


def create_tables(spark: SparkSession, database: str = "default") -> None:
    """The tables of documents, sessions, audit records and searches, where they don't exist."""
    for name, spec in (("chemical_documents", f"{schema.DOCUMENT}, embedding array<float>, created_at timestamp"), ("sessions", schema.SESSION), ("audit_logs", schema.AUDIT), ("search_logs", schema.SEARCH_LOG)):
        columns = ", ".join(f"`{c.split()[0]}` {c.split()[1]}" for c in spec.replace("map<string,string>", "map<string\0string>").split(", ")).replace("\0", ",")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")


def catalog_info(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT current_database() AS database, version() AS version, current_user() AS user")


def tables(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables())


def reachable(spark: SparkSession, database: str = "default") -> bool:
    """Whether the catalog answers and has the database."""
    try:
        return spark.sql("SELECT 1").first()[0] == 1 and spark.catalog.databaseExists(database)
    except PySparkException:
        return False


def united(**sources: DataFrame) -> DataFrame:
    """The documents of several sources as one table with the defaults of the database; `origin` names each one's source.

    Sources may have any of a document's columns besides `content`; rows without a content are left out.
    """
    columns = ("regulation_type", "priority", "chemical_type", "source_file")
    rows = [df.where("content IS NOT NULL").select(F.lit(name).alias("origin"), "content", *[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns]) for name, df in sources.items()]
    first, *rest = rows
    for df in rest:
        first = first.unionByName(df)
    return with_defaults(first)
