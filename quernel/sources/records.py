"""Record files in and out: JSON lines, CSV, text, trees of checkpoints, and the benchmark they are held against."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernel.operators.order import keep_first, numbered
from quernel.store import free_name

PROBLEM = T.StructType().add("task_id", "string").add("prompt", "string").add("canonical_solution", "string").add("test", "string").add("detail_description", "string")
RESULT = T.StructType().add("task_id", "string").add("completion", "string").add("passed", "boolean")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = False) -> DataFrame:
    """One object a line, ``.gz`` by name. Blank lines are skipped; so are lines that aren't objects of the
    schema, unless ``strict``: then they fail the job."""
    return spark.read.schema(schema).json(path, mode="FAILFAST" if strict else "DROPMALFORMED").na.drop("all")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header; fields may hold line ends and doubled quotes."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.csv(path, header=True, multiLine=True, escape='"')


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """A column ``text``, a row for each line, without line ends."""
    return spark.read.text(path).withColumnRenamed("value", "text")


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """By the file's name: csv, then jsonl, then txt, else Parquet."""
    name = path.rstrip("/").rpartition("/")[2]
    if "csv" in name:
        return read_csv(spark, path, schema)
    if "jsonl" in name:
        return read_jsonl(spark, path, schema) if schema is not None else spark.read.json(path)
    return read_text(spark, path) if "txt" in name else spark.read.parquet(path)


def read_problems(spark: SparkSession, path: str, schema: T.StructType | str = PROBLEM) -> DataFrame:
    """Problems by task_id; of several with one id, the last in file order."""
    rows = spark.read.schema(schema).json(path)
    at = free_name(rows, "its_at")
    placed = rows.withColumn(at, F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id()))
    return keep_first(placed, ["task_id"], [at], last=True).drop(at)


def read_benchmark(problems: dict[str, DataFrame], descriptions: dict[str, DataFrame] | None = None) -> DataFrame:
    """Problem sets under one another, columns by name with nulls where a set has none, and a column ``benchmark``.

    ``descriptions`` (task_id, detail_description) are joined to the set of the same name.
    """
    parts = []
    for name, df in problems.items():
        if descriptions and name in descriptions:
            told = descriptions[name].select("task_id", "detail_description")
            df = df.drop("detail_description").join(told, "task_id", "left")
        parts.append(df.withColumn("benchmark", F.lit(name)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


#: Fixed names of a benchmark folder's files: problems, and descriptions, by set.
PROBLEM_FILES = {"machine": "verilogeval-machine.jsonl.gz", "human": "verilogeval-manual.jsonl.gz", "rtllm": "rtllm.jsonl"}
DESCRIPTION_FILES = {"machine": "VerilogDescription_Machine.jsonl", "human": "VerilogDescription_Human.jsonl", "rtllm": "rtllm.jsonl"}


def read_benchmark_folder(spark: SparkSession, path: str) -> DataFrame:
    """The three problem sets of a folder, each with its descriptions, as read_benchmark() puts them; of several problems,
    or descriptions, of one id the last counts."""
    problems = {name: read_problems(spark, f"{path}/{file}") for name, file in PROBLEM_FILES.items()}
    told = {name: read_problems(spark, f"{path}/{file}").select("task_id", "detail_description") for name, file in DESCRIPTION_FILES.items()}
    return read_benchmark(problems, told)


def read_checkpoints(spark: SparkSession, root: str, benchmarks: dict[str, str] | None = None) -> DataFrame:
    """Results under ``root``/<exp>/<checkpoint with step=N>/<benchmark>_0_1.jsonl_results.jsonl, with exp, step
    and benchmark from the path. ``benchmarks`` names the files' beginnings; files that are missing are no error."""
    path = F.col("_metadata.file_path")
    df = spark.read.schema(RESULT).json(f"{root}/*/*/*_0_1.jsonl_results.jsonl")
    name = F.regexp_extract(path, r"([^/]+)_0_1\.jsonl_results\.jsonl$", 1)
    if benchmarks:
        name = F.coalesce(*[F.when(name == file, F.lit(own)) for own, file in benchmarks.items()])
    out = df.select(*df.columns, F.regexp_extract(path, r"([^/]+)/[^/]+/[^/]+$", 1).alias("exp"), step_of(path).alias("step"), name.alias("benchmark"))
    return out.where("benchmark is not null")


def step_of(path: Column) -> Column:
    """The number after ``step=`` in a path, null if there is none."""
    return F.nullif(F.regexp_extract(path, r"step=(\d+)", 1), F.lit("")).try_cast("int")


def write_jsonl(df: DataFrame, path: str, append: bool = False, gzip: bool = False) -> None:
    """A folder of JSON lines; nulls are written, as null."""
    writer = df.write.mode("append" if append else "overwrite").option("ignoreNullFields", "false")
    writer.json(path, compression="gzip" if gzip else "none")


def write_shards(df: DataFrame, path: str, shards: int, order: list) -> None:
    """``path``/shard=i for each of ``shards`` equal runs of rows in order; no remainder is left out."""
    at = free_name(df, "its_index")
    placed = numbered(df.drop("shard"), [], order, at)
    n = placed.count()
    size = -(-n // shards) or 1
    out = placed.withColumn("shard", F.floor(F.col(at) / size).cast("int")).drop(at)
    out.write.mode("overwrite").option("ignoreNullFields", "false").partitionBy("shard").json(path)


def output_name(engine: str, dataset: str, n: int, suffix: str = "", folder: str = "out") -> str:
    """out/engine_dataset_n[_suffix], the dataset without its last extension."""
    return f"{folder}/{engine}_{dataset.rpartition('.')[0] or dataset}_{n}" + (f"_{suffix}" if suffix else "")


def snapshot(df: DataFrame, folder: str, round_: int, stage: str, reuse: bool = False) -> DataFrame:
    """Write a stage's rows under ``folder``/<round>/<stage> and go on from what was written; with ``reuse``, from
    what a run before this one has written there, if it was ended."""
    path, spark = f"{folder}/{round_}/{stage}", df.sparkSession
    if reuse:
        mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
            return spark.read.schema(df.schema).parquet(path)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
