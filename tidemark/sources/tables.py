"""Sources: vector sequences, head metadata and benchmark examples."""

from __future__ import annotations

import json
import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Long form of a stored tensor: one row per position.
VECTORS = "task string, example_id string, layer int, tensor string, head int, pos int, vec array<float>"


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Parquet in long form, partitioned by task and layer: both prune the scan, head and tensor are pushed down."""
    return spark.read.parquet(path)


def heads_of(vectors: DataFrame, layer: int, head: int, kv_head: int, rope: bool = True, max_examples: int | None = None) -> DataFrame:
    """(example_id, pos, q, k, v) of one query head and its key/value head; examples that lack one are left out."""
    kind = "rope" if rope else "raw"
    rows = vectors.filter((F.col("layer") == layer) & (((F.col("tensor") == f"Q_{kind}") & (F.col("head") == head)) | (F.col("tensor").isin(f"K_{kind}", "V") & (F.col("head") == kv_head))))
    if max_examples is not None:
        rows = rows.join(examples(vectors).orderBy("example_id").limit(max_examples), "example_id", "left_semi")
    pick = lambda t: F.max(F.when(F.col("tensor") == t, F.col("vec").cast("array<double>")))
    return rows.groupBy("example_id", "pos").agg(pick(f"Q_{kind}").alias("q"), pick(f"K_{kind}").alias("k"), pick("V").alias("v")).filter("q is not null and k is not null and v is not null")


def examples(vectors: DataFrame) -> DataFrame:
    return vectors.select("example_id").distinct()


def count_examples(vectors: DataFrame) -> int:
    return vectors.agg(F.countDistinct("example_id")).first()[0]


def check_examples(vectors: DataFrame, need: int) -> None:
    """Raises FileNotFoundError for a task with fewer examples than asked."""
    short = vectors.groupBy("task").agg(F.countDistinct("example_id").alias("n")).filter(F.col("n") < need).limit(5).collect()
    if short:
        raise FileNotFoundError(", ".join(f"{r['task']}: {r['n']} of {need} examples" for r in short))


def from_embeddings(table: DataFrame, dim_scale: bool = True) -> DataFrame:
    """Vector rows (head, pos, q, k, v) of the embeddings table: the label as head, keys and values of varied length."""
    pos = (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).cast("long")
    rows = table.select(F.col("label").cast("long").alias("head"), pos.alias("pos"), F.col("embedding").cast("array<double>").alias("e"))
    kf = 1 + (F.col("pos") % 7) / 10 if dim_scale else F.lit(1.0)
    vf = 1 + ((F.col("pos") * 3) % 11) / 10 if dim_scale else F.lit(1.0)
    return rows.select("head", "pos", F.col("e").alias("q"), F.transform("e", lambda x: x * kf).alias("k"), F.transform(F.reverse("e"), lambda x: x * vf).alias("v"))


def gqa_heads(layers: Sequence[int], n_q: int, n_kv: int, spark: SparkSession) -> DataFrame:
    """All (layer, q_head, kv_head): query heads share key heads in equal runs."""
    at = spark.range(len(layers) * n_q)
    layer = F.get(F.array(*map(F.lit, layers)), F.floor(F.col("id") / n_q).cast("int"))
    q = F.col("id") % n_q
    return at.select(layer.alias("layer"), q.alias("q_head"), F.floor(q / (n_q // n_kv)).cast("long").alias("kv_head"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir. Where that is unset, a temporary one, on one machine only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: it names the folder that all executors share")
    return "file://" + tempfile.mkdtemp(prefix="tidemark-")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is such a file or folder, in any store that Spark reaches."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _json_files(spark: SparkSession, path: str, names: str) -> DataFrame:
    """(file, entries): each JSON file's name without its ending, and its entries as text."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter=names)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.[a-z]+$", 1)
    return files.select(name.alias("file"), F.from_json("value", T.MapType(T.StringType(), T.StringType())).alias("m"))


def _head_values(files: DataFrame, *named: str) -> DataFrame:
    """(named, layer, head, metric, value) of the entries; `metadata` is passed over, older metric names are replaced."""
    rows = files.select(*named, F.explode(F.map_filter("m", lambda k, _: k != "metadata")).alias("l", "heads"))
    kind = T.MapType(T.StringType(), T.MapType(T.StringType(), T.DoubleType()))
    rows = rows.select(*named, "l", F.explode(F.from_json("heads", kind)).alias("h", "stats"))
    number = lambda c: F.split_part(c, F.lit("_"), F.lit(2)).cast("int")
    rows = rows.select(*named, number("l").alias("layer"), number("h").alias("head"), F.explode("stats").alias("metric", "value"))
    return rows.withColumn("metric", current_metric(F.col("metric")))


META = T.StructType([
    T.StructField("example_id", T.StringType()), T.StructField("sequence_length", T.LongType()), T.StructField("sequence_lengths", T.ArrayType(T.LongType())),
    T.StructField("scout_examples", T.ArrayType(T.StringType())),
    T.StructField("selected_heads", T.ArrayType(T.StructType([T.StructField(c, T.IntegerType()) for c in ("layer", "q_head", "kv_head")] + [T.StructField("effective_entropy", T.DoubleType()), T.StructField("percentile", T.IntegerType())]))),
])


def head_statistics_json(spark: SparkSession, path: str, names: str = "*.json") -> DataFrame:
    """(task, layer, head, metric, value) of head-statistics JSON files, one a task."""
    return _head_values(_json_files(spark, path, names).withColumnRenamed("file", "task"), "task")


def _meta(files: DataFrame) -> DataFrame:
    return files.withColumn("meta", F.from_json(F.col("m")["metadata"], META))


def _length():
    """A sequence's length: its own entry, else the first of the list, else 0."""
    return F.coalesce(F.nullif(F.col("meta.sequence_length"), F.lit(0)), F.get("meta.sequence_lengths", F.lit(0)), F.lit(0)).alias("seq_len")


def head_statistics_meta(spark: SparkSession, path: str, names: str = "*.json") -> DataFrame:
    """(task, example_id, seq_len) of the files that say so."""
    rows = _meta(_json_files(spark, path, names)).filter("meta is not null")
    return rows.select(F.col("file").alias("task"), F.coalesce("meta.example_id", F.get("meta.scout_examples", F.lit(0)), F.lit("")).alias("example_id"), _length())


def per_example_statistics(spark: SparkSession, root: str, task: str, names: str = "ex_*.json") -> DataFrame:
    """(task, example, seq_len, layer, head, metric, value) of a task's examples; no rows where it has none."""
    folder = f"{root}/per_example/{task}"
    if not exists(spark, folder):
        return spark.createDataFrame([], "task string, example string, seq_len long, layer int, head int, metric string, value double")
    files = _meta(_json_files(spark, folder, names)).select(F.lit(task).alias("task"), F.col("file").alias("example"), _length(), "m")
    return _head_values(files, "task", "example", "seq_len")


def selected_heads(spark: SparkSession, path: str, names: str = "*.json") -> DataFrame:
    """(task, layer, q_head, kv_head, effective_entropy, percentile, ord, label) of the heads that the files' metadata
    lists; labels go by their order."""
    rows = _meta(_json_files(spark, path, names)).select(F.col("file").alias("task"), F.posexplode("meta.selected_heads").alias("ord", "h"))
    labels = F.array(*[F.lit(f"P{p}") for p in (0, 25, 50, 75, 100)])
    label = F.coalesce(F.get(labels, F.col("ord")), F.concat(F.lit("H"), F.col("ord").cast("string")))
    return rows.select("task", "h.*", "ord", label.alias("label"))


# Older names of metrics, and what they are called now.
METRIC_ALIASES = {
    "entropy_full": "full_entropy",
    "entropy_nonlocal": "effective_entropy",
    "top1pct_mass_full": "full_top1pct_mass",
    "top1pct_mass_nonlocal": "effective_top1pct_mass",
    "top5pct_mass_full": "full_top5pct_mass",
    "top5pct_mass_nonlocal": "effective_top5pct_mass",
}


def current_metric(metric: Column) -> Column:
    """A metric's name as it is called now."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in METRIC_ALIASES.items() for x in pair]), metric), metric)


def benchmark_examples(docs: DataFrame, domain: str | None = None) -> DataFrame:
    """Examples (id, task, question, context, domain, source) of a documents table; the ordinal is counted after the filter."""
    rows = docs if domain is None else docs.filter(F.col("lang") == domain)
    task = F.regexp_replace(F.lower("lang"), "[ -]", "_")
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("doc_id")) - 1
    return rows.select(F.concat(task, F.lit("_"), nth.cast("string")).alias("id"), task.alias("task"), F.concat(F.lit("What is "), F.col("doc_id").cast("string"), F.lit("?")).alias("question"), F.col("text").alias("context"), F.col("lang").alias("domain"), "source", "doc_id")


def ordinals(df: DataFrame, name: str) -> DataFrame:
    """df with the number of each row, from 0, in the order of its partitions: their sizes, one row each, pass the driver."""
    own = df.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = dict(own.groupBy("_part").agg(F.count("*")).collect())
    start, firsts = 0, []
    for part in sorted(sizes):
        firsts += [F.lit(part), F.lit(start).cast("long")]
        start += sizes[part]
    base = F.element_at(F.create_map(*firsts), F.col("_part")) if firsts else F.lit(0).cast("long")
    return own.withColumn(name, base + F.col("_at")).drop("_part", "_at")


def load_task(spark: SparkSession, name: str, source: dict) -> DataFrame:
    """Dispatch over the kinds of benchmark files; an unknown kind is a ValueError."""
    if source.get("benchmark") == "jsonl":
        rows = spark.read.json(source["path"])
        return rows if "id" in rows.columns else ordinals(rows, "id").withColumn("id", F.concat(F.lit(f"{name}_"), F.col("id").cast("string")))
    if source.get("benchmark") == "documents":
        return benchmark_examples(spark.read.parquet(source["path"]), source.get("domain"))
    raise ValueError(f"unknown benchmark: {source.get('benchmark')}")


def longest(examples: DataFrame, size: str, by: Sequence[str], n: int, order: Sequence[str]) -> DataFrame:
    """The n examples of the largest size in each group; ties in the given order."""
    w = Window.partitionBy(*by).orderBy(F.desc(size), *order)
    return examples.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= n).drop("r")


def prompt(context, question):
    """The prompt of an example; no context is an empty one."""
    return F.concat(F.lit("Context: "), F.coalesce(context, F.lit("")), F.lit("\n\nQuestion: "), question, F.lit("\n\nAnswer:"))


def tail(tokens, n: int):
    """The last n tokens."""
    return F.slice(tokens, F.greatest(F.size(tokens) - n, F.lit(0)) + 1, n)


#: Folders that older layouts put between the root and the task.
PHASES = ("selected_heads", "all_heads")


def phase_of(spark: SparkSession, root: str, task: str) -> str | None:
    """The older layout's folder that holds a task; none where the task lies at the root, or nowhere."""
    if exists(spark, f"{root}/{task}"):
        return None
    return next((p for p in PHASES if exists(spark, f"{root}/{p}/{task}")), None)


def task_dir(spark: SparkSession, root: str, task: str, phase: str | None = None) -> str:
    """{root}/{task}, or below the folder of an older layout, given or found."""
    phase = phase or phase_of(spark, root, task)
    return f"{root}/{phase}/{task}" if phase else f"{root}/{task}"


def task_metadata(spark: SparkSession, path: str) -> dict:
    """A task's metadata file; nothing where there is none."""
    return json.loads(spark.read.text(path, wholetext=True).first()["value"]) if exists(spark, path) else {}


def layers(asked: str | Sequence[int], n_layers: int) -> list[int]:
    """The layers asked for; "all" is every one."""
    return list(range(n_layers)) if asked == "all" else [int(x) for x in asked]
