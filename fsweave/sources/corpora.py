"""Text, vocabularies and models as inputs, and machines as outputs."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fsweave.plans.machine import ARC_SCHEMA, STATE_SCHEMA, Machine


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ascii_words(docs: DataFrame) -> DataFrame:
    """(doc_id, word) for every run of ASCII letters."""
    return docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), 1)).alias("word"))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Files' lines as sequences to train on."""
    return spark.read.text(path).select(F.col("value").alias("text"))


def file_bytes(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as arrays of two-digit hexadecimal bytes, for byte n-grams."""
    hexed = F.hex("content")
    return spark.read.format("binaryFile").load(path).select("path", F.filter(F.split(hexed, "(?<=\\G..)"), lambda b: b != "").alias("symbols"))


def tiktoken_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(token, spelling) of a rank file; spellings in hexadecimal, two digits for each byte."""
    parts = F.split("value", " ")
    return spark.read.text(path).where(F.length("value") > 0).select(parts[1].alias("token"), F.hex(F.unbase64(parts[0])).alias("spelling"))


def json_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(token, spelling) of a tokenizer file's ``model.vocab``, as the file spells them."""
    doc = spark.read.option("wholetext", True).text(path)
    vocab = F.from_json(F.get_json_object("value", "$.model.vocab"), "map<string,int>")
    return doc.select(F.explode(vocab).alias("spelling", "id")).select(F.col("id").cast("string").alias("token"), "spelling")


def batch_scorer(df: DataFrame, column: str, load: Callable[[], Callable[[list[str]], Iterable[float]]]) -> DataFrame:
    """``df`` with ``score`` from any model that scores lists of texts; ``load`` runs once in each worker."""
    import pyarrow as pa
    from pyspark.sql.types import DoubleType, StructType

    def run(batches):
        model = load()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(column)).to_pylist()
            yield batch.append_column("score", pa.array(list(model(texts)), pa.float64()))

    return df.mapInArrow(run, StructType([*df.schema.fields]).add("score", DoubleType()))


def save_machine(m: Machine, spark: SparkSession, path: str, kind: str = "parquet") -> None:
    """Write the arc and state tables (parquet, json or csv)."""
    arcs, states = m.to_df(spark)
    for df, name in ((arcs, "arcs"), (states, "states")):
        df.coalesce(1).write.format(kind).option("header", True).mode("overwrite").save(f"{path}/{name}")


def load_machine(spark: SparkSession, path: str, kind: str = "parquet") -> Machine:
    read = lambda name, schema: spark.read.format(kind).schema(schema).option("header", True).option("nullValue", "\0").option("emptyValue", "").load(f"{path}/{name}")
    return Machine.from_df(read("arcs", ARC_SCHEMA).na.fill(""), read("states", STATE_SCHEMA))
