"""From raw documents to training tokens: five stages, each on all that the one before kept.

Every stage takes documents with columns doc_id, text, lang, source, n_chars and any others; all but the last return
just these columns. Empty tables give empty tables; ids may be null or repeated; texts of any length are taken whole;
columns may have any names, those of the operators' own results included.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType, VariantType

from profilion.llm import op03_bpe, op04_mixing, op05_suffix, op08_jaccard, op09_toxicity
from profilion.llm.cluster import written
from profilion.session import removed, shared_folder

#: SQL cannot express a trained classifier, nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def unused(docs: DataFrame, name: str) -> str:
    """A column name that docs have not got."""
    while name in docs.columns:
        name += "_"
    return name


def named(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold.

    Null and empty texts score as the model's bias alone; rows of one id are scored each on their own text; without any
    label all score 0.5 and go."""
    labels, out = spark.read.parquet(f"{sf_dir}/labels.parquet"), unused(docs, "score")
    scored = op09_toxicity.toxicity(docs, labels, out=out)
    return scored.where(F.col(out) < op09_toxicity.THRESHOLD).select(*named(docs))


def hashable(docs: DataFrame) -> list:
    """All columns, and whether they are null; those that hold maps or variants, which have no hash, as JSON."""

    def plain(kind) -> bool:
        parts = [f.dataType for f in kind.fields] if isinstance(kind, StructType) else [kind.elementType] if isinstance(kind, ArrayType) else []
        return not isinstance(kind, MapType | VariantType) and all(map(plain, parts))

    columns = [F.col(f"`{f.name}`") if plain(f.dataType) else F.to_json(F.struct(F.col(f"`{f.name}`"))) for f in docs.schema.fields]
    return [*columns, *(F.col(f"`{c}`").isNull() for c in docs.columns)]


def row_keys(docs: DataFrame, key: str) -> DataFrame:
    """Rows with a 64-bit key that equal rows share and different rows do not: where a second hash tells rows of one key apart, they
    get keys made of both, until no key is shared."""
    check = unused(docs, "row_check")
    keyed = docs.withColumn(key, F.xxhash64(*hashable(docs))).withColumn(check, F.xxhash64(F.lit("again"), *hashable(docs)))
    while not (shared := keyed.groupBy(key).agg(F.min(check).alias("lo"), F.max(check).alias("hi")).where("lo <> hi").select(key, F.lit(True).alias("shared_key"))).isEmpty():
        keyed = keyed.join(written(shared), key, "left").withColumn(key, F.when(F.col("shared_key"), F.xxhash64(key, check)).otherwise(F.col(key))).drop("shared_key")
    return keyed.drop(check)


def near_duplicates(_spark: SparkSession, docs: DataFrame, _sf_dir: str) -> DataFrame:
    """Of each group of near copies, one row: that of the smallest id (null comes last), then of the least row hash.

    Rows are told apart by all their columns (``row_keys``), so ids may be null or repeated; of rows that are equal in all
    columns one stays. Rows without shingles have nothing to compare, and all stay."""
    key, alone, equal = unused(docs, "row_key"), unused(docs, "alone"), unused(docs, "equal")
    keyed = row_keys(docs, key)
    found = op08_jaccard.classes(keyed.select(F.col(key).alias("doc_id"), "text")).withColumnRenamed("doc_id", "row_key").distinct()
    ids = keyed.select(F.col(key).alias("row_key"), "doc_id").distinct()
    first = found.where("n_shingles > 0").join(ids, "row_key").groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key")).alias("first"))
    kept = first.select(F.col("first.row_key").alias(key), F.lit(False).alias(alone)).unionByName(found.where("n_shingles = 0").select(F.col("row_key").alias(key), F.lit(True).alias(alone)))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(key))
    return keyed.join(kept, key).withColumn(equal, rank).where(F.col(alone) | (F.col(equal) == 1)).select(*named(docs))


def repeated_passages(_spark: SparkSession, docs: DataFrame, _sf_dir: str) -> DataFrame:
    """Documents without the passages that occur elsewhere as well; those that lose all their text go.

    Texts that came in null or empty have lost nothing and stay as they were; n_chars counts what is left."""
    size = unused(docs, "bytes_before")
    left = op05_suffix.remove_repeats(docs.withColumn(size, F.octet_length("text")))
    bare = F.coalesce(size, F.lit(0)) == 0
    left = left.where(bare | (F.col("text") != "")).withColumn("n_chars", F.when(bare, F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return left.withColumn("text", F.when(F.col(size).isNotNull(), F.col("text"))).select(*named(docs))


def mixing(_spark: SparkSession, docs: DataFrame, _sf_dir: str) -> DataFrame:
    """Documents in training order, as often as the mix plays them.

    Documents stay whole: a last play in part counts where it takes at least half of the document. Those without words
    are kept once, at the end."""
    carried = docs.select(F.struct(*named(docs)).alias("whole"), "doc_id", "source", op04_mixing.words().alias("size"))
    return op04_mixing.training_order(op04_mixing.mix(carried)).select("whole.*")


def encoding(_spark: SparkSession, docs: DataFrame, _sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit) of every text, with all columns but the text.

    Where docs are read from files, shard and place say where the document lay: sorted by both, documents are in the
    training order that mixing wrote; else they are null."""
    others = [c for c in docs.columns if c not in ("text", "ids", "n_tokens", "shard", "place")]
    try:
        docs = docs.select(*named(docs), F.col("_metadata.file_name").alias(unused(docs, "shard")), F.col("_metadata.row_index").alias(unused(docs, "place")))
        shard, place = docs.columns[-2:]
    except AnalysisException:
        shard, place = F.lit(None).cast("string"), F.lit(None).cast("long")
    encoded = op03_bpe.encode(docs, op03_bpe.tokenizer_path())
    column = lambda c: F.col(c) if isinstance(c, str) else c
    return encoded.select(*[f"`{c}`" for c in others], column(shard).alias("shard"), column(place).alias("place"), (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [("toxicity", toxicity), ("n-gram Jaccard join", near_duplicates), ("suffix-array dedup", repeated_passages), ("mixing sources", mixing), ("BPE encoding", encoding)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; what each kept is written to the shared folder, and taken away once the next one has
    been written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            folder = f"{shared_folder(spark)}/{uuid.uuid4()}"
            docs.write.parquet(folder)
            docs = spark.read.parquet(folder)
            if before:
                removed(spark, before)
            before = folder
    return docs
