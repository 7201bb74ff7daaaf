"""From raw documents to packed training sequences, in five stages; each is written and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiweave.llm import mixing, packing, pii, quality, simhash
from lexiweave.llm.common import remove_folder, shared_folder


def _unused(docs: DataFrame, name: str) -> str:
    """The name, or a longer one that no column of docs has."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, each row as it is.

    Null and empty texts are scored as one empty passage. Repeated rows, rows of one id and rows of a null id are scored each by its own
    text and stay or go alike; a score at the threshold is accepted. Columns of the user's stay, also ones named score or predicted.
    Without usable labels nothing is learned, all score 0.5 and all stay. An empty table stays empty.
    """
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    mark = _unused(docs, "lw_predicted")
    return quality.score(docs, model, score_col=_unused(docs, "lw_score"), predicted_col=mark).where(F.col(mark) == 1).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): the row with the smallest doc_id.

    Null and empty texts are one text, as are texts with one set of shingles; a text of fewer words than five is one shingle. Of repeated
    rows one stays, a null doc_id counts as the smallest, ties of the id go by the hash of the text. Columns pass through, whatever their names; an empty table stays empty.
    """
    return simhash.first_of_groups(docs, width=5, similarity=0.8)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets give way to surrogates; n_chars, where docs has it, follows a changed text.

    Null texts stay null, empty ones empty; both keep their n_chars. Repeated rows change alike, and equal originals everywhere. Columns of the user's
    stay, also ones named n_entities or entity_kinds. An empty table stays empty.
    """
    count, kinds = _unused(docs, "lw_entities"), _unused(docs, "lw_kinds")
    done = pii.pseudonymize(docs, pii.session_key(spark), count_col=count, kinds_col=kinds)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col(count) > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return done.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same rows laid out in the mixed order: by the number of a written file, then by the row in it.

    A null source is a source of its own. Texts are not looked at. Repeated rows and null ids each have a place; rows that tie
    in their source stand in any order. Columns pass through, whatever their names; an empty table stays empty.
    """
    return mixing.in_mixed_order(docs, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences of at most 2048 tokens.

    Spark deals files to its tasks by size. mix_part and mix_row say where the last stage put a piece's document, so
    sequences in the order of their smallest (mix_part, mix_row) follow the mixed order; both are null for rows that
    come from no file. Columns of docs but doc_id and text are ignored, also ones named mix_part or mix_row. Null and empty texts are one
    piece of the end token; repeated rows are packed each; long texts are cut into pieces. An empty table gives no pieces.
    """
    place = [F.lit(None).cast("int"), F.lit(None).cast("long")]
    if docs.inputFiles():
        place = [F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).try_cast("int"), F.col("_metadata.row_index")]
    docs = docs.select("doc_id", "text", place[0].alias("mix_part"), place[1].alias("mix_row"))
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), keep=("mix_part", "mix_row"))


STAGES = [
    ("quality", keep_good),
    ("near_dedup", drop_near_copies),
    ("surrogates", replace_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: A trained classifier, hash bits and a tokenizer are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder, read by the next and then removed."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    folder = shared_folder(spark)
    for n, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{n}_{name}")
        docs = spark.read.parquet(path)
        if last is not None:
            remove_folder(spark, last)
        last = path
    return docs
