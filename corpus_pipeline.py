"""From raw documents to packed training sequences, in four stages.

Each stage takes all that its predecessor kept; :func:`run` writes a stage's result to the shared
folder and reads it again before the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.llm.common import cut, table
from termweave.llm.minhash import near_duplicates
from termweave.llm.packing import pack
from termweave.llm.quality import score, train
from termweave.llm.queries import tokenizer_file
from termweave.llm.repeats import remove_repeats

QUALITY, SHINGLE, SIMILAR, PASSAGE, WINDOW = 0.3, 5, 80, 50, 2048


def _aliased(docs: DataFrame) -> tuple[DataFrame, dict[str, str], list]:
    """The columns under names no operator uses, these names, and what gives the columns their names back."""
    names = {c: f"__own{i}" for i, c in enumerate(docs.columns)}
    return docs.select([F.col(c).alias(n) for c, n in names.items()]), names, [F.col(n).alias(c) for c, n in names.items()]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold; all their columns, whatever their names.

    Null and empty texts are scored as empty ones; repeated rows are scored each.
    """
    net = train(docs, table(spark, sf_dir, "labels"))
    rows, names, back = _aliased(docs)
    scored = score(rows, net, text_col=names["text"], keep=rows.columns, name="__score")
    return scored.where(F.col("__score") >= QUALITY).select(back)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one of smallest id.

    Rows without an id stay.  Of rows with one id and equal texts one stays (that of the least hash of
    its columns); rows with one id and different texts stay or go together.
    """
    found = near_duplicates(docs, k=SHINGLE, num=SIMILAR, den=100)
    gone = found.where("not kept and doc_id is not null").select(F.col("doc_id").alias("__gone")).distinct()
    rows, names, back = _aliased(docs)
    id_, text = F.col(names["doc_id"]), F.col(names["text"])
    stay = rows.where(id_.isNotNull()).join(gone, id_ == F.col("__gone"), "left_anti")
    whole = F.struct([F.col(n) for n in rows.columns])
    stay = stay.groupBy(id_, F.sha2(text, 256)).agg(F.min_by(whole, F.xxhash64(whole)).alias("row")).select("row.*")
    return stay.unionAll(rows.where(id_.isNull())).select(back)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document of smaller id has too; n_chars, if there, follows the text.

    A null text becomes the empty one.
    """
    rows, names, back = _aliased(docs)
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    found = remove_repeats(rows, length=PASSAGE, id_col=names["doc_id"], text_col=names["text"], keep=[n for c, n in names.items() if c not in new], as_text=True)
    return found.select([new[c].alias(c) if c in new else b for c, b in zip(docs.columns, back)])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents placed in sequences; a null text is the end id alone."""
    return pack(docs, tokenizer_file("byte_bpe_50k.json"), window=WINDOW)


STAGES = [("quality", keep_good), ("near_dedup", drop_near_copies), ("repeats", cut_repeats), ("packing", pack_sequences)]

#: The first stage scores with a trained network and the last tokenises: SQL can't say them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
