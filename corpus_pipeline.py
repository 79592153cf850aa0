"""Corpus pipeline: language ID, near-duplicate removal, secret redaction, source mixing, packing.

Each stage takes ``(spark, docs, sf_dir)``.  All but the last return the columns of documents, and
any further columns of docs as they are: a stage carries a whole row as one struct, so no name of
a column can clash with its own.  Null, empty and very long texts, ties, repeated rows and empty
tables have defined results, stated by each stage; an empty table gives an empty result in all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wiretide.llm.common import materialize, row_key, table
from wiretide.llm.language_id import held_out, predict_language, train_prototypes
from wiretide.llm.mixing import mix_sources
from wiretide.llm.ngram_join import ngram_jaccard_groups, prefiltered
from wiretide.llm.packing import document_pieces, pack_pieces
from wiretide.llm.secrets import redact, scan_secrets

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near-duplicates: words of a shingle, and the Jaccard similarity as a fraction.
SHINGLE, NEAR = 5, (80, 100)
MAX_TOKENS, END_ID = 4096, 1


def _whole_rows(docs: DataFrame) -> DataFrame:
    """``(key, doc)``: each row as a struct, told apart by id and text; fully repeated rows share a key."""
    return docs.select(row_key("doc_id", "text").alias("key"), F.struct(*docs.columns).alias("doc"))


def _beside_text(docs: DataFrame) -> DataFrame:
    """``(rest, text)``: each row's text, and its other columns as a struct."""
    return docs.select(F.struct(*[F.col(c) for c in docs.columns if c != "text"]).alias("rest"), "text")


def _row_again(columns: list[str], **new: Column) -> list[Column]:
    """The columns of a row of ``(rest, text)``, some of them replaced."""
    old = {c: F.col("text") if c == "text" else F.col("rest").getField(c) for c in columns}
    return [new.get(c, old[c]).alias(c) for c in columns]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language; a null lang takes the predicted one.

    Null and empty texts and texts without letters have no language.  Long texts are read whole.
    Ties go to the language first by code point; repeated rows are treated alike.  Without any
    labelled row every document is dropped, as none can be identified.
    """
    prototypes = train_prototypes(docs.where(~held_out("doc_id")), "text", "lang", "doc_id")
    out = predict_language(_beside_text(docs), prototypes).where("lang_pred <> 'und'")
    return out.select(*_row_again(docs.columns, lang=F.coalesce("rest.lang", "lang_pred")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each near-duplicate group.

    Rows with equal ids are told apart by their text; of fully repeated rows one stays (any one,
    where only further columns differ).  A null id is smallest.  Texts without words are groups
    of their own.  Texts of any length are compared whole.
    """
    keyed = _whole_rows(docs)
    ids = keyed.select(F.struct(F.col("doc.doc_id").alias("doc_id"), "key").alias("id"), F.col("doc.text").alias("text"))
    groups = ngram_jaccard_groups(ids, "id", "text", SHINGLE, *NEAR)
    stay = materialize(groups.where("id = component_id").groupBy(F.col("id.key").alias("key")).agg(F.count("*").alias("n")), "stay")
    out = keyed.join(stay.where("n = 1"), "key", "left_semi").select("doc.*")
    again = stay.where("n > 1")
    if not again.isEmpty():  # fully repeated rows: the filter on keys leaves only them before texts are shuffled
        with prefiltered(spark):
            once = materialize(keyed.join(again, "key", "left_semi").dropDuplicates(["key"]).select("doc.*"), "once")
        out = out.unionByName(once)
    return out.select(*docs.columns)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by a mark and counts the characters again; no document is dropped.

    Null and empty texts stay as they are, as do texts without secrets; long texts are scanned
    whole; overlapping secrets share one mark; repeated rows are changed alike.
    """
    scanned = scan_secrets(_beside_text(docs))
    hit = F.size("spans") > 0
    cleaned = scanned.select("rest", F.when(hit, redact(F.col("text"), F.col("spans"))).otherwise(F.col("text")).alias("text"), hit.alias("hit"))
    chars = F.when(F.col("hit"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("rest.n_chars"))
    return cleaned.select(*_row_again(docs.columns, n_chars=chars))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix says: not at all, once, or several times.

    Null and empty texts and texts without words have size 0 and are taken by their source's whole
    rate alone; a null source is a source of its own.  Ties of rank go to the smaller key; rows
    equal in id and text are taken alike.  Long texts count by all their words.
    """
    keyed = _whole_rows(docs)
    rows = keyed.select("key", F.col("doc.text").alias("text"), F.col("doc.source").alias("source"))
    mix = mix_sources(rows, "key")
    copies = materialize(mix.where("copies > 0").select(F.col("id").alias("key"), "copies").dropDuplicates(["key"]), "copies")
    out = keyed.join(copies, "key").select("doc", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return out.select("doc.*").select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)`` of all pieces, in sequences of at most MAX_TOKENS.

    Null and empty texts are the end id alone; longer texts are cut; repeated rows and null ids
    are packed like others; further columns are left out.
    """
    import public_tokenizers

    pieces = document_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), END_ID, MAX_TOKENS)
    return pack_pieces(pieces, MAX_TOKENS).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language_id", language_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("secret_scan", secret_stage),
    ("mixing", mixing_stage),
    ("best_fit_packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Tokenizer calls, hash-ranked samples and learned profiles are beyond SQL.
ORACLE_SQL = None
