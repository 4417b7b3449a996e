"""The registered queries of the corpus operators: thin digests of each operator's output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, htmltext, katz, langid, minhash, mixing, neardup, quality, runs, shards, simhash, tokenfile, toxicity
from .common import materialise, shared_dir, spread, table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    out = simhash.near_duplicates(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Arrivals that op2_shards appends, one after the other.
ARRIVALS = 4


def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents appended in arrivals, compacted after each, and read back from the last version."""
    docs = table(spark, sf_dir, "documents")
    store = shards.ShardStore(spark, shared_dir(spark, "shards"))
    for k in range(ARRIVALS):
        store.append(docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS)) == k))
        store.compact()
        store.vacuum(keep=2)  # a reader of the version before stays whole
    return store.read().select("doc_id", "lang", "source", "n_chars", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from the folds that are not held out."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    out = langid.identify(docs.select("doc_id", "text"), docs.filter(~langid.held_out()))
    return out.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "accepted")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    out = htmltext.extract(spread(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    return out.select("page_id", "url", F.col("main_text").alias("text"), "n_chars")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents replicated to flattened source shares and shuffled globally."""
    out = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "source", "text", "n_copies", "copy_no", "place")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded by the streaming transducer and decoded again, as digests."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", bpe.round_trip(F.col("text"), keep_ids=False).alias("d"))
    return docs.select("doc_id", "d.n_tokens", "d.ids_sha256", "d.decoded_sha256")


def op7_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and Katz scores of every text, learned from the folds that are not held out."""
    return katz.score_documents(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surface rules and the verdict of the likelihood ratio, one row per document."""
    out = quality.quality_rules(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's ids, written as range-coded files in doc_id order and read back."""
    path = shared_dir(spark, "tokens")
    tokenfile.write(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return tokenfile.read(spark, path)


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, their likeness, and the class of near copies by joined bands and exact Jaccard similarity."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return minhash.edit_report(docs, materialise(neardup.classes(docs, neardup.PADDED), "classes"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document's words, a tenth of the documents made periodic from some word on."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = runs.with_period(F.col("doc_id"), F.col("text"))
    found = docs.select("doc_id", runs.periodic_runs(text, keep_text=False).alias("r"))
    best = F.col("r.strongest")
    exponent = F.floor(1000 * best["length"] / best["period"])
    return found.select("doc_id", F.size("r.runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"), exponent.alias("exponent_milli"), "r.runs_sha256", "r.collapsed_sha256")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labelled ones that are not held out."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    out = toxicity.score_documents(docs, docs.filter(~toxicity.held_out()), labels.filter(~toxicity.held_out()))
    return out.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


QUERIES = {f.__name__: f for f in (op1_simhash, op2_shards, op3_language_id, op4_html_text, op5_mixing, op6_bpe, op7_katz, op8_quality_rules, op9_token_files, op10_minhash, op11_periodic_runs, op12_toxicity)}
ORACLE_SQL: dict[str, str] = {
    "op2_shards": "SELECT doc_id, lang, source, n_chars, md5(coalesce(text, '')) AS text_md5 FROM documents",
    "op5_mixing": mixing.MIX_SQL,
}
