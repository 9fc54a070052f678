"""The registered queries ``opN_<name>``: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from meshframes.llm import ann, html_text, infilling, jaccard, lang_id, mixing, packing, prefix_trie, quality, token_frames, transcripts, url_filter, warc
from meshframes.llm.common import stored, table
from meshframes.llm.registry import ORACLE, QUERIES, query  # noqa: F401
from meshframes.session import scratch_path


@query("op1_quality_rules")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    forest = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, forest).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")


@query("op2_retrieval_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query("op3_source_mixing", mixing.SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    sizes = stored(mixing.source_sizes(docs), "source-sizes")
    return mixing.mix(docs, mixing.capped_weights(sizes), sizes).select("doc_id", "source", "block", "slot", "mixed")


@query("op4_url_filter", url_filter.SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    hosts = pages.select(url_filter.host_and_path(F.col("url"))[0].alias("host"))
    listed = stored(url_filter.named_keys(url_filter.universe_of(hosts), url_filter.NAMES), "listed-keys")
    return url_filter.judge(pages, listed).select("page_id", "host", "path", "rule", "verdict")


@query("op5_jaccard_join")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


@query("op6_nearest_vectors")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


@query("op7_token_frames")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_frames.read(spark, token_frames.write(docs, scratch_path(spark, "token-frames")))


@query("op8_html_text")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract(pages).select("page_id", "url", "text", "n_chars")


@query("op9_chat_turns")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    model = transcripts.fit(messages)
    marked = messages.withColumn("held_out", transcripts.held_out())
    return transcripts.parse(marked, model).select("conv_id", "turn", "part", "held_out", "role", "role_pred", "rendered")


@query("op10_language_id")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = lang_id.fit(docs)
    marked = docs.select("doc_id", lang_id.held_out().alias("held_out"), "text")
    return lang_id.detect(marked, model).select("doc_id", "held_out", "lang_pred", "score", "coverage")


@query("op11_capture_index", warc.SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.read_back(spark, pages.select("url", "page_id"), warc.archive(pages, scratch_path(spark, "captures")))


@query("op12_prefix_trie", prefix_trie.SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = stored(prefix_trie.ordered(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")), "ordered-turns")
    return prefix_trie.trie(*prefix_trie.borrowed(turns)).drop("what")


@query("op13_fill_in_middle", infilling.SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infilling.digest(infilling.transform(table(spark, sf_dir, "documents")))
