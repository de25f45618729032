"""Queries of this subpackage, one for each operator over its whole table."""

from terrafold.llm import bpe, decontam, linededup, lm, minhash, quality, secrets, sharding, suffixes, urlfilter
from terrafold.llm.base import table


def op1_line_dedup(spark, sf_dir):
    return linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_decontamination(spark, sf_dir):
    return decontam.decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op3_secrets(spark, sf_dir):
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op4_bpe(spark, sf_dir):
    return bpe.encode(table(spark, sf_dir, "documents"))


def op5_quality(spark, sf_dir):
    return quality.keep_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    hosts = spark.createDataFrame([("http://casino-win.example.com/",), ("free-bets.example.com",)], "url string")
    return urlfilter.filter_urls(pages, pages.filter("page_id % 7 = 0").select("url").unionAll(hosts))


def op7_lm_score(spark, sf_dir):
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op8_suffix_array(spark, sf_dir):
    return suffixes.repeated_passages(table(spark, sf_dir, "documents"))


def op9_minhash(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_sharding(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_decontamination, op3_secrets, op4_bpe, op5_quality, op6_url_filter, op7_lm_score, op8_suffix_array, op9_minhash, op10_sharding)}

ORACLES = {"op1_line_dedup": linededup.ORACLE, "op2_decontamination": decontam.ORACLE, "op6_url_filter": urlfilter.ORACLE, "op8_suffix_array": suffixes.ORACLE, "op10_sharding": sharding.ORACLE}
