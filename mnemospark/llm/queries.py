"""Registered queries of the operators; each reads whole tables with production parameters."""

from __future__ import annotations

from mnemospark.llm import jaccard_join as jj
from mnemospark.llm import context_trees, decontamination, filter_audit, hard_negatives, lang_id, licence_scan, pii, piece_sampling
from mnemospark.llm import spot_signatures, suffix_dedup, token_files
from mnemospark.llm import toxicity as tox
from mnemospark.llm.common import new_path, table, tokenizer_file


def op10_ngram_jaccard_join(spark, sf_dir):
    return jj.jaccard_components(table(spark, sf_dir, "documents"), n=4, percent=85)


def op1_suffix_array_dedup(spark, sf_dir):
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op2_language_id(spark, sf_dir):
    return lang_id.languages(table(spark, sf_dir, "documents"))


def op3_simhash_decontamination(spark, sf_dir):
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_token_files(spark, sf_dir):
    path = new_path(spark)
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_file("word_bpe_49k.json"))
    return token_files.read_tokens(spark, path, digests=True)


def op5_licence_scan(spark, sf_dir):
    return licence_scan.scan(table(spark, sf_dir, "documents"))


def op6_sentencepiece_sampling(spark, sf_dir):
    return piece_sampling.report(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op7_spot_signatures(spark, sf_dir):
    return spot_signatures.edited(table(spark, sf_dir, "documents"))


def op8_pii(spark, sf_dir):
    return pii.report(table(spark, sf_dir, "documents"))


def op9_subword_toxicity(spark, sf_dir):
    return tox.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_hard_negatives(spark, sf_dir):
    return hard_negatives.mined(table(spark, sf_dir, "embeddings"))


def op12_context_tree_scores(spark, sf_dir):
    return context_trees.document_scores(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark, sf_dir):
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


REGISTRY = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_language_id": op2_language_id,
    "op3_simhash_decontamination": op3_simhash_decontamination,
    "op4_token_files": op4_token_files,
    "op5_licence_scan": op5_licence_scan,
    "op6_sentencepiece_sampling": op6_sentencepiece_sampling,
    "op7_spot_signatures": op7_spot_signatures,
    "op8_pii": op8_pii,
    "op9_subword_toxicity": op9_subword_toxicity,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_context_tree_scores": op12_context_tree_scores,
    "op13_filter_audit": op13_filter_audit,
}
SQL = {
    "op11_hard_negatives": hard_negatives.SQL,
    "op13_filter_audit": filter_audit.SQL,
}
