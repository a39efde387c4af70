"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from rowlens.llm import exact_dedup, html_text, jaccard_join, mixing, packing, quality, repeats, secret_scan, syncmers, wavelet
from rowlens.llm.common import table


def op1_exact_dedup(spark, sf_dir):
    return exact_dedup.groups(table(spark, sf_dir, "documents"))


def tokenizer(name):
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op5_wavelet_output(spark, sf_dir):
    return wavelet.round_trip(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), keeps_spaces=False)


def op3_repeated_passages(spark, sf_dir):
    return repeats.remove(table(spark, sf_dir, "documents"))


def op4_source_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_syncmer_fingerprints(spark, sf_dir):
    return syncmers.neighbours(table(spark, sf_dir, "documents"))


def op7_ngram_jaccard_join(spark, sf_dir):
    return jaccard_join.groups(table(spark, sf_dir, "documents"))


def op9_recursive_secret_scan(spark, sf_dir):
    return secret_scan.find(table(spark, sf_dir, "documents"))


def op10_html_extraction(spark, sf_dir):
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op8_quality_classifier(spark, sf_dir):
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_best_fit_packing": op2_best_fit_packing,
        "op3_repeated_passages": op3_repeated_passages,
        "op4_source_mixing": op4_source_mixing,
        "op5_wavelet_output": op5_wavelet_output,
        "op6_syncmer_fingerprints": op6_syncmer_fingerprints,
        "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
        "op8_quality_classifier": op8_quality_classifier,
        "op9_recursive_secret_scan": op9_recursive_secret_scan,
        "op10_html_extraction": op10_html_extraction,
        "pipeline": pipeline,
    }


def oracle_sql():
    return {"op1_exact_dedup": exact_dedup.ORACLE, "op4_source_mixing": mixing.ORACLE}
