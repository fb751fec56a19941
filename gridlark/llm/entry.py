"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from gridlark.llm import brown_lm, decontaminate, mixing, mpeg_audio, ngram_join, packing, quality_gam, runs, sketches, toxicity, warc, whitening, wordpiece
from gridlark.llm.tables import table


def op1_quality_gam(spark, sf_dir):
    return quality_gam.op1(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_toxicity(spark, sf_dir):
    return toxicity.op10(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs, labels=table(spark, sf_dir, "labels")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op5_fingerprints(spark, sf_dir):
    return sketches.query(spark, sf_dir)


def op6_ngram_jaccard(spark, sf_dir):
    return ngram_join.components(table(spark, sf_dir, "documents"))


def op8_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_mpeg_audio(spark, sf_dir):
    return mpeg_audio.op3(table(spark, sf_dir, "documents"))


def op4_token_counts(spark, sf_dir):
    return wordpiece.token_counts(table(spark, sf_dir, "documents"))


def op7_warc(spark, sf_dir):
    return warc.op7(table(spark, sf_dir, "pages"))


def op9_brown_lm(spark, sf_dir):
    return brown_lm.op9(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark, sf_dir):
    return runs.op11(table(spark, sf_dir, "documents"))


def op12_decontamination(spark, sf_dir):
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_whitening(spark, sf_dir):
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_quality_gam": op1_quality_gam,
    "op2_mixing": op2_mixing,
    "op3_mpeg_audio": op3_mpeg_audio,
    "op4_token_counts": op4_token_counts,
    "op5_fingerprints": op5_fingerprints,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_warc": op7_warc,
    "op8_packing": op8_packing,
    "op9_brown_lm": op9_brown_lm,
    "op10_toxicity": op10_toxicity,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_decontamination": op12_decontamination,
    "op13_whitening": op13_whitening,
}
ORACLES = {"op6_ngram_jaccard": ngram_join.SQL, "op7_warc": warc.SQL, "op12_decontamination": decontaminate.SQL}
