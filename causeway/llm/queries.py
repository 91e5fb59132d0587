"""The queries of this subpackage, by name, with SQL for those that SQL can express."""

from __future__ import annotations

from . import ann, dialogues, licenses, linededup, neardup, packing, pii, quality, secrets, sentencepiece, tokenfiles, vectorcodes, warc
from .common import table


def on(name, query):
    return lambda spark, sf_dir: query(table(spark, sf_dir, name))


QUERIES = {
    "op8_ngram_jaccard_join": on("documents", neardup.query),
    "op7_line_dedup": on("documents", linededup.query),
    "op10_sentencepiece_transducer": on("documents", sentencepiece.query),
    "op2_license_rules": on("documents", licenses.query),
    "op1_warc_archive": on("pages", warc.query),
    "op3_harmonic_packing": on("documents", packing.query),
    "op4_pii": on("documents", pii.query),
    "op9_additive_quantisation": on("embeddings", ann.query),
    "op5_quality_rules": quality.query,
    "op6_secret_ledger": on("documents", secrets.query),
    "op11_context_range_coder": on("documents", tokenfiles.query),
    "op12_segment_mean_bounds": on("embeddings", vectorcodes.query),
    "op13_conversation_repair": on("conversations", dialogues.query),
}
ORACLES: dict[str, str] = {"op1_warc_archive": warc.oracle(), "op2_license_rules": licenses.oracle(), "op6_secret_ledger": secrets.oracle(), "op12_segment_mean_bounds": vectorcodes.oracle()}
