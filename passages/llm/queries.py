"""The registered queries of the training-data operators, over whole tables, with SQL where it can say the same."""

from __future__ import annotations

from passages.llm import codes, decontamination, embeddings, language, licenses, mixing, near_duplicates, packing, pii, secrets, spelling, suffix_dedup, warc
from passages.llm.common import table

QUERIES = {
    "op1_language_id": lambda spark, d: language.report(table(spark, d, "documents")),
    "op2_warc": lambda spark, d: warc.report(table(spark, d, "pages")),
    "op3_suffix_dedup": lambda spark, d: suffix_dedup.report(table(spark, d, "documents")),
    "op4_license_scan": lambda spark, d: licenses.licence_report(table(spark, d, "documents")),
    "op5_packing": lambda spark, d: packing.report(table(spark, d, "documents")),
    "op6_decontamination": lambda spark, d: decontamination.report(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op7_pii": lambda spark, d: pii.pii_report(table(spark, d, "documents")),
    "op8_secret_scan": lambda spark, d: secrets.secret_report(table(spark, d, "documents")),
    "op9_minhash": lambda spark, d: near_duplicates.report(table(spark, d, "documents")),
    "op10_embedding_dedup": lambda spark, d: embeddings.report(table(spark, d, "embeddings")),
    "op11_spelling_variants": lambda spark, d: spelling.report(table(spark, d, "documents")),
    "op12_vector_codes": lambda spark, d: codes.report(table(spark, d, "embeddings")),
    "op13_source_mixing": lambda spark, d: mixing.report(table(spark, d, "documents")),
    "packing_1024": lambda spark, d: packing.report(table(spark, d, "documents"), packing.Settings(capacity=1024)),
    "pages_language": lambda spark, d: language.page_report(table(spark, d, "pages")),
}

ORACLES = {
    "op2_warc": warc.REPORT_SQL,
    "op6_decontamination": decontamination.REPORT_SQL,
    "op4_license_scan": licenses.report_sql(),
    "op8_secret_scan": secrets.report_sql(),
    "op9_minhash": near_duplicates.REPORT_SQL,
    "op10_embedding_dedup": embeddings.REPORT_SQL,
    "op11_spelling_variants": spelling.REPORT_SQL,
    "op12_vector_codes": codes.report_sql(),
    "op13_source_mixing": mixing.REPORT_SQL,
}
