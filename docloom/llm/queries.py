"""The opN queries and the SQL of those that SQL can express."""

from docloom.llm import bpe, decontaminate, html_text, language, lm, mpegts, ngram_join, quality, suffix_dedup, url_filter

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_mpegts": mpegts.op2_mpegts,
    "op3_html_text": html_text.op3_html_text,
    "op7_quality": quality.op7_quality,
    "op8_lm": lm.op8_lm,
    "op9_language": language.op9_language,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_jaccard_join": ngram_join.op5_jaccard_join,
    "op6_url_filter": url_filter.op6_url_filter,
    "op10_decontaminate": decontaminate.op10_decontaminate,
}
ORACLES = {
    "op6_url_filter": url_filter.ORACLE_SQL,
    "op10_decontaminate": decontaminate.ORACLE_SQL,
}
