"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stratum.llm.bpe import op3_byte_bpe
from stratum.llm.chat_format import OP8_SQL, op8_chat_formatting
from stratum.llm.decision_list import op5_quality_rules
from stratum.llm.fingerprints import op1_document_fingerprints
from stratum.llm.fim_frames import OP12_SQL, op12_fim_frames
from stratum.llm.html_text import op4_html_extraction
from stratum.llm.importance import op13_importance_resampling
from stratum.llm.lang_id import op6_language_id
from stratum.llm.mixture import OP9_SQL, op9_mixture
from stratum.llm.ngram_join import op2_ngram_jaccard
from stratum.llm.ordinal_quality import op7_quality_classifier
from stratum.llm.simhash_gray import op11_simhash_gray
from stratum.llm.zip_warc import OP10_SQL, op10_zip_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_document_fingerprints": op1_document_fingerprints,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_html_extraction": op4_html_extraction,
    "op5_quality_rules": op5_quality_rules,
    "op6_language_id": op6_language_id,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_mixture": op9_mixture,
    "op10_zip_warc": op10_zip_warc,
    "op11_simhash_gray": op11_simhash_gray,
    "op12_fim_frames": op12_fim_frames,
    "op13_importance_resampling": op13_importance_resampling,
}

ORACLE: dict[str, str] = {
    "op8_chat_formatting": OP8_SQL,
    "op9_mixture": OP9_SQL,
    "op10_zip_warc": OP10_SQL,
    "op12_fim_frames": OP12_SQL,
}
