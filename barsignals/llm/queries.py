"""Named queries of the training-data operators, over the whole given tables."""

from barsignals.llm.alignment import op12_tokenizer_alignment
from barsignals.llm.annuli import op13_exact_top_k
from barsignals.llm.decontamination import op6_benchmark_decontamination
from barsignals.llm.lang_id import op1_language_id
from barsignals.llm.lm_scoring import op9_lm_scoring
from barsignals.llm.quality import op2_quality_classifier
from barsignals.llm.repair import op11_conversation_repair
from barsignals.llm.repeats import op4_suffix_array_dedup
from barsignals.llm.secrets import op3_secret_scans
from barsignals.llm.sentencepieces import op8_sentencepiece
from barsignals.llm.simhash import op5_simhash_near_dedup
from barsignals.llm.syncmers import op10_document_fingerprints
from barsignals.llm.toxicity import op7_toxicity

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_secret_scans": op3_secret_scans,
    "op4_suffix_array_dedup": op4_suffix_array_dedup,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_toxicity": op7_toxicity,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_document_fingerprints": op10_document_fingerprints,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_tokenizer_alignment": op12_tokenizer_alignment,
    "op13_exact_top_k": op13_exact_top_k,
}
