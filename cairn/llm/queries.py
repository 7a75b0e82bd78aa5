"""Registered queries of the training-data operators, and oracle SQL where SQL can express one."""

from cairn.llm import collocations, licenses
from cairn.llm.alignment import op12_alignment
from cairn.llm.brown_lm import op2_brown_lm
from cairn.llm.collocations import op11_collocations
from cairn.llm.decontaminate import op9_decontamination
from cairn.llm.gam import op13_quality_gam
from cairn.llm.jaccard_join import op5_ngram_jaccard_join
from cairn.llm.language_id import op6_language_id
from cairn.llm.licenses import op8_license_scan
from cairn.llm.pii import op10_pii_pseudonyms
from cairn.llm.quality import op1_quality_rules
from cairn.llm.repair_tokens import op7_repair_tokens
from cairn.llm.secrets import op3_secret_scan
from cairn.llm.sentencepiece_fst import op4_sentencepiece

QUERIES = {
    f.__name__: f
    for f in (op1_quality_rules, op2_brown_lm, op3_secret_scan, op4_sentencepiece, op5_ngram_jaccard_join, op6_language_id, op7_repair_tokens, op8_license_scan, op9_decontamination, op10_pii_pseudonyms, op11_collocations, op12_alignment, op13_quality_gam)
}
ORACLES = {"op8_license_scan": licenses.oracle(), "op11_collocations": collocations.oracle()}
