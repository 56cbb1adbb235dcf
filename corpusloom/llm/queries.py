"""The registered queries of this folder and their SQL."""

from corpusloom.llm import additive, chat, langid, matrices, onebit, packing, phrases, quality, secrets, simhash, transducer, warc, whitening
from corpusloom.llm.sql import ORACLES  # noqa: F401

QUERIES = {
    "op1_id_matrices": matrices.op1_id_matrices,
    "op2_quality_rules": quality.op2_quality_rules,
    "op3_warc": warc.op3_warc,
    "op4_online_packing": packing.op4_online_packing,
    "op5_language_id": langid.op5_language_id,
    "op6_simhash": simhash.op6_simhash,
    "op7_chat_windows": chat.op7_chat_windows,
    "op8_secret_scan": secrets.op8_secret_scan,
    "op9_bpe_transducer": transducer.op9_bpe_transducer,
    "op10_onebit_neighbours": onebit.op10_onebit_neighbours,
    "op11_phrases": phrases.op11_phrases,
    "op12_whitening": whitening.op12_whitening,
    "op13_quality_scores": additive.op13_quality_scores,
}
