"""The queries of this subpackage, with SQL where it can say the same."""

from tessera.llm import ann, bpe, chat, exact_dedup, line_dedup, ngram_join, packing, secrets, toxicity, warc

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_warc": warc.op2_warc,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_chat_formatting": chat.op5_chat_formatting,
    "op6_packing": packing.op6_packing,
    "op7_ngram_join": ngram_join.op7_ngram_join,
    "op8_secret_scans": secrets.op8_secret_scans,
    "op9_bpe": bpe.op9_bpe,
    "op10_nearest": ann.op10_nearest,
}
ORACLES = {
    "op2_warc": warc.ORACLE,
    "op3_exact_dedup": exact_dedup.ORACLE,
    "op4_line_dedup": line_dedup.ORACLE,
    "op5_chat_formatting": chat.ORACLE,
    "op7_ngram_join": ngram_join.ORACLE,
}
