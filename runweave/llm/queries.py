"""The corpus operators' queries and their SQL, as __spark_entry__ registers them."""

from runweave.llm import bpe_automaton, exact_dedup, langid, lm, media, minhash, packing, sharding, substring_dedup, token_files

QUERIES = {
    "op1_shard": sharding.op1_shard,
    "op2_tokens": token_files.op2_tokens,
    "op3_packing": packing.op3_packing,
    "op4_bpe": bpe_automaton.op4_bpe,
    "op5_substring": substring_dedup.op5_substring,
    "op6_media": media.op6_media,
    "op7_minhash": minhash.op7_minhash,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_language": langid.op9_language,
    "op10_score": lm.op10_score,
}
SQL = {**substring_dedup.SQL, **minhash.SQL, **exact_dedup.SQL}
