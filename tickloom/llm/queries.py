"""The registered queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from . import bytebpe, decontam, fingerprints, langid, lexical, licenses, merkle, secrets, sharding, simhash, tokencount, toxicity, urlfilter

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_byte_bpe": bytebpe.op2_byte_bpe,
    "op3_fingerprints": fingerprints.op3_fingerprints,
    "op4_secrets": secrets.op4_secrets,
    "op5_language_id": langid.op5_language_id,
    "op6_token_counts": tokencount.op6_token_counts,
    "op7_sharding": sharding.op7_sharding,
    "op8_licenses": licenses.op8_licenses,
    "op9_simhash": simhash.op9_simhash,
    "op10_decontamination": decontam.op10_decontamination,
    "op11_url_filters": urlfilter.op11_url_filters,
    "op12_merkle": merkle.op12_merkle,
    "op13_lexical": lexical.op13_lexical,
}
#: The others rest on xxHash64, tokenizers or trained models, which DuckDB's SQL lacks; tests hold them against brute force.
ORACLES = {
    "op8_licenses": licenses.oracle(),
    "op11_url_filters": urlfilter.oracle(),
    "op12_merkle": merkle.oracle(),
    "op13_lexical": lexical.oracle(),
}
