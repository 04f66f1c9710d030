"""Registered queries of this subpackage."""

from __future__ import annotations

from hourloom.llm import chat, decontamination, fingerprints, line_dedup, minhash, sentencepiece_codec, sharding, token_store, toxicity, warc

QUERIES = {
    "op1_warc": warc.query,
    "op2_sharding": sharding.query,
    "op3_toxicity": toxicity.query,
    "op4_chat": chat.query,
    "op5_sentencepiece": sentencepiece_codec.query,
    "op6_token_store": token_store.query,
    "op7_decontamination": decontamination.query,
    "op8_line_dedup": line_dedup.query,
    "op9_fingerprints": fingerprints.query,
    "op10_minhash": minhash.query,
}

#: The other queries use hashes, tokenizers, models or bytes that DuckDB's SQL can't express; the
#: tests hold them against brute force instead.
ORACLES: dict[str, str] = {
    "op4_chat": chat.ORACLE,
    "op7_decontamination": decontamination.ORACLE,
    "op8_line_dedup": line_dedup.ORACLE,
    "op10_minhash": minhash.ORACLE,
}
