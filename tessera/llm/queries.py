"""The queries of this subpackage and, where DuckDB can say them, their SQL."""

from __future__ import annotations

from tessera.llm import chat, decontaminate, divergence, embeddings, fim, html, language, packing, pii, quality, sharding, simhash, urls

QUERIES = {
    "op1_html": html.query,
    "op2_simhash": simhash.query,
    "op3_pii": pii.query,
    "op4_decontaminate": decontaminate.query,
    "op5_language": language.query,
    "op6_quality": quality.query,
    "op7_urls": urls.query,
    "op8_sharding": sharding.query,
    "op9_embeddings": embeddings.query,
    "op10_packing": packing.query,
    "op11_chat": chat.query,
    "op12_divergence": divergence.query,
    "op13_fim": fim.query,
}
ORACLE_SQL: dict[str, str] = {
    "op4_decontaminate": decontaminate.ORACLE_SQL,
    "op7_urls": urls.ORACLE_SQL,
    "op9_embeddings": embeddings.ORACLE_SQL,
    "op11_chat": chat.ORACLE_SQL,
    "op12_divergence": divergence.ORACLE_SQL,
    "op13_fim": fim.ORACLE_SQL,
}
