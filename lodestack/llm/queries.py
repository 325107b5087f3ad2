"""The queries of this subpackage and, where DuckDB can express one, its SQL."""

from __future__ import annotations

from . import chat, decontaminate, licenses, masked_lm, multiindex, packing, quality, secrets, simhash, tokens

QUERIES = {
    "op1_chat_format": chat.op1_chat_format,
    "op2_simhash_dedup": simhash.op2_simhash_dedup,
    "op3_lm_scoring": masked_lm.op3_lm_scoring,
    "op4_secret_scan": secrets.op4_secret_scan,
    "op5_license_scan": licenses.op5_license_scan,
    "op6_quality_classifier": quality.op6_quality_classifier,
    "op7_decontamination": decontaminate.op7_decontamination,
    "op8_token_files": tokens.op8_token_files,
    "op9_embedding_dedup": multiindex.op9_embedding_dedup,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
}
ORACLE_SQL: dict[str, str] = {
    "op9_embedding_dedup": """with recursive v as (select vec_id, cast(embedding as double[]) as e from embeddings
where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as materialized (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.95),
reach as (select vec_id as a, vec_id as b from embeddings union select r.a, l.b from reach r join l on r.b = l.a),
n as (select a, count(*) as n from l group by 1), c as (select a, min(b) as component_id from reach group by 1)
select vec_id, coalesce(n, 0) as n_links, component_id, vec_id = component_id as kept from embeddings join c on c.a = vec_id left join n on n.a = vec_id""",
}
