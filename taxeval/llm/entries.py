"""The queries of this subpackage and the SQL that some of them are checked against."""

from __future__ import annotations

from . import bpe, chat, clustering, decontaminate, exact_dedup, langid, licenses, packing, pii, secrets, simhash, topk, whitening


def queries() -> dict:
    return {
        "op1_secret_scan": secrets.query,
        "op2_simhash_near_dedup": simhash.query,
        "op3_language_id": langid.query,
        "op4_chat_formatting": chat.query,
        "op5_pii_surrogates": pii.query,
        "op6_exact_dedup": exact_dedup.query,
        "op7_best_fit_packing": packing.query,
        "op8_license_scan": licenses.query,
        "op9_voronoi_topk": topk.query,
        "op10_bpe": bpe.query,
        "op11_embedding_whitening": whitening.query,
        "op12_centroid_clustering": clustering.query,
        "op13_benchmark_decontamination": decontaminate.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_chat_formatting": chat.SQL, "op6_exact_dedup": exact_dedup.SQL, "op9_voronoi_topk": topk.SQL, "op12_centroid_clustering": clustering.SQL, "op13_benchmark_decontamination": decontaminate.SQL}
