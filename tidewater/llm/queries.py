"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from . import divergence, manifest, media, mixing, ngram, pieces, quality, repeats, secrets, sharding, simhash, toxicity, urls

QUERIES = {
    "op1_mix": mixing.op1_mix,
    "op2_media": media.op2_media,
    "op3_pieces": pieces.op3_pieces,
    "op4_secrets": secrets.op4_secrets,
    "op5_shard": sharding.op5_shard,
    "op6_simhash": simhash.op6_simhash,
    "op7_ngram": ngram.op7_ngram,
    "op8_urls": urls.op8_urls,
    "op9_quality": quality.op9_quality,
    "op10_repeats": repeats.op10_repeats,
    "op11_divergence": divergence.op11_divergence,
    "op12_toxicity": toxicity.op12_toxicity,
    "op13_manifest": manifest.op13_manifest,
}

ORACLES = {
    "op1_mix": mixing.ORACLE,
    "op4_secrets": secrets.ORACLE,
    "op9_quality": quality.ORACLE,
    "op11_divergence": divergence.ORACLE,
    "op13_manifest": manifest.ORACLE,
}
