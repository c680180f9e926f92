"""Queries of the training-data operators, by name, and SQL where it can express them."""

from __future__ import annotations

from . import exactdup, hilbert, jaccard, linededup, mixing, packing, pieces, secrets, subspaces, tiff, toxicity, warc, yinyang


def pipeline(spark, sf_dir):
    """All stages of ``corpus_pipeline.py``."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_hilbert_sharding": hilbert.op1_hilbert_sharding,
    "op2_warc_salvage": warc.op2_warc_salvage,
    "op3_line_dedup": linededup.op3_line_dedup,
    "op4_secret_scan": secrets.op4_secret_scan,
    "op5_source_mixing": mixing.op5_source_mixing,
    "op6_tiff_media": tiff.op6_tiff_media,
    "op7_exact_dedup": exactdup.op7_exact_dedup,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_jaccard_components": jaccard.op9_jaccard_components,
    "op10_toxicity_chain": toxicity.op10_toxicity_chain,
    "op11_binary_packing": pieces.op11_binary_packing,
    "op12_filtering_lloyd": subspaces.op12_filtering_lloyd,
    "op13_yinyang_clusters": yinyang.op13_yinyang_clusters,
    "pipeline": pipeline,
}
ORACLES: dict[str, str] = {
    "op2_warc_salvage": warc.OP2_SQL,
    "op3_line_dedup": linededup.OP3_SQL,
    "op5_source_mixing": mixing.OP5_SQL,
    "op7_exact_dedup": exactdup.OP7_SQL,
    "op12_filtering_lloyd": subspaces.OP12_SQL,
    "op13_yinyang_clusters": yinyang.OP13_SQL,
}
