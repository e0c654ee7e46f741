"""The registered queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

from jobruns.llm import bpe, collocations, exact, licences, lm, mixing, mtree, prefix_trie, quality, recompression, shards, simhash, warc

QUERIES = {
    f.__name__: f
    for f in (
        simhash.op1_simhash,
        warc.op2_warc,
        exact.op3_exact_dedup,
        mixing.op4_mixing,
        mtree.op5_mtree,
        licences.op6_licences,
        quality.op7_quality,
        bpe.op8_bpe,
        shards.op9_shards,
        lm.op10_lm,
        prefix_trie.op11_prefix_trie,
        collocations.op12_collocations,
        recompression.op13_recompression,
    )
}

ORACLE = {
    "op2_warc": warc.SQL,
    "op3_exact_dedup": exact.SQL,
    "op4_mixing": mixing.SQL,
    "op5_mtree": mtree.SQL,
    "op11_prefix_trie": prefix_trie.SQL,
    "op12_collocations": collocations.SQL,
    "op13_recompression": recompression.SQL,
}
