"""The registered queries of this package and the SQL that checks them."""

from __future__ import annotations

from casewise.llm.bpe import op8_byte_bpe
from casewise.llm.counts import op12_array_merging
from casewise.llm.embeddings import op2_pigeonhole
from casewise.llm.fingerprints import op4_prefix_hashes
from casewise.llm.jaccard import op6_jaccard
from casewise.llm.packing import op5_best_fit
from casewise.llm.repeats import op7_run_index
from casewise.llm.secrets import op3_secrets
from casewise.llm.sharding import op9_sharding
from casewise.llm.toxicity import op1_toxicity
from casewise.llm.tries import op11_splitter_skeleton
from casewise.llm.warc import OP10_SQL, op10_warc
from casewise.llm.whitening import op13_eigen_updates


def queries() -> dict:
    return {"op1_toxicity": op1_toxicity, "op2_pigeonhole": op2_pigeonhole, "op3_secrets": op3_secrets, "op4_prefix_hashes": op4_prefix_hashes, "op5_best_fit": op5_best_fit, "op6_jaccard": op6_jaccard, "op7_run_index": op7_run_index, "op8_byte_bpe": op8_byte_bpe, "op9_sharding": op9_sharding, "op10_warc": op10_warc, "op11_splitter_skeleton": op11_splitter_skeleton, "op12_array_merging": op12_array_merging, "op13_eigen_updates": op13_eigen_updates}


def oracle_sql() -> dict[str, str]:
    return {"op10_warc": OP10_SQL}
