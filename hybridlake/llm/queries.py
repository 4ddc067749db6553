"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from hybridlake.llm.alignment import op11_alignment
from hybridlake.llm.decontamination import op13_decontamination
from hybridlake.llm.licenses import op4_licenses
from hybridlake.llm.minhash import op1_fingerprints
from hybridlake.llm.mixing import OP7_SQL, op7_mixing
from hybridlake.llm.neighbours import op8_neighbours
from hybridlake.llm.sentencepieces import op2_sentencepiece
from hybridlake.llm.simhash import op5_simhash
from hybridlake.llm.substrings import op10_substrings
from hybridlake.llm.token_counts import op6_token_counts
from hybridlake.llm.toxicity import op3_toxicity
from hybridlake.llm.urls import OP9_SQL, op9_url_filter
from hybridlake.llm.whitening import op12_whitening

QUERIES = {
    "op1_fingerprints": op1_fingerprints, "op2_sentencepiece": op2_sentencepiece, "op3_toxicity": op3_toxicity,
    "op4_licenses": op4_licenses, "op5_simhash": op5_simhash, "op6_token_counts": op6_token_counts,
    "op7_mixing": op7_mixing, "op8_neighbours": op8_neighbours, "op9_url_filter": op9_url_filter,
    "op10_substrings": op10_substrings, "op11_alignment": op11_alignment, "op12_whitening": op12_whitening,
    "op13_decontamination": op13_decontamination,
}
SQL = {"op7_mixing": OP7_SQL, "op9_url_filter": OP9_SQL}
