"""The registered queries of this subpackage and the SQL that expresses them."""

from __future__ import annotations

from skein.llm.fingerprints import op4_fingerprints
from skein.llm.lm_scoring import op2_lm_scoring
from skein.llm.mixing import OP8_SQL, op8_mixing
from skein.llm.ngram_join import OP9_SQL, op9_ngram_join
from skein.llm.packing import op3_packing
from skein.llm.quality import op10_quality
from skein.llm.secret_scan import op7_secret_scan
from skein.llm.token_files import op1_token_orc
from skein.llm.url_filter import op5_url_filter
from skein.llm.vector_search import op6_vector_search

QUERIES = {
    "op1_token_orc": op1_token_orc,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_packing": op3_packing,
    "op4_fingerprints": op4_fingerprints,
    "op5_url_filter": op5_url_filter,
    "op6_vector_search": op6_vector_search,
    "op7_secret_scan": op7_secret_scan,
    "op8_mixing": op8_mixing,
    "op9_ngram_join": op9_ngram_join,
    "op10_quality": op10_quality,
}

#: Queries without an entry run models, tokenizers or hashes of their own, which SQL can't express.
ORACLE_SQL: dict[str, str] = {"op8_mixing": OP8_SQL, "op9_ngram_join": OP9_SQL}
