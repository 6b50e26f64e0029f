"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from lookupforge.llm.decontaminate import op1_decontaminate
from lookupforge.llm.html_consensus import op5_html_consensus
from lookupforge.llm.minhash_paths import op6_minhash_paths
from lookupforge.llm.neardup_embeddings import op2_embedding_lattice
from lookupforge.llm.oracles import OP1_SQL, OP2_SQL, OP6_SQL, OP8_SQL
from lookupforge.llm.secret_ledger import op4_secret_ledger
from lookupforge.llm.substring_doubling import op8_substring_doubling
from lookupforge.llm.token_store import op9_token_store
from lookupforge.llm.toxicity import op3_toxicity
from lookupforge.llm.url_rules import OP7_SQL, op7_url_rules
from lookupforge.llm.viterbi_pieces import op10_viterbi_pieces

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_embedding_lattice": op2_embedding_lattice,
    "op3_toxicity": op3_toxicity,
    "op4_secret_ledger": op4_secret_ledger,
    "op5_html_consensus": op5_html_consensus,
    "op6_minhash_paths": op6_minhash_paths,
    "op7_url_rules": op7_url_rules,
    "op8_substring_doubling": op8_substring_doubling,
    "op9_token_store": op9_token_store,
    "op10_viterbi_pieces": op10_viterbi_pieces,
}
SQL = {"op1_decontaminate": OP1_SQL, "op2_embedding_lattice": OP2_SQL, "op6_minhash_paths": OP6_SQL, "op7_url_rules": OP7_SQL, "op8_substring_doubling": OP8_SQL}
