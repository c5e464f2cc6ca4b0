"""Queries of the training-data operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from tilewright.llm.ann import op5_ann
from tilewright.llm.conversations import OP12_SQL, op12_trie
from tilewright.llm.mixing import OP9_SQL, op9_mixing
from tilewright.llm.near_texts import op4_near_texts
from tilewright.llm.near_vectors import op3_near_vectors
from tilewright.llm.oracles import OP1_SQL, OP3_SQL, OP4_SQL, OP7_SQL
from tilewright.llm.packing import OP10_SQL, op10_packing
from tilewright.llm.pii import op11_pii
from tilewright.llm.secrets import op6_secrets
from tilewright.llm.spelling import OP13_SQL, op13_spelling
from tilewright.llm.substring import op1_substring
from tilewright.llm.suffixes import op7_suffixes
from tilewright.llm.toxicity import op8_toxicity
from tilewright.llm.warc import OP2_SQL, op2_warc


def queries() -> dict:
    return {"op1_substring": op1_substring, "op2_warc": op2_warc, "op3_near_vectors": op3_near_vectors, "op4_near_texts": op4_near_texts, "op5_ann": op5_ann, "op6_secrets": op6_secrets, "op7_suffixes": op7_suffixes, "op8_toxicity": op8_toxicity, "op9_mixing": op9_mixing, "op10_packing": op10_packing, "op11_pii": op11_pii, "op12_trie": op12_trie, "op13_spelling": op13_spelling}


def oracle_sql() -> dict[str, str]:
    return {"op1_substring": OP1_SQL, "op3_near_vectors": OP3_SQL, "op4_near_texts": OP4_SQL, "op2_warc": OP2_SQL, "op7_suffixes": OP7_SQL, "op9_mixing": OP9_SQL, "op10_packing": OP10_SQL, "op12_trie": OP12_SQL, "op13_spelling": OP13_SQL}
