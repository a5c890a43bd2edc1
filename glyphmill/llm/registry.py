"""Queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from glyphmill.llm.bpe import op10_bpe
from glyphmill.llm.exact_dedup import OP1_SQL, op1_exact_dedup
from glyphmill.llm.lattice import op3_lattice
from glyphmill.llm.lexical import OP12_SQL, op12_lexical
from glyphmill.llm.line_dedup import OP9_SQL, op9_line_dedup
from glyphmill.llm.mixing import op8_mixing
from glyphmill.llm.near_dedup import op7_near_dedup
from glyphmill.llm.pii import op6_pii
from glyphmill.llm.prefix_trie import OP13_SQL, op13_prefix_trie
from glyphmill.llm.quality import op4_quality
from glyphmill.llm.simhash import op11_simhash
from glyphmill.llm.substring_dedup import op5_substring
from glyphmill.llm.webp import op2_media

QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_media": op2_media,
    "op3_lattice": op3_lattice,
    "op4_quality": op4_quality,
    "op5_substring": op5_substring,
    "op6_pii": op6_pii,
    "op7_near_dedup": op7_near_dedup,
    "op8_mixing": op8_mixing,
    "op9_line_dedup": op9_line_dedup,
    "op10_bpe": op10_bpe,
    "op11_simhash": op11_simhash,
    "op12_lexical": op12_lexical,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLE_SQL = {"op1_exact_dedup": OP1_SQL, "op9_line_dedup": OP9_SQL, "op12_lexical": OP12_SQL, "op13_prefix_trie": OP13_SQL}
