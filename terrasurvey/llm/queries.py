"""The corpus operators as queries over the driver's tables, and their SQL."""

from .fmindex import OP8_SQL, op8_substring_dedup
from .hmm import op5_hmm
from .html import op3_html
from .lines import OP1_SQL, op1_line_dedup
from .merkle import OP13_SQL, op13_merkle
from .minhash import op11_fingerprints
from .mixing import OP7_SQL, op7_mixing
from .packing import op2_packing
from .quality import op4_quality_rules
from .repair import op12_conversations
from .secrets import op10_secrets
from .simhash import op9_simhash
from .topk import OP6_SQL, op6_top_k

QUERIES = {"op1_line_dedup": op1_line_dedup, "op2_packing": op2_packing, "op3_html": op3_html, "op4_quality_rules": op4_quality_rules, "op5_hmm": op5_hmm, "op6_top_k": op6_top_k, "op7_mixing": op7_mixing, "op8_substring_dedup": op8_substring_dedup, "op9_simhash": op9_simhash, "op10_secrets": op10_secrets, "op11_fingerprints": op11_fingerprints, "op12_conversations": op12_conversations, "op13_merkle": op13_merkle}
SQL = {"op1_line_dedup": OP1_SQL, "op6_top_k": OP6_SQL, "op7_mixing": OP7_SQL, "op8_substring_dedup": OP8_SQL, "op13_merkle": OP13_SQL}
