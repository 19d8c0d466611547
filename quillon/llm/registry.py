"""The corpus queries by name, with DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from .chat import OP1_SQL, op1_prefix_targets
from .ctw import op4_context_tree
from .forest import op7_prefix_forest
from .ftrl import op5_quality_ftrl
from .importance import op12_importance_resampling
from .licenses import OP13_SQL, op13_diagonal_voting
from .linejoin import op10_line_join
from .minhash import op9_minhash
from .mixing import op2_entropy_mix
from .oracles import OP3_SQL, OP9_SQL, OP10_SQL, OP11_SQL, OP12_SQL
from .packing import op8_retrieval_packing
from .quality import op3_quality_rules
from .repair import op11_repair
from .toxicity import op6_toxic_neighbours

QUERIES = {
    "op1_prefix_targets": op1_prefix_targets,
    "op2_entropy_mix": op2_entropy_mix,
    "op3_quality_rules": op3_quality_rules,
    "op4_context_tree": op4_context_tree,
    "op5_quality_ftrl": op5_quality_ftrl,
    "op6_toxic_neighbours": op6_toxic_neighbours,
    "op7_prefix_forest": op7_prefix_forest,
    "op8_retrieval_packing": op8_retrieval_packing,
    "op9_minhash": op9_minhash,
    "op10_line_join": op10_line_join,
    "op11_repair": op11_repair,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_diagonal_voting": op13_diagonal_voting,
}

ORACLES: dict[str, str] = {
    "op1_prefix_targets": OP1_SQL,
    "op3_quality_rules": OP3_SQL,
    "op9_minhash": OP9_SQL,
    "op10_line_join": OP10_SQL,
    "op11_repair": OP11_SQL,
    "op12_importance_resampling": OP12_SQL,
    "op13_diagonal_voting": OP13_SQL,
}
