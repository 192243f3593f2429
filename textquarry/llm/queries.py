"""The subpackage's queries and their SQL."""

from __future__ import annotations

from .ann import op10_ann
from .chat import OP8_SQL, op8_chat
from .exact_dedup import OP7_SQL, op7_exact_dedup
from .licenses import OP9_SQL, op9_licenses
from .mixing import OP5_SQL, op5_mixing
from .packing import op3_packing
from .quality import op2_quality
from .sharding import op1_sharding
from .simhash import op6_simhash
from .toxicity import op4_toxicity

QUERIES = {f.__name__: f for f in (op1_sharding, op2_quality, op3_packing, op4_toxicity, op5_mixing, op6_simhash, op7_exact_dedup, op8_chat, op9_licenses, op10_ann)}
SQL = {"op5_mixing": OP5_SQL, "op7_exact_dedup": OP7_SQL, "op8_chat": OP8_SQL, "op9_licenses": OP9_SQL}
