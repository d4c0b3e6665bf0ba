"""The registered queries of this folder and their SQL."""

from __future__ import annotations

from docpipe.llm.bpe import op8_bpe
from docpipe.llm.exact_dedup import OP7_SQL, op7_exact_dedup
from docpipe.llm.pii import OP10_SQL, op10_pii
from docpipe.llm.quality_model import op3_quality_model
from docpipe.llm.quality_rules import OP5_SQL, op5_quality_rules
from docpipe.llm.minhash import op1_minhash
from docpipe.llm.mixing import op11_mixing
from docpipe.llm.packing import op9_packing
from docpipe.llm.phrases import OP13_SQL, op13_phrases
from docpipe.llm.repeats import op4_repeats
from docpipe.llm.sharding import op6_sharding
from docpipe.llm.warc import OP2_SQL, op2_warc
from docpipe.llm.whitening import op12_whitening

QUERIES = {
    "op4_repeats": op4_repeats,
    "op2_warc": op2_warc,
    "op3_quality_model": op3_quality_model,
    "op1_minhash": op1_minhash,
    "op5_quality_rules": op5_quality_rules,
    "op6_sharding": op6_sharding,
    "op8_bpe": op8_bpe,
    "op9_packing": op9_packing,
    "op7_exact_dedup": op7_exact_dedup,
    "op10_pii": op10_pii,
    "op11_mixing": op11_mixing,
    "op12_whitening": op12_whitening,
    "op13_phrases": op13_phrases,
}

ORACLES = {
    "op2_warc": OP2_SQL,
    "op5_quality_rules": OP5_SQL,
    "op7_exact_dedup": OP7_SQL,
    "op10_pii": OP10_SQL,
    "op13_phrases": OP13_SQL,
}
