"""Queries of the numbered operators and their SQL answers."""

from __future__ import annotations

from eqpanel.llm.alignment import op12_alignment
from eqpanel.llm.bpe import op1_bpe
from eqpanel.llm.decontamination import ORACLE_SQL as DECONTAMINATION_SQL
from eqpanel.llm.decontamination import op13_decontamination
from eqpanel.llm.jaccard import op7_jaccard
from eqpanel.llm.licenses import op3_licenses
from eqpanel.llm.packing import op5_packing
from eqpanel.llm.pii import op10_pii
from eqpanel.llm.quality import op6_quality
from eqpanel.llm.secrets import op4_secrets
from eqpanel.llm.spans import op2_spans
from eqpanel.llm.urls import op8_urls
from eqpanel.llm.vectors import op9_vectors
from eqpanel.llm.whitening import op11_whitening

QUERIES = {f.__name__: f for f in (op1_bpe, op2_spans, op3_licenses, op4_secrets, op5_packing, op6_quality, op7_jaccard, op8_urls, op9_vectors, op10_pii, op11_whitening, op12_alignment, op13_decontamination)}
#: The operators' own methods (trees, automata, entropy, token merges) have no SQL form; tests hold them against brute force.
ORACLES: dict[str, str] = {"op13_decontamination": DECONTAMINATION_SQL}
