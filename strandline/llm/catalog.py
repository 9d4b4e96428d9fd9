"""Queries of the corpus operators and the DuckDB SQL that they are compared with."""

from __future__ import annotations

from strandline.llm.conversations import OP12_SQL, op12_conversations
from strandline.llm.decontaminate import OP9_SQL, op9_decontaminate
from strandline.llm.dedup_lines import OP3_SQL, op3_dedup_lines
from strandline.llm.dedup_spans import op2_dedup_spans
from strandline.llm.language import op7_language
from strandline.llm.manifest import OP13_SQL, op13_manifest
from strandline.llm.media import op6_media
from strandline.llm.pieces import op4_pieces
from strandline.llm.quality import op5_quality
from strandline.llm.simhash import op1_simhash
from strandline.llm.token_store import op8_token_store
from strandline.llm.toxicity import op11_toxicity
from strandline.llm.warc import OP10_SQL, op10_warc

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_dedup_spans": op2_dedup_spans,
    "op3_dedup_lines": op3_dedup_lines,
    "op4_pieces": op4_pieces,
    "op5_quality": op5_quality,
    "op6_media": op6_media,
    "op7_language": op7_language,
    "op8_token_store": op8_token_store,
    "op10_warc": op10_warc,
    "op9_decontaminate": op9_decontaminate,
    "op11_toxicity": op11_toxicity,
    "op12_conversations": op12_conversations,
    "op13_manifest": op13_manifest,
}
ORACLES: dict[str, str] = {
    "op3_dedup_lines": OP3_SQL,
    "op9_decontaminate": OP9_SQL,
    "op10_warc": OP10_SQL,
    "op12_conversations": OP12_SQL,
    "op13_manifest": OP13_SQL,
}
