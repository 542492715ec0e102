"""The queries of the text operators."""

from __future__ import annotations

from tidelog.llm import oracle, zipwarc
from tidelog.llm.bpe import op2_automaton_bpe
from tidelog.llm.decontam import op8_templates
from tidelog.llm.linkgraph import op1_link_graph
from tidelog.llm.orc_tokens import op5_orc_tokens
from tidelog.llm.quality import op10_line_frequency
from tidelog.llm.secrets import op7_blob_ledger
from tidelog.llm.simhash import op3_byte_index
from tidelog.llm.slots import op6_virtual_slots
from tidelog.llm.wrapper import op4_wrapper


def queries() -> dict:
    return {
        "op1_link_graph": op1_link_graph,
        "op2_automaton_bpe": op2_automaton_bpe,
        "op3_byte_index": op3_byte_index,
        "op4_wrapper": op4_wrapper,
        "op5_orc_tokens": op5_orc_tokens,
        "op6_virtual_slots": op6_virtual_slots,
        "op7_blob_ledger": op7_blob_ledger,
        "op8_templates": op8_templates,
        "op9_zip_warc": zipwarc.op9_zip_warc,
        "op10_line_frequency": op10_line_frequency,
    }


def oracle_sql() -> dict[str, str]:
    """Encoding, fingerprints, trees, ORC files and the slot map have no SQL; tests hold them against brute force."""
    return {**oracle.ORACLE_SQL, "op9_zip_warc": zipwarc.ORACLE_SQL}
