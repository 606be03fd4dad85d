"""The registered corpus queries and their SQL."""

from __future__ import annotations

from panelforge.llm.bagminhash import OP2_SQL, op2_bagminhash_dedup
from panelforge.llm.chat_format import OP1_SQL, op1_chat_format
from panelforge.llm.collocations import OP12_SQL, op12_phrase_collocations
from panelforge.llm.decontamination import OP9_SQL, op9_decontamination
from panelforge.llm.fingerprints import op7_fingerprints
from panelforge.llm.mixing import op11_pivotal_mix
from panelforge.llm.packing import op5_pack_best_fit
from panelforge.llm.pii import op8_pii
from panelforge.llm.quality_mil import op4_quality_mil
from panelforge.llm.secrets import op6_secret_scan
from panelforge.llm.sharding import op10_virtual_slots
from panelforge.llm.spelling import OP13_SQL, op13_spelling_forms
from panelforge.llm.toxicity import op3_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_chat_format, op2_bagminhash_dedup, op3_toxicity, op4_quality_mil, op5_pack_best_fit, op6_secret_scan, op7_fingerprints, op8_pii,
        op9_decontamination, op10_virtual_slots, op11_pivotal_mix, op12_phrase_collocations, op13_spelling_forms,
    )
}
SQL = {"op1_chat_format": OP1_SQL, "op2_bagminhash_dedup": OP2_SQL, "op9_decontamination": OP9_SQL, "op12_phrase_collocations": OP12_SQL, "op13_spelling_forms": OP13_SQL}
