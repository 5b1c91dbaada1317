"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from keepwatt.llm import op5_decontamination as leaks
from keepwatt.llm.op1_bpe import op1_bpe
from keepwatt.llm.op2_personal_data import op2_personal_data
from keepwatt.llm.op3_token_files import op3_token_files
from keepwatt.llm.op4_language_model import op4_language_model
from keepwatt.llm.op5_decontamination import op5_decontamination
from keepwatt.llm.op6_line_quality import op6_line_quality
from keepwatt.llm.op7_licenses import op7_licenses
from keepwatt.llm.op8_hilbert import op8_hilbert
from keepwatt.llm.op9_separators import op9_separators
from keepwatt.llm.op10_simhash import op10_simhash
from keepwatt.llm.op11_language import op11_language
from keepwatt.llm.op12_periodic_runs import op12_periodic_runs
from keepwatt.llm.op13_spelling_groups import op13_spelling_groups

REGISTERED = [op1_bpe, op2_personal_data, op3_token_files, op4_language_model, op5_decontamination,
              op6_line_quality, op7_licenses, op8_hilbert, op9_separators, op10_simhash, op11_language,
              op12_periodic_runs, op13_spelling_groups]
ORACLE_SQL = {"op5_decontamination": leaks.ORACLE_SQL}
