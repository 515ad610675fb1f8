"""The registered queries of this package, one per operator, and their SQL where SQL can express them."""

from __future__ import annotations

from .byte_bpe import op8_byte_bpe
from .fill_middle import OP12_SQL, op12_fill_middle
from .html_text import op5_html_text
from .language_id import op3_language_id
from .line_quality import op13_line_quality
from .nearest import op4_nearest
from .packing import op6_packing
from .pii import op9_pii
from .pitman_yor import op10_pitman_yor
from .quality_rules import OP2_SQL, op2_quality_rules
from .simhash import op1_simhash
from .token_files import op7_token_files
from .vector_codes import OP11_SQL, op11_ball_codes


def queries() -> dict:
    found = [op1_simhash, op2_quality_rules, op3_language_id, op4_nearest, op5_html_text, op6_packing, op7_token_files, op8_byte_bpe, op9_pii, op10_pitman_yor, op11_ball_codes, op12_fill_middle, op13_line_quality]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": OP2_SQL, "op11_ball_codes": OP11_SQL, "op12_fill_middle": OP12_SQL}
