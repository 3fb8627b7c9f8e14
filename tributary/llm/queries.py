"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from .bpe_coding import op9_bpe
from .collocations import OP12_SQL, op12_collocations
from .exact_dedup import OP7_SQL, op7_exact_dedup
from .hard_negatives import OP11_SQL, op11_hard_negatives
from .html_extract import op5_html_text
from .jaccard_join import op6_jaccard_join
from .language_id import op3_language_id
from .line_dedup import OP13_SQL, op13_line_dedup
from .multi_index import op8_multi_index
from .packing import op4_packing
from .suffix_dedup import op10_suffix_dedup
from .url_filter import OP1_SQL, op1_url_filter
from .warc import op2_warc

QUERIES = {
    f.__name__: f
    for f in (op1_url_filter, op2_warc, op3_language_id, op4_packing, op5_html_text, op6_jaccard_join, op7_exact_dedup, op8_multi_index, op9_bpe, op10_suffix_dedup, op11_hard_negatives, op12_collocations, op13_line_dedup)
}

ORACLE = {"op1_url_filter": OP1_SQL, "op7_exact_dedup": OP7_SQL, "op11_hard_negatives": OP11_SQL, "op12_collocations": OP12_SQL, "op13_line_dedup": OP13_SQL}
