"""Queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from .decontam import op7_fm_decontamination
from .html_extract import op4_html_extract
from .jaccard_join import op1_ngram_jaccard
from .langid import op2_language_id
from .license_scan import OP3_SQL, op3_license_scan
from .line_dedup import OP5_SQL, op5_line_dedup
from .packing import op9_best_two_fit
from .phrases import OP11_SQL, op11_phrase_collocations
from .quality_crf import op10_quality_crf
from .rabitq import op6_rabitq_neighbours
from .resample import OP13_SQL, op13_importance_resampling
from .suffix_dedup import op8_suffix_dedup
from .warc import OP12_SQL, op12_warc_bundles

_QUERIES = (op1_ngram_jaccard, op2_language_id, op3_license_scan, op4_html_extract, op5_line_dedup, op6_rabitq_neighbours, op7_fm_decontamination, op8_suffix_dedup, op9_best_two_fit, op10_quality_crf, op11_phrase_collocations, op12_warc_bundles, op13_importance_resampling)


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op3_license_scan": OP3_SQL, "op5_line_dedup": OP5_SQL, "op11_phrase_collocations": OP11_SQL, "op12_warc_bundles": OP12_SQL, "op13_importance_resampling": OP13_SQL}
