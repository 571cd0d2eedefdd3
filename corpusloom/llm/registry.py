"""The queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from . import collocations, substrings, trie, warc
from .bpe import op7_byte_bpe
from .collocations import op13_phrase_collocations
from .fingerprints import op1_document_fingerprints
from .html import op2_html_extraction
from .jaccard import op5_ngram_jaccard_join
from .langid import op9_language_id
from .lines import op10_line_dedup
from .licenses import op4_license_scans
from .packing import op6_best_fit_packing
from .quality import op3_quality_rules
from .substrings import op11_substring_dedup
from .trie import op12_prefix_trie

QUERIES = {
    f.__name__: f
    for f in (
        op1_document_fingerprints,
        op2_html_extraction,
        op3_quality_rules,
        op4_license_scans,
        op5_ngram_jaccard_join,
        op6_best_fit_packing,
        op7_byte_bpe,
        warc.op8_warc,
        op9_language_id,
        op10_line_dedup,
        op11_substring_dedup,
        op12_prefix_trie,
        op13_phrase_collocations,
    )
}

ORACLES: dict[str, str] = {
    "op8_warc": warc.ORACLE,
    "op11_substring_dedup": substrings.ORACLE,
    "op12_prefix_trie": trie.ORACLE,
    "op13_phrase_collocations": collocations.ORACLE,
}
