"""The queries of this subpackage, and their SQL where DuckDB can express it."""

from gradelake.llm.bpe import op4_bpe_encode_decode
from gradelake.llm.chat_format import OP1_SQL, op1_chat_format
from gradelake.llm.decontaminate import op6_benchmark_decontamination
from gradelake.llm.filter_audit import OP13_SQL, op13_filter_interaction_audit
from gradelake.llm.html_extract import op10_html_extraction
from gradelake.llm.jaccard_join import OP3_SQL, op3_ngram_jaccard_join
from gradelake.llm.line_dedup import OP7_SQL, op7_line_dedup
from gradelake.llm.ordinal_quality import op9_quality_classifier
from gradelake.llm.packing import op12_packing
from gradelake.llm.quality_rules import OP2_SQL, op2_quality_rules
from gradelake.llm.url_filter import OP8_SQL, op8_url_filter
from gradelake.llm.warc import OP5_SQL, op5_warc_normaliser
from gradelake.llm.whitening import op11_embedding_whitening

QUERIES = {
    f.__name__: f
    for f in (
        op1_chat_format,
        op2_quality_rules,
        op3_ngram_jaccard_join,
        op4_bpe_encode_decode,
        op5_warc_normaliser,
        op6_benchmark_decontamination,
        op7_line_dedup,
        op8_url_filter,
        op9_quality_classifier,
        op10_html_extraction,
        op11_embedding_whitening,
        op12_packing,
        op13_filter_interaction_audit,
    )
}
SQL = {
    "op1_chat_format": OP1_SQL,
    "op2_quality_rules": OP2_SQL,
    "op3_ngram_jaccard_join": OP3_SQL,
    "op5_warc_normaliser": OP5_SQL,
    "op7_line_dedup": OP7_SQL,
    "op8_url_filter": OP8_SQL,
    "op13_filter_interaction_audit": OP13_SQL,
}
