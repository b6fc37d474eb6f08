"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from attestra.llm.chat_format import OP1_SQL, op1_chat_formatting
from attestra.llm.decontaminate import OP6_SQL, op6_decontaminate
from attestra.llm.line_dedup import OP5_SQL, op5_line_dedup
from attestra.llm.pii import OP2_DOCUMENT_SQL, OP2_SQL, op2_pii, op2_pii_document
from attestra.llm.quality import op7_quality_rules
from attestra.llm.secret_scan import OP4_SQL, op4_secret_scan
from attestra.llm.sentencepiece_codec import op3_sentencepiece
from attestra.llm.simhash import op10_simhash
from attestra.llm.substring_dedup import OP9_SQL, op9_substring_dedup
from attestra.llm.token_count import op8_token_count

QUERIES = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_pii": op2_pii,
    "op2_pii_document": op2_pii_document,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_secret_scan": op4_secret_scan,
    "op5_line_dedup": op5_line_dedup,
    "op6_decontaminate": op6_decontaminate,
    "op7_quality_rules": op7_quality_rules,
    "op8_token_count": op8_token_count,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_simhash": op10_simhash,
}

ORACLES = {
    "op1_chat_formatting": OP1_SQL,
    "op2_pii": OP2_SQL,
    "op2_pii_document": OP2_DOCUMENT_SQL,
    "op4_secret_scan": OP4_SQL,
    "op5_line_dedup": OP5_SQL,
    "op6_decontaminate": OP6_SQL,
    "op9_substring_dedup": OP9_SQL,
}
