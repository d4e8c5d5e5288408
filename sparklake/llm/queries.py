"""The queries of this subpackage and, where SQL can express one, its DuckDB text."""

from .chat import OP5_SQL, op5_chat_formatting
from .decontamination import op1_decontamination
from .html_text import op4_html_extraction
from .media import op7_media_columns
from .ngram_join import OP3_SQL, op3_ngram_jaccard_join
from .pii import op9_pii
from .secrets import op10_secret_scan
from .sentencepiece_bpe import op6_sentencepiece
from .sharding import op2_sharding
from .toxicity import op8_toxicity

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_sharding": op2_sharding,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_html_extraction": op4_html_extraction,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_media_columns": op7_media_columns,
    "op8_toxicity": op8_toxicity,
    "op9_pii": op9_pii,
    "op10_secret_scan": op10_secret_scan,
}

ORACLES: dict[str, str] = {
    "op3_ngram_jaccard_join": OP3_SQL,
    "op5_chat_formatting": OP5_SQL,
}
