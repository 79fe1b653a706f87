"""The queries of the corpus operators, by name, and SQL for those that SQL can express."""

from .decontamination import op9_decontamination
from .embedding_dedup import op4_embedding_dedup
from .html_text import op5_html_extraction
from .language_id import op1_language_id
from .lm_score import op10_lm_scoring
from .mixing import mixing_sql, op8_mixing
from .ngram_join import op3_ngram_jaccard_join
from .quotes import SQL as QUOTES_SQL
from .quotes import op6_chat_formatting
from .substring_dedup import op2_substring_dedup
from .suffix_dedup import op7_suffix_dedup


def queries() -> dict:
    return {f.__name__: f for f in (op1_language_id, op2_substring_dedup, op3_ngram_jaccard_join, op4_embedding_dedup, op5_html_extraction, op6_chat_formatting, op7_suffix_dedup, op8_mixing, op9_decontamination, op10_lm_scoring)}


def oracle_sql() -> dict[str, str]:
    return {"op6_chat_formatting": QUOTES_SQL, "op8_mixing": mixing_sql()}
