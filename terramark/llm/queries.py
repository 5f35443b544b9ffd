"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .exact_dedup import OP1_SQL, op1_exact_dedup
from .hard_negatives import OP12_SQL, op12_hard_negatives
from .language_id import op6_language_id
from .media import op8_media
from .mixing import mix_sql, op7_mixing
from .pii import op10_pii
from .prefix_trie import OP13_SQL, op13_prefix_trie
from .sentencepiece import op9_sentencepiece
from .simhash import op5_simhash
from .substring_dedup import OP2_SQL, op2_substring_dedup
from .suffix_dedup import op4_suffix_dedup
from .token_ids import op11_token_ids
from .warc import OP3_SQL, op3_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_exact_dedup, op2_substring_dedup, op3_warc, op4_suffix_dedup, op5_simhash, op6_language_id, op7_mixing, op8_media, op9_sentencepiece, op10_pii, op11_token_ids,
        op12_hard_negatives, op13_prefix_trie)
}
SQL: dict[str, str] = {"op1_exact_dedup": OP1_SQL, "op2_substring_dedup": OP2_SQL, "op3_warc": OP3_SQL, "op7_mixing": mix_sql(), "op12_hard_negatives": OP12_SQL, "op13_prefix_trie": OP13_SQL}
