"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from callweave.llm import oracles
from callweave.llm.byte_bpe import op12_byte_bpe
from callweave.llm.class_lm import op10_class_lm
from callweave.llm.decontaminate import op9_decontaminate
from callweave.llm.html_text import op1_html_text
from callweave.llm.language import op8_language
from callweave.llm.mixing import op3_mixing
from callweave.llm.phrases import op11_phrases
from callweave.llm.prefix_trie import op13_prefix_trie
from callweave.llm.quality import op2_quality
from callweave.llm.secrets import op6_secrets
from callweave.llm.simhash import op4_simhash
from callweave.llm.token_planes import op7_token_planes
from callweave.llm.url_filter import op5_url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_html_text, op2_quality, op3_mixing, op4_simhash, op5_url_filter, op6_secrets, op7_token_planes, op8_language, op9_decontaminate, op10_class_lm, op11_phrases, op12_byte_bpe, op13_prefix_trie]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_quality": oracles.quality(), "op3_mixing": oracles.mixing(), "op5_url_filter": oracles.urls(), "op6_secrets": oracles.secret_spans(), "op11_phrases": oracles.phrase_list(), "op13_prefix_trie": oracles.trie()}
