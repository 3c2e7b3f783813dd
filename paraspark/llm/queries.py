"""Registered queries of the subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from paraspark.llm.chat_format import OP11_SQL, op11_chat_format
from paraspark.llm.conversation_repair import OP13_SQL, op13_conversation_repair
from paraspark.llm.exact_dedup import OP3_SQL, op3_exact_dedup
from paraspark.llm.html_text import op5_html_text
from paraspark.llm.mixing import OP8_SQL, op8_mixing
from paraspark.llm.ngram_join import OP7_SQL, op7_ngram_join
from paraspark.llm.passage_dedup import op9_passage_dedup
from paraspark.llm.phrases import OP12_SQL, op12_phrases
from paraspark.llm.quality import op10_quality
from paraspark.llm.secret_scan import op4_secret_scan
from paraspark.llm.sentencepiece_fst import op1_sentencepiece
from paraspark.llm.url_filters import OP6_SQL, op6_url_filters
from paraspark.llm.warc_zip import OP2_SQL, op2_warc_zip

QUERIES = {f.__name__: f for f in (
    op1_sentencepiece, op2_warc_zip, op3_exact_dedup, op4_secret_scan, op5_html_text, op6_url_filters, op7_ngram_join,
    op8_mixing, op9_passage_dedup, op10_quality, op11_chat_format,
    op12_phrases, op13_conversation_repair)}

SQL = {"op2_warc_zip": OP2_SQL, "op3_exact_dedup": OP3_SQL, "op6_url_filters": OP6_SQL, "op7_ngram_join": OP7_SQL,
       "op8_mixing": OP8_SQL, "op11_chat_format": OP11_SQL, "op12_phrases": OP12_SQL, "op13_conversation_repair": OP13_SQL}
