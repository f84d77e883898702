"""The thin queries over the tables, and their SQL where SQL can say it."""

from __future__ import annotations

from .bpe import op6_bpe
from .chat import OP10_SQL, op10_chat
from .codes import OP12_SQL, op12_codes
from .common import table
from .embdup import op8_embdup
from .exact import OP4_SQL, classes
from .langid import op9_langid
from .mixing import op7_mix
from .quality import op2_quality
from .simhash import op3_simhash
from .suffix import op5_suffix
from .trie import OP13_SQL, op13_trie
from .urlfilter import OP11_SQL, op11_urls
from .warc import OP1_SQL, op1_warc

QUERIES = {
    "op1_warc": lambda spark, d: op1_warc(spark, table(spark, d, "pages")),
    "op2_quality": lambda spark, d: op2_quality(table(spark, d, "documents"), table(spark, d, "labels")),
    "op3_simhash": lambda spark, d: op3_simhash(table(spark, d, "documents")),
    "op4_exact": lambda spark, d: classes(table(spark, d, "documents")),
    "op5_suffix": lambda spark, d: op5_suffix(table(spark, d, "documents")),
    "op6_bpe": lambda spark, d: op6_bpe(spark, table(spark, d, "documents")),
    "op7_mix": lambda spark, d: op7_mix(table(spark, d, "documents")),
    "op8_embdup": lambda spark, d: op8_embdup(table(spark, d, "embeddings")),
    "op9_langid": lambda spark, d: op9_langid(table(spark, d, "documents")),
    "op10_chat": lambda spark, d: op10_chat(table(spark, d, "conversations")),
    "op11_urls": lambda spark, d: op11_urls(table(spark, d, "pages")),
    "op12_codes": lambda spark, d: op12_codes(table(spark, d, "embeddings")),
    "op13_trie": lambda spark, d: op13_trie(table(spark, d, "conversations")),
}
SQL = {"op1_warc": OP1_SQL, "op4_exact": OP4_SQL, "op10_chat": OP10_SQL, "op11_urls": OP11_SQL, "op12_codes": OP12_SQL, "op13_trie": OP13_SQL}
