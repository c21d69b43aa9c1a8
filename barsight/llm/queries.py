"""Queries and SQL of this subpackage, for the entry module to add."""

from __future__ import annotations

from .common import table
from .decontamination import ORACLE_SQL as SQL8
from .decontamination import op8
from .embedding_dedup import ORACLE_SQL as SQL10
from .embedding_dedup import op10
from .filter_audit import ORACLE_SQL as SQL12
from .filter_audit import op12
from .jaccard_join import op9
from .license_scan import op6
from .line_dedup import ORACLE_SQL as SQL1
from .line_dedup import op1
from .prefix_trie import ORACLE_SQL as SQL13
from .prefix_trie import op13
from .sentencepiece import op2
from .streaming_dedup import ORACLE_SQL as SQL11
from .streaming_dedup import op11
from .substring_dedup import op5
from .toxicity import op7
from .url_filter import op4
from .warc import op3

QUERIES = {
    "op1_line_dedup": lambda spark, d: op1(table(spark, d, "documents")),
    "op2_sentencepiece": lambda spark, d: op2(table(spark, d, "documents")),
    "op3_warc": lambda spark, d: op3(table(spark, d, "pages")),
    "op5_substring_dedup": lambda spark, d: op5(table(spark, d, "documents")),
    "op6_license_scan": lambda spark, d: op6(table(spark, d, "documents")),
    "op4_url_filter": lambda spark, d: op4(table(spark, d, "pages")),
    "op7_toxicity": lambda spark, d: op7(table(spark, d, "documents"), table(spark, d, "labels")),
    "op8_benchmark_decontamination": lambda spark, d: op8(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op10_embedding_dedup": lambda spark, d: op10(table(spark, d, "embeddings")),
    "op9_jaccard_join": lambda spark, d: op9(table(spark, d, "documents")),
    "op11_streaming_dedup": lambda spark, d: op11(spark, f"{d}/documents.parquet"),
    "op12_filter_audit": lambda spark, d: op12(table(spark, d, "documents"), table(spark, d, "labels")),
    "op13_prefix_trie": lambda spark, d: op13(table(spark, d, "conversations")),
}
ORACLE = {"op11_streaming_dedup": SQL11, "op12_filter_audit": SQL12, "op13_prefix_trie": SQL13, "op10_embedding_dedup": SQL10, "op1_line_dedup": SQL1, "op8_benchmark_decontamination": SQL8}
