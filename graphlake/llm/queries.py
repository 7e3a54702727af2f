"""The queries of this subpackage, one for each operator, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphlake.llm.ann import op1_one_bit
from graphlake.llm.chat import OP7_SQL, op7_typed_parts
from graphlake.llm.decontaminate import op10_tiling
from graphlake.llm.kmeans import OP11_SQL, op11_yinyang
from graphlake.llm.langid import op9_language_filters
from graphlake.llm.lines import OP12_SQL, op12_line_bitmaps
from graphlake.llm.mixing import op8_temperature
from graphlake.llm.negatives import OP13_SQL, op13_vantage_tree
from graphlake.llm.neardup import OP3_SQL, op3_minhash
from graphlake.llm.pii import op5_disclosure
from graphlake.llm.quality import op2_resampling
from graphlake.llm.urlrules import OP4_SQL, op4_range_sweep
from graphlake.llm.warc import OP6_SQL, op6_zip_archives

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_one_bit": op1_one_bit,
    "op2_resampling": op2_resampling,
    "op3_minhash": op3_minhash,
    "op4_range_sweep": op4_range_sweep,
    "op5_disclosure": op5_disclosure,
    "op6_zip_archives": op6_zip_archives,
    "op7_typed_parts": op7_typed_parts,
    "op8_temperature": op8_temperature,
    "op9_language_filters": op9_language_filters,
    "op10_tiling": op10_tiling,
    "op11_yinyang": op11_yinyang,
    "op12_line_bitmaps": op12_line_bitmaps,
    "op13_vantage_tree": op13_vantage_tree,
}

ORACLE_SQL: dict[str, str] = {
    "op3_minhash": OP3_SQL,
    "op4_range_sweep": OP4_SQL,
    "op6_zip_archives": OP6_SQL,
    "op7_typed_parts": OP7_SQL,
    "op11_yinyang": OP11_SQL,
    "op12_line_bitmaps": OP12_SQL,
    "op13_vantage_tree": OP13_SQL,
}
