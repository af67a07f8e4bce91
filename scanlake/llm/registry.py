"""The subpackage's queries and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scanlake.llm.ann import op7_ann_ivfpq
from scanlake.llm.bpe import op5_byte_bpe
from scanlake.llm.licenses import op10_license_scan
from scanlake.llm.linededup import OP3_SQL, op3_line_dedup
from scanlake.llm.packing import op4_packing
from scanlake.llm.pii import op9_pii
from scanlake.llm.quality import OP6_SQL, op6_quality_rules
from scanlake.llm.simhash import op2_simhash_near_dups
from scanlake.llm.toxicity import op8_toxicity
from scanlake.llm.warc import OP1_SQL, op1_warc_revisits

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_revisits": op1_warc_revisits,
    "op2_simhash_near_dups": op2_simhash_near_dups,
    "op3_line_dedup": op3_line_dedup,
    "op4_packing": op4_packing,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_quality_rules": op6_quality_rules,
    "op7_ann_ivfpq": op7_ann_ivfpq,
    "op8_toxicity": op8_toxicity,
    "op9_pii": op9_pii,
    "op10_license_scan": op10_license_scan,
}

ORACLE_SQL: dict[str, str] = {"op1_warc_revisits": OP1_SQL, "op3_line_dedup": OP3_SQL, "op6_quality_rules": OP6_SQL}
