"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ann import op4_ann
from .html_extract import op7_html
from .langid import op2_language
from .licenses import op1_licenses
from .licenses import oracle as op1_oracle
from .line_dedup import op3_line_dedup
from .lz_fingerprint import op6_fingerprint
from .mixing import ORACLE as OP10_ORACLE
from .mixing import op10_mixing
from .packing import op8_packing
from .simhash import op5_simhash
from .toxicity import op9_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_licenses": op1_licenses,
    "op2_language": op2_language,
    "op3_line_dedup": op3_line_dedup,
    "op4_ann": op4_ann,
    "op5_simhash": op5_simhash,
    "op6_fingerprint": op6_fingerprint,
    "op7_html": op7_html,
    "op8_packing": op8_packing,
    "op9_toxicity": op9_toxicity,
    "op10_mixing": op10_mixing,
}

ORACLES: dict[str, str] = {
    "op1_licenses": op1_oracle(),
    "op10_mixing": OP10_ORACLE,
}
