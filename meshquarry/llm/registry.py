"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from meshquarry.llm.decontam import op1_decontam
from meshquarry.llm.infill import op13_infill
from meshquarry.llm.langid import op4_langid
from meshquarry.llm.licenses import op10_licenses
from meshquarry.llm.linededup import op9_line_dedup
from meshquarry.llm.multiset import op8_multiset
from meshquarry.llm.packing import op5_packing
from meshquarry.llm.periods import op12_periods
from meshquarry.llm.pii import op3_pii
from meshquarry.llm.quality import op11_quality
from meshquarry.llm.sharding import op7_sharding
from meshquarry.llm.simhash import op2_simhash
from meshquarry.llm.sql import SQL
from meshquarry.llm.tokenfile import op6_tokenfile


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontam, op2_simhash, op3_pii, op4_langid, op5_packing, op6_tokenfile, op7_sharding, op8_multiset, op9_line_dedup, op10_licenses, op11_quality, op12_periods, op13_infill)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
