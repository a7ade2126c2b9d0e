"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import embeddings, licenses, mixing
from .audio import op8_audio
from .embeddings import op6_embeddings
from .licenses import op2_licenses
from .mixing import op9_mixing
from .packing import op4_packing
from .pii import op1_pii
from .sharding import op3_sharding
from .simhash import op10_simhash
from .token_counts import op7_token_counts
from .toxicity import op5_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": op1_pii,
        "op2_licenses": op2_licenses,
        "op3_sharding": op3_sharding,
        "op4_packing": op4_packing,
        "op5_toxicity": op5_toxicity,
        "op6_embeddings": op6_embeddings,
        "op7_token_counts": op7_token_counts,
        "op8_audio": op8_audio,
        "op9_mixing": op9_mixing,
        "op10_simhash": op10_simhash,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_licenses": licenses.oracle_sql(), "op6_embeddings": embeddings.oracle_sql(), "op9_mixing": mixing.oracle_sql()}
