"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import backoff, embeddings, kdtree, line_dedup, nearset
from .alignment import op12_alignment
from .backoff import op7_backoff
from .embeddings import embeddings_recall, op10_embeddings
from .html_text import op6_html
from .kdtree import op11_kmeans
from .langid import op9_language
from .line_dedup import op13_lines
from .mixing import op2_mixing
from .nearset import op5_nearset
from .ogg import op1_ogg
from .packing import op3_packing
from .quality import op8_quality
from .toxicity import op4_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ogg": op1_ogg,
        "op2_mixing": op2_mixing,
        "op3_packing": op3_packing,
        "op4_toxicity": op4_toxicity,
        "op5_nearset": op5_nearset,
        "op6_html": op6_html,
        "op7_backoff": op7_backoff,
        "op8_quality": op8_quality,
        "op9_language": op9_language,
        "op10_embeddings": op10_embeddings,
        "embeddings_recall": embeddings_recall,
        "op11_kmeans": op11_kmeans,
        "op12_alignment": op12_alignment,
        "op13_lines": op13_lines,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_nearset": nearset.SQL, "op7_backoff": backoff.SQL, "op10_embeddings": embeddings.SQL, "embeddings_recall": embeddings.RECALL_SQL, "op11_kmeans": kdtree.SQL, "op13_lines": line_dedup.SQL,
    }
