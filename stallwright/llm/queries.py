"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import audio, chat_format, decontamination, near_dedup, packing, pii, quality_mil, toxicity, training_order, warc_merge
from .common import bounded

QUERIES = {
    "op1_near_dedup": near_dedup.op1_near_dedup,
    "op2_warc_merge": warc_merge.op2_warc_merge,
    "op3_audio": audio.op3_audio,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_chat_format": chat_format.op5_chat_format,
    "op6_training_order": training_order.op6_training_order,
    "op7_pii": pii.op7_pii,
    "op8_quality": quality_mil.op8_quality,
    "op9_decontamination": decontamination.op9_decontamination,
    "op10_packing": packing.op10_packing,
}
QUERIES = {name: bounded(f) for name, f in QUERIES.items()}
ORACLE_SQL = {"op5_chat_format": chat_format.ORACLE, "op9_decontamination": decontamination.ORACLE}
