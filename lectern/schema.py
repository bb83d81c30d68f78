"""Schemas of the entities."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _D, _B = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
_LIST = T.ArrayType(_S, containsNull=False)
BUCKETS = ("headings", "body_text", "bullets", "table_cells", "captions")
RELATIONS = ("isPrerequisiteOf", "isDefinedAs", "isExampleOf", "contrastedWith", "appliedIn", "isPartOf", "causeOf", "isGeneralizationOf")


def _struct(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


SLIDE_MARKDOWN = _struct(slide_id=_S, page_number=_I, raw_markdown=_S, doc_id=_S)
SLIDE_CONTENT = _struct(slide_id=_S, page_number=_I, doc_id=_S, headings=_LIST, body_text=_LIST, bullets=_LIST, table_cells=_LIST, captions=_LIST, code_lines=_LIST, heading_phrases=_LIST, clean_text=_S, ocr_applied=_B)
KEYPHRASE = _struct(phrase=_S, score=_D, source_type=_S, slide_id=_S, doc_id=_S, appears_in=_S)
TRIPLE = _struct(subject=_S, relation=_S, object=_S, evidence=_S, confidence=_D, slide_id=_S, doc_id=_S, source=_S)
RAW_TRIPLE = _struct(subject=_S, relation=_S, object=_S, evidence=_S, confidence=_S)
WEIGHTED_CONCEPT = _struct(name=_S, final_weight=_D, slide_id=_S, doc_id=_S, source_type=_S, keyphrase_score=_D, triples=T.ArrayType(TRIPLE))
