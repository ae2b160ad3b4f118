"""Schemas of records, OCR lines, layouts and edit operations."""

from __future__ import annotations

#: Record fields by their names in JSON and in tab-separated files.
FIELDS = {
    "headword_phrase": "Headword_Phrase",
    "entry_type": "Entry_Type",
    "pos": "POS",
    "translation_ru": "Translation_RU",
    "literal_meaning": "Literal_Meaning",
    "grammar_notes": "Grammar_Notes",
}
TSV_FIELDS = list(FIELDS.values())
JSON_RECORD = ", ".join(f"{k} string" for k in FIELDS)
TSV_RECORD = ", ".join(f"{k} string" for k in TSV_FIELDS)
#: Fields whose characters are compared.
COMPARED = ("Headword_Phrase", "POS", "Translation_RU", "Grammar_Notes")
BOX = "struct<x_min: double, y_min: double, x_max: double, y_max: double>"
LINE = f"bbox {BOX}, text string, confidence double, column string"
ENGINE_RESULT = "dt_polys array<array<array<double>>>, rec_texts array<string>, rec_scores array<double>"
LAYOUT = (
    "input_path string, width int, height int, parsing_res_list array<struct<block_label: string, block_content: string, "
    "block_bbox: array<double>, block_id: int, block_order: int, group_id: int>>, "
    "layout_det_res struct<boxes: array<struct<cls_id: int, label: string, score: double, coordinate: array<double>>>>"
)
EDIT = "array<struct<op: string, gt: string, ext: string, pos: int>>"
