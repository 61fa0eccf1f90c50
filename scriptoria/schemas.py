"""Explicit schemas; nothing is inferred."""

from __future__ import annotations

RAW_OCR = "doc_id string, texts array<string>, scores array<double>, boxes array<array<int>>, polys array<array<array<int>>>, angle int"
#: What a line of JSON that can't be read leaves: its text, beside nulls or what could be read of it.
BROKEN = "record"
RAW_OCR_JSON = f"{RAW_OCR}, {BROKEN} string"
#: Fields in this order, so that array_sort is the reading order and ties go by line_no.
LINE = "struct<top: int, left: int, line_no: int, right: int, bottom: int, text: string, score: double>"
LAYOUTS = f"doc_id string, lines array<{LINE}>"
LINES = "doc_id string, line_no int, text string, left int, top int, right int, bottom int, score double"
LETTER_PAGES = "doc_id string, page_number int, text string, image_count int"
MARKDOWN_PAGES = "array<struct<markdown: struct<text: string, images: map<string, string>>>>"
IMAGES = "doc_id string, height int, width int, channels int, data binary"
