"""Fixed schemas of the document graph."""

BOX = "struct<x0: double, y0: double, x1: double, y1: double>"
DOCUMENT = "id string, source_id string, version int, active boolean, name string, source string, parse_mode string, parse_params string, metadata map<string, string>, created_at timestamp"
PAGE = "id string, document_id string, page_number int, width double, height double, text string, image binary"
ELEMENT = f"id string, document_id string, page_number int, seq int, type string, text string, text_as_html string, image binary, coordinates {BOX}, level int, font_size_max double, caption_target_id string"
SECTION = "id string, document_id string, ordinal int, title string, level int"
CHUNK = "id string, document_id string, text string, idx int, token_count int, type string, chunk_set_version int, active boolean, strategy string, strategy_params string, document_name string, section_heading string, section_context string, element_ids array<string>"
EDGE = "src string, dst string, type string, document_id string"
ENTITY = "label string, key string, props map<string, string>, seq long"
EXTRACTION = "struct<entities: array<struct<label: string, properties: map<string, string>>>, relationships: array<struct<type: string, source_label: string, source_key: string, target_label: string, target_key: string, properties: map<string, string>>>>"
