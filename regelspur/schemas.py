"""The tables of the engine, as DDL; readers declare them and never infer."""

ELEMENTS = "source_file string, elem_idx int, type string, text string, page_number int"
CHUNKS = "position int, chunk_id string, source_file string, page_number int, type string, text string"
CHUNK_VECTORS = "chunk_id string, embedding array<float>, type string, page_number int, source_file string"
GOLDSET = "id string, chunk_id string, source_file string, page_number int, chunk_type string, question_colloquial string, question_precise string, answer_snippet string"
UNANSWERABLE = "id string, question string, category string, anchor_term string, why_unanswerable string"
PER_QUESTION = "config string, variant string, id string, hit_at_5 boolean, hit_at_20 boolean, rank int"
TITLES = "source_file string, title string"
