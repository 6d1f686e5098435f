"""Explicit schemas of the records that are read and written; nothing is inferred."""

QUESTION = "id string, question string, expected_answer string, expected_section string, expected_phrase string, expected_source array<string>, tags array<string>"
ANSWER = "id string, question string, answer string, contexts array<string>, context_sources array<string>, expected_answer string, tags array<string>, answerable boolean, seconds double"
SCORE = "id string, answerable boolean, empty boolean, refused boolean, faithfulness double, relevancy double"
REGISTRY = "collection string, built_at timestamp, chunk_count long, guides array<string>, embedding_model string, chunk_size int, chunk_overlap int, preprocess_guide boolean, emoji_mode string, enrage_bands boolean, hybrid boolean"
RUN = "run_name string, kind string, params map<string,string>, metrics map<string,double>, tags map<string,string>"
EMBED = "embed struct<title:string,description:string,fields:array<struct<name:string,value:string>>>"
