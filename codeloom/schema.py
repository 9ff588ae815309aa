"""Tables of the code graph. Strings are never null: what is absent is ''."""

from __future__ import annotations



SYMBOL_KINDS = ("class", "interface", "trait", "enum", "enum_case", "method", "function", "property", "constant", "type_alias")
EDGE_KINDS = ("calls", "extends", "implements", "uses_trait", "instantiates", "references_type", "references")
HIERARCHY_KINDS = ("extends", "implements", "uses_trait")
CALL_KINDS = ("calls", "instantiates")
CLASS_KINDS = ("class", "interface", "trait", "enum")



FILES = "file_id BIGINT, path STRING, lang STRING, hash STRING, size BIGINT, mtime_ns BIGINT, vendor BOOLEAN, has_errors BOOLEAN, indexed_at BIGINT"
SYMBOLS = "file_id BIGINT, sym_id STRING, lang STRING, kind STRING, name STRING, fqn STRING, container STRING, start_line INT, start_col INT, end_line INT, end_col INT, signature STRING, doc STRING, words STRING"
IMPORTS = "file_id BIGINT, alias STRING, fqn STRING, kind STRING"
EDGES = "file_id BIGINT, from_fqn STRING, kind STRING, to_fqn STRING, resolved BOOLEAN, line INT"
EXT_EDGES = "source STRING, from_fqn STRING, kind STRING, to_fqn STRING, file STRING, line INT"
META = "key STRING, value STRING"
POSTINGS = "file_id BIGINT, row BIGINT, col STRING, token STRING, pos INT, d INT"
LENGTHS = "file_id BIGINT, rows BIGINT, tokens BIGINT"
TRIGRAMS = "file_id BIGINT, gram STRING"
ANCESTORS = "node STRING, ancestor STRING, depth INT, first STRING, last STRING"
TABLES = {"files": FILES, "symbols": SYMBOLS, "postings": POSTINGS, "lengths": LENGTHS, "trigrams": TRIGRAMS, "imports": IMPORTS, "edges": EDGES, "ext_edges": EXT_EDGES, "ancestors": ANCESTORS, "meta": META}

#: One extracted file.
FILE_INDEX = (
    "path STRING, lang STRING, vendor BOOLEAN, has_errors BOOLEAN, "
    "symbols ARRAY<STRUCT<kind:STRING,name:STRING,fqn:STRING,container:STRING,start_line:INT,start_col:INT,end_line:INT,end_col:INT,signature:STRING,doc:STRING>>, "
    "imports ARRAY<STRUCT<alias:STRING,fqn:STRING,kind:STRING>>, "
    "edges ARRAY<STRUCT<from_fqn:STRING,kind:STRING,to_fqn:STRING,resolved:BOOLEAN,line:INT>>"
)
EDGE_COLUMNS = ("from_fqn", "kind", "to_fqn", "file", "line", "resolved", "source")
SYMBOL_COLUMNS = ("fqn", "kind", "path", "start_line", "end_line", "signature", "doc", "vendor")
