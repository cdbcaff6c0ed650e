"""Schemas of the engine's tables."""

SOURCE_FILE = "file_id bigint, path string, content binary, content_hash bigint, size bigint, lang string"
UNIT_META = "unit_id bigint, project_name string, project_root string, package_name string, package_root string, module_name string, module_root string, file_name string, file_path string, package_index bigint"
SCOPE = "scope_id bigint, owner_node_id bigint, symbol_id bigint"
SCOPE_PARENT = "scope_id bigint, parent_id bigint, ordinal bigint"
SCOPE_SYMBOL = "scope_id bigint, name string, symbol_id bigint, ordinal bigint"
SYMBOL = "symbol_id bigint, name string, kind string, unit_id bigint, package_index bigint, owner_node_id bigint, owned_scope_id bigint, type_of bigint, block_id bigint, is_global boolean, field_of bigint, nested_types array<bigint>, decorators array<bigint>"
BLOCK = "block_id bigint, unit_id bigint, kind string, name string, parent_id bigint, ordinal bigint, symbol_id bigint, symbol_kind string, type_ref bigint, type_name string, start_line bigint, type_deps array<bigint>, func_deps array<bigint>, nested_types array<bigint>, decorators array<bigint>"
RELATION = "src bigint, relation string, dst bigint"
NODE = "block_id bigint, name string, unit_id bigint, source_line bigint, symbol_kind string"
EDGE = "from_id bigint, to_id bigint, kind string"
RANK = "block_id bigint, influence double, orchestration double, score double, rank bigint"
