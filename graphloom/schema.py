"""Schemas of the stored tables, and the kinds of nodes and edges."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, FloatType, LongType, StringType, StructField, StructType

# Node and edge kinds.
NODE_KINDS = ("Function", "Method", "Class", "Interface", "TypeAlias", "Variable", "Constant", "Enum", "Module", "Import", "Section", "Document", "Rationale", "Email", "Conversation", "Person", "Attachment")
EDGE_KINDS = ("CALLS", "CONTAINED_BY", "MEMBER_OF", "STEP_IN_PROCESS", "IMPORTS", "REFERENCES", "RATIONALE_FOR", "REPLY_TO", "SENT_BY", "RECEIVED_BY", "HAS_ATTACHMENT", "PART_OF_CONVERSATION", "MENTIONS")


def _of(*names: str, **kinds: object) -> StructType:
    return StructType([StructField(n, kinds.get(n, StringType())) for n in names])


_long = LongType()
SYMBOLS = _of("uid", "name", "qualified_name", "kind", "file_path", "start_line", "end_line", "signature", "content", "repo_id", "metadata", "vector", start_line=_long, end_line=_long, vector=ArrayType(FloatType(), False))
FILES = _of("uid", "path", "language", "repo_id", "num_symbols", num_symbols=_long)
RELATIONSHIPS = _of("uid", "source_uid", "target_uid", "kind", "repo_id", "metadata")
COMMUNITIES = _of("uid", "label", "repo_id", "member_count", "top_symbols", "summary", member_count=_long, top_symbols=ArrayType(StringType()))
COMMUNITY_MEMBERS = _of("community_uid", "symbol_uid")
PROCESSES = _of("uid", "name", "repo_id", "entry_point", "step_count", "description", step_count=_long)
PROCESS_STEPS = _of("process_uid", "ordinal", "depth", "parent", "symbol_uid", ordinal=_long, depth=_long)
INDEX_META = _of("key", "value")
METADATA = "struct<decorators:array<string>,return_type:string,superclasses:array<string>,type_params:array<string>,visibility:string,git:struct<last_author:string,last_modified:string,commit_count:bigint,age_days:bigint,last_commit_hash:string>>"
TABLES = {"symbols": SYMBOLS, "files": FILES, "relationships": RELATIONSHIPS, "communities": COMMUNITIES, "community_members": COMMUNITY_MEMBERS, "processes": PROCESSES, "process_steps": PROCESS_STEPS}
