from continuity.functions.audit import audit_columns
from continuity.functions.digest import digest_aggregates, row_hash, same_digest
from continuity.functions.names import qualified_name, quote
from continuity.functions.rules import delay_type, first_match

__all__ = [
    "audit_columns",
    "delay_type",
    "digest_aggregates",
    "first_match",
    "qualified_name",
    "quote",
    "row_hash",
    "same_digest",
]
