from continuity.sinks.ledger import append_once, append_stream_once, batch_ledger
from continuity.sinks.tables import append

__all__ = ["append", "append_once", "append_stream_once", "batch_ledger"]
