from continuity.streaming.ingest import append_stream

__all__ = ["append_stream"]
