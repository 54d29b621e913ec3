from continuity.sources.delimited import read_batch, read_stream
from continuity.sources.inventory import Inventory, live_inventory, read_inventory
from continuity.sources.tables import read_named, read_path

__all__ = [
    "Inventory",
    "live_inventory",
    "read_batch",
    "read_inventory",
    "read_named",
    "read_path",
    "read_stream",
]
