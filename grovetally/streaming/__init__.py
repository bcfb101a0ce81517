"""Aggregation trees over streams."""

from .incremental import Incremental, Kept, fill_stream
from .stateful import Store, fill_store, updates

__all__ = ["Incremental", "Kept", "fill_stream", "Store", "fill_store", "updates"]
