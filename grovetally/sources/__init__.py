"""Where data come from and results go."""

from .events import EVENT_SCHEMA, read_events
from .jsonio import JsonLog, SharedJsonLog, from_json, load, loads, save, to_json, to_string
from .log_source import TallyLog

__all__ = ["EVENT_SCHEMA", "read_events", "JsonLog", "SharedJsonLog", "from_json", "load", "loads", "save", "to_json", "to_string", "TallyLog"]
