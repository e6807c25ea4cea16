"""Structured Streaming: the hotspot alert stream."""

from .alerts import (ALERT_SCHEMA, DEFAULT_COLUMNS, incident_file_stream, prepare_incidents, alert_counts,
                     alert_sink, start_alerts, alert_history, grid_parameters)
from .progress import PollLog, last_poll, polls

__all__ = ["ALERT_SCHEMA", "incident_file_stream", "prepare_incidents", "alert_counts", "alert_sink",
           "start_alerts", "alert_history", "grid_parameters", "PollLog",
           "last_poll", "polls"]
