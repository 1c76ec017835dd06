from sparkpoison.streaming.detect import (
    dedup_ingest, stream_auto_alert, stream_auto_scan, stream_baselines, stream_collusion, stream_ingest,
    stream_sessions, stream_trend, stream_velocity,
)

__all__ = [
    "dedup_ingest", "stream_auto_alert", "stream_auto_scan", "stream_baselines", "stream_collusion",
    "stream_ingest", "stream_sessions", "stream_trend", "stream_velocity",
]
