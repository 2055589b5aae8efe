"""almagest: geo-temporal event analytics as Spark DataFrame jobs."""

from almagest.session import build_session, shared_dir

__all__ = ["build_session", "shared_dir"]
