"""Event-study and session analytics as plain PySpark DataFrame code."""

from eventide.config import StudyConfig
from eventide.session import build_session

__all__ = ["StudyConfig", "build_session"]
