"""Model backends: over HTTP, from recorded replies, or offline."""

from .base import Answer, Backend, ReplayBackend, answer_all, request_hash
from .http import HttpBackend
from .offline import OfflineBackend

__all__ = ["Answer", "Backend", "HttpBackend", "OfflineBackend", "ReplayBackend", "answer_all", "request_hash"]
