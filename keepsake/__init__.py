"""keepsake: snapshot catalog analytics and dataset snapshots on Spark."""

from keepsake.session import build_session, configure

__all__ = ["build_session", "configure"]
