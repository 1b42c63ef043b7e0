"""larder: set-based perishables supply-chain analytics on Spark.

Every public operator takes a *requests* DataFrame (one row per question,
keyed by ``request_id``) plus the domain tables it reads, and answers all
requests in one Spark job. One request is simply a one-row requests table.
"""

from larder.session import build_session, ensure_checkpoint_dir

__all__ = ["build_session", "ensure_checkpoint_dir"]
