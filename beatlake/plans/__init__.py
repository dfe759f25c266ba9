"""The registered queries, each with the SQL that says what it must return."""

from beatlake.plans import coach, extra, jobs, match, more, music, performance, plan, profile, rest, sequence  # noqa: F401
from beatlake.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
