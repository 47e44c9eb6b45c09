"""All queries over the reference's operators."""

from sparrowmill.plans import built, computed, expressed, flagship, ledgers, ordered, parsing, relational, rewritten, scored, screened, sessions, weighted  # noqa: F401
from sparrowmill.plans.registry import ORACLES, QUERIES

FLAGSHIP = flagship.FLAGSHIP

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
