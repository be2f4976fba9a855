"""What this package registers."""

from marketframe.llm.oracles import ORACLES
from marketframe.llm.queries import QUERIES

__all__ = ["ORACLES", "QUERIES"]
