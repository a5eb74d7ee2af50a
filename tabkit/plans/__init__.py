"""The registered queries and, where SQL can state the result, their oracles."""

from tabkit.plans import amounts, delimited, inventory  # noqa: F401
from tabkit.plans.registry import ORACLES, QUERIES  # noqa: F401
