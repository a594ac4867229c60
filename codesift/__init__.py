"""codesift: code findings on Spark.

Scan text tables for security, quality, DevOps and scalability findings and
hardcoded secrets; adjust severity from context; join explanations and
remediation guides; order and apply fixes; roll up into counts, gates and
reports. See README.md.
"""

from .operators.scan import scan  # noqa: F401
from .rules import ALL_RULES, RULES_BY_ID  # noqa: F401

__version__ = "0.1.0"
