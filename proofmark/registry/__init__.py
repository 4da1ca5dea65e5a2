"""All runnable queries; importing this package registers them."""

from proofmark.registry import (  # noqa: F401
    analyses,
    audits,
    evaluations,
    hypotheses,
    profiles,
    questions,
    sources,
)
from proofmark.registry.base import ORACLES, QUERIES  # noqa: F401
