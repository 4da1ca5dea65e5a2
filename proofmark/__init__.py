"""Evidence-backed table analytics as Spark jobs."""

import sys

from pyspark import cloudpickle

# The few Python helpers used inside tasks travel with the task itself, so executors
# need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from proofmark.operators.profile import profile  # noqa: E402
from proofmark.operators.selection import exact_numbers  # noqa: E402
from proofmark.operators.sql_guard import guarded_sql  # noqa: E402
from proofmark.operators.statistics import (  # noqa: E402
    chi_square,
    compare_groups,
    correlation,
    run_statistics,
)
from proofmark.operators.trace import assemble_trace  # noqa: E402
from proofmark.plans.answer import answer_question  # noqa: E402

__all__ = [
    "answer_question",
    "assemble_trace",
    "chi_square",
    "compare_groups",
    "correlation",
    "exact_numbers",
    "guarded_sql",
    "profile",
    "run_statistics",
]
