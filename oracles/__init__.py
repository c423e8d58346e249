"""The registered queries once more, as SQL for another engine.

Written apart from the Spark code: first-match chains instead of one-pass
searches, character folds, plain window functions. Only the derived input tables
and the job parameters are shared.
"""

from oracles.build import ORACLES

__all__ = ["ORACLES"]
