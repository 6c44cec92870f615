"""The training-data pipeline, whose stages stand in verdex.llm.stages; the two are deleted together.

Without that subpackage, importing this module raises ModuleNotFoundError for `verdex.llm`.
"""

from verdex.llm.stages import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
