"""The corpus pipeline: five stages from raw documents to packed sequences, each reading what the one before wrote."""

from xpanel.llm.stages import ORACLE_SQL, STAGES, run  # noqa: F401
