"""A training corpus from ``documents``: each stage works on all that its predecessor kept.

Stages: toxic documents go; one document of each near-duplicate group stays; personal data are masked;
sources are mixed to their target weights; texts are encoded by byte-level BPE.
"""

from strataframe.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
