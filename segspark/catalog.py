"""All registered queries with their SQL."""

from __future__ import annotations

import segspark.operators.compensation
import segspark.operators.diarize
import segspark.operators.factors
import segspark.operators.frames
import segspark.operators.scores
import segspark.operators.segments
import segspark.operators.sequences
import segspark.operators.training
import segspark.operators.vectors
import segspark.operators.warping
import segspark.sources.formats
import segspark.streaming.online  # noqa: F401
from segspark.registry import COVERS, ORACLE_SQL, QUERIES

FLAGSHIP = "score_tnorm"
__all__ = ["COVERS", "FLAGSHIP", "ORACLE_SQL", "QUERIES"]
