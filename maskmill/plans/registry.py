"""All queries and oracle SQL of the core."""

from __future__ import annotations

from maskmill.plans import curation, dataset, evaluation, images, preparation, runlogs

QUERIES = {**curation.QUERIES, **dataset.QUERIES, **evaluation.QUERIES, **runlogs.QUERIES, **images.QUERIES, **preparation.QUERIES}
SQL = {**curation.SQL, **dataset.SQL, **evaluation.SQL, **runlogs.SQL, **images.SQL, **preparation.SQL}
FLAGSHIP = "headline_scores"
