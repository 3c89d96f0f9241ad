"""All survey queries and their SQL, by name."""

from tracklake.plans import analytics, list_queries, record_queries, review_queries, survey

QUERIES: dict = {**survey.QUERIES, **analytics.QUERIES, **review_queries.QUERIES, **record_queries.QUERIES, **list_queries.QUERIES}
ORACLE: dict = {**survey.ORACLE, **analytics.ORACLE, **review_queries.ORACLE, **record_queries.ORACLE, **list_queries.ORACLE}
FLAGSHIP = "burst_sessions"
