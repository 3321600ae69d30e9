"""All registered queries: name to (query, SQL answer or None)."""

from auditloom.plans import (
    content_queries,
    policy_queries,
    request_queries,
    source_queries,
    state_queries,
    stream_queries,
    text_queries,
)

REGISTERED = {
    **request_queries.QUERIES,
    **state_queries.QUERIES,
    **policy_queries.QUERIES,
    **content_queries.QUERIES,
    **text_queries.QUERIES,
    **source_queries.QUERIES,
    **stream_queries.QUERIES,
}
