"""Table shapes (Spark DDL)."""

RAW_PAGE = """
    search struct<
        result_count: int,
        results: array<struct<
            dc_identifier: array<string>,
            title: string,
            date: array<string>,
            collection_title: array<string>,
            landing_url: string,
            fulltext: variant,
            description: variant>>>
"""

# What a landed record carries into the notices table.
RAW_COLUMNS = ["id", "code", "type", "date", "title", "nzbn", "company_number", "fulltext",
               "landing_url", "source"]

# What annotation adds later.
ANNOTATION_COLUMNS = ["headline", "plain_english", "event_category", "action_taken",
                      "affected_parties", "significance_score", "significance_reason",
                      "enriched_at"]

NOTICES = """
    id string, code string, type string, date date, title string, nzbn string,
    company_number string, fulltext string, landing_url string, source string,
    headline string, plain_english string, event_category string, action_taken string,
    affected_parties array<string>, significance_score int, significance_reason string,
    enriched_at timestamp, embedding array<float>, loaded_at timestamp, tokens array<string>
"""

# One shape for every detailed result.
FULL_COLUMNS = ["id", "date", "type", "headline", "plain_english", "event_category",
                "action_taken", "affected_parties", "significance_score", "significance_reason",
                "title", "fulltext", "landing_url"]

NOTICE_TYPES = "code string, label string, category string, active boolean, tier int, insolvency boolean"

# One search request per row.
REQUESTS = """
    query_id bigint, q string, limit int, event_category string, action_taken string, code string,
    date_from date, date_to date, min_significance int
"""
FILTER_COLUMNS = ["event_category", "action_taken", "code", "date_from", "date_to",
                  "min_significance"]

REQUEST_LOG = """
    ts timestamp, route string, ip_hash string, country string, ua string, referer string,
    request string, response string, status int, ms bigint, error string
"""
