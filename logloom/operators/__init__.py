"""DataFrame operators: parse, query/filter, search, paging, dedup, stats,
lifecycle, postings."""
