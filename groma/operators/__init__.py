"""DataFrame operators: joins, series, episodes, paging, statistics, curation."""
