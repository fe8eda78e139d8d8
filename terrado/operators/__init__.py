"""DataFrame operators: search, matches, analytics, entity resolution, locations, curation."""
