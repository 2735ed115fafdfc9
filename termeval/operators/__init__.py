"""DataFrame operators over a vocabulary: lookups, search, vector top-k."""
