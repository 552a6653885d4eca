"""Analysis of code changes at scale, as DataFrame transformations keyed by a changeset id."""
