"""Training-data operators: tokenising, archiving, filtering and de-duplicating text at scale."""
