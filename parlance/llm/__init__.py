"""Training-data operators: scoring, archives, joins, formatting, media, tokens, dedup, packing, URL rules."""
