"""Training-data operators: scans, joins, models and codecs over the text tables."""
