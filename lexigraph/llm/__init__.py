"""Training-data pipeline operators (quality, language, dedup, mixing,
formatting, packing).  Nothing else in the library imports this package."""
