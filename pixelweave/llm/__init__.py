"""Operations of a training-data pipeline: near-duplicates, contamination, quality, extraction, mixing, privacy."""
