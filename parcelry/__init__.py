"""Market-listing analytics as Spark jobs: normalising, duplicate marking, name resolution, four independent scores, exports."""
