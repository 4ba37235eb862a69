"""Training-data operators: URL rules, quality rules, similarity joins, extraction, tokenising, privacy,
decontamination, sharding, substring removal and quality scoring. Nothing else in the package imports this one."""
