"""Nothing streams: indexes are built in batch and read afterwards, and every build runs all steps again."""
