"""Query language, its compiler, the index facade and configuration."""
