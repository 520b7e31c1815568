"""Spark-native analytics over conversational and narrative data: retrieval, fact lifecycle, rules, platform queries."""
