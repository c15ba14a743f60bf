"""Spark-native analytics over LLM request traffic: classify, scrub, deduplicate, compact, account."""
