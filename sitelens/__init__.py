"""sitelens: a Spark-native engine for auditing web-page collections at scale."""
