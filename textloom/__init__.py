"""textloom: Spark-native preparation and analysis of document corpora."""
