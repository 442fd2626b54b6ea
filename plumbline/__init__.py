"""plumbline: a Spark-native engine for analysing judged generations and their corpora."""
