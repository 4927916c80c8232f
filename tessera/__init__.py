"""Tessera: Spark-native operators for evidence-backed note collections."""
