"""Spark-native option analytics: archive validation, chain metrics, studies, ledgers and streams."""
