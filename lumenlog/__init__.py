"""Spark-native forensic log analytics: scans, parsers, classifiers, detectors and reports as DataFrame jobs."""
