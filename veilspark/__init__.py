"""Spark-native engine for finding, reviewing, tokenizing and redacting personal data in text corpora."""
