"""Spark-native event discovery, moderation and backfill analytics."""
