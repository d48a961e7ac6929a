"""Spark-native catalogue analytics: listings, lookups, mutations, backfills, metainfo codec."""
